"""Words and n-grams of many texts together are those of each alone, in far fewer calls."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from credsieve.llm import language


def _model():
    rng = np.random.default_rng(0)
    words, grams = ["alpha", "beta", "ñandú"], ["alp", "et", "b", "a", "\x02al", "zz", "pha\x03"]
    table = rng.standard_normal((10, 3)).astype(np.float32)
    return language.Model(["aa", "bb", "cc"], {w: i for i, w in enumerate(words)}, {g: 3 + i for i, g in enumerate(grams)}, table, "m")


def _of_word(model, word):
    if word in model.words:
        return model.table[model.words[word]]
    for order in language.ORDERS:
        rows = [model.grams[g] for g in language.grams_of(word, order) if g in model.grams]
        if rows:
            return model.table[rows].mean(axis=0)
    return np.zeros(3, np.float32)


@pytest.mark.parametrize("kept, cells", [(400_000, 1_000_000), (2, 1_000_000), (2, 1), (0, 5)])
def test_words_are_looked_up_together(monkeypatch, kept, cells):
    monkeypatch.setattr(language, "_KEPT_WORDS", kept)
    monkeypatch.setattr(language, "_PIECE_CELLS", cells)
    model = _model()
    texts = ["alpha beta alphabet", "", "12 !", "ñandú zzz quux alpha", "b" * 300, "beta beta quux albeta", "ккк"] * 2
    # One reading of all texts asks the model once for each distinct word that it keeps.
    for text, (label, score) in zip(texts, language.Scorer(model).predictions(texts)):
        words = language.words_of(text)
        if not words:
            assert (label, score) == ("und", 0.0)
            continue
        mean = np.mean([_of_word(model, w) for w in words], axis=0, dtype=np.float64)
        odds = np.exp(mean - mean.max())
        assert label == model.languages[int(np.argmax(np.round(mean, 6)))] and score == pytest.approx(odds.max() / odds.sum(), rel=1e-5)
    together = language.Scorer(model).which_recognised(texts)
    assert together == [language.Scorer(model).recognised(t) for t in texts] and True in together and False in together


def test_grams_of_many_words():
    words = [("aa", "alpha", 2), ("bb", "alpha", 3), ("aa", "é", 5), ("aa", "ñu", 1), ("aa", "x" * 64, 1), ("bb", "y" * 65, 2), ("bb", "xy" * 500, 7)]
    want = Counter()
    for lang, word, n in words:
        for order in language.ORDERS:
            for gram in language.grams_of(word, order):
                want[lang, gram] += n
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*words)], schema=language._COUNTS)
    got = language._summed(language._grams_of_rows(rows)).to_pylist()
    assert {(r["lang"], r["word"]): r["n"] for r in got} == want and len(got) == len(want)


def test_entries_reach_the_driver_as_arrow(spark):
    rows = [("aa", "w1", 5), ("bb", "w1", 1), ("aa", "w0", 6), ("bb", "é", 9), ("bb", "once", 1)]
    top = language._top(spark.createDataFrame(rows, "lang string, word string, n long"), 2)
    assert isinstance(top, pa.Table)
    assert [(r["lang"], r["word"], r["n"]) for r in top.to_pylist()] == [("bb", "é", 9), ("aa", "w0", 6)]
    assert language._wide(top, ["aa", "bb"])[0] == ["é", "w0"]
