"""Language identification, words first.

Learned are, per language, the frequencies of whole words and of character n-grams of
five to one letters with word ends marked.  A word of a text that is known counts with
its own log frequency per language; one that is not falls back to its longest n-grams
that are known, five letters, then four, down to one.  The language whose mean over all
words is highest wins; equal means go to the first in alphabetical order.

Fitting counts the words of every labelled row, in one distributed reading.  Where
``sample_rows`` is given it uses so many instead, shared evenly by the labels, but at least
``label_rows`` a label in the mean, all of a label that has fewer and never none, chosen by
a hash of id and text.  It keeps the ``words`` and ``grams`` most frequent
entries, fewer if there are more labels than the table has room for (``CELLS``); these
bound the model, which is all that reaches the driver.  An entry that a label lacks has
the same small share in every label, however few rows the label has; labels of which no
entry is kept are left out.  More than ``MOST_LABELS`` labels are an error.  Prediction
covers every row and every word of its text.

A row's language is recognised (``accepted``) if its label leads the runner-up by
``least_lead`` a word in the mean, or if ``least_known`` of its words are known as wholes
and at least as frequent in that label as in the mean of all.  Neither falls because
there are more labels; the second holds where two labels name one language.

Null text and text without a letter give ``und`` with score 0; so does every text if no
row has a label.  Rows with a null id are never learned from.  Rows with equal ids are
predicted one by one; other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain, groupby
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import batch, held_once, let_go, row_slices, slices, texts_of
from credsieve.session import settled

LABEL_ROWS = 400
WORDS = 50_000
GRAMS = 100_000
#: Entries times labels of a model, and labels beyond which the column holds something else.
CELLS = 40_000_000
MOST_LABELS = 20_000
LEAST_LEAD = 0.2
LEAST_KNOWN = 0.5
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"

_SMOOTHING = 0.5
_SLOTS = 1 << 20
_FLUSH = 200_000
_KEPT_WORDS = 400_000
_KEPT_CELLS = 16_000_000
#: Words times labels that are looked up at once.
_PIECE_CELLS = 200_000
#: Words whose n-grams are cut at once.
_GRAM_ROWS = 2_500
#: Letters of a word beyond which its n-grams are cut one by one.
_LONG_WORD = 64
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_ASCII_WORD = re.compile("[a-z]+")


def _ranges(kind: str) -> str:
    """The characters of a kind below U+10000 as ranges of a character class."""
    held = regex.compile(kind).findall("".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000)))))
    runs = [list(g) for _, g in groupby(enumerate(map(ord, held)), lambda x: x[1] - x[0])]
    return "".join(f"\\u{r[0][1]:04x}-\\u{r[-1][1]:04x}" for r in runs)


@cache
def _plane_word() -> re.Pattern:
    """``_WORD`` for texts without characters beyond U+FFFF, which ``re`` looks up in a table."""
    letters = _ranges(r"\p{L}")
    return re.compile(f"[{letters}][{letters}{_ranges(r'\p{M}')}]*")


def words_of(text: str) -> list[str]:
    lowered = text.lower()
    if lowered.isascii():
        return _ASCII_WORD.findall(lowered)
    if len(lowered.encode("utf-16-le", "surrogatepass")) == 2 * len(lowered):
        return _plane_word().findall(lowered)
    return _WORD.findall(lowered)


def grams_of(word: str, order: int) -> list[str]:
    marked = f"\x02{word}\x03" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def held_out(doc_id: Column) -> Column:
    """A fifth of the rows, by id; rows without one are in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass
class Model:
    """Log posteriors per language, given a word or an n-gram, under equal priors."""

    languages: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    name: str = ""

    def _rows(self, word: str) -> list[int]:
        """The rows that stand for a word: its own, or those of its longest n-grams that are known."""
        row = self.words.get(word)
        if row is not None:
            return [row]
        get = self.grams.get
        for order in ORDERS:
            rows = [r for r in map(get, grams_of(word, order)) if r is not None]
            if rows:
                return rows
        return []

    def of_words(self, words: list[str]) -> np.ndarray:
        """A row for each word, the mean of those that stand for it; zeros if none does."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        rows = [self._rows(w) for w in words]
        n = np.array([len(r) for r in rows], np.int64)
        held = np.flatnonzero(n)
        if len(held):
            flat = np.fromiter(chain.from_iterable(rows), np.int64, n.sum())
            # Looked up a piece at a time, so that a table of many labels isn't copied many times over.
            ends = np.cumsum(n)
            piece = (ends - 1) * len(self.languages) // _PIECE_CELLS
            for own in np.split(held, np.flatnonzero(np.diff(piece[held])) + 1):
                first = ends[own] - n[own]
                sums = np.add.reduceat(self.table[flat[first[0] : ends[own[-1]]]], first - first[0], axis=0)
                out[own] = sums / n[own, None].astype(np.float32)
        return out


class Scorer:
    """A model with the words met so far as rows of one growing table."""

    def __init__(self, model: Model):
        self.model = model
        self.most = min(_KEPT_WORDS, _KEPT_CELLS // max(1, len(model.languages)))
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)), np.float32)
        self.whole = np.zeros(1024, bool)

    def _add(self, words: list[str]) -> range:
        """Rows of new words, after those of the words that are kept."""
        n = len(self.rows)
        while n + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.whole = np.concatenate([self.whole, np.zeros_like(self.whole)])
        self.table[n : n + len(words)] = self.model.of_words(words)
        self.whole[n : n + len(words)] = [w in self.model.words for w in words]
        return range(n, n + len(words))

    def _looked_up(self, words: list[str]) -> np.ndarray:
        """The rows of words, which stay until others are looked up."""
        found = list(map(self.rows.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, row in zip(words, found) if row is None))
            own = dict(zip(new, self._add(new)))
            # Those that there is no room for go with these words alone.
            self.rows.update(zip(new[: max(0, self.most - len(self.rows))], own.values()))
            found = [own[w] if row is None else row for w, row in zip(words, found)]
        return np.array(found, np.int64)

    def _means(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, mean over its words, their rows) of texts with a word."""
        if not self.model.languages:
            return
        words: list[list[str]] = []
        held, first = 0, 0
        for i, text in enumerate(texts):
            words.append(words_of(text))
            held += len(words[-1])
            if i + 1 == len(texts) or held * len(self.model.languages) > _PIECE_CELLS:
                rows = self._looked_up(list(chain.from_iterable(words)))
                at = 0
                for k, own in enumerate(words):
                    if own:
                        found = rows[at : at + len(own)]
                        yield first + k, self.table[found].sum(axis=0, dtype=np.float64) / len(own), found
                        at += len(own)
                words, held, first = [], 0, i + 1

    def predictions(self, texts: list[str]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        for i, mean, _ in self._means(texts):
            best = int(np.argmax(np.round(mean, 9)))
            odds = np.exp(mean - mean.max())
            out[i] = self.model.languages[best], float(odds[best] / odds.sum())
        return out

    def predict(self, text: str) -> tuple[str, float]:
        return self.predictions([text])[0]

    def which_recognised(self, texts: list[str], least_lead: float = LEAST_LEAD, least_known: float = LEAST_KNOWN) -> list[bool]:
        out = [False] * len(texts)
        for i, mean, found in self._means(texts):
            best = int(np.argmax(np.round(mean, 9)))
            if len(mean) == 1 or mean[best] - np.delete(mean, best).max() >= least_lead:
                out[i] = True
                continue
            even = -np.log(len(mean)) - 1e-4
            known = np.count_nonzero(self.whole[found] & (self.table[found, best] >= even))
            out[i] = bool(known >= least_known * len(found))
        return out

    def recognised(self, text: str, least_lead: float = LEAST_LEAD, least_known: float = LEAST_KNOWN) -> bool:
        return self.which_recognised([text], least_lead, least_known)[0]


def _scorer(model: Model) -> Scorer:
    """One per Python worker and model."""
    return held_once(("language", model.name), lambda: Scorer(model))


_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _counts(rows: DataFrame) -> DataFrame:
    """(``lang``, ``word``, ``n``) of labelled texts."""

    def work(batches):
        let_go()
        held: dict[str, Counter] = defaultdict(Counter)
        for part, texts in row_slices(batches):
            for lang, text in zip(part.column("lang").to_pylist(), texts):
                held[lang].update(words_of(text))
            if sum(map(len, held.values())) > _FLUSH:
                yield from (batch(_COUNTS, [lang] * len(own), list(own), list(own.values())) for lang, own in held.items())
                held.clear()
        yield from (batch(_COUNTS, [lang] * len(own), list(own), list(own.values())) for lang, own in held.items())

    return rows.mapInArrow(work, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _summed(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")])
    return pa.table([sums["lang"], sums["word"], sums["n_sum"]], schema=_COUNTS)


def _grams_of_rows(rows: pa.RecordBatch) -> list[pa.Table]:
    """The n-grams of all words with the words' counts, a table for each order and place in the word."""
    out = []
    lengths = pc.utf8_length(rows.column("word"))
    long = rows.filter(pc.greater(lengths, _LONG_WORD))
    held: Counter = Counter()
    for lang, word, n in zip(*(long.column(c).to_pylist() for c in ("lang", "word", "n"))):
        for order in ORDERS:
            for gram in grams_of(word, order):
                held[lang, gram] += n
    if held:
        out.append(pa.table([[k[0] for k in held], [k[1] for k in held], list(held.values())], schema=_COUNTS))
    own = rows.filter(pc.less_equal(lengths, _LONG_WORD))
    for order in ORDERS:
        words = own.column("word")
        if order > 1:
            words = pc.binary_join_element_wise("\x02", words, "\x03", "")
        left, length = pa.table([own.column("lang"), words, own.column("n")], schema=_COUNTS), pc.utf8_length(words)
        for at in range(_LONG_WORD + 3 - order):
            there = pc.greater_equal(length, at + order)
            left, length = left.filter(there), length.filter(there)
            if not left.num_rows:
                break
            out.append(left.set_column(1, "word", pc.utf8_slice_codeunits(left["word"], at, at + order)))
    return out


def _gram_counts(counts: DataFrame) -> DataFrame:

    def work(batches):
        let_go()
        held: list[pa.Table] = []
        for rows in batches:
            for start in range(0, rows.num_rows, _GRAM_ROWS):
                held.append(_summed(_grams_of_rows(rows.slice(start, _GRAM_ROWS))))
                if sum(t.num_rows for t in held) > 2 * _FLUSH:
                    held = [_summed(held)]
                    if held[0].num_rows > _FLUSH:
                        yield from held.pop().to_batches()
        if held:
            yield from _summed(held).to_batches()

    return counts.mapInArrow(work, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame, most: int) -> pa.Table:
    """(``lang``, ``word``, ``n``, ``total``) of the most frequent entries that occur twice, these in order."""
    totals = counts.groupBy("word").agg(F.sum("n").alias("total")).where("total > 1")
    best = totals.orderBy(F.desc("total"), "word").limit(most)
    # As Arrow: as rows, each value would be a Python object in the driver.
    rows = counts.join(F.broadcast(best), "word").select("lang", "word", "n", "total").toArrow()
    return rows.sort_by([("total", "descending"), ("word", "ascending"), ("lang", "ascending")])


def _wide(rows: pa.Table, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """The entries and their count per language."""
    if not rows.num_rows:
        return [], np.zeros((0, len(languages)))
    entries = rows["word"].combine_chunks().dictionary_encode()
    column = pc.index_in(rows["lang"].combine_chunks(), pa.array(languages))
    out = np.zeros((len(entries.dictionary), len(languages)))
    out[entries.indices.to_numpy(), column.to_numpy()] = rows["n"].to_numpy()
    return entries.dictionary.to_pylist(), out


def fit(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
    sample_rows: int | None = None, label_rows: int = LABEL_ROWS, words: int = WORDS, grams: int = GRAMS,
) -> Model:
    """Learn from rows that are not held out and have a label and a letter in their text."""
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    ).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_SLOTS))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(slot).alias("least")).limit(MOST_LABELS + 1).collect()
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {lang}")
    if not found:
        return Model([])
    chosen = rows.select("lang", "text")
    if sample_rows is not None:
        each = max(label_rows, sample_rows / len(found))
        # At least the row of the least hash, so that no label is without one.
        slots = [(r["lang"], max(r["least"] + 1, int(np.ceil(_SLOTS * min(1.0, each / r["n"]))))) for r in found]
        share = docs.sparkSession.createDataFrame(slots, "lang string, slots long")
        chosen = rows.join(F.broadcast(share), "lang").where(slot < F.col("slots")).select("lang", "text")
    counts = settled(_counts(chosen))
    room = min(1.0, CELLS / len(found) / (words + grams))
    word_rows = _top(counts, int(words * room))
    gram_rows = _top(settled(_gram_counts(counts)), int(grams * room))
    languages = sorted({*word_rows["lang"].unique().to_pylist(), *gram_rows["lang"].unique().to_pylist()})
    if not languages:
        return Model([])
    known, word_counts = _wide(word_rows, languages)
    pieces, gram_counts = _wide(gram_rows, languages)
    del word_rows, gram_rows

    def posterior(n: np.ndarray, kind: np.ndarray) -> np.ndarray:
        out = np.zeros_like(n)
        for k in np.unique(kind):
            own = n[kind == k]
            held = own.sum(axis=0)
            share = np.log(own / np.maximum(held, 1) + _SMOOTHING / held.max())
            out[kind == k] = share - np.logaddexp.reduce(share, axis=1, keepdims=True)
        return out

    table = np.concatenate([
        posterior(word_counts, np.zeros(len(known), int)),
        posterior(gram_counts, np.array([len(p) for p in pieces], int)),
    ]).astype(np.float32)
    where = {g: len(known) + i for i, g in enumerate(pieces)}
    return Model(languages, {w: i for i, w in enumerate(known)}, where, table, uuid4().hex)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row; only the text is looked at."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def work(batches):
        scorer = _scorer(model)
        for ids, texts in slices(batches):
            found = scorer.predictions(texts)
            yield batch(schema, ids, [f[0] for f in found], [f[1] for f in found])

    found = texts_of(docs).mapInArrow(work, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model, *, text: str = "text", least_lead: float = LEAST_LEAD, least_known: float = LEAST_KNOWN) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns."""
    at = docs.columns.index(text)

    def work(batches):
        scorer = _scorer(model)
        for rows in batches:
            kept = []
            for _, texts in row_slices([pa.record_batch([rows.column(at)], ["text"])]):
                kept += scorer.which_recognised(texts, least_lead, least_known)
            yield rows.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
