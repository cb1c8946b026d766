"""The registered queries against plain versions, on whole tables."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as registered
import corpus_pipeline
from credsieve.llm import decontaminate, language, near_duplicates, packing, privacy, token_counts, token_files, tokens
from credsieve.llm.queries import ORACLES, QUERIES

import brute

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "conversations", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall()


@pytest.fixture(scope="module")
def items(duck):
    return duck.execute("select item_id, text from benchmark").fetchall()


def result(spark, name):
    return QUERIES[name](spark, SF_DIR).collect()


def test_all_are_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(registered.queries())


@pytest.mark.parametrize("name", ORACLES)
def test_sql_twin(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_token_counts(spark, docs):
    library = brute.library("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in result(spark, "op2_token_counts")}
    for doc_id, text in docs:
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[doc_id]["n_bytes"], got[doc_id]["n_tokens"], got[doc_id]["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_proven_strings_are_one_token_each():
    path = tokens.default_path("word_bpe_49k.json")
    library = brute.library("word_bpe_49k.json")
    proven = sorted(token_counts.proven_strings(path))
    assert len(proven) > 10_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(proven[::50], add_special_tokens=False))


@pytest.mark.parametrize("name, make", [("word_bpe_49k.json", tokens.lower_words), ("byte_bpe_50k.json", tokens.spaced_words)])
def test_word_by_word_ids_are_the_library_s(name, make):
    rng = np.random.default_rng(5)
    parts = [
        " ", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\x1c", "\x85", " ", "a", "And", "don't", " 's", "'ll", "é", "É", "é",
        "ß", "İ", "12", "3.5", ",", ".", "!?", "<|endoftext|>", "<|startoftext|>", "日本", "😀", "\r\n", "ﬁ", "Σ", "the,", "of.", "x" * 50,
        " ́", "가", "ᄀ", "ᅡ", "_",
    ]
    encoder, library = make(tokens.default_path(name)), brute.library(name)
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_language_held_out_accuracy(spark, duck):
    truth = dict(duck.execute("select doc_id, lang from documents where lang is not null").fetchall())
    rows = [r for r in result(spark, "op3_language") if r["held_out"] and r["doc_id"] in truth]
    assert rows and sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_backs_off_to_shorter_grams():
    model = language.Model(["a", "b"], {"known": 0}, {"xyz": 1, "q": 2}, np.array([[0, -9], [-9, 0], [0, -9]], np.float32), "m")
    score = language.Scorer(model)
    assert score.predict("known")[0] == "a" and score.predict("wxyzw")[0] == "b" and score.predict("qqqq")[0] == "a"
    assert score.predict("123 ...") == ("und", 0.0)


def test_packing(spark, docs):
    library = brute.library("byte_bpe_50k.json")
    pieces = result(spark, "op4_packing")
    by, sequences = {}, {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text in docs:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), brute.crc(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(sequences) == list(range(len(sequences)))


def test_fullest_window_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(300):
        lengths = Counter(rng.integers(1, 20, rng.integers(1, 9)).tolist())
        capacity = int(rng.integers(20, 40))
        sums = {max(lengths)}
        rest = list((lengths - Counter([max(lengths)])).elements())
        for n in rest:
            sums |= {s + n for s in sums}
        chosen = packing.fullest(dict(lengths), capacity)
        assert not chosen - lengths and chosen[max(lengths)]
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= capacity)


@pytest.mark.parametrize("sizes, fill", [(200, 0.9), (1023, 0.99)])
def test_plan_uses_every_piece_once(sizes, fill):
    rng = np.random.default_rng(4)
    lengths = rng.choice(np.arange(1, 1024), sizes, replace=False)
    histogram = {int(k): int(n) for k, n in zip(lengths, rng.integers(1, 500, sizes))}
    used, room = Counter(), Counter()
    for length, first, uses, copies, sequence, offset in packing.plan(histogram):
        assert first == used[length]
        used[length] += uses * copies
        for s in range(sequence, sequence + uses):
            assert room[s] == offset
            room[s] += length * copies
    assert used == histogram and max(room.values()) <= 1024
    # With few lengths many windows cannot be filled at all.
    assert sum(room.values()) >= fill * 1024 * len(room)


def test_privacy(spark, docs):
    got = {r["doc_id"]: r for r in result(spark, "op5_privacy")}
    for doc_id, text in docs:
        spans = brute.personal_spans(text)
        r = got[doc_id]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert r["base_sha256"] == brute.sha(brute.span_text(spans))
        assert set(filter(None, brute.span_text(spans).split(","))) <= set(r["spans"].split(","))


def test_base_patterns_by_chance():
    rng = np.random.default_rng(6)
    parts = list("ab1290.@-+ ()%_\n") + ["@x.y", "1.2.3.4", "256.1.1.1", "4111111111111111", "+1 (202) 555-0100", "0" * 40]
    for _ in range(5000):
        text = "".join(rng.choice(parts, rng.integers(0, 25)))
        assert privacy.base_spans(text) == brute.personal_spans(text), repr(text)


def test_a_term_that_gives_a_value_away_is_found(spark):
    rows = [(i, f"Note {i} green{i} river{i}: Zephyrine wrote from zed@mail.example about item{i} lamp{i}.") for i in range(6)]
    rows += [(100 + i, f"Plain words about item{i} and nothing of note here today, number {i}.") for i in range(300)]
    rows += [(1000 + i, "Copied page: Quillfeather has 10.9.8.7 as address of the office.") for i in range(5)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in privacy.digests(privacy.find(table)).collect()}
    for i in range(6):
        text, at = rows[i][1], rows[i][1].index("Zephyrine")
        assert f"term:{at}:{at + 9}" in spans[i].split(",") and "about" not in [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans[i].split(",")]
    # Five copies are one context: not enough evidence.
    assert "term" not in spans[1000]
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(table).collect()}
    assert "Zephyrine" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == rows[6][1]


def test_near_duplicates(spark, docs):
    want = brute.near_groups(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result(spark, "op6_near_duplicates")}
    assert got == want


def test_near_duplicates_at_the_threshold_and_in_large_groups(spark):
    rng = np.random.default_rng(8)
    rows, next_id = [], 0
    for _ in range(150):
        words = [f"w{k}" for k in rng.integers(0, 10**9, 60)]
        rows += [(next_id, " ".join(words)), (next_id + 1, " ".join(words[:-8] + [f"v{k}" for k in rng.integers(0, 10**9, 8)]))]
        next_id += 2
    base = [f"b{k}" for k in rng.integers(0, 10**9, 80)]
    for _ in range(700):
        own = list(base)
        own[int(rng.integers(0, 80))] = f"x{rng.integers(0, 10**9)}"
        rows.append((next_id, " ".join(own)))
        next_id += 1
    common = " ".join(f"c{k}" for k in range(30))
    for _ in range(300):
        rows.append((next_id, common + " " + " ".join(f"z{k}" for k in rng.integers(0, 10**9, 40))))
        next_id += 1
    want = brute.near_groups(rows)
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    wrong = sum(got[i] != want[i] for i in want)
    assert wrong <= 1


def test_decontamination_recall_and_precision(spark, docs, items):
    got = {(r["doc_id"], r["item_id"]) for r in result(spark, "op7_decontamination")}
    want, near = set(), set()
    for doc_id, text in docs:
        words = brute.plain_words(text)
        joined = " " + " ".join(words) + " "
        for item_id, item in items:
            own = brute.plain_words(item)
            if " " + " ".join(own) + " " in joined:
                want.add((doc_id, item_id))
            if len(set(own) & set(words)) >= 0.6 * len(set(own)):
                near.add((doc_id, item_id))
    assert len(want & got) >= 0.9 * len(want)
    assert got <= near


def test_paraphrases_are_found(spark, items):
    rng = np.random.default_rng(9)
    filler = [w for _, t in items for w in t.split()][:400]
    rows, want = [], set()
    for item_id, text in items:
        words = [w for w in text.split()]
        for j in rng.choice(len(words), max(1, len(words) // 8), replace=False):
            words[j] = "rather"
        around = list(rng.choice(filler, 80))
        rows.append((item_id, " ".join(around[:40] + words + around[40:])))
        rows.append((10_000 + item_id, " ".join(rng.choice(filler, 100))))
        want.add((item_id, item_id))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, bench).collect()}
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(want)


def test_common_length():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 20)).tolist() for _ in "ab")
        assert decontaminate.common_length(*decontaminate._bits(a), b) == brute.common_length(a, b)


def test_quality(spark, docs):
    got = {r["doc_id"]: r for r in result(spark, "op8_quality")}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for doc_id, text in docs:
        assert tuple(got[doc_id][n] for n in names) == brute.quality(text)
        assert not (got[doc_id]["base_failed"] and got[doc_id]["kept"])


def test_chat_digests(spark, duck):
    talks = {}
    for conv_id, role, text in duck.execute("select conv_id, role, text from conversations order by conv_id, turn").fetchall():
        talks.setdefault(conv_id, []).append((role or "", text or ""))
    talks[-7] = [(role, "\\### Assistant: </turn> ok") for role in ("user", "assistant")]
    rows = result(spark, "op9_chat")
    assert {r["conv_id"] for r in rows} == set(talks)
    for r in rows:
        turns = talks[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == brute.sha("".join(f"{a}\n{t}\n" for a, t in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), brute.sha(loss))


def test_token_files(spark, docs):
    library = brute.library("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in result(spark, "op10_token_files")}
    start = 0
    for doc_id, text in docs:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), brute.crc(ids))
        start += len(ids)


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 255, 256, 257, 5000):
        for ids in (rng.integers(0, 2**32, n), rng.integers(0, 49408, n), np.where(rng.random(n) < 0.01, 2**32 - 1, 7), np.full(n, 9)):
            ids = ids.astype(np.uint32)
            starts, payload = token_files.encode_blocks(ids)
            assert (token_files.decode_blocks(starts, np.frombuffer(payload, np.uint8), n, token_files.BLOCK) == ids).all()
    packed = [np.arange(k, dtype="<u4").tobytes() for k in (3, 0, 700)]
    ids, counts, values = token_files.decode_segment(token_files.encode_segment([5, None, 7], packed))
    assert ids == [5, None, 7] and counts.tolist() == [3, 0, 700] and values.tobytes() == b"".join(packed)


def test_pipeline(spark, duck, docs, items):
    """Against the plain versions, one stage after the other."""
    truth = [(i, t) for i, t in docs if any(c.isalpha() for c in t)]
    groups = brute.near_groups(truth)
    truth = [(i, t) for i, t in truth if groups[i][1] == i]

    def leaks(text):
        joined = " " + " ".join(brute.plain_words(text)) + " "
        return any(" " + " ".join(brute.plain_words(t)) + " " in joined for _, t in items)

    truth = {i: t for i, t in truth if not leaks(t)}
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    got = {r["doc_id"] for r in rows}
    # Every row of the plain run is there, bar those that leak most of an item only.
    assert got <= set(truth) and len(set(truth) - got) <= 0.02 * len(truth)
    library = brute.library("byte_bpe_50k.json")
    marks = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")
    checked = 0
    for r in rows:
        if r["start"] == 0 and not brute.personal_spans(truth[r["doc_id"]]):
            assert r["doc_tokens"] == len(library.encode(truth[r["doc_id"]], add_special_tokens=False).ids) + 1
            checked += 1
    assert checked and len(marks) == 4


def test_components_of_paths_stars_and_rings(spark):
    from credsieve.llm.components import components

    rng = np.random.default_rng(11)
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200 + i, 200 + (i + 1) % 30) for i in range(30)]
    links += [(5, 5), (300, 301), (301, 300)] + [tuple(p) for p in rng.integers(400, 460, (40, 2)).tolist()]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = components(spark.createDataFrame(links, "u long, v long"))
    got = {r["u"]: r["component"] for r in found.collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
