"""Ranked search, bin completion and alignment against plain versions, and on odd inputs."""

import hashlib
import math
import os
import re
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from credsieve.llm import alignment, bin_completion, ranked_search
from credsieve.llm.queries import QUERIES

import brute

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "the cat"), (4, "the cat"), (None, "the dog"), (None, "the dog"), (5, "The CAT, ünter cat"),
    (6, "end of <|endoftext|> text </s> <0x41>"), (7, "a  b   c"), (8, "x\r\ny\tz "), (9, "mark ▁ inside"), (10, "日本 語 😀 é"), (11, "the " * 30_000),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs():
    return duckdb.connect().execute(f"select doc_id, coalesce(text, '') from '{SF_DIR}/documents.parquet'").fetchall()


def with_clashes(df):
    """Columns an operator might use for itself."""
    for name in ("digest", "n", "length", "rank", "score", "item", "pair", "part", "copies", "piece", "block"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


# --- ranked search


def plain_ranking(docs, items, top=10):
    cut = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def words(text):
        return cut.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for doc_id, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(words(text)) if c[t]
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def test_ranking_of_odd_rows(spark):
    items = [(1, "the cat"), (1, "the cat"), (1, "dog"), (2, None), (3, "..."), (None, "ünter É the"), (7, "Cat the b c a"), (8, "nowhere"), (9, "the " * 5000)]
    for pass_bytes in (1 << 20, 9000):
        got = ranked_search.rank(
            with_clashes(spark.createDataFrame(ODD, SCHEMA)), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id"),
            pass_bytes=pass_bytes,
        )
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_ranking(ODD, items)


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert ranked_search.rank(docs.limit(0), items).collect() == []
    assert ranked_search.rank(docs, items.limit(0)).collect() == []


def test_ties_rank_by_id_over_tasks(spark):
    docs = [(i, "same words here") for i in range(500, 0, -1)] + [(0, "others")]
    got = ranked_search.rank(spark.createDataFrame(docs, SCHEMA).repartition(7), spark.createDataFrame([(1, "words")], "item_id long, text string"))
    assert sorted((r["rank"], r["doc_id"]) for r in got.collect()) == [(i, i) for i in range(1, 11)]


def test_shared_sets_are_summed_once(monkeypatch):
    rng = np.random.default_rng(2)
    stems = [[f"s{k}w{i}".encode() for i in range(6)] for k in range(5)]
    items = []
    for i in range(60):
        own = [w for k in rng.choice(5, 2, replace=False) for w in stems[k]] + [f"own{i}".encode()]
        items.append((i, list(rng.permutation(np.array(own, object)))))
    block = ranked_search.Block(items)
    apart = sum(len(own) - 1 for _, own in items)
    together = len(block.left) + sum(np.diff([*block.starts, len(block.parts)]) - 1)
    # Each item needs its two stems and its own term; stems are summed once.
    assert together <= 60 * 2 + 5 * 5 and 3 * together < apart
    place = {t: i for i, t in enumerate(block.terms)}
    values = rng.integers(0, 1 << 40, (len(place), 9))
    rows, columns = np.nonzero(np.ones_like(values))
    got = block.scores(rows, columns, values[rows, columns], 9)
    assert got.tolist() == [values[[place[t] for t in own]].sum(axis=0).tolist() for _, own in items]
    # Blocks of few terms give the same ranking.
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 20)
    parts = list(ranked_search._blocks((i, b" ".join(own)) for i, own in items))
    assert len(parts) > 10 and [i for p in parts for i in p.item_ids] == list(range(60))


# --- bin completion


@lru_cache
def least_bins(left, capacity):
    """Fewest sequences for a sorted tuple of lengths, by trying every set with the longest."""
    if not left:
        return 0
    first, rest = left[-1], left[:-1]
    best = len(left)
    for mask in range(1 << len(rest)):
        own = [x for i, x in enumerate(rest) if mask >> i & 1]
        if first + sum(own) <= capacity:
            best = min(best, 1 + least_bins(tuple(x for i, x in enumerate(rest) if not mask >> i & 1), capacity))
    return best


def total(packing):
    return sum(n for _, n in packing)


def lengths_of(packing):
    out = Counter()
    for filling, n in packing:
        for length, copies in filling:
            out[length] += n * copies
    return out


def test_bin_completion_finds_the_fewest():
    rng, improved = np.random.default_rng(4), 0
    for trial in range(150):
        capacity = int(rng.integers(10, 40))
        own = Counter(rng.integers(1, capacity + 1, rng.integers(1, 10)).tolist())
        if trial % 3 == 0:
            # Three full sequences of three pieces each.
            capacity = 100
            splits = np.sort(rng.integers(1, 100, (3, 2)), axis=1)
            own = Counter(x for a, b in splits.tolist() for x in (a, b - a, 100 - b) if x)
        best = least_bins(tuple(sorted(own.elements())), capacity)
        found = bin_completion.complete(own, capacity)
        assert lengths_of(found) == own and all(sum(a * b for a, b in f) <= capacity for f, _ in found)
        assert bin_completion.lower_bound(own, capacity) <= best
        assert total(found) == best, (own, capacity)
        improved += total(bin_completion.best_fit(own, capacity)) > best
    assert improved


def test_bin_completion_beats_best_fit_on_many_copies():
    # Best fit decreasing puts 6 + 4 + ... apart; three fillings without waste exist.
    left = {44: 6000, 24: 6000, 22: 6000, 21: 0, 17: 12000, 10: 6000, 6: 6000}
    capacity = 100
    found = bin_completion.complete(left, capacity)
    assert lengths_of(found) == Counter({k: n for k, n in left.items() if n})
    assert total(found) <= total(bin_completion.best_fit(left, capacity))
    left = {6: 3, 5: 3, 4: 6, 3: 3, 2: 3}
    assert total(bin_completion.complete(left, 12)) == bin_completion.lower_bound(left, 12)


def test_dominated_fillings_are_not_branched_on():
    left = {10: 1, 5: 1, 3: 1, 2: 2}
    # 3 + 2 could give way to the 5; 5 alone is as good as it gets.
    assert [dict(f) for _, f in bin_completion.fillings(left, 15, 15)] == [{10: 1, 5: 1}]
    assert bin_completion.dominated(Counter({10: 1, 3: 1, 2: 1}), left, 0)
    assert not bin_completion.dominated(Counter({10: 1, 5: 1}), left, 0)


def test_best_fit_of_long_histograms_is_best_fit():
    rng = np.random.default_rng(8)
    own = Counter(rng.integers(1, 60, 400).tolist())
    rooms = []
    for x in sorted(own.elements(), reverse=True):
        at = min((r for r in rooms if r >= x), default=None)
        if at is not None:
            rooms.remove(at)
        rooms.append((at or 100) - x)
    packing = bin_completion.best_fit(own, 100)
    assert lengths_of(packing) == own and total(packing) == len(rooms)
    assert sorted(100 - sum(a * b for a, b in f) for f, n in packing for _ in range(n)) == sorted(rooms)


def check_packing(rows, docs, window=2048):
    library = brute.library("word_bpe_49k.json")
    want = Counter()
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), window)):
            own = ids[at : at + window]
            want[doc_id, piece, at, len(own), brute.crc(own)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
    own = Counter(r["length"] for r in rows)
    return len(sequences), bin_completion.lower_bound(own, window)


def test_bin_completion_of_the_table(spark, docs):
    used, bound = check_packing(QUERIES["op12_bin_completion"](spark, SF_DIR).collect(), docs)
    assert used <= bound + 1


def test_bin_completion_of_odd_rows(spark):
    df = with_clashes(spark.createDataFrame(ODD, SCHEMA))
    used, bound = check_packing(bin_completion.pack(df).collect(), ODD)
    assert used == bound
    assert check_packing(bin_completion.pack(df, window=16).collect(), ODD, 16)[0] > 1
    assert bin_completion.pack(df.limit(0)).collect() == []
    ids = bin_completion.pack(df, with_ids=True).select("length", "ids").collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in ids)


# --- alignment


def plain_alignment(docs):
    import sentencepiece

    a_library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_library.encode_special_tokens = True
    b_library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in letters)}
    out, links = [], []
    for doc_id, text in docs:
        row = (0, 0, [], [], "")
        if text:
            a = [(i, bytes(letters[x] for x in a_library.id_to_token(i))) for i in a_library.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in b_library.encode(text):
                p = b_library.id_to_piece(i)
                b.append((i, bytes([int(p[1:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
            full = (" " + text).encode()
            if b"".join(x for _, x in a) == full == b"".join(x for _, x in b):
                ends_a = np.cumsum([len(x) for _, x in a]).tolist()
                ends_b = np.cumsum([len(x) for _, x in b]).tolist()
                both = sorted(set(ends_a) & set(ends_b))
                groups, from_a, from_b, own = [], 0, 0, []
                for end in both:
                    to_a, to_b = ends_a.index(end, from_a) + 1, ends_b.index(end, from_b) + 1
                    groups.append(",".join(str(i) for i, _ in a[from_a:to_a]) + "|" + ",".join(str(i) for i, _ in b[from_b:to_b]))
                    own.append((a[to_a - 1][0], b[to_b - 1][0]))
                    from_a, from_b = to_a, to_b
                row = (len(a), len(b), groups, own, hashlib.sha256(";".join(groups).encode()).hexdigest())
        out.append((doc_id, row))
        links.append(row[3])
    counts = Counter(x for own in links for x in own)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    return sorted(
        ((d, a, b, len(g), len(own), sum(counts[x] == highest[x[1]] for x in own), sum(counts[x] for x in own), h) for d, (a, b, g, own, h) in out), key=str
    )


def measures(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def test_alignment_of_the_table(spark, docs):
    assert measures(QUERIES["op13_alignment"](spark, SF_DIR)) == plain_alignment(docs)


def test_alignment_of_odd_rows(spark):
    df = with_clashes(spark.createDataFrame(ODD * 2, SCHEMA))
    got = measures(alignment.align(df))
    assert got == plain_alignment(ODD * 2)
    assert sum(r[1] == 0 for r in got) == 2 * 3
    assert alignment.align(df.limit(0)).collect() == []


def test_words_are_aligned_as_in_whole_texts():
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    own, rng, by_word = alignment.Aligner(*paths), np.random.default_rng(3), 0
    assert own.by_word
    parts = [
        " ", " ", " ", "\n", "\n", "\t", "\x1c", "\x85", "a", "And", "don't", " 's", "é", "É", "ß", "İ", "12", "3.5", ",", ".", "!?", "<|endoftext|>",
        "</s>", "<0x41>", "日本", "😀", "\r\n", "ﬁ", "the,", "of.", "x" * 50, " ́", "가", "▁", "_", "\x00", "\xa0", "　", "<unk>",
    ]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        got, want = own.entries([text])[0], own.whole(text)
        by_word += not alignment._UNCUT.search(text)
        assert (got and (*got[:4], got[4].tobytes())) == want, repr(text)
    assert by_word > 500


def test_possible_pairs_are_bounded_by_the_vocabularies():
    own = alignment.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    a, b = Counter(own.a.bytes.values()), Counter(own.b.bytes.values())
    pairs = sum(n * b[x[i:]] for x, n in a.items() for i in range(len(x))) + sum(n * a[x[i:]] for x, n in b.items() for i in range(1, len(x)))
    assert pairs < 500_000
