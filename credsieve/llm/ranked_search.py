"""Ranked lexical search of many queries at once, with shared parts computed once.

Items (the queries) are laid out by text, so that items that begin alike share a block.  In
each block the term sets that items share are mined: terms that lie in exactly the same
items are one unit; each item is its units, the common ones first; then, round after round,
neighbours that several items have in common become one new unit.  That makes a graph:
terms at the bottom, each shared set the sum of two others, and items on top as the sum of
what is left to them.

Documents are read once.  What is kept of them is their number of terms and how often each
term of the items occurs.  In batches of documents every block's graph is then evaluated
bottom up: one accumulator for each term and each shared set, a row of 64-bit integers, one
for each document, computed once for all items that use it.  A task keeps each item's best
so far, and those of all tasks are ranked again.

Terms, weights and scores:

    term    maximal run of letters and digits of ASCII and of all characters beyond, A-Z lower-cased
    weight  floor(1000 * ln((2 N + 2) / (2 df + 1)))
    m       10 + (90 n N) div L
    score   sum of weight * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, once each

with N the documents that have a term, L all their terms, n one document's, df the documents
that hold a term and tf its occurrences in one.

``pass_bytes`` bounds the item texts that are worked on in one reading of the documents, and
with them what is sent to executors; more items take more readings.

Null, empty or wordless texts hold no term: such documents are not counted and not found, such
items find nothing.  Whole texts count, of any length.  Equal scores rank by ascending doc_id,
null ids last; rows that repeat an id and a text are documents of their own.  Items that repeat
id and text are one item; an id with several texts has a ranking for each.  Empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.common import SLICE_BYTES, batch, texts_of
from credsieve.session import settled

#: Documents an item is ranked with.
TOP = 10
#: Bytes of item texts that share one reading of the documents.
PASS_BYTES = 32 * 1024 * 1024
#: Distinct terms and items' entries of a block, beyond which the next one begins.
BLOCK_TERMS = 32_768
#: Bytes of a block's accumulators over one batch of documents.
ACCUMULATOR_BYTES = 48 * 1024 * 1024

_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
#: A-Z lower-cased, what is no term blank, bytes beyond ASCII as they are.
_TABLE = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))

_POSTINGS = "doc_id long, n long, terms binary, counts binary"
_POSTING_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_TABLE).split()


class Block:
    """Items with their shared sets: nodes 0 .. n_terms are terms, the others sums of two earlier ones."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        self.item_ids = [item_id for item_id, _ in items]
        place: dict[bytes, int] = {}
        self.left: list[int] = []
        self.right: list[int] = []
        sets = [[place.setdefault(t, len(place)) for t in own] for _, own in items]
        self.terms = list(place)
        self._mine(sets)
        self._level()

    def _sum(self, a: int, b: int) -> int:
        self.left.append(a)
        self.right.append(b)
        return len(self.terms) + len(self.left) - 1

    def _units(self, sets: list[list[int]]) -> list[list[int]]:
        """Each item as units: terms that lie in the same items are summed first, if several items have them."""
        holders: list[list[int]] = [[] for _ in self.terms]
        for i, own in enumerate(sets):
            for t in own:
                holders[t].append(i)
        alike: dict[tuple[int, ...], list[int]] = {}
        for t, held in enumerate(holders):
            alike.setdefault(tuple(held), []).append(t)
        units: list[list[int]] = [[] for _ in sets]
        # Common units first: what many items share then stands side by side.
        for held, own in sorted(alike.items(), key=lambda e: (-len(e[0]), e[1])):
            if len(held) > 1:
                node = own[0]
                for t in own[1:]:
                    node = self._sum(node, t)
                own = [node]
            for i in held:
                units[i].extend(own)
        return units

    def _mine(self, sets: list[list[int]]) -> None:
        units = self._units(sets)
        while True:
            seen = Counter(pair for own in units for pair in set(pairwise(own)))
            shared = {pair: n for pair, n in seen.items() if n > 1}
            if not shared:
                break
            node: dict[tuple[int, int], int] = {}
            for i, own in enumerate(units):
                out, at = [], 0
                while at < len(own):
                    pair = tuple(own[at : at + 2])
                    # A pair gives way to the next one if that is more common.
                    if shared.get(pair, 0) and shared[pair] >= shared.get(tuple(own[at + 1 : at + 3]), 0):
                        if pair not in node:
                            node[pair] = self._sum(*pair)
                        out.append(node[pair])
                        at += 2
                    else:
                        out.append(own[at])
                        at += 1
                units[i] = out
        self.parts = np.array([u for own in units for u in own], np.int64)
        self.starts = np.cumsum([0, *map(len, units)])[:-1].astype(np.int64)

    def _level(self) -> None:
        """Order the sums so that each level needs only what lies before it."""
        n = len(self.terms)
        depth = [0] * (n + len(self.left))
        for k, (a, b) in enumerate(zip(self.left, self.right)):
            depth[n + k] = 1 + max(depth[a], depth[b])
        order = sorted(range(n + len(self.left)), key=lambda k: (depth[k], k))
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        inner = np.array(order[n:], np.int64) - n
        self.left = moved[np.array(self.left, np.int64)[inner]] if len(inner) else np.zeros(0, np.int64)
        self.right = moved[np.array(self.right, np.int64)[inner]] if len(inner) else np.zeros(0, np.int64)
        self.parts = moved[self.parts]
        levels = np.array([depth[k] for k in order])
        cuts = [n, *(n + 1 + np.flatnonzero(np.diff(levels[n:]))).tolist(), len(order)]
        self.levels = list(pairwise(cuts)) if len(order) > n else []
        self.n_nodes = len(order)

    def scores(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Items by documents, from what terms (rows) give documents (columns)."""
        held = np.zeros((self.n_nodes, n), np.int64)
        held[rows, columns] = values
        first = len(self.terms)
        for begin, end in self.levels:
            held[begin:end] = held[self.left[begin - first : end - first]]
            held[begin:end] += held[self.right[begin - first : end - first]]
        return np.add.reduceat(held[self.parts], self.starts, axis=0)


class Best:
    """The highest-scoring documents of each of a block's items so far."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.least = np.ones(n_items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.missing = np.zeros(0, bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, missing: np.ndarray) -> None:
        item, column = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        item = np.concatenate((self.item, item))
        score = np.concatenate((self.score, scores[item[len(self.item) :], column]))
        doc = np.concatenate((self.doc, docs[column]))
        gone = np.concatenate((self.missing, missing[column]))
        order = np.lexsort((doc, gone, -score, item))
        item, score, doc, gone = item[order], score[order], doc[order], gone[order]
        first = np.searchsorted(item, item, "left")
        rank = np.arange(len(item)) - first
        kept = rank < self.top
        full = rank == self.top - 1
        self.least[item[full]] = score[full]
        self.item, self.score, self.doc, self.missing = item[kept], score[kept], doc[kept], gone[kept]


def _blocks(rows: Iterator[tuple[object, bytes]]) -> Iterator[Block]:
    held, seen, entries = [], set(), 0
    for item_id, text in rows:
        own = list(dict.fromkeys(terms(text)))
        if not own:
            continue
        if held and (len(seen.union(own)) > BLOCK_TERMS or entries + len(own) > BLOCK_TERMS):
            yield Block(held)
            held, seen, entries = [], set(), 0
        held.append((item_id, own))
        seen.update(own)
        entries += len(own)
    if held:
        yield Block(held)


def _plans(batches):
    """The blocks of a task's items, as they come."""
    def rows():
        for one in batches:
            yield from zip(one.column("doc_id").to_pylist(), one.column("text").cast(pa.binary()).to_pylist())

    for block in _blocks(rows()):
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])


def _postings(vocabulary: bytes):
    def work(batches):
        place = pickle.loads(vocabulary)
        for rows in batches:
            ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").cast(pa.binary())
            out, held = [], 0
            for doc_id, text in zip(ids, texts):
                words = terms(text.as_py() or b"")
                if not words:
                    continue
                found = [(place[w], n) for w, n in Counter(words).items() if w in place]
                pairs = np.array(found, np.int32).reshape(-1, 2)
                out.append((doc_id, len(words), pairs[:, 0].tobytes(), pairs[:, 1].tobytes()))
                held += 8 * len(pairs)
                if held > SLICE_BYTES:
                    yield batch(_POSTING_SCHEMA, *zip(*out))
                    out, held = [], 0
            if out:
                yield batch(_POSTING_SCHEMA, *zip(*out))

    return work


def _joined(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, all values) of a column of packed arrays."""
    raw = column.to_pylist()
    return np.array([len(x) // np.dtype(kind).itemsize for x in raw], np.int64), np.frombuffer(b"".join(raw), kind)


def _holders(n_terms: int):
    """(term, documents of the task that hold it)."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def work(batches):
        total = np.zeros(n_terms, np.int64)
        for rows in batches:
            total += np.bincount(_joined(rows.column("terms"), np.int32)[1], minlength=n_terms)
        at = np.flatnonzero(total)
        yield batch(schema, at.astype(np.int32), total[at])

    return work


def _ranking(plan, n_docs: int, n_words: int, top: int):
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def work(batches):
        blocks, weights = pickle.loads(plan.value)
        best = [Best(len(block.item_ids), top) for block, _ in blocks]
        lookup = [np.full(len(weights), -1, np.int64) for _ in blocks]
        for own, (_, global_terms) in zip(lookup, blocks):
            own[global_terms] = np.arange(len(global_terms))
        widest = max((block.n_nodes + len(block.parts) for block, _ in blocks), default=1)
        step = max(1, ACCUMULATOR_BYTES // (8 * widest))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                rows = whole.slice(at, step)
                sizes, found = _joined(rows.column("terms"), np.int32)
                tf = _joined(rows.column("counts"), np.int32)[1].astype(np.int64)
                # In whole numbers of any size: long documents in large tables.
                m = np.array([10 + 90 * n * n_docs // n_words for n in rows.column("n").to_pylist()], np.int64)
                doc = np.repeat(np.arange(rows.num_rows), sizes)
                value = weights[found] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                ids = rows.column("doc_id")
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                for (block, _), own, held in zip(blocks, lookup, best):
                    local = own[found]
                    has = local >= 0
                    held.add(block.scores(local[has], doc[has], value[has], rows.num_rows), ids, missing)
        first = 0
        for (block, _), held in zip(blocks, best):
            yield batch(schema, (first + held.item).astype(np.int32), pa.array(held.doc, pa.int64(), mask=held.missing), held.score)
            first += len(block.item_ids)

    return work


def _one_pass(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    spark = docs.sparkSession
    # At most the plans of `pass_bytes` of item texts.
    blocks = [pickle.loads(r["block"]) for r in settled(items.mapInArrow(_plans, "block binary")).collect()]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for block in blocks for t in block.terms))}
    postings = settled(docs.mapInArrow(_postings(pickle.dumps(vocabulary)), _POSTINGS))
    n_docs, n_words = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    held = postings.select("terms").mapInArrow(_holders(len(vocabulary)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in held.collect():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    plan = spark.sparkContext.broadcast(
        pickle.dumps(([(block, np.array([vocabulary[t] for t in block.terms], np.int64)) for block in blocks], weights))
    )
    found = postings.mapInArrow(_ranking(plan, n_docs, n_words, top), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ids = [i for block in blocks for i in block.item_ids]
    named = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    return settled(ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))


def rank(
    docs: DataFrame, items: DataFrame, *, top: int = TOP, key: str = "item_id", pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """Each item's ``top`` documents: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``."""
    wanted = settled(texts_of(items, key).where("text is not null").distinct())
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = size // pass_bytes + 1
    laid = settled(wanted.repartitionByRange(passes, "text", "doc_id").withColumn("pass", F.spark_partition_id())) if passes > 1 else None
    out = None
    for at in range(passes):
        own = wanted if laid is None else laid.where(F.col("pass") == at).drop("pass")
        # Items in the order of their texts, so that those that begin alike meet in one block.
        found = _one_pass(texts_of(docs), own.repartitionByRange("text").sortWithinPartitions("text", "doc_id"), top)
        out = found if out is None else out.union(found)
    return out
