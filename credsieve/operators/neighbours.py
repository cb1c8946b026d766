"""Nearest rows of a whole store: all compared in blocks, or looked up by an index.

``nearest`` compares every row with every vector of the store, exactly.  Rows and vectors are dealt
into blocks of bounded size, and a task takes one block of each: products of matrices in single
precision say which pairs can be near enough, those are computed again in double, and no more than
the ``k`` best of each row leave the task.  No pair is ever written; what is shuffled is each vector
once for each block of the other side.  The work is rows times vectors, some 4 ns for each at 64
numbers, whatever the data; it splits into as many tasks as there are cores.

``nearest_by_index`` is for few rows and a large store: an index of random hyperplanes.  Each of
several tables cuts space by random planes; a vector's code says on which side of each
it lies, so vectors at a small angle often share codes.  A row is looked up under its own code
and under those that differ from it in few planes (those it lies closest to say most, but all
are tried).  Candidates are then compared exactly, and the best are kept.  At a similarity of 0.8 a
row has over a thousand such codes in a store of 240,000, each of which is shuffled.

How many planes a code has follows from the size of the store, so that a code is shared by
some ``bucket`` vectors; how many tables there are follows from the similarity that is asked for
and the share of such neighbours that may be missed.  With ``flips`` planes differing allowed, a
neighbour at the threshold is found in a table with probability sum over f of C(b, f) p^(b-f)
(1-p)^f, p = 1 - angle / pi; nearer ones are found more often.

In both, equal vectors are one entry, which holds the ``k`` least ids, as more can never be
answers.  Vectors that are null, empty, zero or of another length than a row's are no neighbours;
for ``nearest`` neither are those that hold a NaN or an infinite number.
Nothing is sent to executors but a few numbers; all else meets in joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.operators.similarity import THRESHOLD, TOP_K
from credsieve.session import settled

#: Vectors that share a code in the mean.
BUCKET = 32
#: Share of neighbours at the threshold that may be missed.
MISSED = 0.001
#: Planes in which a code may differ from the row's own.
FLIPS = 2
MOST_BITS = 48
#: Numbers in a block of vectors at most, and so few that a block is not split for more tasks.
BLOCK_NUMBERS, LEAST_NUMBERS = 16 * 1024 * 1024, 64 * 1024
#: Rows, vectors and pairs that are looked at together within a task.
_ROWS, _VECTORS, _PAIRS = 1024, 4096, 65_536

_CODES = "entry long, of_table int, code long"
_CODE_SCHEMA = pa.schema([("entry", pa.int64()), ("of_table", pa.int32()), ("code", pa.int64())])


def layout(n: int, threshold: float, *, bucket: int = BUCKET, flips: int = FLIPS, missed: float = MISSED) -> tuple[int, int]:
    """(planes of a code, tables) for an index of ``n`` vectors."""
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(n, 1) / bucket)))) if n > bucket else 1
    same = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    found = sum(math.comb(bits, f) * same ** (bits - f) * (1 - same) ** f for f in range(min(flips, bits) + 1))
    return bits, 1 if found >= 1 - missed else math.ceil(math.log(missed) / math.log(1 - found))


def planes(size: int, bits: int, table: int) -> np.ndarray:
    return np.random.default_rng([size, table]).standard_normal((size, bits))


def _coded(bits: int, tables: int, flips: int):
    """(entry, table, code) of vectors; with ``flips`` also codes that differ in so many planes."""
    turned = [sum(1 << i for i in held) for f in range(min(flips, bits) + 1) for held in combinations(range(bits), f)]
    masks, weights = np.array(turned, np.int64), np.int64(1) << np.arange(bits, dtype=np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            entries = rows.column("entry").to_numpy(zero_copy_only=False)
            for at, held in _matrices(rows.column("vector")):
                for table in range(tables):
                    own = (held @ planes(held.shape[1], bits, table) > 0) @ weights
                    codes = (own[:, None] ^ masks).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(entries[at], len(masks))), pa.array(np.full(len(codes), table, np.int32)), pa.array(codes)], schema=_CODE_SCHEMA
                    )

    return work


def _matrices(vectors: pa.Array, kind: type | None = np.float64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length, in the type given or their own."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(kind) if kind else flat
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, flat[first[at][:, None] + np.arange(size)]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosine similarity of two columns of vectors, in double precision, rounded to single; 0 if lengths differ."""
    for rows in batches:
        out = np.zeros(rows.num_rows)
        scaled = []
        for name in ("vector", "other"):
            units: list = [None] * rows.num_rows
            for at, held in _matrices(rows.column(name)):
                for i, unit in zip(at.tolist(), held / np.sqrt((held * held).sum(axis=1, keepdims=True))):
                    units[i] = unit
            scaled.append(units)
        for i, (a, b) in enumerate(zip(*scaled)):
            if len(a) == len(b):
                out[i] = a @ b
        yield pa.RecordBatch.from_arrays(
            [rows.column("asked"), rows.column("entry"), pa.array(out.astype(np.float32))], ["asked", "entry", "similarity"]
        )


def _usable(rows: DataFrame, embedding: str) -> DataFrame:
    return rows.where(f"size({embedding}) > 0 and exists({embedding}, x -> x <> 0) and not exists({embedding}, x -> x is null)")


def _entries(store: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(``entry``, ``vector``) of each different vector of a store, and its (``entry``, ``id``), ``k`` at most."""
    digest = [F.xxhash64("embedding"), F.hash("embedding")]
    held = _usable(store.select("id", "embedding"), "embedding").select("id", "embedding", F.struct(*digest).alias("same"))
    first = Window.partitionBy("same").orderBy("id")
    least = settled(held.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k), small=True)
    entries = settled(least.where("place = 1").selectExpr("id as entry", "embedding as vector", "same"), small=True)
    return entries, least.select("id", "same").join(entries.select("entry", "same"), "same").select("entry", "id")


def _asked(rows: DataFrame, key: str, embedding: str) -> DataFrame:
    own = _usable(rows.select(F.col(key).alias("of_key"), F.col(embedding).alias("vector")), "vector")
    return settled(own.withColumn("asked", F.monotonically_increasing_id()), small=True)


def _answers(near: DataFrame, ids: DataFrame, asked: DataFrame, key: str, k: int) -> DataFrame:
    best = Window.partitionBy("asked").orderBy(F.desc("similarity"), "id")
    ranked = near.join(ids, "entry").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("asked", "of_key"), "asked").select(F.col("of_key").alias(key), "id", "similarity", "rank")


def best_of_block(a: np.ndarray, b: np.ndarray, of: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, similarity) of the ``k`` best of ``b`` for each of ``a``, ties by ``of``.

    Cosines are computed in double and rounded to single precision.  Single precision alone is off
    by less than ``slack``, so what is below a row's limit by more than that need not be computed again.
    """
    least, slack = np.float32(threshold), np.float32(1e-6 + 2.4e-7 * a.shape[1])
    lengths = [np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)) for m in (a, b)]
    ones = [np.nan_to_num(m / n[:, None], nan=0, posinf=0, neginf=0).astype(np.float32) for m, n in zip((a, b), lengths)]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for top in range(0, len(a), _ROWS):
        some = ones[0][top : top + _ROWS]
        limit = np.full(len(some), least)
        at, to, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        for left in range(0, len(b), _VECTORS):
            rough = some @ ones[1][left : left + _VECTORS].T
            found = np.flatnonzero(rough >= (limit - slack)[:, None])
            if not len(found):
                continue
            i, j = np.divmod(found, rough.shape[1])
            if len(found) > k * len(some) and rough.shape[1] > k:
                # Of a crowd only what can be among the k best.
                last = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
                held = rough[i, j] >= last[i] - 2 * slack
                i, j = i[held], j[held]
            exact = np.concatenate([
                np.einsum("ij,ij->i", a[x + top].astype(np.float64) / lengths[0][x + top, None], b[y].astype(np.float64) / lengths[1][y, None])
                for x, y in ((i[n : n + _PAIRS], j[n : n + _PAIRS] + left) for n in range(0, len(i), _PAIRS))
            ]).astype(np.float32)
            held = exact >= limit[i]
            at, to, near = (np.concatenate(x) for x in ((at, i[held]), (to, j[held] + left), (near, exact[held])))
            order = np.lexsort((of[to], -near, at))
            at, to, near = at[order], to[order], near[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            at, to, near, place = (x[place < k] for x in (at, to, near, place))
            limit[at[place == k - 1]] = near[place == k - 1]
        out.append((at + top, to, near))
    return tuple(np.concatenate(x) for x in zip(*out))


_NEAR = pa.schema([("asked", pa.int64()), ("entry", pa.int64()), ("similarity", pa.float32())])


def _met(k: int, threshold: float):
    def work(asked: pa.Table, entries: pa.Table) -> pa.Table:
        by_size = {}
        for rows, name in ((entries, "entry"), (asked, "asked")):
            held = rows.column("vector").combine_chunks()
            names = rows.column(name).to_numpy()
            by_size[name] = {m.shape[1]: (names[at], m) for at, m in _matrices(held, None)} if len(held) else {}
        out = [_NEAR.empty_table()]
        for size, (own, a) in by_size["asked"].items():
            if size in by_size["entry"]:
                names, b = by_size["entry"][size]
                at, to, near = best_of_block(a, b, names, k, threshold)
                out.append(pa.Table.from_arrays([pa.array(own[at]), pa.array(names[to]), pa.array(near)], schema=_NEAR))
        return pa.concat_tables(out)

    return work


def blocks(rows: int, vectors: int, tasks: int) -> tuple[int, int]:
    """Blocks of the rows and of the vectors, given how many numbers each side has."""
    sides = [max(1, math.ceil(n / BLOCK_NUMBERS)) for n in (rows, vectors)]
    while sides[0] * sides[1] < tasks:
        each, side = max((n / s, x) for x, (n, s) in enumerate(zip((rows, vectors), sides)))
        if each < LEAST_NUMBERS:
            break
        sides[side] += 1
    return sides[0], sides[1]


def nearest(
    rows: DataFrame, store: DataFrame, key: str, *, embedding: str = "embedding", k: int = TOP_K, threshold: float = THRESHOLD,
) -> DataFrame:
    """(``key``, ``id``, ``similarity``, ``rank``): the ``k`` rows of the whole store (``id``,
    ``embedding``) most similar to each of ``rows``, with at least ``threshold``, ties by id."""
    spark = rows.sparkSession
    entries, ids = _entries(store, k)
    asked = _asked(rows, key, embedding)
    numbers = [df.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0] for df in (asked, entries)]
    down, across = blocks(*numbers, 2 * spark.sparkContext.defaultParallelism)
    cells = down * across
    # A name for each cell by which it has a partition of its own.
    named = spark.range(64 * cells).groupBy(F.expr(f"pmod(hash(id), {cells}) as p")).agg(F.min("id").alias("name"))
    names = F.array(*[F.lit(r["name"]) for r in named.orderBy("p").collect()])
    row, column = F.expr(f"pmod(xxhash64(asked), {down})"), F.expr(f"pmod(xxhash64(entry), {across})")
    sides = (
        asked.select("asked", "vector", F.explode(F.slice(names, row * across + 1, F.lit(across))).alias("cell")),
        entries.select("entry", "vector", F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda i: F.get(names, i * across + column))).alias("cell")),
    )
    one, two = (df.repartition(cells, "cell").groupBy("cell") for df in sides)
    near = settled(one.cogroup(two).applyInArrow(_met(k, threshold), "asked long, entry long, similarity float"), small=True)
    return _answers(near, ids, asked, key, k)


def nearest_by_index(
    rows: DataFrame, store: DataFrame, key: str, *, embedding: str = "embedding", k: int = TOP_K,
    threshold: float = THRESHOLD, bucket: int = BUCKET, flips: int = FLIPS, missed: float = MISSED,
) -> DataFrame:
    """As ``nearest``; a share ``missed`` of the neighbours at the threshold may be missing."""
    entries, ids = _entries(store, k)
    asked = _asked(rows, key, embedding)
    bits, tables = layout(entries.count(), threshold, bucket=bucket, flips=flips, missed=missed)
    index = entries.select("entry", "vector").mapInArrow(_coded(bits, tables, 0), _CODES)
    probes = asked.selectExpr("asked as entry", "vector").mapInArrow(_coded(bits, tables, flips), _CODES)
    met = probes.withColumnRenamed("entry", "asked").join(index, ["of_table", "code"]).select("asked", "entry").distinct()
    pairs = met.join(entries.selectExpr("entry", "vector as other"), "entry").join(asked.select("asked", "vector"), "asked")
    scored = pairs.select("asked", "entry", "vector", "other").mapInArrow(_compared, "asked long, entry long, similarity float")
    near = scored.where(F.col("similarity") >= F.lit(threshold).cast("float"))
    return _answers(near, ids, asked, key, k)
