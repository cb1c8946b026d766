"""Sharding by extendible hashing.

A row's key is hashed to 60 bits.  The directory begins as one bucket; a bucket over the
byte limit splits on the next bit of the prefix, and only that one, until every bucket
fits.  A round reads the sizes of cells, prefixes a few bits deeper than the buckets that
are still too large, and settles all splits within those bits at once; only rows of cells
that are too large themselves go to the next round.

Rows whose hash is used up, one key with more bytes than a shard may hold, are dealt to
overflow shards of that bucket by the running sum of their bytes.  A single row larger
than the limit is a shard alone, the only kind that exceeds it.

Everything is DataFrame operations on (hash, bytes) pairs; texts are read once and never
shuffled.  A null key is a key of its own; null text has no bytes; repeated rows are all
kept; other columns are ignored.  Of a text of any length only its size counts.  A check that sees
few heavy cells of one round is right: there are at most 4,096 of them for each open bucket.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve.session import settled

HASH_BITS = 60
SHARD_BYTES = 1024 * 1024
#: Bits a round looks deeper than the one before.
ROUND_BITS = 12


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5; a null key hashes as a word no number is."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _leaves(cells: DataFrame, base: int, bits: int, limit: int) -> DataFrame:
    """(cell, depth): the shallowest prefix of each cell that fits, from ``base`` bits on."""
    top = base + bits
    levels = cells.select("cell", "n_bytes", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {top} - depth)"))
    sizes = levels.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("held")).where(F.col("held") <= limit)
    fits = levels.join(sizes, ["depth", "prefix"])
    return fits.groupBy("cell").agg(F.min("depth").alias("depth"))


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one hash each, dealt to runs of at most ``limit`` bytes."""
    half = limit // 2
    numbered = rows.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    numbered = settled(numbered)
    small = numbered.where(F.col("n_bytes") <= half)
    # A window holds what one task read of one key.
    within = Window.partitionBy("hash", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = small.groupBy("hash", "part").agg(F.sum("n_bytes").alias("held"))
    parts = parts.select("hash", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    dealt = small.withColumn("at", F.coalesce(F.sum("n_bytes").over(within), F.lit(0))).join(parts, ["hash", "part"])
    run = F.floor((F.col("first") + F.col("at")) / F.lit(max(half, 1))).cast("string")
    names = ["doc_id", "n_bytes", "hash", *(c for c in rows.columns if c == "carried")]
    return dealt.select(*names, F.concat(F.lit("r"), run).alias("overflow")).union(
        numbered.where(F.col("n_bytes") > half).select(*names, F.concat(F.lit("a"), F.col("row").cast("string")))
    )


def shard(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES, carry: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, bytes, depth, prefix and name of its shard.

    ``shard`` is the prefix's bits; an overflow shard's name goes on after a dash.  A column to
    ``carry`` is passed on as ``carried``.
    """
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("doc_id"), size.alias("n_bytes"), key_hash(F.col(key)).alias("hash"), *([F.col(carry).alias("carried")] if carry else []))
    rows = settled(rows)
    done, base = [], 0
    while True:
        bits = min(ROUND_BITS, HASH_BITS - base)
        top = base + bits
        in_cells = rows.withColumn("cell", F.expr(f"shiftright(hash, {HASH_BITS - top})"))
        cells = in_cells.groupBy("cell").agg(F.sum("n_bytes").alias("n_bytes"))
        met = in_cells.join(_leaves(cells, base, bits, limit), "cell", "left").drop("cell")
        met = settled(met)
        done.append(met.where("depth is not null").withColumn("overflow", F.lit(None).cast("string")))
        rows = met.where("depth is null").drop("depth")
        if rows.isEmpty():
            break
        if top == HASH_BITS:
            done.append(_overflow(rows, limit).withColumn("depth", F.lit(HASH_BITS)).select(*done[0].columns))
            break
        base = top
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    prefix = F.expr(f"shiftright(hash, {HASH_BITS} - depth)")
    bits_text = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    named = out.withColumn("prefix", prefix).withColumn("bits", bits_text)
    return named.select(
        "doc_id", "n_bytes", F.col("depth").cast("long").alias("depth"), F.col("prefix").cast("long").alias("prefix"),
        F.when(F.col("overflow").isNull(), F.col("bits")).otherwise(F.concat_ws("-", "bits", "overflow")).alias("shard"),
        *(["carried"] if carry else []),
    )


def directory(shards: DataFrame) -> DataFrame:
    """One row per shard: its depth, prefix, rows and bytes."""
    return shards.groupBy("shard", "depth", "prefix").agg(F.count("*").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))


def write_shards(docs: DataFrame, to: str, *, key: str = "doc_id", **options) -> None:
    """Every row of ``docs`` as Parquet, one folder ``shard=...`` per shard, which columns may not be named like.

    Rows are written once with a number, so that a repeated key's are told apart.
    """
    number = "row"
    while any(number == c.lower() for c in docs.columns):
        number += "_"
    if any(c.lower() == "shard" for c in docs.columns):
        raise ValueError("a column named shard cannot be told from the folders'")
    numbered = settled(docs.withColumn(number, F.monotonically_increasing_id()))
    assigned = shard(numbered, key=key, carry=number, **options).select(F.col("carried").alias(number), "shard")
    met = numbered.join(assigned, number).drop(number)
    met.repartition("shard").write.partitionBy("shard").parquet(to)
