"""Consecutive numbers over a total order, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve.session import settled

_PARTITION_BITS = 33


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "seq") -> DataFrame:
    """Add ``name`` = 1, 2, 3, … in the given order.

    A range-partitioned sort gives each row its position within its partition; the
    row counts of the partitions in front of it give the rest.  Only those counts,
    one per partition, meet in one task and are broadcast.
    """
    local = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    local = settled(
        local.withColumn("_part", F.shiftright("_id", _PARTITION_BITS)).withColumn(
            "_pos", F.expr(f"_id - shiftleft(_part, {_PARTITION_BITS})")
        )
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        local.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    joined = local.join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.expr("_before + _pos + 1")).drop(
        "_id", "_part", "_pos", "_before"
    )
