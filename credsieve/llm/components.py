"""Connected components of a table of links, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.session import settled


def _to_least(links: DataFrame) -> DataFrame:
    """Every larger neighbour of ``u`` is linked with the least of ``u`` and its neighbours."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _smaller_to_least(links: DataFrame) -> DataFrame:
    """``u`` and its smaller neighbours are linked with the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _tangled(links: DataFrame) -> bool:
    """Whether any node has two least neighbours, or is both a member and a least one."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("v", F.lit(0), F.lit(1))
    )
    held = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not held.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(``u``, ``component``) for every end of a link that is not the least of its component.

    ``links`` has columns u and v of any ordered type.  The two star steps alternate until
    every component is a star around its least node, a number of rounds logarithmic in the
    longest path.  A node with very many links is a skewed join key that adaptive
    execution splits, never a list.
    """
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = settled(down.where("u <> v").distinct())
    while _tangled(current):
        current = settled(_smaller_to_least(_to_least(current)))
    return current.select("u", F.col("v").alias("component"))
