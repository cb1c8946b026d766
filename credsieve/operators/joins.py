"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Parts a key's rows are dealt to where they must first be reduced within each part.
SALTS = 16


def skewed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi join of a possibly skewed ``left`` with a ``right`` that has each key once.

    A plain join: adaptive execution makes it a broadcast when it measures a small right
    side, and otherwise splits the tasks of heavy keys of the left, reading the matching
    part of the right again for those alone.  Nothing is copied for keys that are not heavy.
    """
    if how not in ("inner", "left", "left_anti", "left_semi"):
        raise ValueError(f"{how} would return repeated rows of the right side")
    return left.join(right, list(on), how)
