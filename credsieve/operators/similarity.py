"""Nearest verified findings of each row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Candidates looked at, neighbours kept, least similarity.
MAX_CANDIDATES = 500
TOP_K = 10
THRESHOLD = 0.8

NEIGHBOUR = (
    "struct<id: bigint, similarity: float, rank: int, file_path: string, confidence: string>"
)


def latest_verified(store: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """The newest verified rows of a finding store, at most ``limit``."""
    return store.where("verified").orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def with_neighbours(
    rows: DataFrame,
    store: DataFrame,
    *,
    embedding: str = "embedding",
    k: int = TOP_K,
    threshold: float = THRESHOLD,
    limit: int = MAX_CANDIDATES,
) -> DataFrame:
    """Add ``neighbours``: the ``k`` most similar of the latest verified rows with at
    least ``threshold`` cosine similarity, best first, ties by id.

    The candidates are a top-``limit`` report, a few hundred short vectors whatever
    the size of the store; they travel with the task as one matrix.  Each batch of
    rows is one matrix product, and only the ``k`` best of a row leave its task: no
    pairs are formed, nothing is shuffled.
    """
    if limit > 10_000:
        raise ValueError("candidates travel with every task; keep limit at 10000 or less")
    latest = latest_verified(store, limit)
    found = latest.select("id", "embedding", "file_path", "confidence").collect()
    found.sort(key=lambda r: r["id"])
    about = {r["id"]: (r["file_path"], r["confidence"]) for r in found}
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r["embedding"]) for r in found} - {0}:
        same = [r for r in found if len(r["embedding"]) == size]
        matrix = np.array([r["embedding"] for r in same], dtype=np.float64)
        norms = np.sqrt((matrix * matrix).sum(axis=1))
        scaled = np.divide(matrix, norms[:, None], where=norms[:, None] > 0, out=np.zeros_like(matrix))
        by_size[size] = (np.array([r["id"] for r in same], dtype=np.int64), scaled)

    least = np.float32(threshold)

    @F.pandas_udf(f"array<{NEIGHBOUR}>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out: list[list[dict]] = [[] for _ in range(len(vectors))]
            sizes = np.array([0 if v is None else len(v) for v in vectors])
            for size, (ids, candidates) in by_size.items():
                where = np.flatnonzero(sizes == size)
                if not len(where):
                    continue
                batch = np.stack([np.asarray(vectors.iloc[i], dtype=np.float64) for i in where])
                norms = np.sqrt((batch * batch).sum(axis=1, keepdims=True))
                batch = np.divide(batch, norms, where=norms > 0, out=np.zeros_like(batch))
                similarity = (batch @ candidates.T).astype(np.float32)
                # Candidates are in id order, so a stable sort breaks ties by id.
                best = np.argsort(-similarity, axis=1, kind="stable")[:, :k]
                for row, order, scores in zip(where, best, similarity, strict=True):
                    out[row] = [
                        {
                            "id": int(ids[j]),
                            "similarity": float(scores[j]),
                            "rank": r,
                            "file_path": about[ids[j]][0],
                            "confidence": about[ids[j]][1],
                        }
                        for r, j in enumerate(order, 1)
                        if scores[j] >= least
                    ]
            yield pd.Series(out)

    return rows.withColumn("neighbours", nearest(F.col(embedding)))


def similar_pairs(rows: DataFrame, store: DataFrame, key: str, **options) -> DataFrame:
    """(``key``, neighbour ``id``, ``similarity``, ``rank``), one row per kept neighbour."""
    return with_neighbours(rows, store, **options).select(
        key, F.explode("neighbours").alias("n")
    ).select(key, "n.id", "n.similarity", "n.rank")
