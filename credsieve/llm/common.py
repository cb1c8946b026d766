"""What the operators of this folder share: reading, row tables, batches of texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of one Arrow batch that are worked on together, in bytes; one longer text is a slice alone.
SLICE_BYTES = 4 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator works on; whatever else the table has cannot clash."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def row_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(rows, their texts) in pieces of bounded size; a null text becomes an empty one."""
    for rows in batches:
        start, held = 0, 0
        lengths = pc.binary_length(rows.column("text")).to_pylist()
        for i, n in enumerate([*lengths, None]):
            if i > start and (i == len(lengths) or held + (n or 0) > limit):
                part = rows.slice(start, i - start)
                yield part, [t or "" for t in part.column("text").to_pylist()]
                start, held = i, 0
            held += n or 0


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) in pieces of bounded size."""
    for rows, texts in row_slices(batches, limit):
        yield rows.column("doc_id").to_pylist(), texts


def batch(schema: pa.Schema, *columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_held: dict = {}


def held_once(name, make):
    """What ``make`` gives, kept by the Python worker under ``name``.

    A worker lives through the stages of a job.  It keeps the tables of one stage alone: those
    of the stage before go when another's are asked for, and their memory back to the system.
    """
    if name not in _held:
        _release()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Give back what the worker holds of another stage; stages that need no table begin with it."""
    if _held:
        _release()


def _release() -> None:
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Rows, and bytes in all, up to which a table of keys is sent to every executor instead of joined by shuffle.
BROADCAST_KEYS = 1_000_000
BROADCAST_BYTES = 32 * 1024 * 1024


def sized(keys: DataFrame) -> DataFrame:
    """``keys`` with a hint to broadcast it if its measured size is small."""
    few = keys.limit(BROADCAST_KEYS + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct(*keys.columns))))).first()
    return F.broadcast(keys) if few[0] <= BROADCAST_KEYS and (few[1] or 0) <= BROADCAST_BYTES else keys


def row_join(docs: DataFrame, found: DataFrame, how: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` joined with ``found`` on its ``doc_id`` (nulls equal) and ``text_key``, xxhash64 of the text.

    The other columns of ``found`` get a prefix, returned with the join, that no column of ``docs`` has.
    """
    prefix = "_"
    while any(name.lower().startswith(prefix) for name in docs.columns):
        prefix += "_"
    named = found.select(*[F.col(c).alias(prefix + c) for c in found.columns])
    marked = docs.withColumn(prefix + "own", F.xxhash64(F.col(text).cast("string")))
    met = F.col(key).cast("long").eqNullSafe(F.col(prefix + "doc_id")) & (F.col(prefix + "own") == F.col(prefix + "text_key"))
    return marked.join(sized(named), met, how), prefix
