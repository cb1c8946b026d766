"""Baseline storage: accepted findings, as one JSON document or as a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0"
ENTRY_SCHEMA = (
    "fingerprint string, file string, line int, rule_id string, secret_hash string, reason string"
)


def empty_baseline(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ENTRY_SCHEMA)


def read_baseline(spark: SparkSession, path: str, *, format: str = "document") -> DataFrame:
    """Entries of a baseline; a missing path is an empty one, malformed JSON an error.

    ``document`` is one pretty JSON text with an ``entries`` list, ``json`` one
    entry per line, ``parquet`` a table; the last two are read in parallel.
    """
    if path.rstrip("/").rsplit("/", 1)[-1].startswith((".", "_")):
        raise ValueError(f"Spark does not read hidden files, and would find nothing: {path}")
    try:
        if format == "document":
            schema = f"version string, entries array<struct<{_struct_fields()}>>"
            reader = spark.read.schema(schema).option("multiLine", True)
            documents = reader.option("mode", "FAILFAST").json(path)
            return documents.select(F.inline("entries"))
        reader = spark.read.schema(ENTRY_SCHEMA)
        if format == "json":
            reader = reader.option("mode", "FAILFAST")
        return reader.format(format).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_baseline(spark)


def _struct_fields() -> str:
    return ", ".join(part.strip().replace(" ", ": ") for part in ENTRY_SCHEMA.split(","))


def ordered_entries(entries: DataFrame) -> DataFrame:
    """Entries by file and line; the fingerprint settles ties."""
    return entries.orderBy("file", "line", "fingerprint")


def write_baseline(entries: DataFrame, path: str, *, format: str = "json") -> None:
    """Write entries as ordered parts (``json`` lines or ``parquet``), to a new path."""
    ordered_entries(entries).write.format(format).save(path)
