"""Suppression of accepted findings, and growing the list of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.functions.identity import fingerprint, secret_hash
from credsieve.operators.joins import skewed_join
from credsieve.session import settled
from credsieve.sources.baseline import empty_baseline, read_baseline, write_baseline
from credsieve.sources.store import remove_snapshots, snapshots

DEFAULT_PATH = "credsieve-baseline"

_FINGERPRINT = fingerprint("file_path", "rule_id", "match")


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", F.expr(_FINGERPRINT))


def suppress(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint is not in the baseline."""
    known = baseline.select("fingerprint").distinct()
    fresh = skewed_join(with_fingerprint(findings), known, ["fingerprint"], "left_anti")
    return fresh.select(*findings.columns)


def entries_of(findings: DataFrame, reason: str = "") -> DataFrame:
    """Baseline entries for findings, one per finding."""
    return findings.select(
        F.expr(_FINGERPRINT).alias("fingerprint"),
        F.col("file_path").alias("file"),
        F.col("line_no").cast("int").alias("line"),
        "rule_id",
        F.expr(secret_hash("match")).alias("secret_hash"),
        F.nullif(F.lit(reason), F.lit("")).alias("reason"),
    )


def updated_baseline(baseline: DataFrame, findings: DataFrame, reason: str = "") -> DataFrame:
    """Baseline plus findings, one entry per fingerprint; existing entries win, and
    among new ones the first line.

    A minimum per fingerprint is combined before the shuffle, so copies of one
    secret do not meet in one task.
    """
    old = baseline.withColumn("_new", F.lit(0))
    new = entries_of(findings, reason).withColumn("_new", F.lit(1))
    rest = ("line", "file", "rule_id", "secret_hash", "reason")
    return (
        old.unionByName(new)
        .groupBy("fingerprint")
        .agg(F.min(F.struct("_new", *rest)).alias("_first"))
        .select("fingerprint", *[f"_first.{c}" for c in ("file", "line", "rule_id", "secret_hash", "reason")])
    )


def stored_baseline(spark: SparkSession, path: str = DEFAULT_PATH, *, format: str = "json") -> DataFrame:
    """The entries of the newest complete version below ``path``; none if there is no version."""
    versions = snapshots(spark, path)
    if not versions:
        return empty_baseline(spark)
    return read_baseline(spark, f"{path}/snapshot={versions[-1]}", format=format)


def update_stored_baseline(
    findings: DataFrame, path: str = DEFAULT_PATH, *, reason: str = "", format: str = "json"
) -> DataFrame:
    """Add findings to the baseline stored at ``path``, keeping what is already there.

    The grown baseline is a new numbered version beside the old one, which stays whole if
    the job fails; versions before the last two are removed.
    """
    spark = findings.sparkSession
    versions = snapshots(spark, path)
    grown = settled(updated_baseline(stored_baseline(spark, path, format=format), findings, reason))
    write_baseline(grown, f"{path}/snapshot={versions[-1] + 1 if versions else 0}", format=format)
    remove_snapshots(spark, path, keep=2)
    return grown
