"""Scan configuration: a small JSON file over built-in defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from credsieve.functions.rules import Rule, rule_set

DEFAULT_FILE = ".credsieve.json"
DEFAULT_MIN_ENTROPY = 3.0

_SCHEMA = """
    general struct<min_entropy: double, max_file_size: bigint>,
    rules array<struct<id: string, pattern: string, description: string,
        tags: array<string>, min_entropy: double, enabled: boolean, confidence: string>>,
    allowlist struct<paths: array<string>, secrets: array<string>, regexes: array<string>,
        rule_ids: array<string>, path_regexes: array<string>, files: array<string>>
"""


@dataclass(frozen=True)
class Allowlist:
    paths: tuple[str, ...] = ()
    secrets: tuple[str, ...] = ()
    regexes: tuple[str, ...] = ()
    rule_ids: tuple[str, ...] = ()
    path_regexes: tuple[str, ...] = ()
    files: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    min_entropy: float = DEFAULT_MIN_ENTROPY
    max_file_size: int | None = None
    rules: tuple[dict, ...] = ()
    allowlist: Allowlist = field(default_factory=Allowlist)

    @property
    def entropy_floor(self) -> float:
        return self.min_entropy if self.min_entropy > 0 else DEFAULT_MIN_ENTROPY

    @property
    def size_cap(self) -> int | None:
        """Largest file that is scanned, if the config sets one."""
        return self.max_file_size if self.max_file_size and self.max_file_size > 0 else None

    def rule_set(self) -> list[Rule]:
        """Built-in rules plus this config's enabled ones; a bad regex is an error."""
        return rule_set(self.rules)


def _read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none.  Spark's readers skip dot files,
    so this asks the file system."""
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def load_config(spark: SparkSession, path: str | None = None, root: str | None = None) -> Config:
    """The config at ``path``; else the default file below ``root``; else defaults.

    A missing explicit file and malformed JSON are errors.
    """
    text = _read_text(spark, path or f"{root or '.'}/{DEFAULT_FILE}")
    if text is None:
        if path:
            raise FileNotFoundError(path)
        return Config()
    parsed = F.from_json("text", _SCHEMA, {"mode": "FAILFAST"})
    row = spark.createDataFrame([(text,)], "text string").select(parsed.alias("c")).first()["c"]
    general, allow = row["general"], row["allowlist"]

    def setting(name: str, default):
        value = general[name] if general else None
        return default if value is None else value

    lists = {
        name: tuple((allow[name] if allow else None) or ())
        for name in Allowlist.__dataclass_fields__
    }
    return Config(
        min_entropy=setting("min_entropy", DEFAULT_MIN_ENTROPY),
        max_file_size=setting("max_file_size", None),
        rules=tuple(r.asDict() for r in row["rules"] or ()),
        allowlist=Allowlist(**lists),
    )
