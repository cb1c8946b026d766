"""Rules as driver-side values: built-in catalogue plus custom rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from credsieve.functions.catalogue import ADDITIONAL_RULES, CORE_RULES
from credsieve.functions.dialect import group_count, is_case_insensitive, to_java

# Regexes that mention one of these names score higher.
BOOSTED_NAMES = ("AWS_Key", "Private_Key")
BOOST = 15


@dataclass(frozen=True)
class Rule:
    rule_idx: int
    rule_id: str
    name: str
    regex: str
    rule_set: str
    literals: tuple[str, ...] = ()
    boost: int = 0
    min_entropy: float | None = None
    confidence: str | None = None
    tags: tuple[str, ...] = ()
    java: str = field(init=False, default="")
    ci: bool = field(init=False, default=False)
    groups: int = field(init=False, default=0)

    def __post_init__(self) -> None:
        object.__setattr__(self, "java", to_java(self.regex))
        object.__setattr__(self, "ci", is_case_insensitive(self.regex))
        object.__setattr__(self, "groups", group_count(self.regex))


def _boost(regex: str) -> int:
    return BOOST if any(name in regex for name in BOOSTED_NAMES) else 0


def _build(rows: Sequence[tuple[str, str, tuple[str, ...]]], start: int, rule_set: str):
    return [
        Rule(i, f"pattern-{i}", name, regex, rule_set, literals, _boost(regex))
        for i, (name, regex, literals) in enumerate(rows, start)
    ]


def builtin_rules() -> list[Rule]:
    """Core rules followed by the additional pack, numbered by position."""
    core = _build(CORE_RULES, 0, "core")
    return core + _build(ADDITIONAL_RULES, len(core), "additional")


def custom_rule(
    rule_id: str,
    pattern: str,
    *,
    description: str = "",
    tags: Iterable[str] = (),
    min_entropy: float | None = None,
    enabled: bool = True,
    confidence: str | None = None,
) -> dict:
    """One custom rule, in the shape the config file uses."""
    return {
        "id": rule_id,
        "pattern": pattern,
        "description": description,
        "tags": list(tags),
        "min_entropy": min_entropy,
        "enabled": enabled,
        "confidence": confidence,
    }


def leading_literal(regex: str) -> tuple[str, ...]:
    """The plain text every match starts with, when the regex shows it openly."""
    body = regex.removeprefix("(?i)")
    if "|" in body:
        return ()
    text = re.match(r"[A-Za-z0-9_-]*", body).group()
    if body[len(text) : len(text) + 1] in ("?", "*", "{"):
        text = text[:-1]
    if body != regex:
        text = text.lower()
    return (text,) if len(text) > 2 else ()


def rule_set(custom: Iterable[dict] = ()) -> list[Rule]:
    """Built-in rules followed by the enabled custom rules."""
    rules = builtin_rules()
    for spec in custom:
        if not spec.get("enabled"):
            continue
        rules.append(
            Rule(
                len(rules),
                spec["id"],
                spec.get("description") or spec["id"],
                spec["pattern"],
                "custom",
                leading_literal(spec["pattern"]),
                boost=_boost(spec["pattern"]),
                min_entropy=spec.get("min_entropy") or None,
                confidence=spec.get("confidence") or None,
                tags=tuple(spec.get("tags") or ()),
            )
        )
    return rules


RULES_SCHEMA = T.StructType(
    [
        T.StructField("rule_idx", T.IntegerType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("regex", T.StringType()),
        T.StructField("rule_set", T.StringType()),
        T.StructField("ci", T.BooleanType()),
        T.StructField("literals", T.ArrayType(T.StringType())),
        T.StructField("n_groups", T.IntegerType()),
        T.StructField("boost", T.IntegerType()),
        T.StructField("min_entropy", T.DoubleType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rules as a DataFrame: ``pattern`` is RE2, ``regex`` its Java spelling.

    One row per rule the caller passed, so its size is known before any join.
    """
    rows = [
        (
            r.rule_idx, r.rule_id, r.name, r.regex, r.java, r.rule_set, r.ci,
            list(r.literals), r.groups, r.boost, r.min_entropy, r.confidence, list(r.tags),
        )
        for r in rules
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)
