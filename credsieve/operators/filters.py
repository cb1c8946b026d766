"""Filters over findings: allowlists, switched-off rules, entropy floor."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.functions.dialect import to_java
from credsieve.functions.globs import full_match
from credsieve.functions.rules import Rule
from credsieve.functions.text import base_name, matches, quote
from credsieve.operators.joins import skewed_join
from credsieve.sources.config import Config


def _one_of(value: str, members: Iterable[str]) -> str:
    listed = ", ".join(quote(m) for m in members)
    return f"{value} in ({listed})" if listed else "false"


def path_is_allowlisted(path: str, config: Config) -> str:
    """Listed file (name or path), path glob, or path regex."""
    allow = config.allowlist
    tests = [
        _one_of(base_name(path), allow.files),
        _one_of(path, allow.files),
        full_match(path, allow.paths),
        *[matches(path, to_java(r)) for r in allow.path_regexes],
    ]
    return "(" + " or ".join(tests) + ")"


def secret_is_allowlisted(secret: str, config: Config) -> str:
    allow = config.allowlist
    tests = [_one_of(secret, allow.secrets), *[matches(secret, to_java(r)) for r in allow.regexes]]
    return "(" + " or ".join(tests) + ")"


def rule_is_disabled(rule_id: str, config: Config) -> str:
    return "(" + _one_of(rule_id, config.allowlist.rule_ids) + ")"


def below_entropy_floor(config: Config, rules: Sequence[Rule] = ()) -> str:
    """Too little entropy, unless the finding is critical or high anyway.

    A custom rule's own minimum replaces the general one.
    """
    own = [r for r in rules if r.min_entropy]
    cases = " ".join(f"when {quote(r.rule_id)} then {r.min_entropy}D" for r in own)
    floor = f"{config.entropy_floor}D"
    if own:
        floor = f"(case rule_id {cases} else {floor} end)"
    return f"(entropy < {floor} and confidence not in ('critical', 'high'))"


# A history finding's path without the commit it ends in.
BASE_PATH = "regexp_replace(file_path, '@[0-9a-f]{8}$', '')"


def apply_config(
    findings: DataFrame, config: Config, rules: Sequence[Rule] = (), *, path: str = "file_path"
) -> DataFrame:
    """Findings that survive path, secret, rule and entropy filters, in that order.

    A history finding's path ends in its commit, so names and suffixes of the allowlist
    do not meet it; ``path=BASE_PATH`` judges it by the path alone.
    """
    return (
        findings.where(f"not {path_is_allowlisted(path, config)}")
        .where(f"not {secret_is_allowlisted('match', config)}")
        .where(f"not {rule_is_disabled('rule_id', config)}")
        .where(f"not {below_entropy_floor(config, rules)}")
    )


def without_listed(findings: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Anti join for allowlists kept as tables: drops findings whose ``column``
    (``match``, ``rule_id`` or ``file_path``) appears in ``listed``."""
    known = listed.select(F.col(column)).distinct()
    return skewed_join(findings, known, [column], "left_anti")


def at_least(threshold: str, level: str = "confidence") -> str:
    """The finding counts as a failure at ``threshold``; an unknown one means low."""
    from credsieve.functions.score import SEVERITY, severity

    return f"({severity(level)} >= {SEVERITY.get(threshold.lower(), 1)})"
