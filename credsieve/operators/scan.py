"""Detection over lines: which rule owns a line, what it found, how sure it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.functions import detect as D
from credsieve.functions.rules import Rule
from credsieve.functions.score import confidence, context_of, entropy
from credsieve.functions.text import any_of, let, lower_path, matches, pin, quote, unused
from credsieve.operators.long_lines import FOUND, resolved
from credsieve.sources.lines import lines

# Fixed value: a line that quotes a regex between backticks is a rule definition.
REGEX_SIGNS = r"\(\?i\)|\\s|\\d|\[|\]|\{|\}|\||\^|\$"
REGEX_LINE = rf"(?d)\A[\t\n\f\r ]*`.*(?:{REGEX_SIGNS}).*`"
RE2_BLANK = "\t\n\f\r "

FINDING_COLUMNS = (
    "file", "file_path", "line_no", "line", "match", "rule_id", "pattern",
    "confidence", "entropy", "context", "verified", "verification_reason",
)


def is_regex_line(line: str) -> str:
    """Whether ``REGEX_LINE`` matches, in one pass: what lies between the first backtick,
    which begins the line, and the last one holds one of the signs."""
    rest = f"substring(trim(LEADING {quote(RE2_BLANK)} FROM l), 2)"
    inner = f"left(r, char_length(r) - char_length(substring_index(r, '`', -1)) - 1)"
    begins = f"startswith(trim(LEADING {quote(RE2_BLANK)} FROM l), '`')"
    held = let("r", rest, f"contains(r, '`') and {matches(inner, REGEX_SIGNS)}")
    return f"(contains({line}, '`') and {let('l', line, f'{begins} and {held}')})"


def gated(rows: DataFrame, rules: Sequence[Rule], line: str = "line") -> DataFrame:
    """Rows whose line some rule may match."""
    return rows.where(D.line_gate(rules, line))


def detect(rows: DataFrame, rules: Sequence[Rule], line: str = "line") -> DataFrame:
    """Keep rows whose line a rule matches and add ``rule_idx``, the first such rule.

    Rule order is resolved before anything is filtered by rule, confidence or
    context, so a rule that is later dropped still hides the rules behind it.
    """
    # explode, not a filter on the index: a filter would be pushed below the
    # projection and evaluate all rules a second time.
    return owned(rows, rules, line).drop(FOUND)


def owned(rows: DataFrame, rules: Sequence[Rule], line: str = "line") -> DataFrame:
    """``detect``, and in ``_found`` what is known already of a long line's match."""
    text, folded, arms, first = (unused(rows, n) for n in ("text", "folded", "arms", "first"))
    # A long line is never looked at by the arms; its rule is found elsewhere.
    bound = pin(rows, **{text: line, folded: f"if({D.is_long_line(line)}, '', {D.fold(line)})"})
    armed = bound.selectExpr("*", f"{D.arms_of(rules, text, folded)} as {arms}")
    # Again not a filter, which would be pushed below the arms and evaluate them a second time.
    likely = any_of([D.is_long_line(text), *(f"{arms}.{name}" for name in D.arm_names(rules))])
    kept = armed.selectExpr(*rows.columns, text, folded, f"explode(if({likely}, array({arms}), null)) as {arms}")
    named = kept.selectExpr(*rows.columns, f"{D.first_rule_of(rules, text, folded, arms)} as {first}")
    owner = f"explode(array_compact(array({first}))) as rule_idx"
    return resolved(named.selectExpr(*rows.columns, owner), rules, line)


def owners(rows: DataFrame, rules: Sequence[Rule], line: str = "line") -> DataFrame:
    """All rows, with the index of the first rule that matches the line or null."""
    owner = f"if({D.line_gate(rules, line)}, {D.first_rule(rules, line)}, null)"
    return resolved(pin(rows, rule_idx=owner), rules, line, keep=True).drop(FOUND)


def detect_all(rows: DataFrame, rules: Sequence[Rule], line: str = "line") -> DataFrame:
    """One row per (line, matching rule): detection without the first-match choice."""
    every = f"explode({D.all_rules(rules, line)}) as rule_idx"
    return resolved(gated(rows, rules, line).selectExpr(*rows.columns, every), rules, line, every=True).drop(FOUND)


def with_rule(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``rule_id``, ``pattern`` and the Java regex of ``rule_idx``."""
    return pin(
        rows,
        rule_id=D.rule_text(rules, "rule_idx", lambda r: r.rule_id),
        pattern=D.rule_text(rules, "rule_idx", lambda r: r.regex),
        _regex=D.rule_text(rules, "rule_idx", lambda r: r.java),
    )


def score(rows: DataFrame, rules: Sequence[Rule], *, path: str = "path") -> DataFrame:
    """Add ``entropy``, ``context`` and ``confidence`` for ``match`` on ``line``."""
    # Columns, not names in a lambda: Spark compiles conditions on columns alone.
    lowered, bare = unused(rows, "lowered"), unused(rows, "bare")
    named = pin(rows, **{lowered: lower_path(path), bare: f"rtrim('/', {lower_path(path)})"})
    scored = pin(named, entropy=entropy("match"), context=context_of(lowered, bare, "line")).drop(lowered, bare)
    boost = "0"
    if any(r.boost for r in rules):
        boost = D.rule_number(rules, "rule_idx", lambda r: r.boost)
    level = confidence("entropy", "context", boost)
    if any(r.confidence for r in rules):
        fixed = D.rule_text(rules, "rule_idx", lambda r: r.confidence)
        level = f"coalesce({fixed}, {level})"
    return pin(scored, confidence=level)


def rule_label(rules: Sequence[Rule], idx: str = "rule_idx") -> str:
    n_core = sum(r.rule_set == "core" for r in rules)
    n_builtin = sum(r.rule_set != "custom" for r in rules)
    return f"if({idx} >= {n_core} and {idx} < {n_builtin}, 'Additional Secret', 'Secret')"


def file_hits(rows: DataFrame, rules: Sequence[Rule], *, path: str = "path") -> DataFrame:
    """Scored hits of file lines, low ones included; all columns of ``rows`` kept."""
    hits = with_rule(owned(rows.where(f"not {is_regex_line('line')}"), rules), rules)
    hits = pin(hits, match=D.secret_of(rules, "line", "rule_idx", "_regex", FOUND))
    return score(hits.drop("_regex", FOUND), rules, path=path)


def as_findings(
    hits: DataFrame, rules: Sequence[Rule], *, path: str = "path", extra: Sequence[str] = ()
) -> DataFrame:
    """File hits in the shape of findings: low ones gone, label and columns in place."""
    return hits.where("confidence <> 'low'").selectExpr(
        f"concat({path}, ' (', {rule_label(rules)}, ')') as file",
        f"{path} as file_path",
        "line_no", "line", "match", "rule_id", "pattern", "confidence", "entropy", "context",
        "false as verified",
        "cast(null as string) as verification_reason",
        *extra,
    )


def scan_lines(rows: DataFrame, rules: Sequence[Rule], *, path: str = "path") -> DataFrame:
    """Findings of a table of numbered lines."""
    return as_findings(file_hits(rows, rules, path=path), rules, path=path)


def scan_files(
    files: DataFrame, rules: Sequence[Rule], *, long_lines: str = "keep"
) -> DataFrame:
    """Findings of a table of texts (``path``, ``content``)."""
    return scan_lines(lines(files.select("path", "content"), long_lines=long_lines), rules)
