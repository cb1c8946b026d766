"""Detection over commit history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.functions import detect as D
from credsieve.functions.rules import Rule
from credsieve.functions.text import pin
from credsieve.operators.joins import skewed_join
from credsieve.operators.long_lines import FOUND
from credsieve.operators.scan import owned, score, with_rule
from credsieve.sources.history import added_lines, select_commits

def history_hits(
    diffs: DataFrame, rules: Sequence[Rule], *, long_lines: str = "keep"
) -> DataFrame:
    """Scored hits on added lines.  Unlike file scans: whole matches, regex lines
    included, low hits kept."""
    hits = with_rule(owned(added_lines(diffs, long_lines=long_lines), rules), rules)
    hits = pin(hits, match=D.matched_group("line", "_regex", found=FOUND))
    return score(hits.drop("_regex", FOUND), rules)


def scan_history(
    commits: DataFrame,
    diffs: DataFrame,
    rules: Sequence[Rule],
    *,
    max_commits: int = 0,
    since: str | None = None,
    reachable: str | None = None,
    long_lines: str = "keep",
) -> DataFrame:
    """Findings of ``diffs`` (``commit_hash``, ``diff``) in the selected ``commits``.

    Diffs of other commits are dropped before they are decoded, where anything is
    selected; the rest are scanned, and hits, a small fraction, meet their commit.
    """
    chosen = select_commits(
        commits, max_commits=max_commits, since=since, reachable=reachable
    ).select(F.col("hash").alias("commit_hash"), "author")
    diffs = diffs.select("commit_hash", "diff")
    if max_commits > 0 or since or reachable:
        diffs = diffs.join(chosen.select("commit_hash"), "commit_hash", "left_semi")
    hits = skewed_join(history_hits(diffs, rules, long_lines=long_lines), chosen, ["commit_hash"], "inner")
    short = "substring(commit_hash, 1, 8)"
    return hits.selectExpr(
        "path as file",
        f"concat(path, '@', {short}) as file_path",
        "line_no",
        "line",
        "match",
        "rule_id",
        "pattern",
        "confidence",
        "entropy",
        f"concat(context, ' (commit: ', {short}, ' by ', author, ')') as context",
        "false as verified",
        "cast(null as string) as verification_reason",
    )


def all_findings(file_findings: DataFrame, history_findings: DataFrame) -> DataFrame:
    """Both phases in one table, marked by ``origin``."""
    return file_findings.withColumn("origin", F.lit("files")).unionByName(
        history_findings.withColumn("origin", F.lit("history"))
    )
