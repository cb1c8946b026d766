"""Commit history as tables: commits, and the lines a diff adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.functions.text import quote
from credsieve.sources.lines import LONG_LINES, is_long, strip_return, without_long_texts

# Markers of a unified diff.
FILE_HEADER = "+++ b/"
# A hunk header whose first new-file position ("+<number>") is readable.
HUNK_HEADER = r"@@[^ \n]*(?: (?!\+(?!\+\+))[^ \n]*)* \+(?!\+\+)[+-]?[0-9]"
_HUNK_START = r"\A@@[^ \n]*(?: (?!\+(?!\+\+))[^ \n]*)* \+(?!\+\+)([+-]?[0-9]+)"


def parse_commit_log(log: DataFrame, line: str = "value") -> DataFrame:
    """Commits from ``hash|author|date|subject`` lines; shorter lines are dropped.

    The subject keeps any further separators.
    """
    parts = F.split(F.col(line), r"\|", 4)
    return (
        log.select(parts.alias("p"))
        .where("size(p) = 4")
        .selectExpr("p[0] as hash", "p[1] as author", "p[2] as date", "p[3] as message")
    )


def select_commits(
    commits: DataFrame,
    *,
    max_commits: int = 0,
    since: str | None = None,
    reachable: str | None = None,
) -> DataFrame:
    """The newest ``max_commits`` commits (0 is all) since a date, of those a boolean
    column marks reachable."""
    kept = commits.where(reachable) if reachable else commits
    if since:
        kept = kept.where(F.to_timestamp("date") >= F.lit(since).cast("timestamp"))
    if max_commits > 0:
        kept = kept.orderBy(F.desc(F.to_timestamp("date")), "hash").limit(max_commits)
    return kept


def added_lines(
    diffs: DataFrame, *, diff: str = "diff", long_lines: str = "keep"
) -> DataFrame:
    """Lines a diff adds: the other columns, ``path``, ``line_no``, ``line``.

    A diff splits into file sections, a section into hunks, a hunk into lines, each
    by ``posexplode`` of its own text; the position among a hunk's ``+`` lines is the
    running count.  So a commit of any size needs no window and no shuffle.

    ``line_no`` counts from the header's number before it is used, hence is one more
    than the true line, which ``line_no_true`` gives.
    """
    if long_lines not in LONG_LINES:
        raise ValueError(f"long_lines must be one of {LONG_LINES}")
    if long_lines == "file":
        diffs = without_long_texts(diffs, diff)
    keys = [c for c in diffs.columns if c != diff]
    file_split = r"\n(?=\+\+\+ b/)"
    hunk_split = rf"\n(?={HUNK_HEADER})"
    has_header = f"startswith(section, {quote(FILE_HEADER)})"
    name = f"substring(split_part(section, '\\n', 1), {len(FILE_HEADER) + 1})"
    sections = diffs.selectExpr(
        *keys, f"posexplode(split({diff}, {quote(file_split)})) as (file_seq, section)"
    ).selectExpr(*keys, "file_seq", f"if({has_header}, {strip_return(name)}, '') as path", "section")
    hunks = sections.selectExpr(
        *keys, "file_seq", "path", f"posexplode(split(section, {quote(hunk_split)})) as (hunk, body)"
    )
    start = f"regexp_extract(body, {quote(_HUNK_START)}, 1)"
    plus = "filter(split(body, '\\n'), raw -> startswith(raw, '+') and not startswith(raw, '+++ b/'))"
    rows = hunks.selectExpr(
        *keys,
        "file_seq",
        "path",
        "hunk",
        f"coalesce(try_cast({start} as bigint), 0L) as hunk_start",
        f"posexplode({plus}) as (pos, raw)",
    ).where("not startswith(raw, '+++')")
    if long_lines == "skip":
        rows = rows.where(f"not {is_long('raw')}")
    return rows.selectExpr(
        *keys,
        "file_seq",
        "hunk",
        "path",
        "hunk_start + pos + 1 as line_no",
        "hunk_start + pos as line_no_true",
        f"{strip_return('substring(raw, 2)')} as line",
    )
