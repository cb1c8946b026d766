"""Texts to numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Fixed value: a line of this many bytes or more does not fit the line buffer.
LINE_LIMIT = 1024 * 1024

LONG_LINES = ("skip", "file", "keep")


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when the input is a few small files.

    A small file is often one row group, so its splits are one full task and some
    empty ones.  Only an input with fewer than two splits per core, that is a small
    one, is shuffled; a large scan has more and stays as it is.  Rows are the same
    either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def raw_lines(content: str) -> str:
    """All lines as an array, none for an empty text; a final newline does not start
    another line."""
    body = (
        f"if(endswith({content}, '\\n'),"
        f" substring({content}, 1, char_length({content}) - 1), {content})"
    )
    return f"if({content} = '', cast(array() as array<string>), split({body}, '\\n'))"


def strip_return(raw: str) -> str:
    return f"if(endswith({raw}, '\\r'), substring({raw}, 1, char_length({raw}) - 1), {raw})"


def is_long(raw: str) -> str:
    return f"(octet_length({raw}) >= {LINE_LIMIT})"


def without_long_texts(df: DataFrame, content: str) -> DataFrame:
    """Drop whole texts that hold a line over the limit."""
    return df.where(f"not exists({raw_lines(content)}, raw -> {is_long('raw')})")


def lines(files: DataFrame, *, content: str = "content", long_lines: str = "keep") -> DataFrame:
    """One row per line: the other columns, ``line_no`` from 1, ``line``.

    ``long_lines`` says what happens to lines over 1 MiB: ``keep`` keeps them, ``skip``
    drops the line, ``file`` drops every line of its text; ``long_line_counts`` lists what
    the last two leave out.  The work stays
    within each input row; nothing is shuffled.
    """
    if long_lines not in LONG_LINES:
        raise ValueError(f"long_lines must be one of {LONG_LINES}")
    if long_lines == "file":
        files = without_long_texts(files, content)
    keys = [c for c in files.columns if c != content]
    out = files.selectExpr(*keys, f"posexplode({raw_lines(content)}) as (pos, raw)")
    if long_lines == "skip":
        out = out.where(f"not {is_long('raw')}")
    return out.selectExpr(*keys, "pos + 1 as line_no", f"{strip_return('raw')} as line")


def long_line_counts(files: DataFrame, *, content: str = "content") -> DataFrame:
    """Texts holding lines over the limit, with how many; nothing else is lost by ``skip``."""
    keys = [c for c in files.columns if c != content]
    counted = f"size(filter({raw_lines(content)}, raw -> {is_long('raw')})) as long_lines"
    return files.selectExpr(*keys, counted).where("long_lines > 0")
