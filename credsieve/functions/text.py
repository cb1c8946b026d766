"""SQL building blocks: quoting, binding, and string helpers.

Throughout ``credsieve.functions`` a function takes SQL expressions as text and
returns one; operators hand the result to ``F.expr``.  Two hundred rules make
expressions of several thousand nodes, and parsing one string is far cheaper than
as many calls into the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The characters with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def quote(value: str) -> str:
    """A SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + escaped.replace("\n", "\\n").replace("\r", "\\r") + "'"


def string_array(values: Iterable[str | None]) -> str:
    return "array(" + ", ".join("null" if v is None else quote(v) for v in values) + ")"


def any_of(conditions: Iterable[str]) -> str:
    return "(" + " or ".join(conditions) + ")"


def contains_any(text: str, marks: Iterable[str]) -> str:
    return any_of(f"contains({text}, {quote(m)})" for m in marks)


def ends_with_any(text: str, marks: Iterable[str]) -> str:
    return any_of(f"endswith({text}, {quote(m)})" for m in marks)


def matches(text: str, regex: str) -> str:
    return f"({text} rlike {quote(regex)})"


def let(name: str, value: str, body: str) -> str:
    """``body``, in which ``name`` is ``value``, evaluated once per row.

    A plain column would be copied into every place that uses it as soon as the
    optimizer merges projections and pushes filters down.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def pin(rows: DataFrame, **columns: str) -> DataFrame:
    """Add columns that are computed exactly once per row.

    They pass through a one-row ``inline``, which filters and projections are not
    pushed through, so nothing downstream evaluates them again.  They are computed in a
    projection before it: Spark compiles that, but interprets what a generator holds.
    """
    held = unused(rows, "pinned")
    struct = ", ".join(f"{value} as {name}" for name, value in columns.items())
    computed = rows.select("*", F.expr(f"struct({struct})").alias(held))
    return computed.select("*", F.expr(f"inline(array({held}))")).drop(held)


def unused(rows: DataFrame, name: str) -> str:
    """A name that no column of the rows has."""
    held = {c.lower() for c in rows.columns}
    while name in held:
        name = "_" + name
    return name


def trim_space(text: str) -> str:
    """Trim Unicode white space, not just blanks, on both sides."""
    return f"btrim({text}, {quote(WHITE_SPACE)})"


def lower_path(path: str) -> str:
    """Lower case, letter by letter (a dotted capital I becomes a plain i)."""
    return f"lower(replace({path}, '\u0130', 'i'))"


def base_name(path: str) -> str:
    return f"substring_index(rtrim('/', {path}), '/', -1)"


def extension(path: str) -> str:
    """From the last dot of the base name, dot included; ``.env`` is all extension."""
    return f"regexp_extract({lower_path(base_name(path))}, '([.][^.]*)$', 1)"
