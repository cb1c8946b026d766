"""Path globs as anchored regexes.

``*`` and ``?`` stay within one path segment, ``[^a]`` negates, a malformed glob
matches nothing.  Regexes are built once, on the driver, from user options.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from credsieve.functions.text import base_name, matches, quote


def glob_to_regex(glob: str, *, one_segment: bool = False) -> str | None:
    """The regex body of a glob, or None when the glob is malformed."""
    guard = "(?!/)" if one_segment else ""
    out, i = [], 0

    def char_at(j: int) -> tuple[str, int] | None:
        if j >= len(glob) or glob[j] in "-]":
            return None
        if glob[j] == "\\":
            j += 1
        return (glob[j], j + 1) if j < len(glob) else None

    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "\\":
            if i >= len(glob):
                return None
            out.append(re.escape(glob[i]))
            i += 1
        elif ch == "[":
            negated = glob[i : i + 1] == "^"
            i += negated
            ranges = []
            while not (ranges and glob[i : i + 1] == "]"):
                low = char_at(i)
                if low is None:
                    return None
                first, i = low
                last = first
                if glob[i : i + 1] == "-":
                    high = char_at(i + 1)
                    if high is None:
                        return None
                    last, i = high
                if first <= last:
                    ranges.append(f"\\x{{{ord(first):x}}}-\\x{{{ord(last):x}}}")
                else:
                    ranges.append("")
            i += 1
            members = "".join(ranges)
            if not members:
                out.append("(?s:.)" if negated else "[^\\x{0}-\\x{10ffff}]")
            else:
                out.append(f"{guard}[{'^' if negated else ''}{members}]")
        else:
            out.append(re.escape(ch))
    return "".join(out)


def full_match(path: str, globs: Iterable[str]) -> str:
    """The glob matches the whole path, or the whole base name."""
    tests = []
    for glob in globs:
        body = glob_to_regex(glob)
        if glob and body is not None:
            tests.append(matches(path, rf"\A(?:{body})\z"))
            tests.append(matches(base_name(path), rf"\A(?:{body})\z"))
    return "(" + (" or ".join(tests) or "false") + ")"


def _below_prefix(path: str, glob: str) -> list[str]:
    if not glob.endswith("/*"):
        return []
    folder = glob[: -len("/*")]
    return [f"startswith({path}, {quote(folder + '/')})", f"({path} = {quote(folder)})"]


def match_any(path: str, globs: Iterable[str]) -> str:
    """Full path, or base name, or anything at or below ``dir`` for ``dir/*``."""
    globs = [g for g in globs if g]
    tests = [full_match(path, globs)]
    for glob in globs:
        tests += _below_prefix(path, glob)
    return "(" + " or ".join(tests) + ")"


def match_any_ancestor(path: str, globs: Iterable[str]) -> str:
    """``match_any`` for the path or for one of the folders it lies in."""
    tests = ["false"]
    for glob in (g for g in globs if g):
        whole, segment = glob_to_regex(glob), glob_to_regex(glob, one_segment=True)
        if whole is not None:
            tests.append(matches(path, rf"\A(?:{whole})(?:/|\z)"))
            if "/" not in glob:
                tests.append(matches(path, rf"(?:\A|/)(?:{segment})(?:/|\z)"))
        tests += _below_prefix(path, glob)
    return "(" + " or ".join(tests) + ")"
