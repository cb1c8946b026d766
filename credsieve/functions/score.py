"""Scoring of a hit: entropy, where it occurs, and the confidence both give."""

from __future__ import annotations

from credsieve.functions.text import (
    any_of, contains_any, ends_with_any, let, lower_path, matches, quote, trim_space,
)

# ---------------------------------------------------------------------------
# Context markers, entropy bands and score weights.
# ---------------------------------------------------------------------------
DOC_SUFFIXES = (".md", ".rst", ".adoc", ".txt")
DOC_DIRS = ("/docs/", "\\docs\\")
TEST_SUFFIXES = (
    "_test.go", "_test.ts", "_test.tsx", "_test.js", "_test.jsx",
    ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx",
)
TEST_DIRS = ("/test/", "/tests/", "\\test\\", "\\tests\\")
COMMENT_STARTS = ("//", "#")
COMMENT_MARKS = ("/*", "*/", "<!--", "-->")
BRACE_PLACEHOLDER = r"\$\{[^}]+\}"
# Tested on letters of either case; dotless i and long s upper-case to ASCII.
PERCENT_PLACEHOLDER = "%[A-Za-z0-9_\u0131\u017f]+%"
DOLLAR_PLACEHOLDER = "\\$[A-Za-z0-9_\u0131\u017f]"
TEMPLATE_MARKS = ("YOUR_", "REPLACE_", "INSERT_", "CHANGE_ME")

BASE_SCORE = 50
ENTROPY_BANDS = ((4.5, 30), (4.0, 20), (3.5, 10))
LOW_ENTROPY_SCORE = -10
CONTEXT_SCORES = {
    "comment": -30, "documentation": -35, "placeholder": -50, "template": -45, "code": 10,
}
CONFIDENCE_FLOORS = ((80, "critical"), (60, "high"), (40, "medium"))
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def entropy(text: str) -> str:
    """Shannon entropy: frequencies per character, over the length in bytes."""
    shares = (
        "transform(array_distinct(split(t, '')),"
        " c -> (char_length(t) - char_length(replace(t, c, ''))) / cast(octet_length(t) as double))"
    )
    total = f"aggregate({shares}, 0D, (sum, share) -> sum - share * log2(share))"
    return let("t", text, f"case when t = '' then 0D else {total} end")


def context(path: str, line: str) -> str:
    """Where a hit occurs; the first condition that holds names the context."""
    chain = let("b", "rtrim('/', p)", context_of("p", "b", "l"))
    return let("p", lower_path(path), let("l", line, chain))


def context_of(lowered: str, bare: str, line: str) -> str:
    """``context`` over columns: the path in lower case, the same without slashes at its end, the line."""
    trimmed = trim_space(line)
    branches = {
        "documentation": any_of((ends_with_any(lowered, DOC_SUFFIXES), contains_any(lowered, DOC_DIRS))),
        "test_file": any_of((ends_with_any(bare, TEST_SUFFIXES), contains_any(lowered, TEST_DIRS))),
        # Trimming costs more than the search that says there is no need of it.
        "comment": any_of(
            [f"(contains({line}, {quote(m)}) and startswith({trimmed}, {quote(m)}))" for m in COMMENT_STARTS]
            + [contains_any(line, COMMENT_MARKS)]
        ),
        "placeholder": any_of(
            f"(contains({line}, {quote(sign)}) and {matches(text, regex)})"
            for sign, text, regex in (
                # Up to the last closing brace, before which no opening one is in vain.
                ("${", f"left({line}, char_length({line}) - char_length(substring_index({line}, '}}', -1)))", BRACE_PLACEHOLDER),
                ("%", line, PERCENT_PLACEHOLDER),
                ("$", line, DOLLAR_PLACEHOLDER),
            )
        ),
        "template": contains_any(line, TEMPLATE_MARKS),
    }
    cases = " ".join(f"when {test} then {quote(name)}" for name, test in branches.items())
    return f"case {cases} else 'code' end"


def confidence(ent: str, ctx: str, boost: str = "0") -> str:
    bands = " ".join(f"when {ent} > {floor}D then {pts}" for floor, pts in ENTROPY_BANDS)
    places = " ".join(f"when {quote(c)} then {pts}" for c, pts in CONTEXT_SCORES.items())
    points = (
        f"{BASE_SCORE} + (case {bands} else {LOW_ENTROPY_SCORE} end)"
        f" + (case {ctx} {places} else 0 end) + {boost}"
    )
    floors = " ".join(f"when s >= {floor} then {quote(c)}" for floor, c in CONFIDENCE_FLOORS)
    return let("s", points, f"case {floors} else 'low' end")


def severity(level: str) -> str:
    """critical 4, high 3, medium 2, low 1, anything else 0; without case."""
    cases = " ".join(f"when {quote(name)} then {rank}" for name, rank in SEVERITY.items())
    return f"(case lower({level}) {cases} else 0 end)"
