"""First-match rule detection as column expressions.

Testing 189 regexes per line is the one expensive thing this engine does, so a
line passes two gates first.  Both are built from byte searches (``contains``),
which cost about a hundredth of a regex, and both are sound: they never reject a
line some rule matches.

1. Four *arms*, each the necessary condition of one shape of rule.  Lines no arm
   accepts, nearly all prose, are dropped before any rule is tried.
2. On the remaining lines a rule's regex runs only if its arm and one of the
   rule's literals are present.

Lines over ``LINEAR_FROM`` bytes pass the gate and are marked ``LONG_LINE`` in place of a
rule: Java's regexes may need time that grows as their square, so they are matched
elsewhere (``operators.long_lines``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from credsieve.functions.dialect import RE2_SPACE
from credsieve.functions.rules import Rule
from credsieve.functions.score import entropy
from credsieve.functions.text import (
    any_of, contains_any, let, matches, quote, string_array, trim_space,
)

# How the label rules spell the gap between a label and its value.
_SEPARATOR = r"""["'\s:=]+"""

# Every label rule ends its label in one of these words, then separators, then at
# least four characters that are neither space nor quote.
_LABEL_WORDS = ("key", "token", "secret", "password", "azure", "sonar")
_LABEL_VALUE = (
    rf"""(?iu:key|token|secret|password|id|login)["'{RE2_SPACE}:=]+[^"'{RE2_SPACE}]{{4}}"""
)
# Rules whose literal ends in _ or - carry at least 20 more token characters.
_DELIMITED_RUN = r"[_-][A-Za-z0-9_-]{20}"

# Short texts shared by several literals of the literal arm: one search for each
# replaces one for every literal that contains it.
_SHARED_PARTS = ("IA", "AC", "AI", "AAA", "eyJ")

#: Bytes beyond which a line is matched by an automaton.
LINEAR_FROM = 8192
#: Stands for the rule of such a line until then.
LONG_LINE = -2


def is_long_line(line: str) -> str:
    return f"(octet_length({line}) > {LINEAR_FROM})"


def fold(line: str) -> str:
    """The line without case, as case-insensitive rules see it."""
    return f"replace(lower({line}), '\u017f', 's')"


def _has_literal(rule: Rule, line: str, folded: str) -> str:
    return contains_any(folded if rule.ci else line, rule.literals)


def arm_of(rule: Rule) -> str:
    """The shape of a rule, which decides the gate arm it hides behind."""
    if not rule.literals:
        return "free"
    if rule.rule_set == "custom":
        return "literal"
    if _SEPARATOR in rule.regex:
        return "label"
    if "://" in rule.regex:
        return "uri"
    if all(lit[-1] in "_-" for lit in rule.literals):
        return "delimited"
    return "literal"


def _label_arm(rules: Sequence[Rule], line: str, folded: str) -> str:
    return f"({contains_any(folded, _LABEL_WORDS)} and {matches(line, _LABEL_VALUE)})"


def _uri_arm(rules: Sequence[Rule], line: str, folded: str) -> str:
    without_userinfo = [r for r in rules if "@" not in r.regex]
    rest = any_of(
        [contains_any(line, ["@"])] + [_has_literal(r, line, folded) for r in without_userinfo]
    )
    return f"(contains({line}, '://') and {rest})"


def _delimited_arm(rules: Sequence[Rule], line: str, folded: str) -> str:
    return f"({contains_any(line, '_-')} and {matches(line, _DELIMITED_RUN)})"


def _literal_arm(rules: Sequence[Rule], line: str, folded: str) -> str:
    # A one-character literal says too little; there the regex itself is the arm.
    single = [r for r in rules if min(map(len, r.literals)) == 1]
    arms = [f"({_has_literal(r, line, folded)} and {matches(line, r.java)})" for r in single]
    cased: dict[str, None] = {}
    behind: dict[str, list[Rule]] = {"=": [], "/": [], "": []}
    for rule in rules:
        if rule in single:
            continue
        if not rule.ci:
            for lit in rule.literals:
                cased[next((part for part in _SHARED_PARTS if part in lit), lit)] = None
            continue
        # Prose seldom holds these characters, so most lines stop at the first search.
        needs = [ch for ch in ("=", "/") if all(ch in lit for lit in rule.literals)]
        needs += ["="] if r"\s*=" in rule.regex else []
        behind[needs[0] if needs else ""].append(rule)
    if cased:
        arms.append(contains_any(line, cased))
    for ch, hidden in behind.items():
        if hidden:
            named = contains_any(folded, dict.fromkeys(lit for r in hidden for lit in r.literals))
            arms.append(f"(contains({line}, '{ch}') and {named})" if ch else named)
    return any_of(arms)


def _free_arm(rules: Sequence[Rule], line: str, folded: str) -> str:
    return any_of(matches(line, r.java) for r in rules)


_ARMS: dict[str, Callable[[Sequence[Rule], str, str], str]] = {
    "literal": _literal_arm,
    "uri": _uri_arm,
    "label": _label_arm,
    "delimited": _delimited_arm,
    "free": _free_arm,
}


def gate_arms(rules: Sequence[Rule], line: str, folded: str) -> dict[str, str]:
    """One boolean per arm in use; a line some rule matches satisfies its rule's arm."""
    by_arm: dict[str, list[Rule]] = {}
    for rule in rules:
        by_arm.setdefault(arm_of(rule), []).append(rule)
    return {
        name: build(by_arm[name], line, folded)
        for name, build in _ARMS.items()
        if name in by_arm
    }


def _bound(line: str, body: str) -> str:
    """``body`` over ``l``, the line, and ``f``, the line without case."""
    return let("l", line, let("f", fold("l"), body))


def line_gate(rules: Sequence[Rule], line: str) -> str:
    """False only for lines that no rule matches; true for long lines."""
    short = _bound(line, any_of(gate_arms(rules, "l", "f").values()))
    return f"({is_long_line(line)} or {short})"


def _rule_test(rule: Rule, line: str = "l", folded: str = "f", arms: str = "a") -> str:
    test = matches(line, rule.java)
    if rule.literals:
        test = f"({arms}.{arm_of(rule)} and {_has_literal(rule, line, folded)} and {test})"
    return test


def _with_arms(rules: Sequence[Rule], line: str, body: str) -> str:
    return _bound(line, let("a", arms_struct(rules, "l", "f"), body))


def first_rule(rules: Sequence[Rule], line: str) -> str:
    """Index of the first rule, in order, that matches the line; null if none does.

    ``LONG_LINE`` on long lines.
    """
    branches = " ".join(f"when {_rule_test(r)} then {r.rule_idx}" for r in rules)
    return f"if({is_long_line(line)}, {LONG_LINE}, {_with_arms(rules, line, f'case {branches} end')})"


def arms_struct(rules: Sequence[Rule], line: str, folded: str) -> str:
    """All arms of a line as a struct of booleans."""
    return "named_struct({})".format(", ".join(f"{quote(n)}, {cond}" for n, cond in gate_arms(rules, line, folded).items()))


def arm_names(rules: Sequence[Rule]) -> list[str]:
    """The arms in use, as fields of ``arms_struct``."""
    return list(gate_arms(rules, "l", "f"))


def arms_of(rules: Sequence[Rule], line: str, folded: str) -> str:
    """``arms_struct`` over columns, compiled as in ``first_rule_of``; none holds for long lines."""
    none = ", ".join(f"{quote(n)}, l is null" for n in arm_names(rules))
    long = let("l", line, f"named_struct({none})")
    return f"if({is_long_line(line)}, {long}, {arms_struct(rules, line, folded)})"


def first_rule_of(rules: Sequence[Rule], line: str, folded: str, arms: str) -> str:
    """``first_rule`` over columns that hold the line without case and its arms already.

    Spark compiles conditions on columns, but interprets the body of a lambda, where each of
    the two hundred rules costs several times the search that it makes.
    """
    branches = " ".join(
        f"when {_rule_test(r, line, folded, arms)} then {r.rule_idx}" for r in rules
    )
    # The lambda, met on long lines only, keeps Spark from writing all branches into one method,
    # one so large that the JVM would interpret it.
    long = let("l", line, f"if(l is null, null, {LONG_LINE})")
    return f"if({is_long_line(line)}, {long}, case {branches} end)"


def all_rules(rules: Sequence[Rule], line: str) -> str:
    """Indexes of every rule that matches, in rule order; ``LONG_LINE`` alone on long lines."""
    hits = ", ".join(f"if({_rule_test(r)}, {r.rule_idx}, null)" for r in rules)
    short = _with_arms(rules, line, f"array_compact(array({hits}))")
    return f"if({is_long_line(line)}, array({LONG_LINE}), {short})"


def rule_text(rules: Sequence[Rule], idx: str, value: Callable[[Rule], str | None]) -> str:
    """A per-rule string, looked up by rule index in a constant array."""
    return f"get({string_array(value(r) for r in rules)}, {idx})"


def rule_number(rules: Sequence[Rule], idx: str, value: Callable[[Rule], float | None]) -> str:
    """A per-rule number; the same lookup as ``rule_text``."""
    numbers = ("null" if value(r) is None else str(value(r)) for r in rules)
    return f"get(array({', '.join(numbers)}), {idx})"


def matched_group(line: str, regex: str, group: int = 0, found: str | None = None) -> str:
    """Group ``group`` of the leftmost match (0 is all of it); the regex is a column.

    ``found`` is a column of match and groups, where they are known already.
    """
    extracted = f"regexp_extract({line}, {regex}, {group})"
    return f"if({found} is null, {extracted}, coalesce(get({found}, {group}), ''))" if found else extracted


def secret_of(rules: Sequence[Rule], line: str, idx: str, regex: str, found: str | None = None) -> str:
    """The text taken as the secret: the most random capture group, else the match.

    Among trimmed, non-empty groups the higher entropy wins; within 0.01 the one
    with more bytes does.  Entropies are compared rounded, so that the order in
    which their terms were added cannot decide between equals.
    """
    match = matched_group(line, regex, found=found)
    most = max((r.groups for r in rules), default=0)
    if most == 0:
        return match
    n_groups = rule_number(rules, idx, lambda r: r.groups)
    groups = ", ".join(
        f"if(n >= {g}, {trim_space(matched_group(line, regex, g, found))}, '')"
        for g in range(1, most + 1)
    )
    scored = f"transform(array({groups}), g -> struct(g as text, round({entropy('g')}, 9) as ent))"
    better = (
        "g.ent > best.ent or"
        " (abs(g.ent - best.ent) < 0.01D and octet_length(g.text) > octet_length(best.text))"
    )
    best = (
        f"aggregate(filter({scored}, g -> g.text <> ''),"
        " named_struct('text', '', 'ent', -1D),"
        f" (best, g) -> if({better}, g, best), best -> best.text)"
    )
    chosen = f"if(n > 0, coalesce(nullif({best}, ''), {match}), {match})"
    return let("n", n_groups, chosen)
