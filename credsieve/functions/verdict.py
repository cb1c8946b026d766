"""Verdicts on findings: heuristic rules, prompts, and decoding of responses."""

from __future__ import annotations

from credsieve.functions.score import PERCENT_PLACEHOLDER
from credsieve.functions.text import (
    any_of, contains_any, ends_with_any, let, lower_path, matches, quote, trim_space,
)

# ---------------------------------------------------------------------------
# Markers and texts of the heuristic verdict.
# ---------------------------------------------------------------------------
DOC_SUFFIXES = (".md", ".rst")
DOC_DIR = "/docs/"
# Without case; dotless i and long s count as I and S.
PLACEHOLDER_WORDS = "(?i)YOUR_|REPLACE_|EXAMPLE_|CHANGE_ME|[iı]N[sſ]ERT_"
ENVIRONMENT_MARKS = ("os.Getenv", "process.env", "${")
LOW_ENTROPY = 3.0
HIGH_ENTROPY = 4.5
REASON_DOC = "Found in documentation"
REASON_PLACEHOLDER = "Contains placeholder text"
REASON_ENVIRONMENT = "Uses environment variable pattern"
REASON_ADDRESS = "Reserved IP/address (not a secret)"
REASON_COMMENT = "Found in comment or documentation"
RECOMMEND_REVIEW = "Review and remove if confirmed as secret"
RECOMMEND_DOUBT = "Likely false positive, but verify manually"
REASON_DISABLED = "Verification pipeline disabled"
RECOMMEND_DISABLED = "Review manually"
REASON_REUSED = "Similar to previously verified finding in "
RECOMMEND_REUSED = "Review and remove"

# The request for an external verdict.
PROMPT = """You are a security expert analyzing code for secrets.

Context:
- File: {file}
- Language: {language}
- Function: {function}
- Line: {line_no}

Matched line (exact line that triggered the detection):
```
{code}
```

Pattern detected: {pattern}
Matched value: {match}
Entropy: {entropy}
Context type: {context}
Initial confidence: {confidence}

Question: Is this a real secret that should be reported, or a false positive?

Consider:
1. Is the value hardcoded or from an environment variable?
2. Does the value format match a real secret pattern?
3. Is the entropy high enough to be a real secret?
4. Could this be example/template code?
5. Is the pattern in a sensitive location?
6. Are there indicators this is a placeholder (YOUR_, REPLACE_, etc.)?

Use only the matched line above; do not infer beyond what is shown.
Answer with JSON only, no code fences or extra text:
{{
  "is_real_secret": true/false,
  "confidence": "low"/"medium"/"high"/"critical",
  "reasoning": "brief explanation",
  "recommendation": "what to do"
}}"""

VERDICT_FIELDS = "is_real_secret boolean, confidence string, reasoning string, recommendation string"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"\A(?:::(?:0{{1,4}}:)*[Ff]{{4}}:)?(?:{_OCTET}[.]){{3}}{_OCTET}\z"
_LOOPBACK_V6 = (
    r"\A(?:(?:0{1,4}:){7}|(?:0{1,4}(?::0{1,4}){0,5})?::(?:0{1,4}:){0,5})0{0,3}1\z"
)


def two_decimals(number: str) -> str:
    """Two decimals, an exact half going to the even digit."""
    return f"format_string('%.2f', bround({number}, 2))"


def is_reserved_address(text: str) -> str:
    """0.0.0.0, loopback (v4 and v6), 10/8, 172.16/12, 192.168/16."""
    octet = "cast(split(substring_index(a, ':', -1), '[.]')[{}] as int)".format
    private = any_of(
        (
            f"{octet(0)} in (10, 127)",
            f"({octet(0)} = 172 and {octet(1)} between 16 and 31)",
            f"({octet(0)} = 192 and {octet(1)} = 168)",
        )
    )
    quad = f"({matches('a', _QUAD)} and {private})"
    tests = any_of(("a = '0.0.0.0'", quad, matches("a", _LOOPBACK_V6)))
    return let("a", trim_space(text), tests)


def heuristic(
    path: str = "file_path",
    line: str = "line",
    match: str = "match",
    entropy: str = "entropy",
    context: str = "context",
    confidence: str = "confidence",
) -> str:
    """Struct of the verdict.  Later conditions overrule earlier ones, so the nested
    cases below test them last to first; reasons are listed first to last."""
    lowered = lower_path(path)
    conditions = {
        "doc": any_of((ends_with_any(lowered, DOC_SUFFIXES), contains_any(lowered, [DOC_DIR]))),
        "placeholder": matches(line, PLACEHOLDER_WORDS),
        "environment": any_of(
            (contains_any(line, ENVIRONMENT_MARKS), matches(line, PERCENT_PLACEHOLDER))
        ),
        "address": is_reserved_address(match),
        "dull": f"{entropy} < {LOW_ENTROPY}D",
        "random": f"({entropy} > {HIGH_ENTROPY}D and {context} = 'code')",
        "remark": f"{context} in ('comment', 'documentation')",
    }
    flags = ", ".join(f"{cond} as {name}" for name, cond in conditions.items())
    real = (
        "case when h.remark then false when h.random then true"
        " else not (h.doc or h.placeholder or h.environment or h.address or h.dull) end"
    )
    level = (
        "case when h.remark then 'low' when h.random then 'critical'"
        f" when h.doc or h.placeholder or h.address or h.dull then 'low' else {confidence} end"
    )
    reasons = {
        "doc": quote(REASON_DOC),
        "placeholder": quote(REASON_PLACEHOLDER),
        "environment": quote(REASON_ENVIRONMENT),
        "address": quote(REASON_ADDRESS),
        "dull": f"concat('Low entropy (', {two_decimals(entropy)}, ')')",
        "random": f"concat('High entropy (', {two_decimals(entropy)}, ') in code')",
        "remark": quote(REASON_COMMENT),
    }
    why = ", ".join(f"if(h.{name}, {text}, null)" for name, text in reasons.items())
    verdict = (
        f"struct(r as is_real_secret, {level} as confidence, concat_ws('; ', {why}) as reasoning,"
        f" if(r, {quote(RECOMMEND_REVIEW)}, {quote(RECOMMEND_DOUBT)}) as recommendation)"
    )
    return let("h", f"struct({flags})", let("r", real, verdict))


def disabled(confidence: str = "confidence") -> str:
    """The verdict when verification is off: real, confidence unchanged."""
    return (
        f"struct(true as is_real_secret, {confidence} as confidence,"
        f" {quote(REASON_DISABLED)} as reasoning, {quote(RECOMMEND_DISABLED)} as recommendation)"
    )


def prompt(**values: str) -> str:
    """The request text; keyword arguments are SQL expressions for its fields."""
    pieces, rest = [], PROMPT
    for name in (
        "file", "language", "function", "line_no", "code",
        "pattern", "match", "entropy", "context", "confidence",
    ):
        before, rest = rest.split("{" + name + "}", 1)
        value = two_decimals(values[name]) if name == "entropy" else f"cast({values[name]} as string)"
        pieces += [quote(before), value]
    pieces.append(quote(rest.replace("{{", "{").replace("}}", "}")))
    return f"concat({', '.join(pieces)})"


def response(content: str) -> str:
    """The verdict struct a response text holds; null when it holds none.

    Code fences come off, the rest must start with ``{``; up to the last ``}`` it is
    JSON.  A field of the wrong type spoils the whole, an absent one is false or ''.
    """
    bare = trim_space(
        f"regexp_replace(regexp_replace(regexp_replace({trim_space(content)},"
        " '^```json', ''), '^```', ''), '```$', '')"
    )
    last = "char_length(t) - instr(reverse(t), '}') + 1"
    parsed = (
        f"from_json(substring(t, 1, {last}), '{VERDICT_FIELDS}, broken string',"
        " map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', 'broken'))"
    )
    verdict = (
        "struct(coalesce(v.is_real_secret, false) as is_real_secret,"
        " coalesce(v.confidence, '') as confidence, coalesce(v.reasoning, '') as reasoning,"
        " coalesce(v.recommendation, '') as recommendation)"
    )
    decoded = let("v", parsed, f"if(v is null or v.broken is not null, null, {verdict})")
    usable = "startswith(t, '{') and contains(t, '}')"
    return let("t", bare, f"if({usable}, {decoded}, null)")


# ---------------------------------------------------------------------------
# Languages by extension, and what counts as code structure.
# ---------------------------------------------------------------------------
LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java",
    ".c": "c", ".cpp": "cpp", ".rs": "rust", ".rb": "ruby", ".php": "php", ".sh": "bash",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json",
}
FUNCTION_MARKS = ("func ", "def ", "function ")
IMPORT_STARTS = ("import ", "from ", "require(")
TEST_MARKS = ("test", "spec")


def language(ext: str) -> str:
    """Language of a file extension, ``unknown`` if it is not listed."""
    names = ", ".join(f"{quote(e)}, {quote(name)}" for e, name in LANGUAGES.items())
    return f"coalesce(map({names})[{ext}], 'unknown')"


def is_function_line(trimmed: str) -> str:
    return contains_any(trimmed, FUNCTION_MARKS)


def is_import_line(trimmed: str) -> str:
    return any_of(f"startswith({trimmed}, {quote(m)})" for m in IMPORT_STARTS)


def is_test_path(path: str) -> str:
    return contains_any(lower_path(path), TEST_MARKS)
