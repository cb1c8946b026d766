"""Verification of findings: code around them, verdicts, and merging both in."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.functions import verdict as V
from credsieve.functions.identity import finding_key
from credsieve.functions.rules import Rule
from credsieve.functions.text import extension, pin, quote, trim_space
from credsieve.functions.vectors import embedding
from credsieve.operators.scan import as_findings, file_hits
from credsieve.operators.similarity import THRESHOLD, TOP_K, with_neighbours
from credsieve.sources.lines import LONG_LINES, is_long, raw_lines, strip_return, without_long_texts
from credsieve.sources.store import content_tie, store_rows, upsert

CONTEXT_LINES = 5

_KEY = finding_key("file_path", "line_no", "rule_id")


def code_structure(files: DataFrame) -> DataFrame:
    """Per file: language, function-like and import-like lines in order, test or not.

    Works within each row; a file's lines are never regrouped.
    """
    trimmed = f"transform(split(content, '\\n'), raw -> {trim_space('raw')})"
    return files.selectExpr(
        "path",
        f"{V.language(extension('path'))} as language",
        f"filter({trimmed}, t -> {V.is_function_line('t')}) as functions",
        f"filter({trimmed}, t -> {V.is_import_line('t')}) as imports",
        f"{V.is_test_path('path')} as is_test",
    )


def lines_with_code(files: DataFrame, *, context_lines: int = CONTEXT_LINES, long_lines: str = "keep") -> DataFrame:
    """All lines with their neighbours (``code``), the first function-like line of the file
    (``function``) and its ``language``.

    Neighbours are cut out of the file's own line array, before a line is looked at: rules
    are then tested on columns, where Spark compiles them, and not on the array, where it
    interprets them.  An array holds places of lines alone; texts are joined line by line.
    """
    n = context_lines
    first = "greatest(s.line_no - {0}, 1)".format(n)
    around = f"slice(every, {first}, s.line_no + {n} - {first} + 1)"
    if long_lines not in LONG_LINES:
        raise ValueError(f"long_lines must be one of {LONG_LINES}")
    if long_lines == "file":
        files = without_long_texts(files, "content")
    chosen = f"filter(numbered, s -> not {is_long('s.raw')})" if long_lines == "skip" else "numbered"
    # What is on a trimmed line is on the line: few have to be trimmed.
    marked = f"filter(every, raw -> {V.is_function_line('raw')})"
    functions = f"filter(transform({marked}, raw -> {trim_space('raw')}), t -> {V.is_function_line('t')})"
    numbered = (
        f"transform({raw_lines('content')},"
        f" (raw, i) -> struct(i + 1 as line_no, raw, {strip_return('raw')} as line))"
    )
    texts = files.selectExpr(
        "path", f"{numbered} as numbered", "split(content, '\\n') as every"
    )
    cut = texts.selectExpr(
        "path",
        f"coalesce(get({functions}, 0), 'unknown') as function",
        f"inline(transform({chosen}, s -> struct(s.line_no, s.line, {around} as around)))",
    )
    joined = cut.selectExpr("path", "function", "line_no", "line", "array_join(around, '\\n') as code")
    return joined.withColumn("language", F.expr(V.language(extension("path"))))


def scan_with_code(
    files: DataFrame, rules: Sequence[Rule], *, long_lines: str = "keep"
) -> DataFrame:
    """File findings with ``code``, ``function``, ``language`` and their ``finding_key``."""
    hits = file_hits(lines_with_code(files, long_lines=long_lines), rules)
    found = as_findings(hits, rules, extra=("code", "function", "language"))
    return found.withColumn("finding_key", F.expr(_KEY))


def prompt_of_finding() -> str:
    return V.prompt(
        file="file_path", language="language", function="function", line_no="line_no",
        code="code", pattern="pattern", match="match", entropy="entropy",
        context="context", confidence="confidence",
    )


def requests(findings: DataFrame) -> DataFrame:
    """(``finding_key``, ``prompt``) for an external verifier to answer offline."""
    return findings.selectExpr("finding_key", f"{prompt_of_finding()} as prompt")


def decode_responses(responses: DataFrame) -> DataFrame:
    """Verdicts of the (``finding_key``, ``content``) rows that hold one."""
    decoded = pin(responses, verdict=V.response("content"))
    return decoded.where("verdict is not null").selectExpr("finding_key", "verdict.*")


def heuristic_verdicts(findings: DataFrame) -> DataFrame:
    """The default verifier: findings with a ``verdict`` struct."""
    return pin(findings, verdict=V.heuristic())


def batch_verdicts(findings: DataFrame, contexts: DataFrame) -> DataFrame:
    """Verdicts for findings and their contexts, paired by ``finding_key``; both sides
    must pair up completely, each key once.

    The pairing is checked first, by keys alone and in one job; a key that is missing or
    repeated on either side is an error.
    """
    key = "finding_key"
    sides = [df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((findings, "one"), (contexts, "two"))]
    if not sides[0].join(sides[1], key, "full").where("coalesce(one, 0) <> 1 or coalesce(two, 0) <> 1").isEmpty():
        raise ValueError("findings and contexts must have same length")
    return heuristic_verdicts(findings.join(contexts, key))


def disabled_verdicts(findings: DataFrame) -> DataFrame:
    return findings.withColumn("verdict", F.expr(V.disabled()))


def given_verdicts(verdicts: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A verifier that takes decoded verdicts by ``finding_key`` and falls back to the
    heuristic where there is none.  Of several verdicts on one key the least counts."""
    fields = ("is_real_secret", "confidence", "reasoning", "recommendation")
    given = verdicts.groupBy("finding_key").agg(F.min(F.struct(*fields)).alias("_given"))

    def verify(findings: DataFrame) -> DataFrame:
        judged = heuristic_verdicts(findings.join(given, "finding_key", "left"))
        return judged.withColumn("verdict", F.coalesce("_given", "verdict")).drop("_given")

    return verify


def reuse_verdicts(
    findings: DataFrame, store: DataFrame, *, threshold: float = THRESHOLD, k: int = TOP_K
) -> DataFrame:
    """Add ``embedding`` and ``reused``, the verdict taken from the most similar
    verified row of the store, null where none is similar enough."""
    near = with_neighbours(
        pin(findings, embedding=embedding("line")), store, threshold=threshold, k=k
    )
    reused = (
        "if(size(neighbours) = 0, null, struct(true as is_real_secret,"
        " neighbours[0].confidence as confidence,"
        f" concat({quote(V.REASON_REUSED)}, neighbours[0].file_path) as reasoning,"
        f" {quote(V.RECOMMEND_REUSED)} as recommendation))"
    )
    return pin(near, reused=reused).drop("neighbours")


def merge_verdicts(findings: DataFrame) -> DataFrame:
    """Findings with their ``verdict`` applied.  Verdicts advise: no finding is dropped,
    and one without a verdict stays as detected, unverified."""
    return findings.withColumns(
        {
            "file": F.expr("if(verdict is null, file, concat(file, ' [LLM: ', verdict.reasoning, ']'))"),
            "confidence": F.expr("coalesce(verdict.confidence, confidence)"),
            "verified": F.expr("coalesce(verdict.is_real_secret, false)"),
            "verification_reason": F.expr("nullif(verdict.reasoning, '')"),
        }
    )


def verify(
    findings: DataFrame,
    *,
    store: DataFrame | None = None,
    verifier: Callable[[DataFrame], DataFrame] = heuristic_verdicts,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Judge findings of ``scan_with_code``: reuse a verdict from the store as it was
    when the job began, else ask ``verifier``; then merge."""
    if store is None:
        return merge_verdicts(verifier(findings))
    judged = verifier(reuse_verdicts(findings, store, threshold=threshold))
    return merge_verdicts(judged.withColumn("verdict", F.coalesce("reused", "verdict")))


def without_vectors(verified: DataFrame, *, ephemeral: bool = False) -> DataFrame:
    """Judged findings as they are kept for ``grown_store``: a vector follows from the line and is
    many times as large, so only what ties are broken by is kept of it."""
    return verified.withColumn("_tie", F.expr(content_tie("embedding", ephemeral=ephemeral))).drop("embedding")


def grown_store(store: DataFrame, verified: DataFrame, *, ephemeral: bool = False) -> DataFrame:
    """Store plus the findings that got a verdict of their own; reused ones are not
    stored again.  Findings of ``without_vectors`` get theirs anew, those that stay."""
    own = verified.where("reused is null")
    if "embedding" not in own.columns:
        rows = store_rows(own, "cast(null as array<float>)", ephemeral=ephemeral, extra=("line as _text", "_tie"))
        return upsert(store, rows, vectors=embedding("_text"))
    return upsert(store, store_rows(own, "embedding", ephemeral=ephemeral))
