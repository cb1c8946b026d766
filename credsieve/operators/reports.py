"""Reports: redaction, summaries, gate, JSON and SARIF documents.

Nothing here gathers findings into one row or one task.  A document is a table of
text lines; written in order, its parts concatenate to the document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.functions import detect as D
from credsieve.functions.rules import Rule
from credsieve.functions.score import SEVERITY, severity
from credsieve.functions.text import let, quote
from credsieve.operators.filters import at_least
from credsieve.operators.long_lines import holds_long_line, redact_long
from credsieve.operators.order import numbered
from credsieve.sources.baseline import VERSION
from credsieve.sources.lines import raw_lines

MASK = "****REDACTED****"
TOOL = "credsieve"
MODES = ("detect", "protect", "report")

# SARIF version, levels by confidence, and the message text.
SARIF_VERSION = "2.1.0"
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
SARIF_OTHER_LEVEL = "warning"
SARIF_MESSAGE = ("Potential secret detected (", ")")

# Section titles and closing line of the readable report.
ADVICE = "Please review and remove them before committing your code."
TITLES = {
    "critical": "=== CRITICAL FINDINGS ===", "high": "=== HIGH CONFIDENCE ===", "medium": "=== MEDIUM CONFIDENCE ===",
}

# Fixed value: findings are reported in this order.
REPORT_ORDER = ("file_path", "line_no", "rule_id", "match")


def redact(findings: DataFrame, enabled: bool = True) -> DataFrame:
    """Mask the match, and every occurrence of it in its line."""
    if not enabled:
        return findings
    mask = quote(MASK)
    return findings.withColumns(
        {
            "line": F.expr(f"if(match = '', line, replace(line, match, {mask}))"),
            "match": F.expr(f"if(match = '', match, {mask})"),
        }
    )


def _match_spans(line: str, regex: str) -> str:
    """(s, e) of every match of a regex, from the pieces between matches."""
    found, pieces = f"regexp_extract_all({line}, {regex}, 0)", f"split({line}, {regex})"
    begun = "b.at + char_length(get(p, i))"
    step = (
        f"named_struct('at', {begun} + char_length(get(m, i)),"
        f" 'spans', concat(b.spans, array(named_struct('s', {begun}, 'e', {begun} + char_length(get(m, i))))))"
    )
    none = "cast(array() as array<struct<s: int, e: int>>)"
    walked = (
        f"if(size(m) = 0, {none}, aggregate(sequence(0, size(m) - 1),"
        f" named_struct('at', 0, 'spans', {none}), (b, i) -> {step}, b -> b.spans))"
    )
    return let("m", found, let("p", pieces, walked))


def redacted_line(rules: Sequence[Rule], line: str) -> str:
    """The line with everything masked that any rule matches on it.

    All matches are found on the line as it is; where they overlap or touch, one mask
    stands for all of them, so a wider match leaves no rest behind a narrower one.
    """
    regex = D.rule_text(rules, "r", lambda r: r.java)
    spans = f"array_sort(flatten(transform({D.all_rules(rules, line)}, r -> {_match_spans(line, regex)})))"
    last = "element_at(u, -1)"
    joined = (
        f"concat(slice(u, 1, size(u) - 1), array(named_struct('s', {last}.s, 'e', greatest({last}.e, x.e))))"
    )
    # ``get`` of an empty list is null where ``element_at`` would fail.
    meets = "size(u) > 0 and x.s <= get(u, size(u) - 1).e"
    union = (
        f"aggregate({spans}, cast(array() as array<struct<s: int, e: int>>),"
        f" (u, x) -> if({meets}, {joined}, concat(u, array(x))))"
    )
    masked = (
        f"aggregate({union}, named_struct('at', 0, 'text', ''),"
        f" (b, x) -> named_struct('at', x.e, 'text',"
        f" concat(b.text, substring({line}, b.at + 1, x.s - b.at), {quote(MASK)})),"
        f" b -> concat(b.text, substring({line}, b.at + 1)))"
    )
    return f"if({D.line_gate(rules, line)}, {masked}, {line})"


def redact_texts(files: DataFrame, rules: Sequence[Rule], content: str = "content") -> DataFrame:
    """Whole texts with all matches masked; each text is rewritten in place.

    Texts that hold long lines are told apart first; those lines are masked on their own.
    """
    line = f"if({D.is_long_line('raw')}, raw, {redacted_line(rules, 'raw')})"
    ending = f"if(endswith({content}, '\\n'), '\\n', '')"
    short = F.expr(f"concat(array_join(transform({raw_lines(content)}, raw -> {line}), '\\n'), {ending})")
    held = f"coalesce({holds_long_line(content)}, false)"
    longs = files.where(held).withColumn(content, short)
    return files.where(f"not {held}").withColumn(content, short).unionByName(redact_long(longs, rules, MASK, content))


def totals_by_origin(findings: DataFrame) -> DataFrame:
    """Findings per phase and, as ``all``, overall."""
    return (
        findings.rollup("origin")
        .agg(F.count("*").alias("n"))
        .select(F.coalesce("origin", F.lit("all")).alias("origin"), "n")
    )


def counts_by_confidence(findings: DataFrame) -> DataFrame:
    return findings.groupBy("confidence").agg(F.count("*").alias("n"))


def severity_summary(findings: DataFrame) -> DataFrame:
    """One row: all findings (low ones too), and the three listed levels."""
    return findings.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("confidence") == c).alias(c) for c in ("critical", "high", "medium")],
    )


def severity_report(findings: DataFrame, *, masked: bool = True) -> DataFrame:
    """Findings to show, most severe first; low ones are not listed."""
    shown = redact(findings, masked).where("confidence in ('critical', 'high', 'medium')")
    return shown.withColumn("severity", F.expr(severity("confidence"))).orderBy(
        F.desc("severity"), *REPORT_ORDER
    )


def ci_summary(findings: DataFrame, *, masked: bool = True, columns: Sequence[str] = ()) -> DataFrame:
    """Numbered findings with the match cut to 57 bytes and ``...`` beyond 60."""
    cut = "concat(make_valid_utf8(cast(substring(cast(match as binary), 1, 57) as string)), '...')"
    return numbered(redact(findings, masked), REPORT_ORDER, "number").selectExpr(
        "number",
        "file_path",
        "line_no",
        "upper(confidence) as confidence",
        f"if(octet_length(match) > 60, {cut}, match) as match",
        "verified",
        "verification_reason",
        *columns,
    )


def gate(findings: DataFrame, *, fail_on: str = "low", mode: str = "detect") -> DataFrame:
    """One row: number of findings, of those at the threshold, and pass or fail.

    An unknown mode means detect; report never fails.
    """
    mode = mode.lower() if mode.lower() in MODES else "detect"
    failed = "false" if mode == "report" else "failing > 0"
    return findings.agg(
        F.count("*").alias("total"),
        F.expr(f"count_if({at_least(fail_on)})").alias("failing"),
    ).selectExpr("total", "failing", f"if({failed}, 'failed', 'success') as status")


def scan_outputs(findings: DataFrame, *, fail_on: str = "low", mode: str = "detect") -> DataFrame:
    """What a CI step reports: the count, zeroed when the gate passes, and the status."""
    return gate(findings, fail_on=fail_on, mode=mode).selectExpr(
        "if(status = 'success', 0L, total) as secrets_found", "status as scan_status"
    )


def finding_json(findings: DataFrame, *, masked: bool = True) -> DataFrame:
    """Findings as JSON objects (``item``); the display label stays out."""
    item = F.to_json(
        F.struct(
            F.col("file_path").alias("file"),
            F.col("line_no").alias("line"),
            F.col("line").alias("line_text"),
            "match",
            "rule_id",
            "pattern",
            "confidence",
            "entropy",
            "context",
            "verified",
            F.nullif("verification_reason", F.lit("")).alias("verification_reason"),
        )
    )
    # Sort keys come from the findings themselves, before redaction.
    keyed = findings.select("*", F.struct(*REPORT_ORDER).alias("_key"))
    return redact(keyed, masked).select("_key", item.alias("item"))


def sarif_results(findings: DataFrame, *, masked: bool = True) -> DataFrame:
    """One SARIF result per finding, flat and as JSON (``item``)."""
    cases = " ".join(f"when {quote(c)} then {quote(v)}" for c, v in SARIF_LEVELS.items())
    before, after = map(quote, SARIF_MESSAGE)
    keyed = findings.select("*", F.struct(*REPORT_ORDER).alias("_key"))
    flat = redact(keyed, masked).selectExpr(
        "_key",
        "if(rule_id = '', pattern, rule_id) as ruleId",
        f"case lower(confidence) {cases} else {quote(SARIF_OTHER_LEVEL)} end as level",
        f"concat({before}, pattern, {after}) as text",
        "file_path as uri",
        "line_no as startLine",
    )
    place = "struct(struct(uri) as artifactLocation, struct(startLine) as region)"
    item = (
        "to_json(struct(ruleId, level, struct(text) as message,"
        f" array(struct({place} as physicalLocation)) as locations))"
    )
    return flat.withColumn("item", F.expr(item))


def _document(items: DataFrame, head: str, tail: str) -> DataFrame:
    """Ordered text lines: head, items separated by commas, tail."""
    spark = items.sparkSession
    body = numbered(items, ["_key"], "seq").selectExpr(
        "seq", "concat(if(seq = 1, ' ', ','), item) as value"
    )
    frame = spark.createDataFrame([(0, head), (2**62, tail)], "seq bigint, value string")
    return frame.unionByName(body).orderBy("seq")


def findings_document(findings: DataFrame, *, masked: bool = True) -> DataFrame:
    """The findings as one JSON array, line by line (``seq``, ``value``)."""
    return _document(finding_json(findings, masked=masked), "[", "]")


def sarif_document(findings: DataFrame, *, masked: bool = True, tool: str = TOOL) -> DataFrame:
    """The SARIF report, line by line (``seq``, ``value``)."""
    head = f'{{"version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":{{"name":"{tool}"}}}},"results":['
    return _document(sarif_results(findings, masked=masked).select("_key", "item"), head, "]}]}")


def baseline_document(entries: DataFrame) -> DataFrame:
    """A baseline as one JSON document ordered by file and line (``seq``, ``value``)."""
    item = F.to_json(F.struct("fingerprint", "file", "line", "rule_id", "secret_hash", "reason"))
    key = F.struct("file", "line", "fingerprint").alias("_key")
    return _document(
        entries.select(key, item.alias("item")), f'{{"version":"{VERSION}","entries":[', "]}"
    )


def write_document(document: DataFrame, path: str) -> None:
    """Write a document's lines; its parts, in name order, concatenate to the text."""
    document.orderBy("seq").select("value").write.text(path)


def report_lines(findings: DataFrame, *, masked: bool = True) -> DataFrame:
    """The readable report, line by line: a title per severity, its findings, totals.

    Returns (``section``, ``file_path``, ``line_no``, ``rule_id``, ``match``,
    ``part``, ``value``) in reading order.
    """
    shown = redact(
        findings.select("*", F.struct(*REPORT_ORDER).alias("_key")), masked
    ).where("confidence in ('critical', 'high', 'medium')")
    section = f"{SEVERITY['critical']} - {severity('confidence')}"
    texts = (
        "concat('File: ', file)",
        "concat('Line Number: ', line_no)",
        "concat('Confidence: ', upper(confidence), ' (Entropy: ',"
        " format_string('%.2f', bround(entropy, 2)), ')')",
        "concat('Context: ', context)",
        "concat('Pattern: ', pattern)",
        "concat('Line: ', line)",
        "if(verified, 'Verified: YES (LLM)', null)",
        "if(verification_reason <> '', concat('Reason: ', verification_reason), null)",
    )
    body = shown.selectExpr(
        f"{section} as section", "_key", f"posexplode(array({', '.join(texts)})) as (part, value)"
    ).where("value is not null")
    named = " ".join(f"when {quote(c)} then {quote(t)}" for c, t in TITLES.items())
    titles = (
        shown.groupBy("confidence")
        .agg(F.min("_key").alias("_key"))
        .selectExpr(
            f"{section} as section",
            "cast(null as struct<file_path: string, line_no: int, rule_id: string, match: string>) as _key",
            "-1 as part",
            f"case confidence {named} end as value",
        )
    )
    summary = (
        "concat('Summary: ', total, ' secrets found (Critical: ', critical, ', High: ', high, ', Medium: ', medium, ')')"
    )
    closing = f"if(total = 0, array('No secrets found.'), array({summary}, {quote(ADVICE)}))"
    total = severity_summary(findings).selectExpr(
        "9 as section",
        "cast(null as struct<file_path: string, line_no: int, rule_id: string, match: string>) as _key",
        f"posexplode({closing}) as (part, value)",
    )
    return (
        titles.unionByName(body)
        .unionByName(total)
        .orderBy("section", F.asc_nulls_first("_key"), "part")
        .select("section", "_key.*", "part", "value")
    )
