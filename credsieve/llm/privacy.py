"""Information-theoretic sanitisation of personal data.

Base: emails, IP addresses, card and phone numbers by pattern, leftmost and not
overlapping within a kind.  Beyond them, a term may give a value away: in the corpus it
stands in documents of that value and hardly anywhere else, wherever in them.  With p(e)
the share of documents that hold value e, and p(e|t) the share of those holding term t
that hold e, the disclosure of e by t is the part of e's information that t gives,

    PMI(e; t) / IC(e)  =  1 - log p(e|t) / log p(e)

In a document that holds a value, every occurrence of a term whose disclosure of it reaches
the threshold is a span of its own: a number is generalised, a word removed.  Term and value
have to meet in ``LEAST_TEXTS`` different texts, copies being one: with fewer, every
word that is in no other document gives the value away.  Document frequencies are counted
over all documents.

Null text is empty.  Rows with null or repeated ids are judged one by one; other columns
are ignored, or passed through by ``sanitise``.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import batch, let_go, row_join, row_slices, sized, texts_of
from credsieve.session import settled

# ---------------------------------------------------------------------------
# Kinds in their order, and their patterns.
# ---------------------------------------------------------------------------
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits fails where one from the run's start does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

LEAST_TERM = 3
LEAST_TEXTS = 3
DISCLOSURE = 0.8

_TERM = re.compile(r"[^\W_]+")
_DIGIT = re.compile("[0-9]")
_MARKS = {kind: f"[{kind.upper()}]" for kind in KINDS}


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of personal data by pattern, in order."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _value(kind: int, raw: str) -> int:
    """A value's name in the statistics: a hash, so that no table holds the value."""
    plain = raw.lower() if kind == 0 else re.sub("[^0-9.]" if kind == 1 else "[^0-9]", "", raw)
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}".encode()) - (1 << 63)


def terms_of(text: str, spans: list[tuple[int, int, int]]):
    """(term, start, end) of the terms outside the values, which come by start."""
    reach, at = 0, 0
    for m in _TERM.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if m.start() >= reach and m.end() - m.start() >= LEAST_TERM:
            yield m[0].lower(), m.start(), m.end()


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("base", pa.list_(_SPAN)), ("values", pa.list_(pa.int64()))])
_FOUND = "doc_id long, text_key long, base array<struct<start:int,kind:int,end:int>>, values array<long>"
_PLACE_SCHEMA = pa.schema([("text_key", pa.int64()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_PLACES = "text_key long, term string, start int, end int"


_HELD_SCHEMA = pa.schema([("term", pa.string()), ("n", pa.int64())])
#: Terms a task counts before it passes them on.
_MOST_COUNTED = 500_000


def _scan(batches):
    let_go()
    for rows, texts in row_slices(batches):
        base = [base_spans(t) for t in texts]
        yield batch(
            _SCHEMA, rows.column("doc_id"), rows.column("text_key"),
            [[dict(zip(("start", "kind", "end"), s)) for s in x] for x in base],
            [sorted({_value(k, t[s:e]) for s, k, e in x}) for t, x in zip(texts, base)],
        )


def _places(batches):
    let_go()
    for rows, texts in row_slices(batches):
        for key, text in zip(rows.column("text_key").to_pylist(), texts):
            held = list(terms_of(text, base_spans(text)))
            if held:
                yield batch(_PLACE_SCHEMA, [key] * len(held), *zip(*held))


def _held(batches):
    """(term, documents of the task that hold it outside the values): counted as candidates are found."""
    counts: Counter = Counter()

    def counted():
        return batch(_HELD_SCHEMA, list(counts), list(counts.values()))

    for _, texts in row_slices(batches):
        for text in texts:
            spans = base_spans(text)
            if spans:
                counts.update({term for term, _, _ in terms_of(text, spans)})
            else:
                counts.update({m.lower() for m in set(_TERM.findall(text)) if len(m) >= LEAST_TERM})
        if len(counts) > _MOST_COUNTED:
            yield counted()
            counts.clear()
    yield counted()


def disclosing(rows: DataFrame, found: DataFrame) -> DataFrame | None:
    """(``text_key``, ``start``, ``end``) of the terms that give away a value of their text, if any can.

    ``rows`` are all texts, ``found`` what the scan of them gave.
    """
    total = found.count()
    texts = found.where(F.size("values") > 0).groupBy("text_key").agg(F.count("*").alias("n"), F.first("values").alias("values"))
    held = settled(texts.select("text_key", "n", F.explode("values").alias("value")))
    values = held.groupBy("value").agg(F.sum("n").alias("of_value"), F.count("*").alias("texts"))
    share = F.col("of_value") / F.lit(float(total))
    # A value that is in every document tells nothing; a term in more than ``most`` documents gives none away.
    values = values.where((F.col("texts") >= LEAST_TEXTS) & (F.col("of_value") < total)).drop("texts")
    values = values.withColumn("most", F.col("of_value") * F.pow(share, F.lit(DISCLOSURE - 1)) * 1.000001)
    wanted = settled(held.join(values, "value"))
    if wanted.isEmpty():
        return None
    keys = sized(wanted.select("text_key").distinct())
    whole = rows.join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    places = settled(whole.mapInArrow(_places, _PLACES))
    inside = settled(places.select("text_key", "term").distinct())
    often = settled(inside.groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= LEAST_TEXTS).select("term"))
    # Counted before they meet the candidates, and by the same function, so that none is missing.
    counted = settled(rows.select("text").mapInArrow(_held, "term string, n long").groupBy("term").agg(F.sum("n").alias("of_term")))
    of_term = often.join(counted, "term")
    top = wanted.agg(F.max("most")).first()[0]
    rare = settled(of_term.where(F.col("of_term") <= top))
    met = wanted.join(inside.join(rare, "term"), "text_key").where(F.col("of_term") <= F.col("most"))
    both = met.groupBy("value", "term").agg(
        F.sum("n").alias("both"), F.count("*").alias("texts"), F.first("of_value").alias("of_value"), F.first("of_term").alias("of_term")
    ).where(F.col("texts") >= LEAST_TEXTS)
    given = F.col("both") / F.col("of_term")
    pairs = both.where(1 - F.log(given) / F.log(share) >= DISCLOSURE).select("value", "term")
    named = wanted.select("text_key", "value").join(pairs, "value").select("text_key", "term").distinct()
    return places.join(named, ["text_key", "term"]).select("text_key", "start", "end")


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_key`` (xxhash64 of the text), base spans, all spans.

    Spans are (start, kind's number, end) in code points, by start, then kind.
    """
    rows = texts_of(docs).withColumn("text_key", F.xxhash64("text"))
    found = settled(rows.mapInArrow(_scan, _FOUND))
    terms = disclosing(rows, found)
    if terms is None:
        return found.select("doc_id", "text_key", "base", F.col("base").alias("spans"))
    term = F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end")
    added = settled(terms.groupBy("text_key").agg(F.collect_set(term).alias("added")))
    out = found.join(added, "text_key", "left")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    spans = F.array_sort(F.concat("base", F.coalesce("added", none)))
    return out.select("doc_id", "text_key", "base", spans.alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the base spans' digest and all spans as text, from ``find``."""
    names = F.array(*map(F.lit, KINDS))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")

    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        F.size(F.filter(kinds, lambda s: s == F.lit(number))).cast("long").alias(f"n_{kind}")
        for number, kind in enumerate(KINDS[:4])
    ]
    digest = F.sha2(joined("base").cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), joined("spans").alias("spans"))


def masked(text: str, spans) -> str:
    """The text with each span replaced by its kind's mark; overlapping spans become one.

    A disclosing term that holds a digit becomes a mark, any other word goes.
    """

    def mark(start, end, kind):
        return "" if kind == "term" and not _DIGIT.search(text, start, end) else _MARKS[kind]

    out, at, end, first, kind = [], 0, -1, 0, ""
    for start, number, stop in sorted(spans):
        if start < end:
            end = max(end, stop)
            continue
        if end >= 0:
            out.append(mark(first, end, kind))
            at = end
        out.append(text[at:start])
        first, kind, end = start, KINDS[number], stop
    if end < 0:
        return text
    out.append(mark(first, end, kind))
    out.append(text[end:])
    return "".join(out)


def sanitise(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with personal data masked in ``text``; every other column, and clean text, stays.

    Only the spans of terms are joined to the texts; base spans are found again in place.
    """
    found = find(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    kind = KINDS.index("term")
    terms = found.where(F.exists("spans", lambda s: s["kind"] == kind)).select(
        "doc_id", "text_key", F.filter("spans", lambda s: s["kind"] == kind).alias("terms")
    )
    met, prefix = row_join(docs, settled(terms.dropDuplicates(["doc_id", "text_key"])), "left", key, text)
    names = docs.columns
    at = names.index(text)

    def work(batches):
        for rows in batches:
            texts = []
            for value, extra in zip(rows.column(at).to_pylist(), rows.column(len(names)).to_pylist()):
                if value is not None:
                    spans = base_spans(value) + [(s["start"], s["kind"], s["end"]) for s in extra or ()]
                    value = masked(value, spans) if spans else value
                texts.append(value)
            columns = [rows.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return met.select(*names, prefix + "terms").mapInArrow(work, docs.schema)
