"""Rules on long lines, in time linear in the line.

Java's regexes backtrack: where a rule holds an open repetition that its own beginning fits
into, as in ``http://ab:80,http://ab:80,...``, each place it may begin at reads on to the end,
and time grows as the square of the line.  On short lines that is nothing; lines over
``LINEAR_FROM`` bytes are matched by an automaton instead, the RE2 of Arrow's functions, whose
dialect the rules are written in.  It reads a line once for each rule whose literals are on it.

The JVM finds and scores everything on short lines; only rows that were hit, and long lines,
pass through Python, in the same task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from credsieve.functions.detect import LINEAR_FROM, LONG_LINE, is_long_line
from credsieve.functions.dialect import with_named_groups
from credsieve.functions.rules import Rule
from credsieve.sources.lines import raw_lines

#: Column of what a long line's rule found: the match, then its groups.
FOUND = "_found"


class Matcher:
    """The rules over one long line at a time."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = [(r.rule_idx, r.ci, r.literals, r.regex, with_named_groups(r.regex)) for r in rules]

    def _likely(self, line: str) -> Iterator[tuple[int, str, str]]:
        """Rules one of whose literals is on the line."""
        folded = line.lower().replace("ſ", "s")
        for idx, ci, literals, regex, named in self.rules:
            if not literals or any(x in (folded if ci else line) for x in literals):
                yield idx, regex, named

    def matching(self, line: str) -> Iterator[tuple[int, list[str]]]:
        """(rule, leftmost match and its groups) of each rule that matches, in rule order."""
        text = pa.array([line], pa.large_string())
        for idx, _, named in self._likely(line):
            found = pc.extract_regex(text, named)[0].as_py()
            if found is not None:
                yield idx, [x or "" for x in found.values()]

    def spans(self, line: str) -> list[tuple[int, int]]:
        """Where the rules match on the line, overlapping or touching matches as one."""
        begin, end = _unused(line, 2)
        text, found = pa.array([line], pa.large_string()), []
        for _, regex, _ in self._likely(line):
            marked = pc.replace_substring_regex(text, regex, rf"{begin}\0{end}")[0].as_py()
            at = 0
            before, *rest = marked.split(begin)
            at += len(before)
            for piece in rest:
                match, _, after = piece.partition(end)
                found.append((at, at + len(match)))
                at += len(match) + len(after)
        joined: list[tuple[int, int]] = []
        for s, e in sorted(found):
            if joined and s <= joined[-1][1]:
                joined[-1] = joined[-1][0], max(e, joined[-1][1])
            else:
                joined.append((s, e))
        return joined

    def masked(self, line: str, mask: str) -> str:
        out, at = [], 0
        for s, e in self.spans(line):
            out += [line[at:s], mask]
            at = e
        return "".join([*out, line[at:]])


def _unused(text: str, n: int) -> list[str]:
    """Characters that the text does not hold."""
    held = set(text)
    return [c for c in map(chr, range(0xE000, 0xF8FF)) if c not in held][:n]


def resolved(hits: DataFrame, rules: Sequence[Rule], line: str = "line", *, every: bool = False, keep: bool = False) -> DataFrame:
    """``hits`` with the rules of long lines in ``rule_idx``, and what they found in ``_found``.

    ``rule_idx`` arrives as ``LONG_LINE`` on them.  The first rule that matches gets the line,
    or with ``every`` each one a row of it; a line without any goes, or with ``keep`` stays
    with a null.
    """
    schema = T.StructType([*hits.schema.fields, T.StructField(FOUND, T.ArrayType(T.StringType()))])
    names = hits.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for rows in batches:
            owner = rows.column("rule_idx").fill_null(-1).to_numpy(zero_copy_only=False)
            long = owner == LONG_LINE
            place, idx, found = np.flatnonzero(~long).tolist(), rows.column("rule_idx").filter(pa.array(~long)).to_pylist(), [None] * int((~long).sum())
            if long.any():
                matcher = matcher or Matcher(rules)
                texts = rows.column(line)
                for i in np.flatnonzero(long).tolist():
                    own = matcher.matching(texts[i].as_py())
                    own = list(own) if every else [x for x in [next(own, None)] if x]
                    for rule, groups in own or ([(None, None)] if keep else []):
                        place.append(i)
                        idx.append(rule)
                        found.append(groups)
            taken = rows.take(pa.array(place, pa.int64())) if long.any() else rows
            columns = [pa.array(idx, pa.int32()) if n == "rule_idx" else taken.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.string()))], [*names, FOUND])

    return hits.mapInArrow(work, schema)


def redact_long(files: DataFrame, rules: Sequence[Rule], mask: str, content: str = "content") -> DataFrame:
    """Texts with everything masked that rules match on their long lines."""
    schema = files.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rules)
        at = schema.names.index(content)
        for rows in batches:
            texts = []
            for text in rows.column(at).to_pylist():
                lines = (text or "").split("\n")
                lines = [matcher.masked(x, mask) if len(x.encode()) > LINEAR_FROM else x for x in lines]
                texts.append(None if text is None else "\n".join(lines))
            yield rows.set_column(at, schema.names[at], pa.array(texts, rows.schema.field(at).type))

    return files.mapInArrow(work, schema)


def holds_long_line(content: str) -> str:
    # A short text holds none; that is seen without splitting it.
    return f"({is_long_line(content)} and exists({raw_lines(content)}, raw -> {is_long_line('raw')}))"
