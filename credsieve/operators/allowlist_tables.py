"""Allowlists of any length kept as tables, without a condition for each row of them.

A glob or regex cannot be a join key, but what it needs can.  Every row of a list gets a key
that each text it matches has, a text gets all keys it could be found by, and only rows that
meet on a key are tested.  Of the keys that a row could have it gets the one that the fewest
rows of the list share, so that a list of many alike rows (``src/app_17.p[xy]``) is told apart
by where they differ.

* A glob without wildcards is a whole path or a base name.  One with wildcards needs its plain
  beginning, its plain ending and the plain texts between wildcards.  A path and its base name
  are looked up by their beginnings and endings of the lengths that the list has.
* A regex needs the plain texts that each of its matches holds, and so every run of letters in
  them; runs have one of a few lengths (``GRAMS``).  A text is looked up by all its runs of the
  lengths that the list has.

Rows without anything plain to need (``*``, ``[a-z]+``) are tested on every text, where the texts
lie.  Keys and texts meet as 64-bit hashes: two that share one are tested in vain, no more.
Texts are looked up once however many findings have them.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as regex_parser
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.functions.dialect import is_case_insensitive, to_java
from credsieve.functions.globs import glob_to_regex
from credsieve.functions.text import base_name, let
from credsieve.operators.joins import skewed_join
from credsieve.session import settled

#: Letters of a regex's plain text that are its key at least.
GRAM = 4
#: Lengths of all keys that a plain text gives.
GRAMS = (GRAM, 6, 8, 12)
#: Letters of a piece of a long text.
PIECE = 4096
_WILD = "*?[\\"
_KEYED = "key string, regex string"
ANY = "any"


def glob_key(glob: str) -> str:
    """The key of a glob; see the module."""
    first = min((glob.index(c) for c in _WILD if c in glob), default=None)
    if first is None:
        return ("path:" if "/" in glob else "name:") + glob
    if "/" in glob[:first]:
        return "under:" + glob[:first].rsplit("/", 1)[0]
    ending = glob[max(glob.rfind(c) for c in "*?]") + 1 :]
    if "/" not in glob and "\\" not in glob and "." in ending:
        return "ending:" + ending[ending.index(".") :]
    return "any"


def glob_keys(glob: str, body: str) -> list[str]:
    """All keys that could be a glob's, given its regex."""
    first = min((glob.index(c) for c in _WILD if c in glob), default=None)
    if first is None:
        return [glob_key(glob)]
    ending = "" if "\\" in glob else glob[max(glob.rfind(c) for c in "*?]") + 1 :]
    keys = [f"starts:{glob[:first]}"] if first else []
    keys += [f"ends:{ending}"] if ending else []
    return keys + _runs("plain", needed_texts(body)) or [ANY]


def shaped_path_keys(path: str, shapes: Iterable[tuple[str, int]]) -> str:
    """SQL: the keys of certain kinds and lengths that a path is found by."""
    shapes, name = sorted(set(shapes)), base_name(path)
    exact = [f"concat('path:', {path})", f"concat('name:', {path})", f"concat('name:', {name})"]
    cuts = {"starts": "left(t, n)", "ends": "right(t, n)"}
    parts = [f"array({', '.join(exact)})"]
    for kind, cut in cuts.items():
        lengths = ", ".join(str(n) for k, n in shapes if k == kind)
        if lengths:
            fitting = f"filter(array({lengths}), n -> n <= char_length(t))"
            parts.append(f"flatten(transform(array({path}, {name}), t -> transform({fitting}, n -> concat('{kind}:', {cut}))))")
    parts.append(piece_keys(path, [(k, n) for k, n in shapes if k == "plain"]))
    return f"array_distinct(concat({', '.join(parts)}))"


def path_keys(path: str) -> str:
    """SQL: the keys that a path is found by."""
    name = base_name(path)
    parts = f"split({path}, '/')"
    folders = f"transform(sequence(1, size({parts})), i -> concat('under:', array_join(slice({parts}, 1, i), '/')))"
    dots = f"split({name}, '[.]')"
    endings = (
        f"if(size({dots}) < 2, cast(array() as array<string>), transform(sequence(2, size({dots})),"
        f" i -> concat('ending:.', array_join(slice({dots}, i, size({dots})), '.'))))"
    )
    return f"array_distinct(concat(array('any', concat('path:', {path}), concat('name:', {path}), concat('name:', {name})), {folders}, {endings}))"


def needed_texts(regex: str) -> list[str]:
    """Plain texts that every match of an RE2 regex holds, as far as they are seen.

    Whatever is not plainly needed (choices, options, classes, escapes that this does not know)
    ends a text, so there can be too few but no wrong ones.
    """
    body = regex.removeprefix("(?i)")
    if "(?" in body.replace("(?:", "").replace("(?P<", "") or any(x in body for x in ("\\Q", "[[:", "\\z", "\\p", "\\P", "\\x", "\\C")):
        return []
    try:
        parsed = regex_parser.parse(body)
    except re.error:
        return []
    runs = [""]

    def walk(tokens) -> None:
        for op, arg in tokens:
            if op is C.LITERAL:
                runs[-1] += chr(arg)
            elif op is C.SUBPATTERN:
                walk(arg[-1])
            elif op is C.MAX_REPEAT and arg[0] >= 1:
                # One copy is needed, but not what stands around it.
                runs.append("")
                walk(arg[2])
                runs.append("")
            elif op is C.AT:
                continue
            else:
                runs.append("")

    walk(parsed)
    # Without case only letters that have no others beyond ASCII are the same in lower case.
    if is_case_insensitive(regex):
        runs = [part for run in runs for part in _plain_runs(run)]
    return [run for run in runs if run]


def _plain_runs(run: str) -> list[str]:
    out = [""]
    for ch in run.lower():
        if ch.isascii() and ch not in "sk":
            out[-1] += ch
        else:
            out.append("")
    return out


def regex_keys(regex: str) -> list[str]:
    """All keys that could be a regex's."""
    kind = "folded" if is_case_insensitive(regex) else "plain"
    return _runs(kind, needed_texts(regex), (GRAM,)) or [ANY]


def finer_regex_keys(regex: str) -> list[str]:
    """The same with longer runs, which fewer regexes share."""
    kind = "folded" if is_case_insensitive(regex) else "plain"
    return _runs(kind, needed_texts(regex)) or [ANY]


def _runs(kind: str, texts: Iterable[str], lengths: Iterable[int] = GRAMS) -> list[str]:
    return sorted({f"{kind}:{t[i : i + n]}" for t in texts for n in lengths for i in range(len(t) - n + 1)})


def text_pieces(text: str) -> str:
    """SQL: a text in pieces of bounded length that hold all its runs of the lengths in ``GRAMS``."""
    blocks = f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"
    return let("b", blocks, f"transform(b, (x, i) -> if(i = 0, x, concat(right(get(b, i - 1), {max(GRAMS) - 1}), x)))")


def piece_keys(piece: str, shapes: Iterable[tuple[str, int]] = (("plain", GRAM), ("folded", GRAM))) -> str:
    """SQL: the keys of certain kinds and lengths that a text is found by for one of its pieces."""

    def grams(kind: str, length: int) -> str:
        n, of = f"(char_length(t) - {length - 1})", f"lower({piece})" if kind == "folded" else piece
        runs = f"transform(sequence(1, {n}), i -> concat('{kind}:', substring(t, i, {length})))"
        return let("t", of, f"if({n} < 1, cast(array() as array<string>), {runs})")

    return f"array_distinct(concat({', '.join(['cast(array() as array<string>)', *[grams(*s) for s in shapes]])}))"


def _keyed(listed: DataFrame, column: str, kind: str) -> DataFrame:
    """(``key``, ``regex``) of the rows of a list, computed where they are: of each row's keys
    the one that the fewest rows could have, of those the longest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            held = rows.column(0).to_pylist()
            if kind == "glob":
                bodies = [(g, glob_to_regex(g)) for g in held if g]
                out = [(key, rf"\A(?:{body})\z") for g, body in bodies if body is not None for key in glob_keys(g, body)]
            else:
                out = [(key, java) for r in held for java in [to_java(r)] for key in finer_regex_keys(r)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else ([], []))], ["key", "regex"])

    keyed = settled(listed.select(F.col(column)).where(F.col(column).isNotNull()).distinct().mapInArrow(work, _KEYED))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"))
    order = F.struct("n", -F.length("key"), "key")
    # One key per regex is enough, but the same regex can stand for a whole path and for a base name.
    exact = "key like 'path:%' or key like 'name:%'"
    chosen = keyed.join(shared, "key").groupBy("regex", F.expr(f"if({exact}, key, '')").alias("_exact")).agg(F.min_by("key", order).alias("key"))
    return settled(chosen.select("key", "regex"))


def _shapes(keyed: DataFrame) -> list[tuple[str, int]]:
    """The kinds and lengths of the keys of a list; there are no more than letters in its longest row."""
    kind = F.substring_index("key", ":", 1)
    shaped = keyed.where("key not like 'path:%' and key not like 'name:%'").where(F.col("key") != ANY)
    rows = shaped.select(kind.alias("kind"), (F.char_length("key") - F.char_length(kind) - 1).alias("n")).distinct().collect()
    return sorted((r["kind"], r["n"]) for r in rows)


def _matched(texts: DataFrame, looked: DataFrame, keyed: DataFrame, test: str) -> DataFrame:
    """The ``text`` that a row of the list matches; texts meet keys by hashes, not by themselves."""
    found = keyed.where(F.col("key") != ANY).select(F.xxhash64("key").alias("key"), "regex")
    met = looked.select("digest", F.xxhash64("key").alias("key")).join(found, "key").select("digest", "regex").distinct()
    # Rows that every text meets are tested where the texts are: on one key they would be one task's work.
    every = texts.crossJoin(keyed.where(F.col("key") == ANY).select("regex"))
    return texts.join(met, "digest").where(test).select("text").union(every.where(test).select("text")).distinct()


def _texts(findings: DataFrame, of: str) -> DataFrame:
    own = findings.select(F.expr(of).alias("text")).where("text is not null").distinct()
    return settled(own.withColumn("digest", F.xxhash64("text")))


def _without(findings: DataFrame, known: DataFrame, of: str) -> DataFrame:
    # A name that no column of the findings has.
    name = "_" + "_".join(findings.columns)
    met = skewed_join(findings.withColumn(name, F.expr(of)), known.withColumnRenamed("text", name), [name], "left_anti")
    return met.select(*findings.columns)


def without_globs(findings: DataFrame, globs: DataFrame, *, column: str = "glob", path: str = "file_path") -> DataFrame:
    """Findings whose path no glob of the table matches, as the config's path globs do."""
    texts = _texts(findings, path)
    keyed = _keyed(globs, column, "glob")
    looked = texts.select("digest", F.explode(F.expr(shaped_path_keys("text", _shapes(keyed)))).alias("key"))
    test = f"text rlike regex or {base_name('text')} rlike regex"
    return _without(findings, _matched(texts, looked, keyed, test), path)


def without_regexes(findings: DataFrame, regexes: DataFrame, *, column: str = "regex", text: str = "match") -> DataFrame:
    """Findings in whose text no regex of the table matches."""
    texts = _texts(findings, text)
    pieces = texts.select("digest", F.explode(F.expr(text_pieces("text"))).alias("piece"))
    keyed = _keyed(regexes, column, "regex")
    looked = pieces.select("digest", F.explode(F.expr(piece_keys("piece", _shapes(keyed)))).alias("key"))
    return _without(findings, _matched(texts, looked, keyed, "text rlike regex"), text)
