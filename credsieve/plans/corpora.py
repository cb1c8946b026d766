"""Texts derived from the given tables that exercise every rule and context.

The tables themselves hold few credentials, so lines with a made-up match of rule
``k mod n`` are derived from row keys.  The derivation is plain SQL, spelled for
Spark and for DuckDB, so both sides of a comparison read the same texts.
"""

from __future__ import annotations

import os
import re._constants as C
import re._parser as regex_parser
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession

from credsieve.functions.rules import Rule, custom_rule, rule_set
from credsieve.functions.text import let, quote
from credsieve.sources.lines import spread
from credsieve.sources.tree import opened, qualified

# A rule for the tokens that do occur in the documents table.
CORPUS_TOKEN = custom_rule(
    "corpus-token", r"""token["'\s:=]+[0-9a-f]{40}""", description="Bare token", tags=["corpus"]
)

# Placeholders a template character stands for: a hex digit, an upper-case hex
# digit, a decimal digit; all taken from a hash of the row key.
HEX, UPPER, DIGIT = "¤", "¥", "§"


def corpus_rules() -> list[Rule]:
    return rule_set([CORPUS_TOKEN])


def _class_sample(members: list) -> str:
    def holds(ch: str) -> bool:
        negated = members[0][0] is C.NEGATE
        found = any(
            (op is C.LITERAL and arg == ord(ch))
            or (op is C.RANGE and arg[0] <= ord(ch) <= arg[1])
            or (op is C.CATEGORY and arg is C.CATEGORY_WORD and (ch.isalnum() or ch == "_"))
            for op, arg in members
        )
        return found != negated

    for sample, needed in ((HEX, "0a"), (UPPER, "0A"), (DIGIT, "0")):
        if all(holds(ch) for ch in needed):
            return sample
    return next(chr(arg if op is C.LITERAL else arg[0]) for op, arg in members if op is not C.CATEGORY)


def template(regex: str) -> str:
    """A text with placeholders that becomes a match of the regex."""

    def render(tokens) -> str:
        out = []
        for op, arg in tokens:
            if op is C.LITERAL:
                out.append(chr(arg))
            elif op is C.IN:
                is_space = arg == [(C.CATEGORY, C.CATEGORY_SPACE)]
                out.append(" " if is_space else _class_sample(arg))
            elif op is C.SUBPATTERN:
                out.append(render(arg[-1]))
            elif op is C.BRANCH:
                out.append(render(arg[1][0]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, _, body = arg
                members = body[0][1] if body[0][0] is C.IN else [(None, None)]
                if members[0][0] is not C.NEGATE and (C.LITERAL, ord('"')) in members:
                    out.append(' = "')
                else:
                    # An open repeat gets enough characters to look like a value.
                    out.append(render(body) * (12 if low == 1 else low))
        return "".join(out)

    return render(regex_parser.parse(regex))


def runs(pattern: str) -> list[tuple[str, str, int, int]]:
    """A template as its stretches: (placeholder or '', plain text, place of its first character, length)."""
    out, at = [], 1
    for kind, held in groupby(pattern, lambda c: c if c in (HEX, UPPER, DIGIT) else ""):
        text = "".join(held)
        out.append((kind, "" if kind else text, at, len(text)))
        at += len(text)
    return out


@dataclass(frozen=True)
class Dialect:
    """The spellings in which Spark SQL and DuckDB differ."""

    spark: bool

    def text(self, value: str) -> str:
        return quote(value) if self.spark else "'" + value.replace("'", "''") + "'"

    def sha(self, value: str) -> str:
        return f"sha2({value}, 256)" if self.spark else f"sha256({value})"

    def pick(self, values: list[str], index: str) -> str:
        listed = ", ".join(self.text(v) for v in values)
        return f"([{listed}])[cast({index} as int) + 1]"

    def fill(self, patterns: list[str], index: str, digits: str) -> str:
        """A pattern with placeholders replaced by the hash digits at their place."""
        if self.spark:
            # A stretch at a time: a pattern has some 60 characters and few stretches.
            cut = "substr(d, r.at, r.n)"
            filled = (
                f"case r.kind when '' then r.plain when '{HEX}' then {cut} when '{UPPER}' then upper({cut})"
                f" else translate({cut}, 'abcdef', '123456') end"
            )
            listed = ", ".join("array({})".format(", ".join(
                f"struct({quote(kind)} as kind, {quote(plain)} as plain, {at} as at, {n} as n)" for kind, plain, at, n in runs(p)
            )) for p in patterns)
            return let("d", digits, f"array_join(transform(get(array({listed}), cast({index} as int)), r -> {filled}), '')")
        at = f"substr({digits}, i, 1)"
        chosen = (
            f"case c when '{HEX}' then {at} when '{UPPER}' then upper({at})"
            f" when '{DIGIT}' then translate({at}, 'abcdef', '123456') else c end"
        )
        return (
            f"array_to_string(list_transform(string_split({self.pick(patterns, index)}, ''),"
            f" lambda c, i: {chosen}), '')"
        )


SPARK, DUCKDB = Dialect(True), Dialect(False)


def planted(dialect: Dialect, key: str) -> str:
    """SQL: the credential-like text for an integer key."""
    patterns = [template(r.regex) for r in corpus_rules()]
    as_text = f"cast({key} as varchar(20))" if not dialect.spark else f"cast({key} as string)"
    hashes = ", ".join(dialect.sha(f"concat('{part}', {as_text})") for part in "abc")
    digits = f"case when {key} % 11 = 0 then repeat('a', 192) else concat({hashes}) end"
    return dialect.fill(patterns, f"({key}) % {len(patterns)}", f"({digits})")


def _group(key: str, size: int, n: int) -> str:
    return f"(cast(floor({key} / {size}) as bigint) % {n})"


def files_sql(dialect: Dialect, orders: str = "orders") -> str:
    """(``k``, ``path``, ``content``): a small source file per order."""
    n = len(corpus_rules())
    secret = planted(dialect, "o_orderkey")
    return f"""
        select k,
            case {_group('k', 5 * n, 7)}
                when 1 then concat('pkg/svc_', k, '_test.go')
                when 2 then concat('docs/guide_', k, '.md')
                when 3 then concat('web/vendor/lib_', k, '.js')
                when 4 then concat('conf/docs/', k, '.yaml')
                when 5 then concat('a/tests/case_', k, '.json')
                when 6 then concat('src/bundle_', k, '.min.js')
                else concat('src/app_', k, '.py') end as path,
            concat('import os', chr(10), 'def handler_', k, '():', chr(10),
                case {_group('k', n, 5)}
                    when 1 then concat('# ', secret)
                    when 2 then concat(secret, ' ${{ENV_', k, '}}')
                    when 3 then concat(secret, ' YOUR_VALUE')
                    when 4 then concat('`', secret, '[a-z]`')
                    else secret end,
                case when k % 3 = 0
                    then concat(chr(10), 'password = "', substr(md5(cast(k as varchar(20))), 1, 12), '"')
                    else '' end,
                chr(10)) as content
        from (select o_orderkey as k, {secret} as secret from {orders}) t"""


def commits_sql(dialect: Dialect, conversations: str = "conversations") -> str:
    """(``hash``, ``author``, ``date``, ``message``, ``diff``): a commit per turn."""
    key = "(conv_id * 31 + turn * 7)"
    n = 3

    def secret(j: int) -> str:
        return planted(dialect, f"({key} + {j})")

    secrets = ", ".join(f"{secret(j)} as s{j}" for j in range(n))
    name = "concat(cast(conv_id as varchar(20)), ':', cast(turn as varchar(20)))"
    return f"""
        select {dialect.sha(name)} as hash,
            concat(role, '_', conv_id % 7) as author,
            concat('2024-', lpad(cast(1 + conv_id % 12 as varchar(2)), 2, '0'), '-',
                lpad(cast(1 + turn % 28 as varchar(2)), 2, '0'), ' 10:00:00') as date,
            concat('turn ', turn, ' | conversation ', conv_id) as message,
            concat_ws(chr(10),
                concat('diff --git a/conv/c', conv_id, '.py b/conv/c', conv_id, '.py'),
                concat('--- a/conv/c', conv_id, '.py'), concat('+++ b/conv/c', conv_id, '.py'),
                concat('@@ -0,0 +', 1 + turn * 3, ',4 @@ def f()'),
                concat('+', replace(text, chr(10), concat(chr(10), '+'))),
                '+++counted, not read', concat('+', s0), '-password = "removed-value"',
                '@@ -9 +40,2 @@', concat('+# ', s1), ' unchanged', '@@ no position', '+plain',
                concat('+++ b/docs/notes_', conv_id, '.md'), '@@ -1 +1 @@', concat('+', s2),
                concat('--- a/gone_', turn), '+++ /dev/null', '@@ -1,2 +0,0 @@', '-gone') as diff
        from (select conv_id, turn, role, text, {secrets} from {conversations}) t"""


def long_lines_sql(dialect: Dialect, documents: str = "documents", regions: str = "region") -> str:
    """(``path``, ``line_no``, ``line``): a line of some 20 KB per document and of 10 MB per region.

    Text of the table, repeated, with beginnings of addresses and tokens that lead nowhere;
    at the end a credential.
    """
    text = "replace(coalesce(text, ''), chr(10), ',http://ab:80,')"
    secret = planted(dialect, "doc_id")
    return f"""
        select concat('long/d', doc_id, '.py') as path, cast(1 as int) as line_no,
            concat(repeat(concat({text}, 'eyJhttp://ab:80,'), cast(1 + floor(20000 / (length({text}) + 16)) as int)),
                ' ', {secret}) as line from {documents}
        union all
        select concat('long/r', r_regionkey, '.py'), cast(1 as int),
            concat(repeat(concat(r_name, ':http://ab:80,eyJ${{'), cast(floor(10000000 / (length(r_name) + 19)) as int)),
                ' password = "', md5(r_name), '"') from {regions}"""


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def planted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(load(spark, sf_dir, "orders").select("o_orderkey"))
    orders.createOrReplaceTempView("credsieve_orders")
    return spark.sql(files_sql(SPARK, "credsieve_orders"))


def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(load(spark, sf_dir, "documents").select("doc_id", "text")).createOrReplaceTempView("credsieve_documents")
    spread(load(spark, sf_dir, "region")).createOrReplaceTempView("credsieve_regions")
    return spark.sql(long_lines_sql(SPARK, "credsieve_documents", "credsieve_regions"))


def plant_entries(spark: SparkSession, root: str, *, links: dict[str, str], pipes: list[str]) -> None:
    """Links and pipes below a root on a file system that has them."""
    address = qualified(spark, root)

    def planted(batches):
        for rows in batches:
            top = opened(address)[1]
            for name, target in links.items():
                if not os.path.islink(f"{top}/{name}"):
                    os.symlink(target, f"{top}/{name}")
            for name in pipes:
                if not os.path.exists(f"{top}/{name}"):
                    os.mkfifo(f"{top}/{name}")
            yield rows

    spark.range(1).coalesce(1).mapInArrow(planted, "id long").collect()


def commit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(load(spark, sf_dir, "conversations")).createOrReplaceTempView("credsieve_conversations")
    return spark.sql(commits_sql(SPARK, "credsieve_conversations"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``path``, ``content``) of the documents table."""
    return spread(load(spark, sf_dir, "documents")).selectExpr(
        "concat(source, '/', doc_id) as path", "text as content"
    )
