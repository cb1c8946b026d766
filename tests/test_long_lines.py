"""Long lines: the same findings as on short ones, in time linear in their length."""

import time

import duckdb
import pytest

from credsieve.functions import detect as D
from credsieve.functions.dialect import with_named_groups
from credsieve.operators import long_lines, reports, scan
from credsieve.operators.long_lines import Matcher

KEY = "AKIA" + "Q7RT" * 4
PAD = "plain words, " * 1200


@pytest.fixture(scope="module")
def matcher(rules):
    return Matcher(rules)


def rows_of(spark, *lines):
    return spark.createDataFrame([("a.py", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")


def test_long_lines_have_the_rules_of_short_ones(spark, rules):
    short = [f"key = {KEY}", 'password = "abcdefgh1234"', "Server=db.local; Password=hunter22aa;", "nothing here", "https://u:p@host/x", "`[a-z]` x"]
    one = {r["line_no"]: r for r in scan.file_hits(rows_of(spark, *short), rules).collect()}
    two = {r["line_no"]: r for r in scan.file_hits(rows_of(spark, *[f"{PAD} {x}" for x in short]), rules).collect()}
    assert set(two) - set(one) <= {5} and len(one) == 4
    for i, r in one.items():
        assert (r["rule_idx"], r["match"], r["confidence"]) == (two[i]["rule_idx"], two[i]["match"], two[i]["confidence"])
    both = rows_of(spark, short[0], f"{PAD}{short[0]} {short[1]}", PAD)
    every = {}
    for r in scan.detect_all(both, rules).collect():
        every.setdefault(r["line_no"], []).append(r["rule_idx"])
    assert set(every) == {0, 1} and every[0][0] in every[1] and len(every[1]) > len(every[0])
    owners = {r["line_no"]: r["rule_idx"] for r in scan.owners(both, rules).collect()}
    assert owners == {0: every[0][0], 1: min(every[1]), 2: None}


def test_gate_lets_long_lines_through(evaluate, rules):
    assert evaluate([(PAD,), ("plain",)], "l string", D.line_gate(rules, "l")) == [(True,), (False,)]


def test_time_is_linear(matcher):
    hard = ["@" + "http://ab:80,", "eyJ", "1", "mysql://a:", "${", "GOPRIVATE token "]
    for unit in hard:
        took = []
        for size in (1_000_000, 4_000_000):
            line = unit * (size // len(unit))
            begun = time.process_time()
            list(matcher.matching(line))
            took.append(time.process_time() - begun)
        # Quadratic time would be sixteen times as much.
        assert took[1] < 9 * took[0] + 0.2, unit


def test_context_and_definition_lines_are_linear(spark, rules):
    lines = ["${" * 500_000, "`" + "[" * 1_000_000, "`" + "[" * 300_000 + "` " + KEY]
    begun = time.time()
    found = scan.file_hits(rows_of(spark, *lines), rules).collect()
    assert [r["line_no"] for r in found] == [] and time.time() - begun < 30


def test_masked_like_short_lines(spark, rules, matcher):
    texts = [
        f"key = {KEY}", 'google_api_key = "AIza' + "a1" * 16 + 'abcTAILTAIL9"', "https://u:p@host/x and http://a:b@c", "plain",
        'auth0_secret = "ghp_' + "a1" * 16 + 'abcdTAILTAILTAIL5"', "é " + KEY + " ü " + KEY,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    short = {r["id"]: r["content"] for r in reports.redact_texts(df, rules).collect()}
    assert {i: matcher.masked(t, reports.MASK) for i, t in enumerate(texts)} == short
    wide = df.selectExpr("id", f"concat('x\\n', repeat('plain words, ', 1200), ' ', content, '\\n', content, '\\n') as content")
    got = {r["id"]: r["content"] for r in reports.redact_texts(wide, rules).collect()}
    assert got == {i: f"x\n{PAD} {t}\n{t}\n" for i, t in short.items()}
    none = spark.createDataFrame([(1, None), (2, "")], "id int, content string")
    assert sorted(r["content"] or "" for r in reports.redact_texts(none, rules).collect()) == ["", ""]


def test_groups_get_names():
    named = with_named_groups(r"(?i)(?:a|(b))[(](?P<x>c)\(\Q(\E")
    assert named == r"(?P<m>(?i)(?:a|(?P<g1>b))[(](?P<g2>c)\(\()"
    assert long_lines.Matcher([]).spans("x") == []


@pytest.mark.parametrize("regex", ["(?i)i", "(?i)s", "(?i)[j-t]", "(?i)[^ks]", "(?i:k)", "(?i)x|K", "k", "(?i)[é]", "(?i)ß", "(?i)Σ", "(?i)[[:alpha:]]", "(?i)\\w"])
def test_letters_without_case_as_in_duckdb(evaluate, regex):
    from credsieve.functions.dialect import to_java
    from credsieve.functions.text import matches

    texts = [*"iIıİsSſkK\u212a", "ıÉ", "İé", "ẞ", "ς"]
    want = [duckdb.execute("select regexp_matches(?, ?)", [t, regex]).fetchone() for t in texts]
    assert evaluate([(t,) for t in texts], "t string", matches("t", to_java(regex))) == want, to_java(regex)
