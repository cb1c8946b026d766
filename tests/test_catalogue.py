"""Every rule, on generated matches: gates are sound, Java equals RE2."""

import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis.strategies import from_regex

from credsieve.functions import detect as D
from credsieve.functions.catalogue import ADDITIONAL_RULES, CORE_RULES
from credsieve.functions.rules import custom_rule, leading_literal, rule_set
from credsieve.operators import scan

PER_RULE = 12


def generated(regex):
    found = []

    @settings(
        max_examples=PER_RULE, database=None, derandomize=True, deadline=None,
        suppress_health_check=list(HealthCheck),
    )
    @given(from_regex(re.compile(regex, re.ASCII), fullmatch=True))
    def collect(text):
        if not set(text) & set("\n\r\x0b"):
            found.append(text)

    collect()
    return found


@pytest.fixture(scope="module")
def samples(spark, rules):
    """(rule_idx, line): generated matches, bare and inside other text."""
    rows = []
    for rule in rules:
        found = generated(rule.regex)
        assert found, rule
        for i, text in enumerate(found):
            rows.append((rule.rule_idx, text if i % 2 else f"x = {text} ;"))
            if rule.ci:
                rows.append((rule.rule_idx, text.swapcase()))
    df = spark.createDataFrame(rows, "want int, line string")
    df.cache().count()
    return df


def test_sizes(rules):
    assert (len(CORE_RULES), len(ADDITIONAL_RULES)) == (138, 51)
    assert [r.rule_idx for r in rules] == list(range(189))
    assert rules[138].rule_set == "additional" and rules[188].rule_id == "pattern-188"
    assert [r.rule_idx for r in rules if r.groups] == [139] and rules[139].groups == 2
    assert all(r.boost == 0 for r in rules)


def test_every_generated_match_passes_gate_and_rule(samples, rules):
    regex = D.rule_text(rules, "want", lambda r: r.java)
    checked = samples.selectExpr(
        "want", "line",
        f"line rlike {regex} as matches",
        f"{D.line_gate(rules, 'line')} as gated",
        f"array_contains({D.all_rules(rules, 'line')}, want) as listed",
    )
    assert checked.where("not (matches and gated and listed)").collect() == []


def test_first_rule_equals_plain_join_and_duckdb(samples, rules):
    got = {
        r["line"]: r["rule_idx"]
        for r in scan.detect(samples.select("line").distinct(), rules).collect()
    }
    con = duckdb.connect()
    lines = [r["line"] for r in samples.select("line").distinct().collect()]
    con.execute("create table t(line varchar)")
    con.executemany("insert into t values (?)", [(x,) for x in lines])
    cases = " ".join(
        "when regexp_matches(line, '{}') then {}".format(r.regex.replace("'", "''"), r.rule_idx)
        for r in rules
    )
    want = dict(con.execute(f"select line, case {cases} end from t").fetchall())
    assert {k: v for k, v in want.items() if v is not None} == got


def test_prose_is_dropped_by_the_gate(spark, rules):
    text = spark.createDataFrame(
        [("It was a dark and stormy night; the rain fell in torrents.",),
         ("Please reset your password today, thanks.",)],
        "line string",
    )
    assert [r["line"] for r in scan.gated(text, rules).collect()] == [
        "Please reset your password today, thanks."
    ]


def test_letters_that_fold_to_ascii(spark, rules):
    """Long s and the kelvin sign count as s and k where case does not matter."""
    rows = spark.createDataFrame(
        [("PAſſWORD = abcdefgh1",), ("api_Key: 0123456789abcdef0123",),
         ("s3.amaſonaws.com/x",), ("İ password: abcdefgh",)],
        "line string",
    )
    found = {r["line"]: r["rule_idx"] for r in scan.detect(rows, rules).collect()}
    assert found == {
        "PAſſWORD = abcdefgh1": 136,
        "api_Key: 0123456789abcdef0123": 127,
        "İ password: abcdefgh": 136,
    }


@pytest.mark.parametrize(
    "regex, want",
    [("token[a-z]", ("token",)), ("toke?n", ("tok",)), ("(?i)MyKey=", ("mykey",)), ("ab[0-9]", ()),
     ("key|token", ()), ("abc{2}d", ())],
)
def test_leading_literal(regex, want):
    assert leading_literal(regex) == want


def test_custom_rules_come_after_the_built_in_ones():
    rules = rule_set(
        [custom_rule("a", "aaa[0-9]"), custom_rule("off", "bbb", enabled=False),
         custom_rule("named", "Private_Key=[0-9]", tags=["t"], min_entropy=1.5, confidence="high")]
    )
    assert [(r.rule_idx, r.rule_id, r.boost) for r in rules[189:]] == [
        (189, "a", 0), (190, "named", 15)
    ]
    assert rules[190].tags == ("t",) and rules[190].min_entropy == 1.5
