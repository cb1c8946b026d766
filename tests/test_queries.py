"""Every registered query against its SQL equivalent in DuckDB, on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as registered

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
ORACLES = registered.oracle_sql()
# The training-data operators have tests of their own beside them.
CORE = registered.QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = registered.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in cursor.fetchall())


def test_entry(spark):
    rows = registered.entry(spark).collect()
    assert rows and {"rule_id", "confidence", "n"} == set(rows[0].asDict())


def test_every_query_has_sql():
    assert set(CORE) == set(CORE) & set(ORACLES)
