"""Streams drained with availableNow give what the batch operators give."""

import pytest

from credsieve.operators import baseline as B
from credsieve.operators import scan
from credsieve.sources import store as ST
from credsieve.streaming import scan as stream

SCHEMA = "path string, content string, ts timestamp"


def _rows(hour, values):
    return [(f"a{v % 3}.py", f'x\npassword = "Zx81kQpLmN{v:02d}"', f"2024-01-01 {hour:02d}:00:00") for v in values]


@pytest.fixture
def source(spark, fresh_dir):
    """Two batches of texts, later ones repeating earlier findings."""
    for n, rows in enumerate([_rows(0, range(20)), _rows(1, range(10, 30)), _rows(5, range(5))]):
        df = spark.createDataFrame(rows, "path string, content string, t string")
        df.selectExpr("path", "content", "cast(t as timestamp) as ts").coalesce(1).write.parquet(
            f"{fresh_dir}/in/part={n}"
        )
    return f"{fresh_dir}/in"


def _arriving(spark, source):
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
    return reader.option("recursiveFileLookup", True).parquet(source)


def _batch(spark, source, rules):
    texts = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source)
    return scan.scan_files(texts, rules)


def _drain(spark, findings, fresh_dir, name):
    out = f"{fresh_dir}/{name}"
    stream.write_findings(findings, out, f"{out}-state").awaitTermination()
    return spark.read.schema(findings.schema).parquet(out)


def test_scan_and_suppress(spark, source, rules, fresh_dir):
    found = stream.scan_stream(_arriving(spark, source), rules)
    batch = _batch(spark, source, rules)
    done = _drain(spark, found, fresh_dir, "all")
    assert sorted(done.drop("ts").collect()) == sorted(batch.collect()) and done.count() == 45
    known = B.entries_of(batch.where("file_path = 'a0.py'"))
    left = _drain(spark, stream.suppress_stream(found, known), fresh_dir, "left")
    assert left.count() == batch.where("file_path <> 'a0.py'").count()


def test_once_per_fingerprint(spark, source, rules, fresh_dir):
    found = stream.scan_stream(_arriving(spark, source), rules)
    once = _drain(spark, stream.once_per_fingerprint(found, delay="100 days", salts=4), fresh_dir, "once")
    assert once.count() == 30 and once.select("fingerprint").distinct().count() == 30


def test_a_fingerprint_is_reported_again_after_the_delay(spark, rules, fresh_dir):
    batches = [_rows(0, range(4)), _rows(5, [10]), _rows(6, [11]), _rows(7, [12]), _rows(12, range(4)), _rows(13, range(4))]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "path string, content string, t string")
        df.selectExpr("path", "content", "cast(t as timestamp) as ts").coalesce(1).write.parquet(f"{fresh_dir}/in/part={n}")
    found = stream.scan_stream(_arriving(spark, f"{fresh_dir}/in"), rules)
    once = _drain(spark, stream.once_per_fingerprint(found, delay="2 hours", salts=4), fresh_dir, "again")
    hours = sorted(str(r["ts"])[11:13] for r in once.collect())
    # The repetition after twelve hours is new, the one an hour later is not.
    assert hours == ["00"] * 4 + ["05", "06", "07"] + ["12"] * 4


def test_counts_of_all_windows(spark, source, rules, fresh_dir):
    found = stream.scan_stream(_arriving(spark, source), rules)
    counts = stream.counted_windows(found, f"{fresh_dir}/all", f"{fresh_dir}/all-state", delay="6 hours")
    got = {str(r["window_start"])[11:13]: r["n"] for r in counts.collect()}
    assert got == {"00": 20, "01": 20, "05": 5}


def test_windowed_counts(spark, source, rules, fresh_dir):
    found = stream.scan_stream(_arriving(spark, source), rules)
    counts = _drain(spark, stream.counts_per_window(found, delay="0 seconds"), fresh_dir, "counts")
    got = {str(r["window_start"])[11:13]: r["n"] for r in counts.collect()}
    assert got == {"00": 20, "01": 20}


def test_upsert_stream(spark, source, rules, fresh_dir):
    found = stream.scan_stream(_arriving(spark, source), rules)
    rows = ST.store_rows(found, "array(cast(1 as float))", timestamp="unix_timestamp(ts)")
    path, state = f"{fresh_dir}/store", f"{fresh_dir}/store-state"
    stream.upsert_stream(rows, path, state).awaitTermination()
    stored = ST.read_store(spark, path).collect()
    assert len(stored) == 3 and {r["line_number"] for r in stored} == {2}
    # A restart with nothing new changes nothing.
    stream.upsert_stream(rows, path, state).awaitTermination()
    assert sorted(ST.read_store(spark, path).collect()) == sorted(stored)
