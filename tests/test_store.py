"""The stored store: buckets that split, versions, marks, writers that meet."""

import os

import pytest

from credsieve.sources import store as ST

SCHEMA = "file_path string, line_no int, line string, pattern string, entropy double, confidence string, verified boolean"


def rows(spark, lines, confidence="high", when=1, x=1):
    found = [("src/a.py", i, f"line {i}", "p", 3.0, confidence, False) for i in lines]
    return ST.store_rows(spark.createDataFrame(found, SCHEMA), f"array(cast({x} as float))", timestamp=str(when))


def held(spark, path, version=None):
    return {r["line_number"]: (r["confidence"], r["verified"]) for r in ST.read_store(spark, path, version=version).collect()}


def test_an_upsert_writes_the_buckets_it_touches(spark, fresh_dir):
    path = f"{fresh_dir}/store"
    assert ST.read_store(spark, path).count() == 0 and ST.store_versions(spark, path) == []
    assert ST.upsert_stored(rows(spark, []), path).version == 0
    first = ST.upsert_stored(rows(spark, range(400)), path, bucket_bytes=4000)
    assert first.version == 1 and len(first.buckets) > 8
    assert all(b.bytes <= 4000 for b in first.buckets) and sum(b.rows for b in first.buckets) == 400
    # The buckets cover every place once.
    assert sum(2.0 ** -len(b.bits) for b in first.buckets) == 1
    second = ST.upsert_stored(rows(spark, [7], "low", 2), path, bucket_bytes=4000)
    assert len(set(second.buckets) - set(first.buckets)) == 1
    assert held(spark, path)[7] == ("low", False) and held(spark, path, 1)[7] == ("high", False) and len(held(spark, path)) == 400
    with pytest.raises(ValueError):
        ST.read_store(spark, path, version=9)


def test_a_larger_store_has_more_buckets_not_larger_ones(spark, fresh_dir):
    def grown(n):
        return ST.upsert_stored(rows(spark, range(n)), f"{fresh_dir}/store{n}", bucket_bytes=4000).buckets

    small, large = grown(60), grown(6000)
    assert len(large) > 50 * len(small) and max(b.bytes for b in large) <= 4000
    # More than one round of splitting goes on where a bucket has grown that much.
    path = f"{fresh_dir}/deep"
    deep = ST.upsert_stored(rows(spark, range(3000)), path, bucket_bytes=400)
    assert max(len(b.bits) for b in deep.buckets) > ST.SPLIT_LEVELS and sum(b.rows for b in deep.buckets) == 3000
    assert ST.read_store(spark, path).count() == 3000


def test_writers_that_meet(spark, fresh_dir):
    path = f"{fresh_dir}/store"
    base = ST.upsert_stored(rows(spark, range(20)), path).version
    ST.upsert_stored(rows(spark, [1], "low", 2), path, base=base)
    with pytest.raises(ST.StoreChanged):
        ST.upsert_stored(rows(spark, [2], "low", 3), path, base=base)
    assert held(spark, path)[1][0] == "low" and held(spark, path)[2][0] == "high"
    assert ST.store_versions(spark, path) == [1, 2]
    assert not [n for n in os.listdir(f"{path}/manifests") if n.startswith(".") and not n.endswith(".crc")]


def test_batches_are_done_once(spark, fresh_dir):
    path = f"{fresh_dir}/store"
    assert ST.upsert_stored(rows(spark, [1]), path, batch=("s", 0)).version == 1
    assert ST.upsert_stored(rows(spark, [2]), path, batch=("s", 0)).version == 1
    assert ST.upsert_stored(rows(spark, [2]), path, batch=("t", 0)).version == 2
    assert ST.upsert_stored(rows(spark, [3]), path, batch=("s", 1)).batches == (("s", 1), ("t", 0))
    assert set(held(spark, path)) == {1, 2, 3}


def test_marks_write_only_what_changes(spark, fresh_dir):
    path = f"{fresh_dir}/store"
    first = ST.upsert_stored(rows(spark, range(300)), path, bucket_bytes=4000)
    ids = {r["line_number"]: r["id"] for r in ST.read_store(spark, path).collect()}
    marks = spark.createDataFrame([(ids[5], True), (ids[9], False), (-1, True), (None, True)], "id bigint, verified boolean")
    second = ST.mark_stored(marks, path)
    assert len(set(second.buckets) - set(first.buckets)) == 1
    assert [i for i, (_, v) in held(spark, path).items() if v] == [5] and not any(v for _, v in held(spark, path, 1).values())
    assert ST.mark_stored(marks, path).version == 2


def test_removed_versions_leave_the_rest_readable(spark, fresh_dir):
    path = f"{fresh_dir}/store"
    for n in range(4):
        ST.upsert_stored(rows(spark, range(100) if n == 0 else [n], str(n), n), path, bucket_bytes=4000)
    ST.remove_versions(spark, path, keep=2)
    assert ST.store_versions(spark, path) == [3, 4] and len(held(spark, path, 3)) == 100 and held(spark, path)[3][0] == "3"
    with pytest.raises(ValueError):
        ST.read_store(spark, path, version=1)
    used = {b.folder for v in (3, 4) for b in ST.read_manifest(spark, path, v).buckets if b.folder}
    assert {f"data/{w}/{n}" for w in os.listdir(f"{path}/data") for n in os.listdir(f"{path}/data/{w}") if n.startswith("bits=")} == used


def test_small_buckets_share_folders_and_old_rows_in_them_are_not_read(spark, fresh_dir, monkeypatch):
    path = f"{fresh_dir}/store"
    monkeypatch.setattr(ST, "FOLDER_BYTES", 20_000)
    first = ST.upsert_stored(rows(spark, range(1000)), path, bucket_bytes=1000)
    folders = {b.folder for b in first.buckets if b.folder}
    assert len(first.buckets) > 100 and 5 <= len(folders) <= 12
    # Every other bucket is written again, in parts too: the rest of its folder stays where it is, until it is most of nothing.
    second = ST.upsert_stored(rows(spark, range(0, 60), "low", 2), path, bucket_bytes=400)
    assert {b.folder for b in second.buckets if b.folder} & folders
    assert held(spark, path) == {i: ("low" if i < 60 else "high", False) for i in range(1000)} and held(spark, path, 1)[7] == ("high", False)
    assert ST.read_store(spark, path).count() == 1000 == sum(b.rows for b in second.buckets)
    ids = {r["line_number"]: r["id"] for r in ST.read_store(spark, path).collect()}
    ST.mark_stored(spark.createDataFrame([(ids[500], True)], "id bigint, verified boolean"), path)
    third = ST.upsert_stored(rows(spark, range(0, 1000, 2), "mid", 3), path, bucket_bytes=1000)
    got = held(spark, path)
    assert got == {i: ("mid" if i % 2 == 0 else "low" if i < 60 else "high", False) for i in range(1000)}
    live = {}
    for b in third.buckets:
        if b.folder:
            live.setdefault(b.folder, [b.held, 0])[1] += b.rows
    # No folder of which most is old is left.
    assert all(2 * n >= whole for whole, n in live.values())
    ST.remove_versions(spark, path, keep=1)
    assert held(spark, path) == got
