"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from credsieve.llm import (
    chat, decontaminate, language, near_duplicates, packing, privacy, quality, shards, token_counts, token_files,
)

SENTENCE = "The quick brown fox jumps over the lazy dog while seven wizards mix a potion of herbs, roots and rain."
LONG = " ".join(f"word{i % 977} goes{i % 31}." for i in range(30_000))
ODD = (
    "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, row int, hash string,"
    " cid string, part int, component string, length string, term string, sequence_id string, _id int, item_id int"
)
ROWS = [
    (1, SENTENCE), (2, SENTENCE), (3, None), (4, ""), (5, " \n\t "), (6, "x"), (7, LONG), (None, SENTENCE + " Null id."),
    (None, None), (8, "a@b.example and 10.0.0.1"), (8, "a@b.example and 10.0.0.1"), (8, "other text of one id"),
    (9, "<|endoftext|> é ß 日本 😀\r\n"), (10, "12345 67890 !!! ???"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rest = ("en", None, None, "c", 1, "h", "c", 2, "k", "l", "t", "s", 3, 4)
    return spark.createDataFrame([(*r, *rest) for r in ROWS], ODD).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, SENTENCE), (2, None), (3, ""), (None, " ... "), (4, SENTENCE)]
    return spark.createDataFrame(rows, "item_id long, text string")


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x))


ALL_IDS = sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))


def test_shards(odd, none):
    rows = shards.shard(odd, limit=2000).collect()
    assert ids(rows) == ALL_IDS
    held = shards.directory(shards.shard(odd, limit=2000)).collect()
    assert all(r["n_bytes"] <= 2000 or r["n_rows"] == 1 for r in held)
    assert shards.shard(none).count() == 0


def test_shards_split_one_hot_key(spark):
    rows = spark.createDataFrame([(7, "x" * 100)] * 500 + [(i, "y" * 40) for i in range(200)], "doc_id long, text string").repartition(5)
    held = shards.directory(shards.shard(rows, limit=1000)).collect()
    assert sum(r["n_rows"] for r in held) == 700 and max(r["n_bytes"] for r in held) <= 1000


def test_token_counts(odd, none):
    rows = token_counts.count_tokens(odd).collect()
    assert ids(rows) == ALL_IDS
    by = {r["doc_id"]: r for r in rows}
    assert (by[3]["n_bytes"], by[3]["n_tokens"]) == (0, 0) and by[7]["over_limit"] and not by[1]["over_limit"]
    assert token_counts.count_tokens(none).count() == 0


def test_language(odd, none):
    model = language.fit(odd)
    rows = language.predict(odd, model).collect()
    assert ids(rows) == ALL_IDS
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["lang_pred"] == by[10]["lang_pred"] == "und" and by[1]["lang_pred"] == "en"
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert language.predict(none, language.fit(none)).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(unlabelled)).collect()} == {"und"}


def test_language_tie_goes_to_the_first_name(spark):
    rows = spark.createDataFrame([(i, "same words here", "bb" if i % 2 else "aa") for i in range(40)], "doc_id long, text string, lang string")
    learned = rows.where(~language.held_out(F.col("doc_id")))
    even = learned.where("lang = 'aa'").limit(10).union(learned.where("lang = 'bb'").limit(10))
    assert {r["lang_pred"] for r in language.predict(rows, language.fit(even)).collect()} == {"aa"}


def test_packing(odd, none):
    pieces = packing.pack(odd, with_ids=True)
    rows = pieces.collect()
    assert sum(r["start"] == 0 for r in rows) == len(ROWS)
    made = packing.sequences(pieces).collect()
    assert sum(len(r["ids"]) for r in made) == 4 * sum(r["length"] for r in rows)
    assert all(len(r["ids"]) <= 4 * packing.WINDOW for r in made)
    assert packing.pack(none).count() == 0


def test_privacy(odd, none):
    rows = privacy.digests(privacy.find(odd)).collect()
    assert ids(rows) == ALL_IDS
    assert [(r["n_email"], r["n_ip"]) for r in rows if r["doc_id"] == 8] .count((1, 1)) == 2
    assert privacy.find(none).count() == 0
    clean = privacy.sanitise(odd)
    assert clean.schema == odd.schema and clean.count() == len(ROWS)
    assert clean.where("doc_id = 8 and text = '[EMAIL] and [IP]'").count() == 2
    assert clean.where("text is null").count() == 2
    assert privacy.sanitise(none).count() == 0


def test_near_duplicates(odd, none):
    found = near_duplicates.near_duplicates(odd)
    by = {}
    for r in found.collect():
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by[1][0][1] == by[2][0][1] == 1 and by[3] == [(0, 3)] and by[6] == [(1, 6)]
    assert ids(found.collect()) == ALL_IDS and (0, None) in by[None]
    kept = near_duplicates.kept_rows(odd, found)
    assert kept.columns == odd.columns
    # 2 repeats 1, one of the two equal rows of 8 goes, and the null id that is near 1.
    left = [r["doc_id"] for r in kept.collect()]
    assert 2 not in left and left.count(8) == 2 and 1 in left and left.count(3) == 1
    assert near_duplicates.near_duplicates(none).count() == 0
    assert near_duplicates.kept_rows(none, near_duplicates.near_duplicates(none)).count() == 0


def test_decontamination(odd, none, bench):
    rows = decontaminate.leaks(odd, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(d, i) for d in (1, 2, None) for i in (1, 4)}
    left = decontaminate.clean(odd, bench)
    assert left.schema == odd.schema and left.count() == len(ROWS) - 3
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.clean(none, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == len(ROWS)


def test_quality(odd, none):
    rows = quality.clean(odd).collect()
    assert ids(rows) == ALL_IDS
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["kept"] and not by[3]["kept"] and by[3]["base_failed"] and by[5]["n_words"] == 0
    assert quality.clean(none).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, example int, last string"
    rows = [
        (1, 0, "user", "a <b> \\ c"), (1, 1, "assistant", "</turn>\n\\<"), (1, 2, "user", None), (2, 0, None, "x"),
        (3, 1, "assistant", ""), (3, None, "user", "first"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"),
        (None, 0, "user", "no id"), (5, 0, "user", LONG), (5, 1, "assistant", LONG),
    ]
    talks = spark.createDataFrame([(*r, 1, "z") for r in rows], schema).repartition(3)
    by = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(talks)).collect()}
    assert {k: r["n_turns"] for k, r in by.items()} == {1: 3, 2: 1, 3: 2, 4: 2, None: 1, 5: 2}
    assert by[4]["loss_chars"] == 8 and by[2]["loss_chars"] == 0 and by[5]["loss_chars"] == len(LONG)
    assert chat.read_back(chat.format_conversations(talks.limit(0))).count() == 0


def test_chat_mask_covers_the_reply_alone(spark):
    talks = spark.createDataFrame([(1, 0, "user", "q<"), (1, 1, "assistant", "r\\<"), (1, 2, "assistant", "s")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_conversations(talks).collect(), key=lambda r: r["example"])
    cut = [chat.unescaped(r["text"][r["loss_start"] : r["loss_start"] + r["loss_length"]]) for r in rows]
    assert cut == ["r\\<", "s"] and [r["last"] for r in rows] == [False, True]
    assert chat.turns_of(rows[1]["text"]) == [("user", "q<"), ("assistant", "r\\<"), ("assistant", "s")]


def test_token_files(spark, odd, none, fresh_dir):
    token_files.write(odd, fresh_dir + "/odd")
    rows = token_files.read(spark, fresh_dir + "/odd").collect()
    assert ids(rows) == ALL_IDS
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    token_files.write(none, fresh_dir + "/none")
    assert token_files.read(spark, fresh_dir + "/none").count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, odd, none, fresh_dir, bench, name, stage):
    bench.write.parquet(fresh_dir + "/benchmark.parquet")
    out = stage(spark, odd, fresh_dir)
    if name != "packing":
        assert out.columns == odd.columns
    left = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert left <= {r[0] for r in ROWS}
    gone = {"language": {3, 4, 5, 10}, "near_duplicates": {2}, "decontamination": {1, 2}}.get(name, set())
    assert not gone & left and (name == "decontamination" or 1 in left)
    assert stage(spark, none, fresh_dir).count() == 0
