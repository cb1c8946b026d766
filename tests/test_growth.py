"""Steps whose time has to grow no faster than their input."""

import hashlib
import re

from credsieve.functions import detect as D
from credsieve.operators import allowlist_tables, scan
from credsieve.plans import corpora
from credsieve.sources import files, store, tree


def test_rules_are_tested_by_compiled_conditions(spark, rules):
    rows = spark.createDataFrame([("a.py", 1, "token ghp_" + "a1" * 20)], "path string, line_no int, line string")
    plan = scan.detect(rows, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and "lambdafunction(CASE WHEN" not in plan


def test_compiled_and_interpreted_rules_agree(spark):
    rules = corpora.corpus_rules()
    keys = spark.range(2 * len(rules)).selectExpr(f"{corpora.planted(corpora.SPARK, 'id')} as line")
    odd = spark.createDataFrame([(None,), ("",), ("x" * 9000 + ' password = "a1b2c3d4e5f6"',), ("PAſſWORD = 'abcdefgh1234'",)], "line string")
    rows = keys.unionByName(odd).withColumn("path", scan.F.lit("a.py"))
    one = {(r["line"], r["rule_idx"]) for r in scan.detect(rows, rules).collect()}
    two = {(r["line"], r["i"]) for r in rows.selectExpr("line", f"{D.first_rule(rules, 'line')} as i").where(f"i is not null and i <> {D.LONG_LINE}").collect()}
    assert two <= one and {r for r in one - two if len(r[0]) < D.LINEAR_FROM} == set() and len(one) > len(two)


def test_a_column_of_any_name_stays(spark, rules):
    rows = spark.createDataFrame([("password = 'abcdefgh1234'", 7, 8)], "line string, arms int, first int")
    found = scan.detect(rows, rules).collect()
    assert [(r["arms"], r["first"]) for r in found] == [(7, 8)]


def test_templates_are_filled_by_stretches(spark):
    patterns = [corpora.template(r.regex) for r in corpora.corpus_rules()]
    # What is done for a text grows with its stretches, of which there are few.
    assert sum(len(corpora.runs(p)) for p in patterns) * 8 < sum(map(len, patterns))
    plan = spark.range(1).selectExpr(corpora.planted(corpora.SPARK, "id"))._jdf.queryExecution().analyzed().toString()
    assert "split(" not in plan

    def filled(key):
        digits = "a" * 192 if key % 11 == 0 else "".join(hashlib.sha256(f"{p}{key}".encode()).hexdigest() for p in "abc")
        out = ""
        for i, ch in enumerate(patterns[key % len(patterns)]):
            at = digits[i : i + 1]
            out += {corpora.HEX: at, corpora.UPPER: at.upper(), corpora.DIGIT: at.translate(str.maketrans("abcdef", "123456"))}.get(ch, ch)
        return out

    keys = [*range(len(patterns)), 10**9 + 7]
    rows = spark.createDataFrame([(k,) for k in [*keys, None]], "k bigint").selectExpr("k", f"{corpora.planted(corpora.SPARK, 'k')} as text")
    assert {r["k"]: r["text"] for r in rows.collect()} == {None: None} | {k: filled(k) for k in keys}


def test_alike_rows_of_an_allowlist_do_not_share_a_key(spark):
    n = 300
    globs = spark.range(n).selectExpr("concat('src/app_', id, '.p[xy]') as glob").union(spark.range(n).selectExpr("concat('*_', id, '.go')"))
    regexes = spark.range(n).selectExpr("concat('(?i)wo[r]d = .', substr(md5(cast(id as string)), 1, 8)) as regex")
    for listed, kind in ((globs, "glob"), (regexes, "regex")):
        keyed = allowlist_tables._keyed(listed, kind, kind)
        assert keyed.count() == listed.count() and keyed.groupBy("key").count().agg({"count": "max"}).first()[0] <= 3
    paths = spark.createDataFrame([(f"src/app_{i}.py",) for i in range(2 * n)] + [(f"a/b_{i}.go",) for i in range(2 * n)] + [(None,)], "file_path string")
    left = {r[0] for r in allowlist_tables.without_globs(paths, globs).collect()}
    assert left == {None} | {f"src/app_{i}.py" for i in range(n, 2 * n)} | {f"a/b_{i}.go" for i in range(n, 2 * n)}


def test_rows_of_an_allowlist_without_a_key_are_not_shuffled_to_one_task(spark):
    texts = spark.createDataFrame([(f"ab{i}",) for i in range(50)] + [("12",), (None,)], "match string")
    left = allowlist_tables.without_regexes(texts, spark.createDataFrame([("[a-z]+1",), ("^[0-9]",)], "regex string"))
    assert sorted(r[0] for r in left.where("match is not null").collect()) == sorted(f"ab{i}" for i in range(50) if str(i)[0] != "1")
    assert left.where("match is null").count() == 1


def test_a_split_counts_no_more_parts_than_it_makes(spark, monkeypatch):
    rows = spark.range(4000).selectExpr(
        "cast(conv(substring(sha2(cast(id as string), 256), 1, 15), 16, 10) as bigint) as id", "'a.py' as file_path", "'' as code_snippet",
        "array(cast(1 as float)) as embedding", "'p' as pattern_type", "'high' as confidence", "'' as _bits",
    )
    size = rows.agg(store.F.sum(store._row_bytes())).first()[0]
    seen = []
    frame = type(rows)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    parts = store._split(rows, {"": size}, size // 3)
    assert sum(2.0 ** -len(p) for p in parts) == 1 and sum(map(len, seen)) <= 8
    seen.clear()
    # Many buckets, each a little over the limit, are split in one round that sees a few parts of each.
    held = rows.withColumn("_bits", store.F.expr(f"substring({store._bits()}, 1, 5)"))
    sizes = {r["_bits"]: r["n"] for r in collect(held.groupBy("_bits").agg(store.F.sum(store._row_bytes()).alias("n")))}
    parts = store._split(held, sizes, int(0.8 * min(sizes.values())))
    assert sum(2.0 ** -len(p) for p in parts) == 1 and sum(map(len, seen)) <= 4 * len(sizes) < len(parts) * 4


def test_files_of_one_split_are_written_by_many_tasks(spark, fresh_dir, monkeypatch):
    rows = spark.range(0, 90, 1, 1).selectExpr("concat('d', id % 4, '/', id) as path", "cast(id as string) as content")
    seen, frame = [], type(rows)
    mapped = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a: seen.append(self.rdd.getNumPartitions()) or mapped(self, *a))
    files.write_files(rows, f"{fresh_dir}/tree")
    assert seen == [4 * spark.sparkContext.defaultParallelism]
    monkeypatch.setattr(tree, "BUNDLE_FILES", 7)
    read = {(r["path"], r["content"]) for r in files.read_files(spark, f"{fresh_dir}/tree").collect()}
    assert read == {(f"d{i % 4}/{i}", str(i)) for i in range(90)}


def test_arms_of_the_gate_are_tested_by_compiled_conditions(spark, rules):
    rows = spark.createDataFrame([("a.py", 1, "token ghp_" + "a1" * 20)], "path string, line_no int, line string")
    plan = scan.owned(rows, rules)._jdf.queryExecution().optimizedPlan().toString()
    bodies = [re.split(r", lambda \w+#\d+, false", x)[0] for x in plan.split("lambdafunction(")[1:]]
    assert "Contains(" in plan and not any("Contains(" in x or "RLIKE" in x for x in bodies)
    odd = [None, "", "nothing here", "x" * 9000 + ' password = "a1b2c3d4e5f6"', "token ghp_" + "a1" * 20, "x" * 9000]
    found = scan.owned(spark.createDataFrame([("a.py", i, x) for i, x in enumerate(odd)], "path string, line_no int, line string"), rules)
    wanted = {r["line_no"] for r in scan.owners(spark.createDataFrame([("a.py", i, x) for i, x in enumerate(odd)], "path string, line_no int, line string"), rules).where("rule_idx is not null").collect()}
    assert {r["line_no"] for r in found.collect()} == wanted == {3, 4}
