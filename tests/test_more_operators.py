"""Start refs, allowlist tables, neighbours in a whole store, the request ledger, worse findings."""

import os

import numpy as np
import pytest

from credsieve.functions.globs import full_match
from credsieve.functions.text import matches
from credsieve.functions.dialect import to_java
from credsieve.operators import allowlist_tables as A
from credsieve.operators import ledger as L
from credsieve.operators import neighbours as N
from credsieve.operators import verify
from credsieve.operators.reachable import chains, reachable_commits
from credsieve.session import released, settled
from credsieve.streaming import lifecycle

EDGES = "commit string, parent string"


def reached(edges, refs):
    seen, todo = set(), [r for r in refs if r is not None]
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += [p for a, p in edges if a == c and p is not None]
    return seen


def test_reachable_commits_of_many_histories(spark):
    rng = np.random.default_rng(3)
    # Each history has its own names, so that one job walks all of them.
    edges, refs = [], []
    for h in range(60):
        n = int(rng.integers(1, 40))
        for c in range(1, n):
            parents = [c - 1] if rng.random() < 0.8 else rng.choice(c, min(c, int(rng.integers(0, 3))), replace=False).tolist()
            edges += [(f"{h}:{c}", f"{h}:{p}") for p in parents]
        edges += [(f"{h}:{n - 1}", f"{h}:gone"), (f"{h}:0", None)]
        refs += [f"{h}:{int(rng.integers(0, n))}" for _ in range(int(rng.integers(0, 3)))]
    edges += edges[:50]
    refs += [None, "alone", refs[0]]
    got = reachable_commits(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(r,) for r in refs], "commit string"))
    rows = [r["commit"] for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == reached(edges, refs)
    none = spark.createDataFrame([], EDGES)
    assert reachable_commits(none, spark.createDataFrame([], "commit string")).collect() == []


def test_long_chains_take_few_rounds_and_cycles_are_errors(spark):
    line = spark.range(1, 5000).selectExpr("cast(id as string) as commit", "cast(id - 1 as string) as parent")
    got = {r["commit"]: (r["top"], r["below"]) for r in chains(line).collect()}
    assert got["0"] == ("4999", 4999) and got["4999"] == ("4999", 0)
    assert reachable_commits(line, spark.createDataFrame([("70",)], "commit string")).count() == 71


GLOBS = [
    "src/*", "*.go", "a.py", "src/a.py", "*", "d?c/*.md", "docs/[^a]*/x.*", r"lit\*eral", "*.tar.gz", "pre*.min.js", "[", "x[]", "", "/abs/*", "e.*",
    "deep/er/still/?", "s*c/a.py", "no/such", "*/a.py", ".env", "*.e?v", "b/",
]
PATHS = [
    "src/a.py", "a.py", "x/a.py", "main.go", "src/sub/main.go", "docs/bx/x.md", "docs/ax/x.md", "dxc/r.md", "lit*eral", "literal", "q/r.tar.gz",
    "pre1.min.js", "x/pre.min.js", "/abs/y", "deep/er/still/z", ".env", "k/.env", "e.", "", "b/", "é/ü.go", "none",
]


def test_globs_as_a_table(spark, evaluate):
    findings = spark.createDataFrame([(p, i) for i, p in enumerate([*PATHS, None])], "file_path string, _known int")
    for glob in GLOBS:
        want = [p for p in PATHS if not evaluate([(p,)], "p string", full_match("p", [glob]))[0][0]] if glob in ("*", "b/", "[") else None
        if want is not None:
            left = A.without_globs(findings, spark.createDataFrame([(glob,)], "glob string"))
            assert sorted(r["file_path"] for r in left.collect() if r["file_path"] is not None) == sorted(want), glob
    # Every glob at once, one by one: a path is met by the globs that match it.
    tests = [f"{full_match('p', [g])} as g{i}" for i, g in enumerate(GLOBS)]
    want = evaluate([(p,) for p in PATHS], "p string", *tests)
    for i, glob in enumerate(GLOBS):
        matched = {p for p, row in zip(PATHS, want) if row[i]}
        if matched:
            keys = {k for p in matched for k in evaluate([(p,)], "p string", A.path_keys("p"))[0][0]} if i % 4 == 0 else None
            assert keys is None or A.glob_key(glob) in keys, glob
    left = A.without_globs(findings, spark.createDataFrame([(g,) for g in GLOBS if g != "*"] + [(None,)], "glob string"))
    assert {r["file_path"] for r in left.collect()} == {None} | {p for p, row in zip(PATHS, want) if not any(x for g, x in zip(GLOBS, row) if g != "*")}
    assert left.columns == findings.columns


REGEXES = [
    "abcd", "(?i)pass[w]ord=", "a|bcdef", "xyz+w", "(abc)?defg", "^start", "en[d]$", "(?i)skis", "(?i)kelv", r"\bword\b", r"a\.b\.c", "(?:long){2}er",
    "", "[0-9]{4}", r"\Qa.b\E", "lo*ng", r"tab\there", "(?i)É[a]bcd", "(?P<n>name)d", "x.y.zzzz",
]
TEXTS = [
    "xxabcdxx", "PASSWORD=1", "password=1", "a", "bcdef", "xyzzzw", "defg", "abcdefg", "start here", "the end", "ſKIS", "Kelv", "a word.", "words",
    "a.b.c", "longlonger", "1234", "12", "a.b", "lng", "looong", "tab\there", "éabcd", "ÉABCD", "named", "x1y2zzzz", "z" * 9000 + "abcd" + "z" * 9000, "",
    "y" * 4094 + "abcd", "y" * 4095 + "word=PASSWORD=",
]


def test_regexes_as_a_table(spark, evaluate):
    want = evaluate([(t,) for t in TEXTS], "t string", *[f"{matches('t', to_java(r))} as r{i}" for i, r in enumerate(REGEXES)])
    findings = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "match string")
    for chosen in ([r for r in REGEXES if r and r not in ("[0-9]{4}",)], ["abcd"], ["(?i)kelv"], ["(?i)skis"], REGEXES[6:9]):
        left = A.without_regexes(findings, spark.createDataFrame([(r,) for r in chosen] + [(None,)], "regex string"))
        kept = [t for t, row in zip(TEXTS, want) if not any(x for r, x in zip(REGEXES, row) if r in chosen)]
        assert sorted(r["match"] for r in left.where("match is not null").collect()) == sorted(kept), chosen
        assert left.where("match is null").count() == 1


def test_needed_texts():
    assert A.needed_texts("ab(cd)ef") == ["abcdef"] and A.needed_texts("a|b") == []
    assert A.needed_texts("ab?cd") == ["a", "cd"] and A.needed_texts("(?i)Task") == ["ta"]
    assert A.regex_keys("[a-z]+") == ["any"] and A.regex_keys("(?i)ABCDE") == ["folded:abcd", "folded:bcde"]


def exact(rows, store, k, threshold):
    out = []
    for key, v in rows:
        if v is None or not any(v):
            continue
        x = np.array(v, np.float64)
        near = []
        for i, w in store:
            if w is not None and len(w) == len(v) and any(w):
                y = np.array(w, np.float64)
                s = np.float32(x @ y / np.sqrt((x @ x) * (y @ y)))
                if s >= np.float32(threshold):
                    near.append((-s, i))
        out += [(key, i, r) for r, (_, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def test_neighbours_in_a_whole_store(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((150, 24))
    store = [(i, (centres[i % 150] + 0.35 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(3000)]
    # Many copies of one vector, and vectors that are none.
    store += [(10_000 + i, store[0][1]) for i in range(400)] + [(20_000, None), (20_001, [0.0] * 24), (20_002, [1.0, 2.0]), (20_003, [])]
    rows = [(i, v) for i, v in store if i % 100 == 0] + [(30_001, None), (30_002, [2.0, 4.0]), (30_003, [0.0])]
    schema = "id long, embedding array<float>"
    got = N.nearest(spark.createDataFrame(rows, schema).withColumnRenamed("id", "of"), spark.createDataFrame(store, schema), "of")
    found = sorted((r["of"], r["id"], r["rank"]) for r in got.collect())
    want = exact(rows, store, 10, 0.8)
    hit = len({(a, b) for a, b, _ in found} & {(a, b) for a, b, _ in want})
    assert len(want) > 200 and hit >= 0.99 * len(want)
    assert (30_002, 20_002, 1) in found
    assert N.nearest(spark.createDataFrame([], schema).withColumnRenamed("id", "of"), spark.createDataFrame([], schema), "of").collect() == []


def test_whole_store_is_compared_in_blocks_and_exactly(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 16))
    store = [(i, (centres[i % 6] + 0.4 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(1500)]
    # One direction in many lengths: more equal similarities than are asked for.
    store += [(5000 + i, [float(x) for x in (i + 1) * np.array(store[7][1][:4] + [0.0] * 12)]) for i in range(40)] + [(9000, [float("nan")] * 16)] * 20
    rows = store[::3]
    schema = "id long, embedding array<float>"
    frames = [spark.createDataFrame(x, schema) for x in (rows, store)]
    monkeypatch.setattr(N, "BLOCK_NUMBERS", 4000)
    assert N.blocks(500 * 16, 1500 * 16, 4) == (2, 6) and N.blocks(0, 0, 8) == (1, 1)
    got = sorted((r["of"], r["id"], r["rank"]) for r in N.nearest(frames[0].withColumnRenamed("id", "of"), frames[1], "of", threshold=0.7).collect())
    whole = [(i, v) for i, v in store if v[0] == v[0]]
    want = exact([(i, v) for i, v in rows if v[0] == v[0]], whole, 10, 0.7)
    assert len(want) > 4000
    # Sums in another order can exchange neighbours whose similarities differ in the last digit alone.
    assert len(set(got) & set(want)) >= 0.995 * len(want) and len(got) == len(want)
    indexed = {(r["of"], r["id"]) for r in N.nearest_by_index(frames[0].withColumnRenamed("id", "of"), frames[1].where("id < 9000"), "of", threshold=0.9).collect()}
    assert len(indexed & {(a, b) for a, b, _ in exact(rows, whole, 10, 0.9)}) >= 0.99 * len(indexed)


def test_no_pairs_of_vectors_are_shuffled(spark):
    rows = spark.range(1, 3001).selectExpr("id as of", "transform(sequence(1, 16), i -> cast(sin(id * i) as float)) as embedding")
    joined = N.nearest(rows, rows.withColumnRenamed("of", "id"), "of")
    assert joined.where("rank = 1").count() == 3000
    # Cells are blocks of both sides: each vector is in as many as the other side has blocks.
    sides = N.blocks(3000 * 16, 3000 * 16, 2 * spark.sparkContext.defaultParallelism)
    assert sides == (1, 1) and N.blocks(120_000 * 64, 240_000 * 64, 16)[0] * N.blocks(120_000 * 64, 240_000 * 64, 16)[1] <= 20


def test_layout_follows_size_and_threshold():
    assert N.layout(10, 0.8) == (1, 1)
    small, large = N.layout(10_000, 0.8), N.layout(100_000_000, 0.8)
    assert small[0] < large[0] and small[1] < large[1]
    assert N.layout(10_000, 0.95)[1] < small[1]


def found_rows(spark, n=4):
    files = spark.createDataFrame([(f"src/a{i}.py", f'def f():\n    password = "Zx81kQpLmN{i:02d}"\n') for i in range(n)], "path string, content string")
    from credsieve.functions.rules import builtin_rules

    return L.with_digest(verify.scan_with_code(files, builtin_rules()))


def test_ledger_asks_each_prompt_until_it_is_answered_or_given_up(spark):
    found = found_rows(spark)
    twice = found.unionByName(found)
    book = L.enrolled(L.empty_ledger(spark), twice)
    assert L.to_ask(book).count() == 4
    ids = sorted(r["digest"] for r in book.collect())
    good = '{"is_real_secret": true, "confidence": "low", "reasoning": "r"}'
    answers = spark.createDataFrame([(ids[0], good), (ids[0], good.replace("true", "false")), (ids[1], "no"), ("other", good), (ids[2], None)], "digest string, content string")
    for _ in range(2):
        book = L.merged(book, answers, 1, most_attempts=2)
    state = {r["digest"]: (r["attempts"], r["status"]) for r in book.collect()}
    assert state == {ids[0]: (1, L.ANSWERED), ids[1]: (1, L.OPEN), ids[2]: (1, L.OPEN), ids[3]: (1, L.OPEN)}
    late = spark.createDataFrame([(ids[0], good), (ids[3], good)], "digest string, content string")
    book = L.merged(book, late, 2, most_attempts=2)
    state = {r["digest"]: (r["attempts"], r["status"]) for r in book.collect()}
    assert state == {ids[0]: (1, L.ANSWERED), ids[1]: (2, L.GIVEN_UP), ids[2]: (2, L.GIVEN_UP), ids[3]: (2, L.ANSWERED)}
    assert L.to_ask(book).count() == 0 and L.enrolled(book, found).count() == 4
    # Of two answers in one round the least counts; what was given up has the heuristic's verdict.
    judged = {r["digest"]: r["verdict"] for r in L.judged(twice, book).collect()}
    assert judged[ids[0]]["is_real_secret"] is False and judged[ids[3]]["is_real_secret"] is True
    assert judged[ids[1]]["reasoning"] != "r" and L.judged(twice, book).count() == 8


def test_versions_of_a_ledger_are_kept_without_prompts(spark):
    found = found_rows(spark)
    whole = L.enrolled(L.empty_ledger(spark), found)
    prompts = L.to_ask(whole)
    bare = L.enrolled(L.empty_ledger(spark).drop("prompt"), found.unionByName(found))
    ids = sorted(r["digest"] for r in whole.collect())
    good = '{"is_real_secret": true, "confidence": "low", "reasoning": "r"}'
    answers = spark.createDataFrame([(ids[0], good), (ids[1], "no")], "digest string, content string")
    whole, bare = L.merged(whole, answers, 1), L.merged(bare, answers, 1)
    assert "prompt" not in bare.columns and sorted(bare.collect(), key=str) == sorted(whole.drop("prompt").collect(), key=str)
    asked = L.to_ask(bare, prompts).collect()
    assert len(asked) == 3 and sorted(asked) == sorted(L.to_ask(whole).collect()) and all(r["prompt"] for r in asked)
    assert L.enrolled(bare, found).count() == 4 and L.judged(found, bare).where("verdict.reasoning = 'r'").count() == 1


def test_a_table_that_is_replaced_is_removed(spark):
    rows = settled(spark.range(100).groupBy("id").count(), small=True)
    assert rows.count() == 100 and os.path.isdir(rows._settled_at)
    released(rows, spark.range(1))
    assert not os.path.exists(rows._settled_at)


def test_batch_verdicts_need_complete_pairs(spark):
    found = verify.scan_with_code(found_rows(spark).select("file_path").selectExpr("file_path as path", "'password = \"Zx81kQpLmN99\"' as content"), _rules())
    around = found.select("finding_key", "code", "function", "language")
    bare = found.drop("code", "function", "language")
    assert verify.batch_verdicts(bare, around).count() == 4
    for one, two in ((bare, around.limit(3)), (bare.limit(3), around), (bare, around.union(around.limit(1)))):
        with pytest.raises(Exception, match="same length"):
            verify.batch_verdicts(one, two).collect()


def _rules():
    from credsieve.functions.rules import builtin_rules

    return builtin_rules()


def test_expiring_state_needs_a_trigger_that_goes_on(spark):
    with pytest.raises(ValueError):
        lifecycle.write_worse(spark.range(1), "x", "y", remembered_ms=1000)
