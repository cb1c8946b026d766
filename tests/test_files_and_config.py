import json

import pytest

from credsieve.functions.globs import full_match, match_any, match_any_ancestor
from credsieve.functions.rules import rule_set
from credsieve.operators import filters
from credsieve.sources import files as S
from credsieve.sources.config import Allowlist, Config, load_config

MIB = 1024 * 1024


@pytest.mark.parametrize(
    "path, globs, want",
    [
        ("vendor/github.com/foo", ["vendor/*"], True), ("vendor", ["vendor/*"], True),
        ("src/vendor/lib", ["vendor/*"], False), ("test.go", ["*.go"], True),
        ("src/app/test.go", ["*.go"], True), ("README.md", ["*.txt", "*.md"], True),
        ("main.py", ["*.go"], False), ("a/b", ["a?b"], False), ("a/xb", ["a/[^a-m]b"], True),
        ("a/bb", ["a/[^a-m]b"], False), ("a.b", ["a[.]b"], True), ("ab", ["a[b"], False),
        ("a*b", [r"a\*b"], True), ("axb", [r"a\*b"], False), ("é.go", ["?.go"], True),
        ("x", [""], False), ("A.GO", ["*.go"], False), ("a/b/c", ["a/*"], True),
        ("a+b.go", ["a+b.go"], True), ("a\nb", ["a*b"], True), ("x]", ["x[]]"], False),
    ],
)
def test_globs(evaluate, path, globs, want):
    assert evaluate([(path,)], "p string", match_any("p", globs)) == [(want,)]


@pytest.mark.parametrize(
    "path, glob, want",
    [
        ("a/tmp/x.go", "tmp", True), ("a/tmpx/x.go", "tmp", False), ("a/b/x.go", "a/b", True),
        ("z/a/b/x.go", "a/b", False), ("gen1/x.go", "gen?", True), ("a/gen1/y/x.go", "gen?", True),
        ("a/x.log", "*.log", True), ("d.log/x.go", "*.log", True), ("a/b/c/d", "a/*", True),
        ("b/a/c", "a/*", False), ("x/ab/c", "a[^z]", True),
    ],
)
def test_excluded_folders_prune_what_is_below(evaluate, path, glob, want):
    assert evaluate([(path,)], "p string", match_any_ancestor("p", [glob])) == [(want,)]


def test_prune(spark):
    rows = [
        ("src/main.go", 10), ("src/big.go", 6 * MIB), ("a/vendor/x.go", 1), ("vendor", 1),
        ("x/logo.PNG", 1), ("x/app.min.js", 1), ("x/app.js", 1), ("buildx/a.py", 1), ("build/a.py", 1),
        (".env", 1), ("tmp/q/a.py", 1),
    ]
    files = spark.createDataFrame(rows, "path string, size long")

    def kept(**options):
        return sorted(r["path"] for r in S.prune(files, **options).collect())

    assert kept() == [".env", "buildx/a.py", "src/big.go", "src/main.go", "tmp/q/a.py", "vendor", "x/app.js"]
    assert kept(include_extensions=S.parse_extensions("PY, .Js,")) == [
        "buildx/a.py", "tmp/q/a.py", "x/app.js"
    ]
    assert kept(exclude_globs=["tmp"], include_globs=["*.py"]) == ["buildx/a.py"]
    assert "src/big.go" not in kept(max_file_size=5 * MIB)
    over = S.oversize(files, 5 * MIB).collect()
    assert [tuple(r) for r in over] == [("src/big.go", 6 * MIB, "size")] and not S.oversize(files, None).collect()


def test_max_file_size_precedence():
    assert S.resolve_max_file_size(None, None) is None
    assert S.resolve_max_file_size(5 * MIB, None) == 5 * MIB
    assert S.resolve_max_file_size(5 * MIB, 1 * MIB) == 1 * MIB
    assert S.resolve_max_file_size(2 * MIB, 1 * MIB) == 2 * MIB
    assert S.resolve_max_file_size(-1, -1) is None


def test_read_files(spark, fresh_dir):
    import os

    for path, text in {
        "src/a.py": "x\n", "node_modules/b.py": "x", "c.png": "x", "docs/d.md": "x",
        "src/e.py": "y" * 100,
    }.items():
        os.makedirs(os.path.dirname(f"{fresh_dir}/{path}"), exist_ok=True)
        with open(f"{fresh_dir}/{path}", "w") as f:
            f.write(text)
    got = {r["path"]: (r["size"], r["content"]) for r in S.read_files(spark, fresh_dir, max_file_size=50).collect()}
    assert got == {"src/a.py": (2, "x\n"), "docs/d.md": (1, "x")}


def test_hidden_files_and_any_way_to_write_the_root(spark, fresh_dir):
    import os

    names = [
        ".env", "_settings.py", ".aws/credentials", "_private/a.py", ".github/ci.yml", "x/.npmrc", "src/a.py",
        "my dir/b c.py", "odd%20name+é.py", "p/tree/p/tree/c.py",
    ]
    texts = spark.createDataFrame([(n, f"text of {n}") for n in [*names, ".git/config", "a/node_modules/b.js"]], "path string, content string")
    S.write_files(texts, fresh_dir + "/p/tree")
    here = os.path.relpath(fresh_dir, spark._jvm.java.lang.System.getProperty("user.dir"))
    for root in (here + "/p/tree", "./" + here + "/p/tree", fresh_dir + "/p/tree", fresh_dir + "/p/tree/", "file://" + fresh_dir + "/p/tree", "file:" + fresh_dir + "/p/../p/tree"):
        got = {r["path"]: r["content"] for r in S.read_files(spark, root).collect()}
        assert got == {n: f"text of {n}" for n in names}


def _write(folder, name, value):
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write(value if isinstance(value, str) else json.dumps(value, indent=2))
    return path


def test_config_defaults_overlay_and_discovery(spark, fresh_dir):
    assert load_config(spark, root=fresh_dir) == Config()
    _write(fresh_dir, ".credsieve.json", {"general": {"min_entropy": 4.0}})
    found = load_config(spark, root=fresh_dir)
    assert (found.min_entropy, found.max_file_size) == (4.0, None)
    path = _write(fresh_dir, "c.json", {
        "general": {"min_entropy": 4.0, "max_file_size": MIB},
        "rules": [{"id": "custom-1", "pattern": "custom-[0-9]+", "enabled": True}],
        "allowlist": {"paths": ["vendor/*"], "rule_ids": ["pattern-5"]},
    })
    full = load_config(spark, path)
    assert full.size_cap == MIB and full.allowlist.paths == ("vendor/*",)
    assert [r.rule_id for r in full.rule_set()[189:]] == ["custom-1"]
    assert Config(min_entropy=-1, max_file_size=0).entropy_floor == 3.0


def test_config_errors(spark, fresh_dir):
    with pytest.raises(Exception):
        load_config(spark, f"{fresh_dir}/missing.json")
    with pytest.raises(Exception):
        load_config(spark, _write(fresh_dir, "bad.json", "{not json"))
    with pytest.raises(ValueError):
        rule_set([{"id": "x", "pattern": "(?=a)", "enabled": True}])


def test_allowlists(evaluate):
    config = Config(
        min_entropy=3.5,
        allowlist=Allowlist(
            paths=("vendor/*",), secrets=("allowed-secret",), regexes=("(?i)example",),
            rule_ids=("pattern-5",), path_regexes=(r".*\.md$",), files=("only.py", "a/b.py"),
        ),
    )
    paths = ["vendor/foo.go", "vendor/a/foo.go", "src/main.go", "docs/README.md", "x/only.py", "a/b.py", "z/b.py"]
    got = evaluate([(p,) for p in paths], "p string", filters.path_is_allowlisted("p", config))
    assert [g for (g,) in got] == [True, False, False, True, True, True, False]
    secrets = ["allowed-secret", "this-is-example-key", "real-secret-123"]
    got = evaluate([(s,) for s in secrets], "s string", filters.secret_is_allowlisted("s", config))
    assert [g for (g,) in got] == [True, True, False]
    got = evaluate([("pattern-5",), ("pattern-1",)], "r string", filters.rule_is_disabled("r", config))
    assert [g for (g,) in got] == [True, False]
    rows = [(3.4, "medium", "x"), (3.4, "high", "x"), (3.5, "medium", "x")]
    got = evaluate(rows, "entropy double, confidence string, rule_id string", filters.below_entropy_floor(config))
    assert [g for (g,) in got] == [True, False, False]
    assert full_match("p", []) == "(false)"
