"""The registered queries: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credsieve.functions import verdict as V
from credsieve.functions.detect import arm_of
from credsieve.functions.globs import match_any
from credsieve.functions.identity import fingerprint, secret_hash, snippet_hash
from credsieve.functions.rules import custom_rule, rule_set, rules_table
from credsieve.functions.score import context, entropy, severity
from credsieve.functions.vectors import cosine, embedding, raw_embedding, strict_cosine
from credsieve.operators import allowlist_tables, ledger
from credsieve.operators import baseline as B
from credsieve.operators import filters, history, reports, scan, similarity, verify
from credsieve.operators.neighbours import nearest
from credsieve.operators.reachable import reachable_commits as reached
from credsieve.operators.run import complete_scan as complete
from credsieve.operators.run import scan_and_store
from credsieve.plans.corpora import (
    CORPUS_TOKEN, commit_rows, corpus_rules, document_files, load, long_lines, plant_entries,
    planted_files,
)
from credsieve.session import fresh_path, released, settled
from credsieve.sources import files as S
from credsieve.sources import store as ST
from credsieve.sources.baseline import ordered_entries
from credsieve.sources.config import Allowlist, Config, load_config
from credsieve.sources.history import added_lines, parse_commit_log, select_commits
from credsieve.sources.lines import lines, long_line_counts, spread
from credsieve.sources.tree import stream_tree
from credsieve.streaming import lifecycle
from credsieve.streaming import scan as stream

Query = Callable[[SparkSession, str], DataFrame]

# Options of the queries; the oracle SQL spells them out again.
FILTERS = Config(
    min_entropy=3.4,
    rules=(CORPUS_TOKEN,),
    allowlist=Allowlist(
        paths=("conf/docs/*", "src/app_1[0-4]?.py"),
        secrets=("password = \"" + "c4ca4238a0b9",),
        regexes=(r"(?i)^glpat-[0-9a]",),
        rule_ids=("pattern-0", "pattern-21"),
        path_regexes=(r"_test\.go$",),
        files=("app_7.py",),
    ),
)
BASELINED_RULES = ("pattern-35", "pattern-136")
CORPUS_RULE_VARIANTS = (
    custom_rule("weak-password", r"passcode[=:][0-9a-f]{8}", min_entropy=2.9),
    custom_rule("fixed-level", r"(?i)Note[_-]id=[0-9]+", confidence="critical", tags=("a", "b")),
    custom_rule("AWS_Key boost", r"AWS_Key=[0-9]{6}"),
    custom_rule("off", r"never", enabled=False),
)

DIALECT_RULES = (
    custom_rule("posix-digits", r"[[:alpha:]]{2}[[:digit:]]{4}[^[:space:]]*", confidence="high"),
    custom_rule("posix-punct", r"(?i)[[:lower:]]+[[:punct:]][[:lower:]]+-[0-9]+", confidence="high"),
    custom_rule("vertical-tab", r"a\vb[[:word:]]+", confidence="high"),
    custom_rule("quoted", r"\Q(x)[y]$\E [0-9]+", confidence="high"),
    custom_rule("inside-a-word", r"\Bqqword", confidence="high"),
    custom_rule("folded", r"(?i)sTi[r-t]K-(?:k|i)_[É][0-9]+", confidence="high"),
    custom_rule("partly-folded", r"s(?i:TIſ)k-[^K]_", confidence="high"),
)


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_files(spark, sf_dir).select("path", "content")


def _planted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(_planted(spark, sf_dir))


def _planted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_files(_planted(spark, sf_dir), corpus_rules())


def _flat(findings: DataFrame, *columns: str) -> DataFrame:
    """Plain columns of findings, entropy rounded for comparison."""
    shown = columns or (
        "file", "file_path", "line_no", "line", "match", "rule_id", "pattern",
        "confidence", "entropy", "context", "verified",
    )
    casts = {
        "entropy": "round(entropy, 6) as entropy",
        "line_no": "cast(line_no as bigint) as line_no",
    }
    return findings.selectExpr(*[casts.get(c, c) for c in shown])


# --- detection and scoring -------------------------------------------------


def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: all rules over documents and planted files, counted."""
    files = document_files(spark, sf_dir).unionByName(_planted(spark, sf_dir))
    found = scan.scan_files(files, corpus_rules())
    return found.groupBy("rule_id", "confidence").agg(F.count("*").alias("n"))


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(scan.scan_files(document_files(spark, sf_dir), corpus_rules()))


def planted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_planted_findings(spark, sf_dir))


def file_hits_with_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan.file_hits(_planted_lines(spark, sf_dir), corpus_rules())
    return hits.groupBy("rule_idx", "context", "confidence").agg(
        F.count("*").alias("n"), F.round(F.sum("entropy"), 4).alias("entropy_sum")
    )


def text_table_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text column of the tables as lines: how many, and how many rules own."""
    tables = {
        "documents": ("doc_id", "text"), "pages": ("page_id", "html"),
        "conversations": ("conv_id", "text"), "benchmark": ("item_id", "text"),
        "events": ("event_id", "props"),
    }
    parts = []
    for table, (key, text) in tables.items():
        texts = spread(load(spark, sf_dir, table).select(key, text)).selectExpr(
            f"'{table}' as source", f"cast({key} as string) as path", f"{text} as content"
        )
        parts.append(texts)
    texts = parts[0]
    for part in parts[1:]:
        texts = texts.unionByName(part)
    rows = lines(texts)
    owners = scan.owners(rows, corpus_rules())
    return owners.groupBy("source").agg(
        F.count("*").alias("n_lines"), F.count("rule_idx").alias("n_hits")
    )


def every_matching_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan.detect_all(_planted_lines(spark, sf_dir), corpus_rules())
    return hits.selectExpr("path", "cast(line_no as bigint) as line_no", "rule_idx")


def first_of_every_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan.detect_all(_planted_lines(spark, sf_dir), corpus_rules())
    return hits.groupBy("path", F.col("line_no").cast("bigint").alias("line_no")).agg(
        F.min("rule_idx").alias("rule_idx")
    )


def hits_per_rule_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = corpus_rules()
    hits = scan.detect(_planted_lines(spark, sf_dir), rules).groupBy("rule_idx").count()
    table = rules_table(spark, rules).select("rule_idx", "rule_id", "name", "rule_set")
    return table.join(hits, "rule_idx", "left").select(
        "rule_idx", "rule_id", "name", "rule_set", F.coalesce("count", F.lit(0)).alias("n")
    )


def hits_per_gate_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines each gate arm lets through, next to those a rule of that arm owns."""
    rules = corpus_rules()
    arms = {r.rule_idx: arm_of(r) for r in rules}
    hits = scan.detect(_planted_lines(spark, sf_dir), rules)
    names = ", ".join(f"'{arms[i]}'" for i in range(len(rules)))
    return hits.groupBy(F.expr(f"get(array({names}), rule_idx)").alias("arm")).agg(
        F.count("*").alias("n")
    )


def most_random_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "concat('src/db_', c_custkey, '.py') as path",
        "cast(1 as int) as line_no",
        "concat(case c_custkey % 3 when 0 then 'Server=10.0.' when 1 then 'data source=db'"
        " else 'HOST=' end, c_custkey, '; ', case c_custkey % 2 when 0 then 'Password='"
        " else 'Initial Catalog=' end, case c_custkey % 5 when 0 then 'aaaa' else"
        " substr(md5(cast(c_custkey as string)), 1, 9) end, ';') as line",
    )
    hits = scan.file_hits(rows, corpus_rules())
    return hits.selectExpr(
        "c_custkey", "rule_idx", "match", "round(entropy, 6) as entropy", "confidence"
    )


def text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "conversations")).selectExpr(
        "conv_id", "turn", f"round({entropy('text')}, 6) as entropy"
    )


def character_entropy_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sum over a whole source: histogram by grouping, then one sum."""
    docs = load(spark, sf_dir, "documents")
    counts = (
        docs.select("source", F.explode(F.split("text", "")).alias("ch"))
        .groupBy("source", "ch")
        .agg(F.count("*").alias("n"))
    )
    lengths = docs.groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"))
    share = F.col("n") / F.col("bytes")
    return (
        counts.join(lengths, "source")
        .groupBy("source")
        .agg(F.round(F.sum(-share * F.log2(share)), 6).alias("entropy"))
    )


def contexts_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines(document_files(spark, sf_dir))
    pages = spread(load(spark, sf_dir, "pages").selectExpr("url as path", "html as content"))
    rows = docs.unionByName(lines(pages)).unionByName(_planted_lines(spark, sf_dir))
    return rows.groupBy(F.expr(context("path", "line")).alias("context")).agg(
        F.count("*").alias("n")
    )


def regex_definition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planted_lines(spark, sf_dir).where(scan.is_regex_line("line"))
    return rows.selectExpr("path", "cast(line_no as bigint) as line_no", "line")


def severity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = (
        "case o_orderpriority when '1-URGENT' then 'CRITICAL' when '2-HIGH' then 'High'"
        " when '3-MEDIUM' then 'medium' when '5-LOW' then 'low' else o_orderpriority end"
    )
    return (
        load(spark, sf_dir, "orders")
        .groupBy(F.expr(word).alias("level"))
        .agg(F.count("*").alias("n"))
        .selectExpr("level", f"{severity('level')} as severity", "n")
    )


def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rule_set(CORPUS_RULE_VARIANTS)
    rows = load(spark, sf_dir, "part").selectExpr(
        "concat('src/p', p_partkey, '.py') as path",
        "cast(p_partkey % 3 + 1 as int) as line_no",
        "case p_partkey % 4 when 0 then concat('passcode=', substr(md5(cast(p_partkey as string)), 1, 8))"
        " when 1 then concat('NOTE_ID=', p_partkey) when 2 then concat('AWS_Key=', 100000 + p_partkey)"
        " else concat('never ', p_name) end as line",
    )
    config = Config(rules=CORPUS_RULE_VARIANTS)
    found = filters.apply_config(scan.scan_lines(rows, rules), config, rules)
    return _flat(found, "file", "line_no", "match", "rule_id", "confidence", "entropy")


# --- sources ---------------------------------------------------------------


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(load(spark, sf_dir, "documents").selectExpr("doc_id", "text as content"))
    return rows.groupBy("doc_id").agg(
        F.max("line_no").cast("bigint").alias("n_lines"),
        F.max(F.octet_length("line")).cast("bigint").alias("longest"),
        F.count_if(F.col("line") == "").alias("n_blank"),
    )


def texts_with_long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and a text per nation whose second line is over a megabyte."""
    texts = load(spark, sf_dir, "documents").selectExpr("concat('d', doc_id) as path", "text as content")
    nations = load(spark, sf_dir, "nation").selectExpr(
        "concat('n', n_nationkey) as path",
        "concat(n_name, '\\n', repeat(concat(n_name, ' '), 1 + 1200000 div length(n_name)), '\\n', n_regionkey) as content",
    )
    return long_line_counts(texts.unionByName(spread(nations))).withColumn("long_lines", F.col("long_lines").cast("bigint"))


def long_line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules find on lines of 20 KB and of 10 MB."""
    hits = scan.file_hits(long_lines(spark, sf_dir), corpus_rules())
    return hits.selectExpr("path", "rule_idx", "context", "md5(match) as digest", "char_length(match) as length")


def written_corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files, then scanned as a file tree."""
    root = fresh_path(spark, "corpus")
    (
        load(spark, sf_dir, "documents")
        .select("lang", "text")
        .write.option("maxRecordsPerFile", 20)
        .partitionBy("lang")
        .text(root)
    )
    # Written files end in .txt, which makes them documentation: count low hits too.
    files = S.read_files(spark, root, include_globs=["lang=*/*"])
    hits = scan.file_hits(lines(files.select("path", "content")), corpus_rules())
    counted = hits.groupBy(F.split("path", "/")[0].alias("folder"), "context", "confidence")
    return counted.agg(F.count("*").alias("n"))


def _named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under names that Spark's file sources would leave out, or that need quoting."""
    names = (
        "'.env'", "'_settings.py'", "'.aws/credentials'", "'_private/a.py'", "'.github/ci.yml'", "'x/.npmrc'",
        "'src/a.py'", "'my dir/b c.py'", "'node_modules/m.js'", "'deep/er/.hid den/%41+.cfg'",
    )
    return load(spark, sf_dir, "documents").selectExpr(
        f"concat('d', doc_id, '/', get(array({', '.join(names)}), cast(doc_id % {len(names)} as int))) as path",
        "text as content",
    )


def hidden_files_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written tree with hidden names, read back whole."""
    root = fresh_path(spark, "tree")
    S.write_files(_named_documents(spark, sf_dir), root)
    found = S.read_files(spark, root)
    return found.selectExpr("path", "size", "md5(content) as digest")


def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with a link loop, a link to a file, one to nothing and a pipe, read in small input partitions."""
    root = fresh_path(spark, "tree")
    files = _named_documents(spark, sf_dir)
    S.write_files(files, root)
    target = files.agg(F.min_by("path", F.regexp_extract("path", r"^d(\d+)", 1).cast("long"))).first()[0]
    plant_entries(spark, root, links={"loop": ".", "self": "self", "same.cfg": target}, pipes=["pipe"])
    found = S.read_tree(spark, root, bundle_bytes=1 << 20)
    return found.selectExpr("path", "size", "md5(content) as digest", "reason")


def streamed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree that grows between two runs of a stream, read some files at a time."""
    root, log, out, state = (fresh_path(spark, n) for n in ("tree", "tree-log", "tree-out", "tree-state"))
    files = settled(_named_documents(spark, sf_dir))
    first = F.expr("pmod(xxhash64(path), 2) = 0")
    for wave in (files.where(first), files.where(~first)):
        S.write_files(wave, root)
        arriving = stream_tree(spark, root, log, max_files=150, ignored_dirs=S.IGNORED_DIRS)
        rows = arriving.selectExpr("path", "size", "md5(content) as digest", "reason")
        stream.drain(rows, out, state)
    return spark.read.schema("path string, size bigint, digest string, reason string").parquet(out)


def skipped_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a size cap and skipped long lines leave out of a scan, and why."""
    long = "repeat(replace(text, '\n', ' '), cast(ceil(1200000 / octet_length(text)) * (1 + doc_id % 2) as int))"
    texts = load(spark, sf_dir, "documents").selectExpr(
        "concat('doc/', doc_id, '.cfg') as path", f"if(doc_id % 83 = 5, {long}, text) as content"
    )
    files = texts.selectExpr("path", "cast(octet_length(content) as bigint) as size", "content")
    over = S.oversize(files, 2_000_000)
    kept = S.prune(files, max_file_size=2_000_000)
    lost = long_line_counts(kept).selectExpr("path", "size", "'long lines' as reason")
    return over.unionByName(lost)


def pruned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tree(spark, sf_dir)
    kept = S.prune(
        files,
        max_file_size=S.resolve_max_file_size(S.MAX_FILE_SIZE, 900_000),
        exclude_globs=S.parse_list("tmp/*, *.log,src/gen?"),
    )
    return kept.select("path", "size")


def included_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = S.prune(
        _tree(spark, sf_dir),
        include_globs=["src/*", "*.py", "lib/[a-m]*/*.js"],
        include_extensions=S.parse_extensions("go, .PY,js"),
    )
    return kept.select("path", "size")


def glob_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    globs = {
        "deep": ["vendor/*"], "suffix": ["*.go"], "several": ["*.txt", "*.md"],
        "one": ["src/gen?/*"], "negated": ["lib/[^a-m]*/*"], "broken": ["[a-"],
    }
    return tree.select(
        *[F.count_if(F.expr(match_any("path", g))).alias(name) for name, g in globs.items()]
    )


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file tree derived from the part table."""
    folders = (
        "src", "lib/alpha", "lib/zeta", "vendor", "a/node_modules/x", "tmp", "src/gen1",
        "docs", "build", "buildx", "src/vendor/y", ".git",
    )
    names = (
        "main.go", "app.PY", "x.min.js", "y.js", "logo.PNG", "run.log", "readme.md", "notes.txt",
        ".env", "a.tar.gz", "b.min.css", "noext",
    )
    listed = "array({})".format(", ".join(f"'{f}'" for f in folders))
    named = "array({})".format(", ".join(f"'{f}'" for f in names))
    return load(spark, sf_dir, "part").selectExpr(
        f"concat(get({listed}, cast(p_partkey % 12 as int)), '/', p_partkey, '_',"
        f" get({named}, cast(floor(p_partkey / 12) % 12 as int))) as path",
        "p_partkey % 1000 * 1000 as size",
    )


def parsed_commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = commit_rows(spark, sf_dir).select(
        F.concat_ws("|", "hash", "author", "date", "message").alias("value")
    )
    short = load(spark, sf_dir, "benchmark").select(F.col("text").alias("value"))
    return parse_commit_log(log.unionByName(short))


def newest_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = commit_rows(spark, sf_dir).select("hash", "author", "date", "message")
    return select_commits(commits, max_commits=40, since="2024-02-10").select(
        "hash", "author", "date"
    )


def diff_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = commit_rows(spark, sf_dir).selectExpr("hash as commit_hash", "diff")
    return added_lines(diffs).select(
        "commit_hash", "path", "line_no", "line_no_true", "line"
    )


def history_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commit_rows(spark, sf_dir)
    return _flat(
        history.scan_history(
            rows.select("hash", "author", "date"),
            rows.selectExpr("hash as commit_hash", "diff"),
            corpus_rules(),
        )
    )


def recent_history_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commit_rows(spark, sf_dir)
    found = history.scan_history(
        rows.select("hash", "author", "date", F.expr("author <> 'user_3'").alias("on_branch")),
        rows.selectExpr("hash as commit_hash", "diff"),
        corpus_rules(),
        max_commits=100,
        since="2024-03-01",
        reachable="on_branch",
    )
    return _flat(found, "file", "file_path", "line_no", "rule_id", "confidence", "context")


# --- filters and baseline --------------------------------------------------


def config_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.apply_config(_planted_findings(spark, sf_dir), FILTERS, corpus_rules())
    return _flat(found, "file_path", "line_no", "match", "rule_id", "confidence", "entropy")


def table_allowlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowlists kept as tables: secrets of some orders, and two rules."""
    found = _planted_findings(spark, sf_dir)
    secrets = load(spark, sf_dir, "lineitem").selectExpr(
        "concat('password = \"', substr(md5(cast(l_orderkey as string)), 1, 12)) as match"
    )
    rules = load(spark, sf_dir, "region").selectExpr("concat('pattern-', r_regionkey * 2) as rule_id")
    found = filters.without_listed(found, secrets, "match")
    found = filters.without_listed(found, rules, "rule_id")
    return _flat(found, "file_path", "line_no", "match", "rule_id")


def allowlist_tables_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowlists of as many globs as there are parts and regexes as there are customers."""
    found = _settled_findings(spark, sf_dir)
    globs = load(spark, sf_dir, "part").selectExpr("concat('src/app_', p_partkey, '.p[xy]') as glob").union(
        load(spark, sf_dir, "supplier").selectExpr("concat('svc_', s_suppkey * 3, '_*.go') as glob")
    ).union(load(spark, sf_dir, "region").selectExpr("concat('conf/doc', if(r_regionkey % 2 = 0, 's', 'x'), '/*.yaml')"))
    regexes = load(spark, sf_dir, "customer").selectExpr("concat('(?i)PASS[v-z]ord = .', substr(md5(cast(c_custkey as string)), 1, 6)) as regex").union(
        load(spark, sf_dir, "nation").selectExpr("concat('^ghp_', substr(md5(n_name), 1, 1), '[0-9]|^[a-f]', n_nationkey % 10, '$')")
    )
    found = allowlist_tables.without_globs(found, globs)
    return _flat(allowlist_tables.without_regexes(found, regexes), "file_path", "line_no", "match", "rule_id")


def reachable_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits (orders) that the last orders of some customers reach: a customer's orders are a
    chain, its first follows the last of another, and urgent ones merge that of a third."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    last = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = orders.withColumn("parent", before)
    of = last.selectExpr("o_custkey as c", "last")
    chain = rows.select(F.col("o_orderkey").alias("commit"), "parent").where("parent is not null")
    forks = rows.where("parent is null and o_custkey > 0").join(of, F.expr("c = o_custkey div 2"), "left").select(F.col("o_orderkey").alias("commit"), F.col("last").alias("parent"))
    merges = rows.where("o_orderpriority = '1-URGENT' and o_custkey > 0").join(of, F.expr("c = o_custkey div 3")).select(F.col("o_orderkey").alias("commit"), F.col("last").alias("parent"))
    refs = load(spark, sf_dir, "supplier").selectExpr("s_suppkey * 7 as c").join(of, "c").select(F.col("last").alias("commit"))
    return reached(chain.union(forks).union(merges), refs)


def request_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of answers, some malformed or missing, merged into a ledger; one round twice."""
    found = settled(ledger.with_digest(_planted_with_code(spark, sf_dir)), small=True)
    # Prompts are most of the ledger and never change: its versions are kept without them, and what
    # is open has its texts from the last round's.  What a round has replaced is removed.
    wanted = settled(ledger.to_ask(ledger.enrolled(ledger.empty_ledger(spark), found)), small=True)
    book = settled(ledger.enrolled(ledger.empty_ledger(spark).drop("prompt"), wanted), small=True)
    asked = None
    for number in (1, 2, 3):
        if number > 1:
            before, wanted = wanted, settled(ledger.to_ask(book, wanted), small=True)
            released(before)
        round_asked = settled(wanted.select("digest").withColumn("round", F.lit(number)), small=True)
        asked = round_asked if asked is None else asked.union(round_asked)
        answer = (
            f"case ascii(substr(digest, {number}, 1)) % 4 when 0 then concat('{{\"is_real_secret\": true, \"confidence\": \"high\", \"reasoning\": \"round {number}\"}}')"
            " when 1 then 'no idea' when 2 then '```json {broken' end"
        )
        answers = wanted.selectExpr("digest", f"{answer} as content").where("content is not null")
        for _ in range(2 if number == 2 else 1):
            before, book = book, settled(ledger.merged(book, answers, number), small=True)
            released(before)
    released(wanted)
    judged = ledger.judged(found, settled(ledger.enrolled(book, found), small=True))
    times = asked.groupBy("digest").agg(F.count("*").alias("asked"))
    return judged.join(book.select("digest", "attempts", "status"), "digest").join(times, "digest").selectExpr(
        "finding_key", "attempts", "cast(asked as int) as asked", "status", "verdict.confidence as confidence", "verdict.reasoning as reasoning"
    )


def whole_store_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector the nearest of all in a store that holds each, and a copy bent a little or more."""
    vectors = load(spark, sf_dir, "embeddings")
    bent = "transform(embedding, (x, i) -> cast(x + (0.03 + 0.02 * (vec_id % 6)) * sin(i * 1.7 + vec_id) as float))"
    store = vectors.selectExpr("vec_id as id", "embedding").union(vectors.selectExpr("vec_id + 10000000 as id", f"{bent} as embedding"))
    found = nearest(vectors.select("vec_id", "embedding"), store, "vec_id")
    return found.selectExpr("vec_id", "id", "round(cast(similarity as double), 4) as similarity", "cast(rank as bigint) as rank")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted_findings(spark, sf_dir).selectExpr(
        "file_path",
        "cast(line_no as bigint) as line_no",
        f"{fingerprint('file_path', 'rule_id', 'match')} as fingerprint",
        f"{secret_hash('match')} as secret_hash",
        f"{snippet_hash('line')} as snippet",
        f"{snippet_hash('line', ephemeral=True)} as short_snippet",
    )


def _settled_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings a query uses more than once, or sorts (a sort samples its input
    before it reads it): computed once."""
    return settled(_planted_findings(spark, sf_dir))


def _accepted(findings: DataFrame) -> DataFrame:
    kept = findings.where(F.col("rule_id").isin(*BASELINED_RULES))
    return B.updated_baseline(
        B.entries_of(kept.where("line_no < 0")), kept, "accepted in review"
    )


def baseline_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _settled_findings(spark, sf_dir)
    return _flat(B.suppress(found, _accepted(found)), "file_path", "line_no", "rule_id", "match")


def baseline_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _settled_findings(spark, sf_dir)
    entries = ordered_entries(B.updated_baseline(_accepted(found), found))
    return entries.withColumn("line", F.col("line").cast("bigint"))


def baseline_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _settled_findings(spark, sf_dir)
    entries = B.updated_baseline(_accepted(found), found)
    return entries.agg(F.count("*").alias("n"), F.count("reason").alias("n_with_reason"))


def baseline_as_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _planted_findings(spark, sf_dir)
    document = reports.baseline_document(_accepted(found))
    items = document.where("startswith(ltrim(value), '{\"fing') or startswith(value, ',')")
    item = "from_json(substring(value, 2), 'file string, line bigint, secret_hash string')"
    return items.select("seq", F.expr(item).alias("e")).select("seq", "e.*")


# --- reports ---------------------------------------------------------------


def redacted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.redact(_planted_findings(spark, sf_dir))
    return _flat(found, "file_path", "line_no", "line", "match", "rule_id")


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spread(load(spark, sf_dir, "documents").selectExpr("doc_id", "text as content"))
    masked = reports.redact_texts(texts, corpus_rules())
    return masked.selectExpr("doc_id", "md5(content) as digest")


def redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which matches of several rules overlap, masked."""
    digits = "md5(cast(o_orderkey as string))"
    line = (
        "case o_orderkey % 4"
        f" when 0 then concat('google_api_key = \"AIza', substr({digits}, 1, 32), 'abcTAILSECRETTAIL', o_orderkey, '\"')"
        f" when 1 then concat('auth0_secret = \"ghp_', substr({digits}, 1, 32), 'abcdTAILTAILTAIL', o_orderkey, '\"')"
        f" when 2 then concat('password = \"', {digits}, '\" and token = \"', sha1(cast(o_orderkey as string)), '\"')"
        " else concat('nothing on line ', o_orderkey) end"
    )
    rows = spread(load(spark, sf_dir, "orders").select("o_orderkey")).selectExpr("o_orderkey", f"{line} as content")
    return reports.redact_texts(rows, corpus_rules()).selectExpr("o_orderkey", "content as line")


def findings_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = reports.findings_document(_settled_findings(spark, sf_dir), masked=False)
    item = (
        "from_json(substring(value, 2), 'file string, line bigint, line_text string, match string,"
        " rule_id string, pattern string, confidence string, context string, verified boolean')"
    )
    items = document.where("value not in ('[', ']')")
    return items.select("seq", F.expr(item).alias("e")).select("seq", "e.*")


def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _planted_findings(spark, sf_dir)
    return reports.sarif_results(found).selectExpr(
        "ruleId", "level", "text", "uri", "cast(startLine as bigint) as startLine"
    )


def sarif_as_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SARIF lines, read back."""
    document = reports.sarif_document(_settled_findings(spark, sf_dir))
    at = "$.locations[0].physicalLocation"
    return document.selectExpr(
        "if(seq > 4000000000, -1L, seq) as seq",
        "get_json_object(substring(value, 2), '$.ruleId') as rule_id",
        f"get_json_object(substring(value, 2), '{at}.artifactLocation.uri') as uri",
        f"cast(get_json_object(substring(value, 2), '{at}.region.startLine') as bigint) as line_no",
    )


def severity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commit_rows(spark, sf_dir)
    hits = history.scan_history(
        rows.select("hash", "author", "date"),
        rows.selectExpr("hash as commit_hash", "diff"),
        corpus_rules(),
    )
    return reports.severity_summary(hits)


def severity_ordered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.severity_report(_settled_findings(spark, sf_dir))
    return _flat(report, "severity", "file_path", "line_no", "rule_id", "match", "line")


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.report_lines(_settled_findings(spark, sf_dir), masked=False)
    return report.groupBy("section", "part").agg(
        F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last")
    )


def ci_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ci_summary(_settled_findings(spark, sf_dir), masked=False).selectExpr(
        "number", "file_path", "cast(line_no as bigint) as line_no", "confidence", "match"
    )


def gate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate at each threshold and mode, and the status outputs of a CI step."""
    found = _settled_findings(spark, sf_dir)
    out = None
    for fail_on, mode in (("critical", "detect"), ("HIGH", "protect"), ("odd", "other"), ("low", "report")):
        row = reports.gate(found, fail_on=fail_on, mode=mode).withColumn("run", F.lit(f"{fail_on}/{mode}"))
        out = row if out is None else out.unionByName(row)
    return out


def ci_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_outputs(_planted_findings(spark, sf_dir), fail_on="high")


def counts_per_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts_by_confidence(_planted_findings(spark, sf_dir))


def totals_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commit_rows(spark, sf_dir)
    past = history.scan_history(
        rows.select("hash", "author", "date"),
        rows.selectExpr("hash as commit_hash", "diff"),
        corpus_rules(),
    )
    return reports.totals_by_origin(history.all_findings(_planted_findings(spark, sf_dir), past))


def complete_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and history through config and baseline, as one scan."""
    files = planted_files(spark, sf_dir).selectExpr(
        "path", "octet_length(content) as size", "content"
    )
    rows = commit_rows(spark, sf_dir)
    accepted = load(spark, sf_dir, "customer").selectExpr(
        "concat('src/app_', c_custkey, '.py') as path",
        "concat('password = \"', substr(md5(cast(c_custkey as string)), 1, 12)) as secret",
    )
    found = complete(
        files,
        config=FILTERS,
        commits=rows.select("hash", "author", "date"),
        diffs=rows.selectExpr("hash as commit_hash", "diff"),
        since="2024-02-01",
        baseline=accepted.selectExpr(
            f"{fingerprint('path', repr('pattern-136'), 'secret')} as fingerprint"
        ),
    )
    return found.selectExpr(
        "origin", "file_path", "cast(line_no as bigint) as line_no", "rule_id", "match", "confidence"
    )


# --- verification ----------------------------------------------------------


def _planted_with_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.scan_with_code(_planted(spark, sf_dir), corpus_rules())


def code_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.code_structure(_planted(spark, sf_dir)).selectExpr(
        "path", "language", "concat_ws('|', functions) as functions",
        "concat_ws('|', imports) as imports", "is_test",
    )


def document_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.code_structure(document_files(spark, sf_dir)).selectExpr(
        "path", "cast(size(functions) as bigint) as n_functions",
        "cast(size(imports) as bigint) as n_imports",
    )


def neighbour_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = verify.scan_with_code(document_files(spark, sf_dir), corpus_rules())
    found = docs.unionByName(_planted_with_code(spark, sf_dir))
    return _flat(found, "file_path", "line_no", "function", "language", "code", "finding_key")


def heuristic_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = verify.heuristic_verdicts(_planted_with_code(spark, sf_dir))
    return judged.selectExpr("file_path", "cast(line_no as bigint) as line_no", "verdict.*")


def reserved_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = (
        "case s_suppkey % 7 when 0 then concat('10.', s_suppkey % 256, '.0.1')"
        " when 1 then concat('172.', s_suppkey % 64, '.9.9') when 2 then concat('192.', 100 + s_suppkey, '.1.1')"
        " when 3 then concat(' 127.0.0.', s_suppkey, ' ') when 4 then '0.0.0.0'"
        " when 5 then concat('host', s_suppkey) else concat('10.01.', s_suppkey, '.1') end"
    )
    rows = load(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{address} as address")
    return rows.selectExpr("s_suppkey", "address", f"{V.is_reserved_address('address')} as reserved")


def verification_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = verify.requests(_planted_with_code(spark, sf_dir))
    return asked.selectExpr("finding_key", "md5(prompt) as digest")


def _responses(findings: DataFrame) -> DataFrame:
    """A made-up response per finding, in the shapes a verifier answers in."""
    body = (
        "concat('{\"is_real_secret\": ', if(line_no % 2 = 1, 'true', 'false'),"
        " ', \"confidence\": \"high\", \"reasoning\": \"looks ', rule_id, '\"}')"
    )
    content = (
        f"case char_length(match) % 5 when 0 then {body}"
        f" when 1 then concat('```json\\n', {body}, '\\n```')"
        f" when 2 then concat(' ', {body}, ' Hope it helps') when 3 then concat('Sure: ', {body})"
        " else '{\"is_real_secret\": \"yes\"}' end"
    )
    return findings.selectExpr("finding_key", f"{content} as content")


def decoded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.decode_responses(_responses(_planted_with_code(spark, sf_dir)))


def merged_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settled(_planted_with_code(spark, sf_dir))
    given = verify.decode_responses(_responses(found))
    return _flat(
        verify.verify(found, verifier=verify.given_verdicts(given)),
        "file", "line_no", "confidence", "verified", "verification_reason",
    )


def disabled_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = verify.disabled_verdicts(_planted_findings(spark, sf_dir))
    return judged.groupBy("verdict.confidence", "verdict.reasoning", "verdict.recommendation").agg(
        F.count("*").alias("n")
    )


# --- vectors and the finding store -----------------------------------------


def embedding_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as a finding store."""
    return load(spark, sf_dir, "embeddings").selectExpr(
        "vec_id as id",
        "concat('src/e', vec_id, '.py') as file_path",
        "cast(vec_id % 50 as int) as line_number",
        "'' as code_snippet",
        "embedding",
        "concat('pattern-', label) as pattern_type",
        "cast(vec_id as double) as entropy",
        "case label % 4 when 1 then 'high' when 3 then 'critical' else 'medium' end as confidence",
        "label % 2 = 1 as verified",
        "vec_id as timestamp",
    )


def pseudo_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spread(load(spark, sf_dir, "customer")).select("c_custkey", "c_name")
    vectors = names.selectExpr("c_custkey", f"{raw_embedding('c_name')} as v")
    return vectors.selectExpr("c_custkey", "posexplode(v) as (i, x)").selectExpr(
        "c_custkey", "cast(i as bigint) as i", "round(cast(x as double), 4) as x"
    )


def unit_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each name's vector with that of the next customer's."""
    names = spread(load(spark, sf_dir, "customer")).selectExpr(
        "c_custkey", "c_name as a", "concat('Customer#', lpad(c_custkey + 1, 9, '0')) as b"
    )
    both = names.selectExpr("c_custkey", f"{embedding('a')} as va", f"{embedding('b')} as vb")
    return both.selectExpr("c_custkey", f"round(cast({cosine('va', 'vb')} as double), 4) as similarity")


def cosine_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    pairs = vectors.alias("a").join(
        vectors.selectExpr("vec_id - 1 as vec_id", "embedding as other"), "vec_id"
    )
    return pairs.selectExpr(
        "vec_id", f"round(cast({cosine('embedding', 'other')} as double), 5) as similarity"
    )


def latest_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.latest_verified(embedding_store(spark, sf_dir), 200).select(
        "id", "file_path", "timestamp"
    )


def similar_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = similarity.similar_pairs(rows, embedding_store(spark, sf_dir), "vec_id", threshold=0.3)
    return pairs.selectExpr(
        "vec_id", "id", "round(cast(similarity as double), 5) as similarity", "cast(rank as bigint) as rank"
    )


def batch_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and their contexts as two tables, judged pair by pair."""
    found = settled(_planted_with_code(spark, sf_dir).dropDuplicates(["finding_key"]))
    around = found.select("finding_key", "code", "function", "language")
    judged = verify.batch_verdicts(found.drop("code", "function", "language"), around)
    return judged.select("finding_key", "verdict.is_real_secret", "verdict.confidence")


def scanned_and_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that judges its findings, and the store it leaves behind."""
    files = planted_files(spark, sf_dir).selectExpr("path", "octet_length(content) as size", "content")
    found, store = scan_and_store(files, ST.empty_store(spark), config=Config(rules=(CORPUS_TOKEN,)), ephemeral=True)
    kept = settled(store, small=True).groupBy("confidence", "verified").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 384).alias("n_vectors"))
    shown = found.groupBy("confidence", "verified").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("n_vectors"))
    return kept.withColumn("what", F.lit("store")).unionByName(shown.withColumn("what", F.lit("findings")))


def stored_baseline_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored baseline grown twice, then read as it lies in the folder."""
    found, path = _settled_findings(spark, sf_dir), fresh_path(spark, "baseline")
    B.update_stored_baseline(found.where(F.col("rule_id").isin(*BASELINED_RULES)), path, reason="accepted in review")
    B.update_stored_baseline(found, path)
    entries = B.stored_baseline(spark, path)
    return entries.groupBy("rule_id", "reason").agg(F.count("*").alias("n"))


def loaded_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A config file written, loaded over the defaults, and applied."""
    folder = fresh_path(spark, "config")
    text = (
        '{"general": {"min_entropy": 3.4}, "allowlist": {"paths": ["conf/docs/*"], "rule_ids": ["pattern-0"],'
        ' "files": ["app_7.py"]}}'
    )
    written = spark.createDataFrame([(".credsieve.json", text)], "path string, content string")
    S.write_files(written, folder)
    config = load_config(spark, root=folder)
    found = filters.apply_config(_planted_findings(spark, sf_dir), config, corpus_rules())
    return _flat(found, "file_path", "line_no", "match", "rule_id")


def strict_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-precision cosine of each vector with the next."""
    vectors = load(spark, sf_dir, "embeddings")
    pairs = vectors.alias("a").join(
        vectors.selectExpr("vec_id - 1 as vec_id", "embedding as other"), "vec_id"
    )
    return pairs.selectExpr(
        "vec_id", f"round(cast({strict_cosine('embedding', 'other')} as double), 3) as similarity"
    )


def dialect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom rules and allowlists with constructs that two regex dialects spell differently."""
    rows = load(spark, sf_dir, "part").selectExpr(
        "concat('src/p', p_partkey, if(p_partkey % 5 = 0, '.T3ST', '.py')) as path",
        "cast(1 as int) as line_no",
        "case p_partkey % 6 when 0 then concat('id', p_partkey + 1000, 'x9QrTyLmWz') when 1 then concat('zq~zq-', p_partkey)"
        " when 2 then concat('a', char(11), 'bKqWzXvTyU') when 3 then concat('(x)[y]$ ', p_partkey)"
        " when 4 then concat('mid', p_partkey, 'qqword') else concat('plain ', p_partkey) end as line",
    ).unionByName(
        # Letters that some engines take for i, s and k without case.
        load(spark, sf_dir, "supplier").selectExpr(
            "concat('src/s', s_suppkey, '.py') as path", "cast(1 as int) as line_no",
            "replace('azure_client_id = 0a1b2c3d-0a1b-2c3d-4e5f-0a1b2c3d4e5f aſkkey', substr('iskK', 1 + s_suppkey % 4, 1),"
            " substr('ıſKİ', 1 + s_suppkey % 4, 1)) as line",
        ).unionByName(
            load(spark, sf_dir, "supplier").selectExpr(
                "concat('src/t', s_suppkey, '.py') as path", "cast(1 as int) as line_no",
                "concat(substr('ısSİſK', 1 + s_suppkey % 6, 1), 'tiſk-', substr('KkKıiE', 1 + s_suppkey % 6, 1), '_é', s_suppkey) as line",
            )
        )
    )
    config = Config(rules=DIALECT_RULES, allowlist=Allowlist(path_regexes=(r"[.][[:upper:]][[:digit:]]",), regexes=(r"^[[:alpha:]]+1[[:digit:]]*x",)))
    rules = config.rule_set()
    found = filters.apply_config(scan.scan_lines(rows, rules), config, rules)
    return _flat(found, "file_path", "match", "rule_id")


def reused_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings judged with a store that knows some of them already."""
    found = settled(_planted_with_code(spark, sf_dir))
    known = ST.store_rows(
        verify.merge_verdicts(verify.heuristic_verdicts(found)).where("line_no = 4"),
        embedding("line"), timestamp="conv(substring(md5(file_path), 1, 7), 16, 10)",
    )
    judged = verify.verify(found, store=known)
    return judged.selectExpr("file_path", "cast(line_no as bigint) as line_no", "rule_id", "reused is not null as reused", "confidence", "verified")


def store_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _settled_findings(spark, sf_dir)
    first = ST.store_rows(found, "array(cast(line_no as float))", timestamp="1")
    second = ST.store_rows(
        found.where("line_no = 4").selectExpr("* except (verified)", "true as verified"),
        "array(cast(0 as float))", timestamp="2",
    )
    store = ST.upsert(ST.upsert(ST.empty_store(spark), first), second)
    return store.selectExpr(
        "file_path", "cast(line_number as bigint) as line_number", "pattern_type",
        "code_snippet", "verified", "timestamp", "cast(embedding[0] as double) as x",
    )


def store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store grown in three writes and marked, in small buckets: two of its versions."""
    found, path = _settled_findings(spark, sf_dir), fresh_path(spark, "store")
    first = ST.store_rows(found, "array(cast(line_no as float))", timestamp="1")
    later = ST.store_rows(found.where("confidence = 'high'"), "array(cast(0 as float))", timestamp="2")
    ST.upsert_stored(first.where("line_number <> 4"), path, bucket_bytes=64 * 1024)
    seen = ST.upsert_stored(first.where("line_number = 4"), path, bucket_bytes=64 * 1024)
    ST.upsert_stored(later, path, bucket_bytes=64 * 1024, base=seen.version)
    ST.mark_stored(ST.read_store(spark, path).where("confidence = 'critical'").selectExpr("id", "true as verified"), path)
    parts = [ST.read_store(spark, path, version=v).withColumn("version", F.lit(v)) for v in (seen.version, seen.version + 2)]
    return parts[0].unionByName(parts[1]).selectExpr(
        "version", "file_path", "cast(line_number as bigint) as line_number", "pattern_type", "verified", "timestamp"
    )


def store_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = load(spark, sf_dir, "labels").selectExpr("doc_id as id", "quality = 1 as verified")
    marked = ST.mark_verified(embedding_store(spark, sf_dir), verdicts)
    return marked.select("id", "verified")


# --- streaming -------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving events as one-line texts; every event carries a planted password."""
    schema = load(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    return _as_texts(events)


def _as_texts(events: DataFrame) -> DataFrame:
    secret = "substr(md5(cast(user_id as string)), 1, 10 + cast(event_id % 3 as int))"
    return events.selectExpr(
        "concat('app/', event_type, '_', user_id % 50, '.py') as path",
        f"concat(props, ' password = \"', {secret}, '\"') as content",
        "to_timestamp(concat(cast(ts as string), 'Z')) as ts",
    )


def _drained(findings: DataFrame, name: str) -> DataFrame:
    """Run a stream over what has arrived, into a table in the shared folder."""
    spark = findings.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, name + "-state")
    stream.write_findings(findings, out, state).awaitTermination()
    return spark.read.schema(findings.schema).parquet(out)


def streamed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream.scan_stream(_event_stream(spark, sf_dir), corpus_rules())
    done = _drained(found, "findings")
    return done.groupBy("file_path", "rule_id", "confidence").agg(F.count("*").alias("n"))


def streamed_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a stream on one checkpoint: in the first, findings in comments; in the
    second the same and others in code, which are worse."""
    inbox, out, state = (fresh_path(spark, n) for n in ("inbox", "worse", "worse-state"))
    events = load(spark, sf_dir, "events").selectExpr(
        "concat('app/', event_type, '_', user_id % 50, '.py') as path",
        "concat(if(event_id % 3 = 0, '# ', ''), 'token ghp_', md5(cast(user_id as string)), 'Zz9Q') as content",
        "event_id % 3 = 0 as first", "to_timestamp(concat(cast(ts as string), 'Z')) as ts",
    )
    for number, wave in enumerate((events.where("first"), events.where("not first"))):
        wave.drop("first").write.parquet(f"{inbox}/wave={number}")
        arriving = spark.readStream.schema("path string, content string, ts timestamp").option("recursiveFileLookup", True).parquet(inbox)
        lifecycle.write_worse(stream.scan_stream(arriving, corpus_rules()).drop("ts"), out, state).awaitTermination()
    reported = spark.read.schema("file_path string, rule_id string, match string, confidence string").parquet(out)
    return reported.select("file_path", "rule_id", "match", "confidence")


def streamed_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = load(spark, sf_dir, "customer").selectExpr(
        "explode(array('view', 'click', 'error')) as kind",
        "c_custkey",
        "concat('password = \"', substr(md5(cast(c_custkey as string)), 1, 10)) as match",
    )
    path = "concat('app/', kind, '_', c_custkey % 50, '.py')"
    known = accepted.selectExpr(
        f"{fingerprint(path, repr('pattern-136'), 'match')} as fingerprint"
    )
    found = stream.scan_stream(_event_stream(spark, sf_dir), corpus_rules())
    done = _drained(stream.suppress_stream(found, known), "fresh")
    return done.groupBy("file_path", "rule_id").agg(F.count("*").alias("n"))


def streamed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream.scan_stream(_event_stream(spark, sf_dir), corpus_rules())
    done = _drained(stream.once_per_fingerprint(found, delay="1 day"), "once")
    return done.select("file_path", "rule_id", "match", "fingerprint")


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of all windows, open ones too: each batch updates those it touches, and
    the last update of a window is its count."""
    found = stream.scan_stream(_event_stream(spark, sf_dir), corpus_rules())
    done = stream.counted_windows(
        found, fresh_path(spark, "counts"), fresh_path(spark, "counts-state"), window="1 day", delay="1 day"
    )
    return done.groupBy("confidence").agg(
        F.count("*").alias("n_windows"), F.sum("n").alias("n")
    )


def streamed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream.scan_stream(_event_stream(spark, sf_dir), corpus_rules())
    rows = ST.store_rows(found, "array(cast(1 as float))", timestamp="unix_timestamp(ts)")
    path, state = fresh_path(spark, "store"), fresh_path(spark, "store-state")
    stream.upsert_stream(rows, path, state).awaitTermination()
    stored = ST.read_store(spark, path)
    return stored.selectExpr(
        "file_path", "cast(line_number as bigint) as line_number", "pattern_type", "timestamp"
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        findings_by_rule, document_findings, planted_findings, file_hits_with_low, text_table_hits,
        every_matching_rule, first_of_every_rule, hits_per_rule_name, hits_per_gate_arm,
        most_random_group, text_entropy, character_entropy_per_source, contexts_of_lines,
        regex_definition_lines, severity_ranks, custom_rules,
        line_counts, texts_with_long_lines, written_corpus_scan, pruned_files, included_files,
        glob_matches, parsed_commit_log, newest_commits, diff_added_lines, history_findings,
        recent_history_findings,
        config_filtered, table_allowlisted, fingerprints, baseline_suppressed, baseline_updated,
        baseline_size, baseline_as_document,
        redacted_findings, redacted_documents, findings_as_json, sarif_results, sarif_as_document,
        severity_totals, severity_ordered_report, report_text, ci_summary, gate_results, ci_outputs,
        counts_per_confidence, totals_by_origin, complete_scan,
        code_structure, document_structure, neighbour_lines, heuristic_verdicts, reserved_addresses,
        verification_requests, decoded_responses, merged_verdicts, disabled_verification,
        pseudo_embeddings, unit_embeddings, cosine_to_first, latest_verified, similar_verified,
        reused_verdicts, store_upserted, store_marked,
        streamed_findings, streamed_suppressed, streamed_once, streamed_counts, streamed_store,
        hidden_files_scan, skipped_inputs, redacted_lines, dialect_rules, batch_verdicts,
        scanned_and_stored, stored_baseline_update, loaded_config, strict_cosines,
        long_line_findings, tree_scan, streamed_tree,
        store_history, allowlist_tables_applied, reachable_commits, request_rounds, whole_store_neighbours,
        streamed_lifecycle,
    )
}
