"""The same queries in plain SQL, for DuckDB to check the Spark results against.

They are written from the definitions, not from the Spark expressions: rules are
tried one after the other with no gate, diffs are decoded with windows, entropies
and vectors are summed the long way.
"""

from __future__ import annotations

from collections.abc import Sequence

from credsieve.functions.rules import Rule, rule_set
from credsieve.functions.verdict import PROMPT
from credsieve.plans.corpora import DUCKDB, commits_sql, corpus_rules, files_sql, long_lines_sql
from credsieve.plans.queries import CORPUS_RULE_VARIANTS

S = DUCKDB.text

REGEX_LINE = r"^\s*`.*(?:\(\?i\)|\\s|\\d|\[|\]|\{|\}|\||\^|\$).*`"


def _ent(x: str) -> str:
    n = f"len(list_filter(string_split({x}, ''), lambda y: y = c))"
    p = f"({n} / strlen({x})::double)"
    terms = f"list_transform(list_distinct(string_split({x}, '')), lambda c: -{p} * log2({p}))"
    return f"(case when {x} = '' then 0.0 else list_sum({terms}) + 0.0 end)"


def _context(path: str = "path", line: str = "line") -> str:
    p, up = f"lower({path})", f"upper({line})"
    doc = " or ".join(f"ends_with({p}, '{e}')" for e in (".md", ".rst", ".adoc", ".txt"))
    test = " or ".join(
        f"ends_with({p}, '{e}')"
        for stem in ("_test", ".spec") for ext in ("go", "ts", "tsx", "js", "jsx")
        for e in [f"{stem}.{ext}"] if (stem, ext) != (".spec", "go")
    )
    dirs = " or ".join(f"contains({p}, '{d}')" for d in ("/test/", "/tests/", "\\test\\", "\\tests\\"))
    marks = " or ".join(f"contains({line}, '{m}')" for m in ("/*", "*/", "<!--", "-->"))
    words = " or ".join(
        f"contains({line}, '{m}')" for m in ("YOUR_", "REPLACE_", "INSERT_", "CHANGE_ME")
    )
    return f"""(case when {doc} or contains({p}, '/docs/') or contains({p}, '\\docs\\') then 'documentation'
        when {test} or {dirs} then 'test_file'
        when regexp_matches({line}, '^[\\s\\x0b\\x{{85}}\\p{{Z}}]*(//|#)') or {marks} then 'comment'
        when regexp_matches({line}, '\\$\\{{[^}}]+\\}}') or regexp_matches({up}, '%[A-Za-z0-9_]+%')
            or regexp_matches({up}, '\\$[A-Z0-9_]+') then 'placeholder'
        when {words} then 'template' else 'code' end)"""


_SCORE = """(50 + case when entropy > 4.5 then 30 when entropy > 4.0 then 20
        when entropy > 3.5 then 10 else -10 end
    + case context when 'comment' then -30 when 'documentation' then -35
        when 'placeholder' then -50 when 'template' then -45 when 'code' then 10 else 0 end)"""


def _level(score: str) -> str:
    return (
        f"(case when {score} >= 80 then 'critical' when {score} >= 60 then 'high'"
        f" when {score} >= 40 then 'medium' else 'low' end)"
    )


def _first_rule(rules: Sequence[Rule], line: str = "line") -> str:
    cases = " ".join(f"when regexp_matches({line}, {S(r.regex)}) then {r.rule_idx}" for r in rules)
    return f"(case {cases} end)"


def _whole(rules: Sequence[Rule]) -> str:
    cases = " ".join(f"when {r.rule_idx} then regexp_extract(line, {S(r.regex)}, 0)" for r in rules)
    return f"(case rule_idx {cases} end)"


def _of_rule(rules: Sequence[Rule], values: list[str]) -> str:
    return f"([{', '.join(S(v) for v in values)}])[rule_idx + 1]"


def _files_to_lines(name: str, files: str, keys: str = "path") -> str:
    """CTEs turning (keys, content) rows into numbered lines."""
    return f"""{name} as (
        select {keys}, pos as line_no,
            case when ends_with(raw, chr(13)) then left(raw, length(raw) - 1) else raw end as line
        from (select {keys}, unnest(parts) as raw, generate_subscripts(parts, 1) as pos
            from (select {keys}, string_split(case when ends_with(content, chr(10))
                    then left(content, length(content) - 1) else content end, chr(10)) as parts
                from {files} where content <> '') a) b
        )"""


def _hits(lines: str, rules: Sequence[Rule], keys: str = "path") -> str:
    """CTE ``hits``: scored file hits, low ones included."""
    two = [r for r in rules if r.groups == 2]
    group = {
        g: "(case rule_idx "
        + " ".join(f"when {r.rule_idx} then trim(regexp_extract(line, {S(r.regex)}, {g}))" for r in two)
        + " else '' end)"
        for g in (1, 2)
    } if two else {1: "''", 2: "''"}
    core = sum(r.rule_set == "core" for r in rules)
    builtin = sum(r.rule_set != "custom" for r in rules)
    return f"""owned as (
        select *, {_first_rule(rules)} as rule_idx from {lines}
        where not regexp_matches(line, {S(REGEX_LINE)})),
    grouped as (
        select *, {_whole(rules)} as whole, {group[1]} as g1, {group[2]} as g2
        from owned where rule_idx is not null),
    weighed as (select *, round({_ent('g1')}, 9) as e1, round({_ent('g2')}, 9) as e2 from grouped),
    chosen as (
        select *, case when g1 = '' and g2 = '' then whole when g1 = '' then g2 when g2 = '' then g1
            when e2 > e1 or (abs(e2 - e1) < 0.01 and strlen(g2) > strlen(g1)) then g2 else g1 end as match
        from weighed),
    measured as (select *, {_ent('match')} as entropy, {_context()} as context from chosen),
    hits as (
        select {keys}, line_no, line, match, rule_idx, entropy, context, {_level(_SCORE)} as confidence,
            {_of_rule(rules, [r.rule_id for r in rules])} as rule_id,
            {_of_rule(rules, [r.regex for r in rules])} as pattern,
            concat(path, case when rule_idx >= {core} and rule_idx < {builtin}
                then ' (Additional Secret)' else ' (Secret)' end) as file
        from measured)"""


_FILES = f"planted as ({files_sql(DUCKDB)})"
_DOCS = "docs as (select concat(source, '/', doc_id) as path, text as content from documents)"
_PLANTED_LINES = f"{_FILES}, {_files_to_lines('planted_lines', 'planted')}"
_DOC_LINES = f"{_DOCS}, {_files_to_lines('doc_lines', 'docs')}"
_RULES = corpus_rules()
_PLANTED_HITS = f"{_PLANTED_LINES}, {_hits('planted_lines', _RULES)}"
_FOUND = f"{_PLANTED_HITS}, found as (select *, path as file_path from hits where confidence <> 'low')"
_MASK = "'****REDACTED****'"
_REPORT_ORDER = "file_path, line_no, rule_id, match"
_RANK = "(case confidence when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end)"
_FINGERPRINT = "substr(sha256(concat(file_path, ':', rule_id, ':', match)), 1, 32)"

# A diff decoded with windows over its lines.
_ADDED = f"""commits as ({commits_sql(DUCKDB)}),
    raw as (select hash, author, unnest(string_split(diff, chr(10))) as raw,
        generate_subscripts(string_split(diff, chr(10)), 1) as seq from commits),
    marked as (select *, starts_with(raw, '+++ b/') as is_file,
        starts_with(raw, '@@') and regexp_matches(raw, '^@@[^+]* \\+[0-9]') as is_hunk from raw),
    carried as (select *,
        coalesce(last_value(case when is_file then substr(raw, 7) end ignore nulls) over w, '') as path,
        count(case when is_file or is_hunk then 1 end) over w as section
        from marked window w as (partition by hash order by seq rows unbounded preceding)),
    counted as (select *,
        coalesce(max(case when is_hunk then cast(regexp_extract(raw, ' \\+([0-9]+)', 1) as bigint) end)
            over (partition by hash, section), 0) as start,
        count(case when starts_with(raw, '+') and not is_file then 1 end)
            over (partition by hash, section order by seq rows unbounded preceding) as n_plus
        from carried),
    added as (select hash, author, path, start + n_plus as line_no, substr(raw, 2) as line
        from counted where starts_with(raw, '+') and not starts_with(raw, '+++'))"""

_HISTORY = f"""{_ADDED},
    past_owned as (select *, {_first_rule(_RULES)} as rule_idx from added),
    past_matched as (select *, {_whole(_RULES)} as match from past_owned where rule_idx is not null),
    past_measured as (select *, {_ent('match')} as entropy, {_context()} as context from past_matched),
    past as (select hash, author, path as file, concat(path, '@', substr(hash, 1, 8)) as file_path,
        line_no, line, match, entropy, {_level(_SCORE)} as confidence,
        {_of_rule(_RULES, [r.rule_id for r in _RULES])} as rule_id,
        {_of_rule(_RULES, [r.regex for r in _RULES])} as pattern,
        concat(context, ' (commit: ', substr(hash, 1, 8), ' by ', author, ')') as context
        from past_measured)"""

_ACCEPTED = f"""{_FOUND},
    marked as (select *, {_FINGERPRINT} as fingerprint, substr(sha256(match), 1, 16) as secret_hash
        from found),
    accepted as (select fingerprint, min(file_path) as file, min(line_no) as line,
        min(rule_id) as rule_id, min(secret_hash) as secret_hash, 'accepted in review' as reason
        from marked where rule_id in ('pattern-35', 'pattern-136') group by fingerprint)"""

_TREE = """tree as (select concat(([
        'src', 'lib/alpha', 'lib/zeta', 'vendor', 'a/node_modules/x', 'tmp', 'src/gen1',
        'docs', 'build', 'buildx', 'src/vendor/y', '.git'])[p_partkey % 12 + 1], '/', p_partkey, '_',
    (['main.go', 'app.PY', 'x.min.js', 'y.js', 'logo.PNG', 'run.log', 'readme.md', 'notes.txt',
        '.env', 'a.tar.gz', 'b.min.css', 'noext'])[cast(floor(p_partkey / 12) as bigint) % 12 + 1]) as path,
    p_partkey % 1000 * 1000 as size from part),
    kept as (select * from tree where not regexp_matches(path,
            '(^|/)(\\.git|node_modules|vendor|dist|build|\\.venv|venv|__pycache__|coverage|\\.idea|\\.vscode)/')
        and not regexp_matches(lower(path), '\\.(png|gz|min\\.js|min\\.css)$'))"""

# Code around findings, from all lines of a file, blank ones included.
_CODE = f"""{_FOUND},
    every as (select path, unnest(string_split(content, chr(10))) as raw,
        generate_subscripts(string_split(content, chr(10)), 1) as no from everything),
    around as (select path, no, string_agg(raw, chr(10)) over (partition by path order by no
        rows between 5 preceding and 5 following) as code from every),
    first_function as (select path, min_by(trim(raw, ' ' || chr(9)), no) as function from every
        where regexp_matches(raw, '(func|def|function) ') group by path),
    coded as (select f.*, a.code, coalesce(ff.function, 'unknown') as function,
        case lower(regexp_extract(f.path, '(\\.[^./]*)$', 1)) when '.go' then 'go' when '.py' then 'python'
            when '.js' then 'javascript' when '.yaml' then 'yaml' when '.json' then 'json'
            else 'unknown' end as language,
        substr(sha256(concat(f.path, ':', line_no, ':', rule_id)), 1, 32) as finding_key
        from found f join around a on a.path = f.path and a.no = f.line_no
        left join first_function ff on ff.path = f.path)"""


def _coded(everything: str) -> str:
    return _CODE.replace(
        "found as (select", f"everything as ({everything}), found as (select", 1
    )


_CODED = _coded("select path, content from planted")

_PROMPT_SQL = "concat(" + ", ".join(
    part
    for piece in PROMPT.replace("{{", "\x01").replace("}}", "\x02").split("{")
    for part in (
        [
            {
                "file": "path", "language": "language", "function": "function",
                "line_no": "cast(line_no as varchar)", "code": "code", "pattern": "pattern",
                "match": "match", "entropy": "printf('%.2f', entropy)", "context": "context",
                "confidence": "confidence",
            }[piece.split("}")[0]],
            S(piece.split("}", 1)[1].replace("\x01", "{").replace("\x02", "}")),
        ]
        if "}" in piece
        else [S(piece.replace("\x01", "{").replace("\x02", "}"))]
    )
) + ")"

_JUDGED = f"""{_CODED},
    flags as (select *,
        ends_with(lower(path), '.md') or ends_with(lower(path), '.rst') or contains(lower(path), '/docs/') as c1,
        regexp_matches(upper(line), 'YOUR_|REPLACE_|EXAMPLE_|CHANGE_ME|INSERT_') as c2,
        contains(line, 'os.Getenv') or contains(line, 'process.env') or contains(line, '${{')
            or regexp_matches(upper(line), '%[A-Za-z0-9_]+%') as c3,
        regexp_matches(match, '^(127\\.|10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)[0-9.]+$')
            and regexp_matches(match, '^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){{3}}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$') as c4,
        entropy < 3.0 as c5, entropy > 4.5 and context = 'code' as c6,
        context in ('comment', 'documentation') as c7 from coded),
    steps as (select *,
        not (c1 or c2 or c3 or c4 or c5) as r5,
        case when c1 or c2 or c4 or c5 then 'low' else confidence end as l5 from flags),
    judged as materialized (select * exclude (confidence), confidence as detected,
        case when c7 then false when c6 then true else r5 end as real,
        case when c7 then 'low' when c6 then 'critical' else l5 end as confidence,
        array_to_string(list_filter([
            case when c1 then 'Found in documentation' end,
            case when c2 then 'Contains placeholder text' end,
            case when c3 then 'Uses environment variable pattern' end,
            case when c4 then 'Reserved IP/address (not a secret)' end,
            case when c5 then concat('Low entropy (', printf('%.2f', entropy), ')') end,
            case when c6 then concat('High entropy (', printf('%.2f', entropy), ') in code') end,
            case when c7 then 'Found in comment or documentation' end], lambda x: x is not null), '; ') as reasoning
        from steps)"""

# Which of the made-up responses hold a verdict, and what it says.
_ANSWERED = """answered as (select finding_key, line_no % 2 = 1 as is_real_secret, 'high' as confidence,
        concat('looks ', rule_id) as reasoning, '' as recommendation
    from judged where length(match) % 5 in (0, 1, 2))"""

_EVENTS = """arrived as (select concat('app/', event_type, '_', user_id % 50, '.py') as path, 1 as line_no,
        concat(props, ' password = "', substr(md5(cast(user_id as varchar)), 1, 10 + cast(event_id % 3 as int)), '"') as line,
        ts from events)"""
_STREAMED = f"""{_EVENTS}, {_hits('arrived', _RULES, 'path, ts')},
    found as (select *, path as file_path from hits where confidence <> 'low')"""

_STORE = """store as (select vec_id as id, embedding, label, label % 2 = 1 as verified,
        case label % 4 when 1 then 'high' when 3 then 'critical' else 'medium' end as confidence,
        concat('src/e', vec_id, '.py') as file_path, vec_id as timestamp from embeddings)"""


def _custom_rules() -> str:
    rules = [r for r in rule_set(CORPUS_RULE_VARIANTS) if r.rule_set == "custom"]
    weak, fixed, boosted = (r.regex for r in rules)
    return f"""
        with rows as (select p_partkey as k, concat('src/p', p_partkey, '.py') as path, p_partkey % 3 + 1 as line_no,
            case p_partkey % 4 when 0 then concat('passcode=', substr(md5(cast(p_partkey as varchar)), 1, 8))
                when 1 then concat('NOTE_ID=', p_partkey) when 2 then concat('AWS_Key=', 100000 + p_partkey)
                else concat('never ', p_name) end as line from part),
        matched as (select *, case k % 4 when 0 then 'weak-password' when 1 then 'fixed-level' else 'AWS_Key boost' end as rule_id,
            case k % 4 when 0 then regexp_extract(line, {S(weak)}) when 1 then regexp_extract(line, {S(fixed)})
                else regexp_extract(line, {S(boosted)}) end as match
            from rows where k % 4 < 3),
        measured as (select *, {_ent('match')} as entropy, 'code' as context from matched),
        levelled as (select *, case rule_id when 'fixed-level' then 'critical' when 'AWS_Key boost'
            then {_level(_SCORE + ' + 15')} else {_level(_SCORE)} end as confidence from measured)
        select concat(path, ' (Secret)') as file, line_no, match, rule_id, confidence, round(entropy, 6) as entropy
        from levelled where confidence <> 'low' and (confidence in ('critical', 'high')
            or entropy >= case rule_id when 'weak-password' then 2.9 else 3.0 end)"""


def _embedding(text: str) -> str:
    """All components from the defining sum; the offset of a character is in bytes."""
    term = (
        f"list_sum(list_transform(range(1, length({text}) + 1), lambda j:"
        f" ord(substr({text}, cast(j as int), 1)) * sin(i + strlen(left({text}, cast(j - 1 as int))))))"
    )
    return f"list_transform(range(0, 384), lambda i: sin({term}))"


def _character_sum(wave: str) -> str:
    """Code points of the line times a wave of their byte offset."""
    return (
        "list_sum(list_transform(range(1, length(line) + 1), lambda j: ord(substr(line, cast(j as int), 1))"
        f" * {wave}(strlen(left(line, cast(j - 1 as int))))))"
    )


def _gate(run: str, threshold: int, failed: str) -> str:
    failing = f"count(*) filter ({_RANK} >= {threshold})"
    return f"""select '{run}' as run, count(*) as total, {failing} as failing,
        case when {failed.format(failing)} then 'failed' else 'success' end as status
        from found"""


def _report_sections() -> str:
    section = f"4 - {_RANK}"
    texts = (
        "concat('File: ', file)", "concat('Line Number: ', line_no)",
        "concat('Confidence: ', upper(confidence), ' (Entropy: ', printf('%.2f', entropy), ')')",
        "concat('Context: ', context)", "concat('Pattern: ', pattern)", "concat('Line: ', line)",
    )
    bodies = " union all ".join(
        f"select {section} as section, {i} as part, {text} as value from found"
        for i, text in enumerate(texts)
    )
    return f"""with {_FOUND}, rows as ({bodies}
        union all select distinct {section}, -1, case confidence when 'critical' then '=== CRITICAL FINDINGS ==='
            when 'high' then '=== HIGH CONFIDENCE ===' else '=== MEDIUM CONFIDENCE ===' end from found
        union all select 9, 0, concat('Summary: ', count(*), ' secrets found (Critical: ',
            count(*) filter (confidence = 'critical'), ', High: ', count(*) filter (confidence = 'high'),
            ', Medium: ', count(*) filter (confidence = 'medium'), ')') from found
        union all select 9, 1, 'Please review and remove them before committing your code.')
        select section, part, count(*) as n, min(value) as first, max(value) as last from rows group by all"""


def _text_tables() -> str:
    tables = {
        "documents": ("doc_id", "text"), "pages": ("page_id", "html"),
        "conversations": ("conv_id", "text"), "benchmark": ("item_id", "text"),
        "events": ("event_id", "props"),
    }
    union = " union all ".join(
        f"select '{t}' as source, cast({k} as varchar) as path, {c} as content from {t}"
        for t, (k, c) in tables.items()
    )
    return f"""with texts as ({union}), {_files_to_lines('all_lines', 'texts', 'source, path')}
        select source, count(*) as n_lines, count({_first_rule(_RULES)}) as n_hits
        from all_lines group by source"""


# Lines on which several rules meet.
_OVERLAPPING = """select o_orderkey as id, 1 as no, case o_orderkey % 4
    when 0 then concat('google_api_key = "AIza', substr(md5(cast(o_orderkey as varchar)), 1, 32), 'abcTAILSECRETTAIL', o_orderkey, '"')
    when 1 then concat('auth0_secret = "ghp_', substr(md5(cast(o_orderkey as varchar)), 1, 32), 'abcdTAILTAILTAIL', o_orderkey, '"')
    when 2 then concat('password = "', md5(cast(o_orderkey as varchar)), '" and token = "', sha1(cast(o_orderkey as varchar)), '"')
    else concat('nothing on line ', o_orderkey) end as line from orders"""


def _masked_lines(lines: str) -> str:
    """CTE ``masked_lines`` (id, no, masked): every character some rule matches belongs to a
    run, and each run is one mask."""
    spans = " union all ".join(
        f"select id, no, regexp_extract_all(line, {S(r.regex)}) as m, regexp_split_to_array(line, {S(r.regex)}) as p"
        f" from all_lines where regexp_matches(line, {S(r.regex)})"
        for r in _RULES
    )
    return f"""all_lines as materialized ({lines}), found_spans as ({spans}),
        numbered_spans as (select id, no, m, p, unnest(range(1, len(m) + 1)) as i from found_spans),
        placed as (select id, no, list_sum(list_transform(p[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as s, length(m[i]) as n
            from numbered_spans),
        covered as (select distinct id, no, unnest(range(s::bigint + 1, s::bigint + n + 1)) as pos from placed),
        letters as (select id, no, unnest(range(1, length(line) + 1)) as pos, line from all_lines
            where (id, no) in (select (id, no) from covered)),
        flagged as (select l.id, l.no, l.pos, substr(line, l.pos::int, 1) as ch, c.pos is not null as hidden,
            coalesce(lag(c.pos is not null) over (partition by l.id, l.no order by l.pos), false) as before
            from letters l left join covered c on c.id = l.id and c.no = l.no and c.pos = l.pos),
        rebuilt as (select id, no, string_agg(case when not hidden then ch when before then '' else {_MASK} end, ''
            order by pos) as masked from flagged group by id, no),
        masked_lines as (select a.id, a.no, coalesce(r.masked, a.line) as masked
            from all_lines a left join rebuilt r on r.id = a.id and r.no = a.no)"""


_NAMED = """named as (select concat('d', doc_id, '/', (['.env', '_settings.py', '.aws/credentials', '_private/a.py',
        '.github/ci.yml', 'x/.npmrc', 'src/a.py', 'my dir/b c.py', 'node_modules/m.js',
        'deep/er/.hid den/%41+.cfg'])[doc_id % 10 + 1]) as path, text as content from documents)"""


def _dialect_rules() -> str:
    from credsieve.plans.queries import DIALECT_RULES

    rules = rule_set(DIALECT_RULES)
    ids = f"([{', '.join(S(r.rule_id) for r in rules)}])[rule_idx + 1]"
    return f"""with rows as (select concat('src/p', p_partkey, case when p_partkey % 5 = 0 then '.T3ST' else '.py' end) as path,
            1 as line_no, case p_partkey % 6 when 0 then concat('id', p_partkey + 1000, 'x9QrTyLmWz')
                when 1 then concat('zq~zq-', p_partkey) when 2 then concat('a', chr(11), 'bKqWzXvTyU')
                when 3 then concat('(x)[y]$ ', p_partkey) when 4 then concat('mid', p_partkey, 'qqword')
                else concat('plain ', p_partkey) end as line from part
            union all select concat('src/s', s_suppkey, '.py'), 1,
                replace('azure_client_id = 0a1b2c3d-0a1b-2c3d-4e5f-0a1b2c3d4e5f aſkkey', substr('iskK', 1 + (s_suppkey % 4)::int, 1),
                    substr('ıſKİ', 1 + (s_suppkey % 4)::int, 1)) from supplier
            union all select concat('src/t', s_suppkey, '.py'), 1,
                concat(substr('ısSİſK', 1 + (s_suppkey % 6)::int, 1), 'tiſk-', substr('KkKıiE', 1 + (s_suppkey % 6)::int, 1), '_é', s_suppkey) from supplier),
        owned as (select *, {_first_rule(rules)} as rule_idx from rows),
        matched as (select *, {_whole(rules)} as match, {ids} as rule_id from owned where rule_idx is not null)
        select path as file_path, match, rule_id from matched
        where not regexp_matches(path, '[.][[:upper:]][[:digit:]]') and not regexp_matches(match, '^[[:alpha:]]+1[[:digit:]]*x')"""


def _every_rule() -> str:
    tests = ", ".join(
        f"case when regexp_matches(line, {S(r.regex)}) then {r.rule_idx} end" for r in _RULES
    )
    return f"""{_PLANTED_LINES}, tested as (select path, line_no,
        list_filter([{tests}], lambda x: x is not null) as found_rules from planted_lines)"""


def _arm_names() -> list[str]:
    from credsieve.functions.detect import arm_of

    return [arm_of(r) for r in _RULES]


def oracle_sql() -> dict[str, str]:
    planted_columns = """file, file_path, line_no, line, match, rule_id, pattern, confidence,
        round(entropy, 6) as entropy, context, false as verified"""
    doc_hits = f"{_DOC_LINES}, {_hits('doc_lines', _RULES)}"
    both = f"""{_FILES}, {_DOCS}, both_files as (select path, content from docs union all
        select path, content from planted), {_files_to_lines('both_lines', 'both_files')}"""
    lookup = " union all ".join(
        f"select {r.rule_idx} as rule_idx, {S(r.rule_id)} as rule_id, {S(r.name)} as name, '{r.rule_set}' as rule_set"
        for r in _RULES
    )
    return {
        "findings_by_rule": f"""with {both}, {_hits('both_lines', _RULES)}
            select rule_id, confidence, count(*) as n from hits where confidence <> 'low' group by all""",
        "document_findings": f"""with {doc_hits}, found as (select *, path as file_path from hits
            where confidence <> 'low') select {planted_columns} from found""",
        "planted_findings": f"with {_FOUND} select {planted_columns} from found",
        "file_hits_with_low": f"""with {_PLANTED_HITS} select rule_idx, context, confidence, count(*) as n,
            round(sum(entropy), 4) as entropy_sum from hits group by all""",
        "text_table_hits": _text_tables(),
        "every_matching_rule": f"""with {_every_rule()}
            select path, line_no, unnest(found_rules) as rule_idx from tested""",
        "first_of_every_rule": f"""with {_every_rule()}
            select path, line_no, list_min(found_rules) as rule_idx from tested where len(found_rules) > 0""",
        "hits_per_rule_name": f"""with {_PLANTED_LINES}, lookup as ({lookup}),
            owned as (select {_first_rule(_RULES)} as rule_idx from planted_lines)
            select l.rule_idx, rule_id, name, rule_set, count(o.rule_idx) as n
            from lookup l left join owned o on o.rule_idx = l.rule_idx group by all""",
        "hits_per_gate_arm": f"""with {_PLANTED_LINES}, owned as (select {_first_rule(_RULES)} as rule_idx
            from planted_lines) select {_of_rule(_RULES, _arm_names())} as arm, count(*) as n
            from owned where rule_idx is not null group by all""",
        "most_random_group": f"""with rows as (select c_custkey, concat('src/db_', c_custkey, '.py') as path,
                1 as line_no, concat(case c_custkey % 3 when 0 then 'Server=10.0.' when 1 then 'data source=db'
                else 'HOST=' end, c_custkey, '; ', case c_custkey % 2 when 0 then 'Password='
                else 'Initial Catalog=' end, case c_custkey % 5 when 0 then 'aaaa' else
                substr(md5(cast(c_custkey as varchar)), 1, 9) end, ';') as line from customer),
            {_hits('rows', _RULES, 'c_custkey, path')}
            select c_custkey, rule_idx, match, round(entropy, 6) as entropy, confidence from hits""",
        "text_entropy": f"""select conv_id, turn, round({_ent('text')}, 6) as entropy from conversations""",
        "character_entropy_per_source": """with chars as (select source, unnest(string_split(text, '')) as ch
                from documents), counts as (select source, ch, count(*) as n from chars group by all),
            lengths as (select source, sum(strlen(text)) as bytes from documents group by source)
            select source, round(sum(-(n / bytes) * log2(n / bytes)), 6) as entropy
            from counts join lengths using (source) group by source""",
        "contexts_of_lines": f"""with {_FILES}, files as (select path, content from planted union all
                select concat(source, '/', doc_id), text from documents union all select url, html from pages),
            {_files_to_lines('all_lines', 'files')}
            select {_context()} as context, count(*) as n from all_lines group by all""",
        "regex_definition_lines": f"""with {_PLANTED_LINES} select path, line_no, line from planted_lines
            where regexp_matches(line, {S(REGEX_LINE)})""",
        "severity_ranks": """select level, case lower(level) when 'critical' then 4 when 'high' then 3
                when 'medium' then 2 when 'low' then 1 else 0 end as severity, count(*) as n
            from (select case o_orderpriority when '1-URGENT' then 'CRITICAL' when '2-HIGH' then 'High'
                when '3-MEDIUM' then 'medium' when '5-LOW' then 'low' else o_orderpriority end as level
                from orders) t group by all""",
        "custom_rules": _custom_rules(),
        "line_counts": f"""with texts as (select doc_id, text as content from documents),
            {_files_to_lines('doc_lines', 'texts', 'doc_id')}
            select doc_id, max(line_no) as n_lines, max(strlen(line)) as longest,
                count(*) filter (line = '') as n_blank from doc_lines group by doc_id""",
        "texts_with_long_lines": """with texts as (select concat('d', doc_id) as path, text as content from documents
                union all select concat('n', n_nationkey), concat(n_name, chr(10),
                    repeat(concat(n_name, ' '), 1 + 1200000 // length(n_name)), chr(10), n_regionkey) from nation)
            select path, len(list_filter(string_split(content, chr(10)), lambda x: strlen(x) >= 1048576)) as long_lines
            from texts where long_lines > 0""",
        "long_line_findings": f"""with long_lines as materialized ({long_lines_sql(DUCKDB)}), {_hits('long_lines', _RULES)}
            select path, rule_idx, context, md5(match) as digest, length(match)::int as length from hits""",
        "written_corpus_scan": f"""with files as (select concat('lang=', lang, '/x.txt') as path, text as content
                from documents), {_files_to_lines('doc_lines', 'files')}, {_hits('doc_lines', _RULES)}
            select split_part(path, '/', 1) as folder, context, confidence, count(*) as n from hits group by all""",
        "pruned_files": f"""with {_TREE} select path, size from kept where size <= 900000
            and not regexp_matches(path, '(^|/)tmp/') and not ends_with(path, '.log')
            and not regexp_matches(path, '^src/gen[^/](/|$)')""",
        "included_files": f"""with {_TREE} select path, size from kept where (starts_with(path, 'src/') or ends_with(path, '.py')
                or regexp_matches(path, '^lib/[a-m][^/]*/[^/]*\\.js$'))
            and regexp_matches(lower(path), '\\.(go|py|js)$')""",
        "glob_matches": f"""with {_TREE} select
            count(*) filter (starts_with(path, 'vendor/')) as deep,
            count(*) filter (ends_with(path, '.go')) as suffix,
            count(*) filter (ends_with(path, '.txt') or ends_with(path, '.md')) as several,
            count(*) filter (regexp_matches(path, '^src/gen[^/]/[^/]*$')) as one,
            count(*) filter (regexp_matches(path, '^lib/[^a-m][^/]*/[^/]*$')) as negated,
            0::bigint as broken from tree""",
        "parsed_commit_log": f"""with commits as ({commits_sql(DUCKDB)})
            select hash, author, date, message from commits
            union all select split_part(text, '|', 1), split_part(text, '|', 2), split_part(text, '|', 3),
                array_to_string(string_split(text, '|')[4:], '|') from benchmark where len(string_split(text, '|')) >= 4""",
        "newest_commits": f"""with commits as ({commits_sql(DUCKDB)}) select hash, author, date from commits
            where date >= '2024-02-10' order by date desc, hash limit 40""",
        "diff_added_lines": f"""with {_ADDED} select hash as commit_hash, path, line_no,
            line_no - 1 as line_no_true, line from added""",
        "history_findings": f"""with {_HISTORY} select file, file_path, line_no, line, match, rule_id, pattern,
            confidence, round(entropy, 6) as entropy, context, false as verified from past""",
        "recent_history_findings": f"""with {_HISTORY}, chosen as (select hash from commits
                where author <> 'user_3' and date >= '2024-03-01' order by date desc, hash limit 100)
            select file, file_path, line_no, rule_id, confidence, context from past
            where hash in (select hash from chosen)""",
        "config_filtered": f"""with {_FOUND} select file_path, line_no, match, rule_id, confidence,
                round(entropy, 6) as entropy from found
            where split_part(file_path, '/', -1) <> 'app_7.py'
                and not regexp_matches(file_path, '^conf/docs/[^/]*$')
                and not regexp_matches(file_path, '^src/app_1[0-4][^/]\\.py$')
                and not ends_with(file_path, '_test.go')
                and match <> 'password = "c4ca4238a0b9' and not regexp_matches(match, '(?i)^glpat-[0-9a]')
                and rule_id not in ('pattern-0', 'pattern-21')
                and (entropy >= 3.4 or confidence in ('critical', 'high'))""",
        "table_allowlisted": f"""with {_FOUND} select file_path, line_no, match, rule_id from found
            where match not in (select concat('password = "', substr(md5(cast(l_orderkey as varchar)), 1, 12))
                from lineitem) and rule_id not in ('pattern-0', 'pattern-2', 'pattern-4', 'pattern-6', 'pattern-8')""",
        "fingerprints": f"""with {_FOUND} select file_path, line_no, {_FINGERPRINT} as fingerprint,
            substr(sha256(match), 1, 16) as secret_hash, concat('sha256:', sha256(line)) as snippet,
            concat('sha256:', substr(sha256(line), 1, 16)) as short_snippet from found""",
        "baseline_suppressed": f"""with {_ACCEPTED} select file_path, line_no, rule_id, match from marked
            where fingerprint not in (select fingerprint from accepted)""",
        "baseline_updated": f"""with {_ACCEPTED} select * from accepted union all
            select fingerprint, min(file_path), min(line_no), min(rule_id), min(secret_hash), null
            from marked where fingerprint not in (select fingerprint from accepted) group by fingerprint""",
        "baseline_size": f"""with {_ACCEPTED} select count(distinct fingerprint) as n,
            count(distinct case when rule_id in ('pattern-35', 'pattern-136') then fingerprint end) as n_with_reason
            from marked""",
        "baseline_as_document": f"""with {_ACCEPTED} select row_number() over (order by file, line, fingerprint) as seq,
            file, line, secret_hash from accepted""",
        "redacted_findings": f"""with {_FOUND} select file_path, line_no, replace(line, match, {_MASK}) as line,
            {_MASK} as match, rule_id from found""",
        "redacted_documents": f"""with {_masked_lines("select doc_id as id, unnest(string_split(text, chr(10))) as line,"
            " generate_subscripts(string_split(text, chr(10)), 1) as no from documents")}
            select id as doc_id, md5(string_agg(masked, chr(10) order by no)) as digest from masked_lines group by id""",
        "redacted_lines": f"""with {_masked_lines(_OVERLAPPING)}
            select id as o_orderkey, masked as line from masked_lines""",
        "findings_as_json": f"""with {_FOUND} select row_number() over (order by {_REPORT_ORDER}) as seq,
            file_path as file, line_no as line, line as line_text, match, rule_id, pattern, confidence, context,
            false as verified from found""",
        "sarif_results": f"""with {_FOUND} select rule_id as "ruleId", case when confidence = 'medium' then 'warning'
            else 'error' end as level, concat('Potential secret detected (', pattern, ')') as text,
            file_path as uri, line_no as "startLine" from found""",
        "sarif_as_document": f"""with {_FOUND} select row_number() over (order by {_REPORT_ORDER}) as seq, rule_id,
            file_path as uri, line_no from found union all select 0, null, null, null
            union all select -1, null, null, null""",
        "severity_totals": f"""with {_HISTORY} select count(*) as total,
            count(*) filter (confidence = 'critical') as critical, count(*) filter (confidence = 'high') as high,
            count(*) filter (confidence = 'medium') as medium from past""",
        "severity_ordered_report": f"""with {_FOUND} select {_RANK} as severity, file_path, line_no, rule_id,
            {_MASK} as match, replace(line, match, {_MASK}) as line from found""",
        "report_text": _report_sections(),
        "ci_summary": f"""with {_FOUND} select row_number() over (order by {_REPORT_ORDER}) as number, file_path,
            line_no, upper(confidence) as confidence, case when strlen(match) > 60
                then concat(substr(match, 1, 57), '...') else match end as match from found""",
        "gate_results": f"""with {_FOUND} {_gate('critical/detect', 4, '{} > 0')}
            union all {_gate('HIGH/protect', 3, '{} > 0')} union all {_gate('odd/other', 1, '{} > 0')}
            union all {_gate('low/report', 1, 'false')}""",
        "ci_outputs": f"""with {_FOUND} select case when count(*) filter ({_RANK} >= 3) > 0 then count(*) else 0 end
            as secrets_found, case when count(*) filter ({_RANK} >= 3) > 0 then 'failed' else 'success' end
            as scan_status from found""",
        "counts_per_confidence": f"with {_FOUND} select confidence, count(*) as n from found group by all",
        "totals_by_origin": f"""with {_HISTORY}, {_FOUND}, origins as (select 'files' as origin, count(*) as n
                from found union all select 'history', count(*) from past)
            select origin, n from origins union all select 'all', sum(n)::bigint from origins""",
        "complete_scan": f"""with {_HISTORY}, {_FOUND}, both_phases as materialized (
                select 'files' as origin, file_path, line_no, rule_id, match, confidence, entropy from found
                where not starts_with(file_path, 'web/vendor/') and not ends_with(file_path, '.min.js')
                union all select 'history', file_path, line_no, rule_id, match, confidence, entropy from past
                where hash in (select hash from commits where date >= '2024-02-01')),
            accepted as (select concat('src/app_', c_custkey, '.py') as path, 'pattern-136' as rule,
                concat('password = "', substr(md5(cast(c_custkey as varchar)), 1, 12)) as secret from customer)
            select origin, file_path, line_no, rule_id, match, confidence from both_phases
            where split_part(file_path, '/', -1) <> 'app_7.py'
                and not regexp_matches(file_path, '^conf/docs/[^/]*$')
                and not regexp_matches(file_path, '^src/app_1[0-4][^/]\\.py$')
                and not ends_with(file_path, '_test.go')
                and match <> 'password = "c4ca4238a0b9' and not regexp_matches(match, '(?i)^glpat-[0-9a]')
                and rule_id not in ('pattern-0', 'pattern-21')
                and (entropy >= 3.4 or confidence in ('critical', 'high'))
                and not exists (select 1 from accepted a where a.path = file_path and a.secret = match
                    and a.rule = rule_id)""",
        "code_structure": f"""with {_FILES}, rows as (select path, unnest(string_split(content, chr(10))) as raw,
                generate_subscripts(string_split(content, chr(10)), 1) as no from planted)
            select path, case lower(regexp_extract(path, '(\\.[^./]*)$', 1)) when '.go' then 'go' when '.py' then 'python'
                when '.js' then 'javascript' when '.yaml' then 'yaml' when '.json' then 'json' else 'unknown' end as language,
                coalesce(string_agg(case when regexp_matches(raw, '(func|def|function) ') then trim(raw) end, '|' order by no), '') as functions,
                coalesce(string_agg(case when regexp_matches(raw, '^\\s*(import |from |require\\()') then trim(raw) end, '|' order by no), '') as imports,
                contains(lower(path), 'test') or contains(lower(path), 'spec') as is_test from rows group by path""",
        "document_structure": """with rows as (select concat(source, '/', doc_id) as path,
                unnest(string_split(text, chr(10))) as raw from documents)
            select path, count(*) filter (regexp_matches(raw, '(func|def|function) \\S')
                    or regexp_matches(raw, '(func|def|function) +\\S')) as n_functions,
                count(*) filter (regexp_matches(raw, '^\\s*(import \\s*\\S|from \\s*\\S|require\\()')) as n_imports
            from rows group by path""",
        "neighbour_lines": f"""with {_DOC_LINES}, {_FILES}, {_files_to_lines('planted_lines', 'planted')},
            all_lines as (select * from doc_lines union all select * from planted_lines),
            {_hits('all_lines', _RULES)}, everything as (select path, content from planted union all
                select path, content from docs), found as (select *, path as file_path from hits where confidence <> 'low'),
            {_CODE.split("found as (select *, path as file_path from hits where confidence <> 'low'),", 1)[1]}
            select file_path, line_no, function, language, code, finding_key from coded""",
        "heuristic_verdicts": f"""with {_JUDGED} select file_path, line_no, real as is_real_secret, confidence,
            reasoning, case when real then 'Review and remove if confirmed as secret'
                else 'Likely false positive, but verify manually' end as recommendation from judged""",
        "reserved_addresses": """with rows as (select s_suppkey, case s_suppkey % 7
                when 0 then concat('10.', s_suppkey % 256, '.0.1') when 1 then concat('172.', s_suppkey % 64, '.9.9')
                when 2 then concat('192.', 100 + s_suppkey, '.1.1') when 3 then concat(' 127.0.0.', s_suppkey, ' ')
                when 4 then '0.0.0.0' when 5 then concat('host', s_suppkey)
                else concat('10.01.', s_suppkey, '.1') end as address from supplier)
            select s_suppkey, address, case s_suppkey % 7 when 0 then true
                when 1 then s_suppkey % 64 between 16 and 31 when 2 then s_suppkey = 68
                when 3 then s_suppkey <= 255 when 4 then true else false end as reserved from rows""",
        "verification_requests": f"with {_CODED} select finding_key, md5({_PROMPT_SQL}) as digest from coded",
        "decoded_responses": f"with {_JUDGED}, {_ANSWERED} select * from answered",
        "merged_verdicts": f"""with {_JUDGED}, {_ANSWERED} select
            concat(j.file, ' [LLM: ', coalesce(a.reasoning, j.reasoning), ']') as file, line_no,
            coalesce(a.confidence, j.confidence) as confidence, coalesce(a.is_real_secret, j.real) as verified,
            nullif(coalesce(a.reasoning, j.reasoning), '') as verification_reason
            from judged j left join answered a using (finding_key)""",
        "disabled_verification": f"""with {_FOUND} select confidence, 'Verification pipeline disabled' as reasoning,
            'Review manually' as recommendation, count(*) as n from found group by all""",
        "pseudo_embeddings": f"""with vectors as (select c_custkey, {_embedding('c_name')} as v from customer)
            select c_custkey, unnest(range(0, 384)) as i, round(unnest(v)::float::double, 4) as x from vectors""",
        "unit_embeddings": f"""with names as (select c_custkey, c_name as a,
                concat('Customer#', lpad(cast(c_custkey + 1 as varchar), 9, '0')) as b from customer),
            vectors as (select c_custkey, {_embedding('a')} as va, {_embedding('b')} as vb from names)
            select c_custkey, round(list_cosine_similarity(va, vb)::float::double, 4) as similarity from vectors""",
        "cosine_to_first": """select a.vec_id, round(list_cosine_similarity(a.embedding::double[],
            b.embedding::double[])::float::double, 5) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
        "latest_verified": f"""with {_STORE} select id, file_path, timestamp from store where verified
            order by timestamp desc, id desc limit 200""",
        "similar_verified": f"""with {_STORE}, candidates as (select * from store where verified
                order by timestamp desc, id desc limit 500),
            pairs as (select e.vec_id, c.id,
                list_cosine_similarity(e.embedding::double[], c.embedding::double[])::float as similarity
                from embeddings e, candidates c),
            ranked as (select *, row_number() over (partition by vec_id order by similarity desc, id) as rank
                from pairs where similarity >= 0.3::float)
            select vec_id, id, round(similarity::double, 5) as similarity, rank from ranked where rank <= 10""",
        "reused_verdicts": f"""with {_JUDGED}, sums as materialized (select *, row_number() over () as rid,
                {_character_sum('cos')} as a, {_character_sum('sin')} as b from judged),
            vectors as materialized (select *, list_transform(range(0, 384),
                lambda i: sin(sin(i) * a + cos(i) * b)::float::double) as v from sums),
            stored as (select path, confidence, v, ('0x' || substr(md5(path), 1, 7))::bigint as timestamp,
                ('0x' || substr(sha256(concat(path, chr(0), line_no, chr(0), pattern)), 1, 15))::bigint as id
                from vectors where line_no = 4 and real),
            candidates as materialized (select * from stored order by timestamp desc, id desc limit 500),
            near as (select x.rid, c.confidence, c.id, list_cosine_similarity(x.v, c.v)::float as similarity
                from vectors x, candidates c where list_cosine_similarity(x.v, c.v)::float >= 0.8::float),
            taken as (select distinct on (rid) rid, confidence from near order by rid, similarity desc, id)
            select path as file_path, line_no, rule_id, t.rid is not null as reused, coalesce(t.confidence, x.confidence) as confidence,
                t.rid is not null or real as verified from vectors x left join taken t on t.rid = x.rid""",
        "store_upserted": f"""with {_FOUND} select file_path, line_no as line_number, pattern as pattern_type,
            concat('sha256:', sha256(line)) as code_snippet, line_no = 4 as verified,
            case when line_no = 4 then 2 else 1 end::bigint as timestamp,
            case when line_no = 4 then 0.0 else line_no end::double as x from found""",
        "store_history": f"""with {_FOUND} select version::int as version, file_path, line_no as line_number, pattern as pattern_type,
            version = 4 and confidence = 'critical' as verified,
            (case when version = 4 and confidence = 'high' then 2 else 1 end)::bigint as timestamp
            from found, (values (2), (4)) as v(version)""",
        "store_marked": f"""with {_STORE} select id, coalesce(l.quality = 1, s.verified) as verified
            from store s left join labels l on l.doc_id = s.id""",
        "hidden_files_scan": f"""with {_NAMED} select path, strlen(content) as size, md5(content) as digest
            from named where not contains(path, 'node_modules/')""",
        "tree_scan": f"""with {_NAMED} select path, strlen(content) as size, md5(content) as digest, null as reason
                from named where not contains(path, 'node_modules/')
            union all select 'same.cfg', strlen(text), md5(text), null from documents where doc_id = (select min(doc_id) from documents)
            union all values ('loop', 0, null, 'link to a folder'), ('self', 0, null, 'broken link'), ('pipe', 0, null, 'special file')""",
        "streamed_tree": f"""with {_NAMED} select path, strlen(content) as size, md5(content) as digest, null as reason
                from named where not contains(path, 'node_modules/')""",
        "skipped_inputs": """with texts as (select concat('doc/', doc_id, '.cfg') as path, case when doc_id % 83 = 5
                then repeat(replace(text, chr(10), ' '), (ceil(1200000 / strlen(text)) * (1 + doc_id % 2))::bigint)
                else text end as content from documents)
            select path, strlen(content) as size, case when strlen(content) > 2000000 then 'size' else 'long lines' end
                as reason from texts where strlen(content) > 2000000
                or list_max(list_transform(string_split(content, chr(10)), lambda x: strlen(x))) >= 1048576""",
        "dialect_rules": _dialect_rules(),
        "batch_verdicts": f"""with {_JUDGED}, once as (select distinct on (finding_key) * from judged)
            select finding_key, real as is_real_secret, confidence from once""",
        "allowlist_tables_applied": f"""with {_FOUND} select file_path, line_no, match, rule_id from found
            where file_path not in (select concat('src/app_', p_partkey, '.py') from part)
                and not (regexp_extract(file_path, '^(?:.*/)?svc_([0-9]+)_[^/]*\\.go$', 1) in (select cast(s_suppkey * 3 as varchar) from supplier))
                and not regexp_matches(file_path, '^conf/docs/[^/]*\\.yaml$')
                and not exists (select 1 from customer where position(concat('password = "', substr(md5(cast(c_custkey as varchar)), 1, 6)) in match) > 0)
                and not exists (select 1 from nation where regexp_matches(match, concat('^ghp_', substr(md5(n_name), 1, 1), '[0-9]|^[a-f]', n_nationkey % 10, '$')))""",
        "reachable_commits": """with recursive latest as materialized (select o_custkey as c, max(o_orderkey) as last from orders group by all),
            rows as materialized (select o_orderkey as commit, o_custkey, o_orderpriority,
                lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as parent from orders),
            edges as materialized (select commit, parent from rows where parent is not null
                union select commit, last from rows join latest on c = o_custkey // 2 where parent is null and o_custkey > 0
                union select commit, last from rows join latest on c = o_custkey // 3 where o_orderpriority = '1-URGENT' and o_custkey > 0),
            reach(commit) as (select last from latest where c in (select s_suppkey * 7 from supplier)
                union select parent from edges join reach using (commit))
            select commit from reach""",
        "request_rounds": f"""with {_JUDGED}, keyed as materialized (select j.*, digest from judged j join
                (select distinct finding_key, sha256({_PROMPT_SQL}) as digest from coded) using (finding_key)),
            kinds as (select *, ascii(substr(digest, 1, 1)) % 4 = 0 as a1, ascii(substr(digest, 2, 1)) % 4 = 0 as a2,
                ascii(substr(digest, 3, 1)) % 4 = 0 as a3 from keyed)
            select finding_key, (case when a1 then 1 when a2 then 2 else 3 end)::int as attempts,
                (case when a1 then 1 when a2 then 2 else 3 end)::int as asked,
                case when a1 or a2 or a3 then 'answered' else 'given up' end as status,
                case when a1 or a2 or a3 then 'high' else confidence end as confidence,
                case when a1 then 'round 1' when a2 then 'round 2' when a3 then 'round 3' else reasoning end as reasoning from kinds""",
        "whole_store_neighbours": """with store as materialized (select vec_id as id, embedding::double[] as v from embeddings union all
                select vec_id + 10000000, list_transform(embedding, lambda x, i: (x + (0.03 + 0.02 * (vec_id % 6)) * sin((i - 1) * 1.7 + vec_id))::float)::double[] from embeddings),
            pairs as (select e.vec_id, s.id, list_cosine_similarity(e.embedding::double[], s.v)::float as similarity
                from embeddings e, store s),
            ranked as (select *, row_number() over (partition by vec_id order by similarity desc, id) as rank from pairs where similarity >= 0.8::float)
            select vec_id, id, round(similarity::double, 4) as similarity, rank from ranked where rank <= 10""",
        "streamed_lifecycle": f"""with arrived as (select concat('app/', event_type, '_', user_id % 50, '.py') as path, 1 as line_no,
                concat(case when event_id % 3 = 0 then '# ' else '' end, 'token ghp_', md5(cast(user_id as varchar)), 'Zz9Q') as line,
                case when event_id % 3 = 0 then 1 else 2 end as wave from events),
            {_hits('arrived', _RULES, 'path, wave')},
            best as (select path, rule_id, match, wave, max({_RANK}) as severity, max_by(confidence, {_RANK}) as confidence
                from hits where confidence <> 'low' group by all),
            told as (select *, coalesce(lag(severity) over (partition by path, rule_id, match order by wave), 0) as before from best)
            select path as file_path, rule_id, match, confidence from told where severity > before""",
        "scanned_and_stored": f"""with {_JUDGED}, scanned as materialized (select * from judged
                where not starts_with(path, 'web/vendor/') and not ends_with(path, '.min.js')
                    ),
            kept as (select * from scanned where entropy >= 3.0 or confidence in ('critical', 'high')),
            stored as (select distinct path, line_no, pattern, confidence, real from scanned)
            select 'store' as what, confidence, real as verified, count(*) as n, count(*) as n_vectors from stored group by all
            union all select 'findings', confidence, real, count(*), 0::bigint from kept group by all""",
        "stored_baseline_update": f"""with {_ACCEPTED}, entries as (select rule_id, reason from accepted union all
                select min(rule_id), null from marked where fingerprint not in (select fingerprint from accepted)
                group by fingerprint)
            select rule_id, reason, count(*) as n from entries group by all""",
        "loaded_config": f"""with {_FOUND} select file_path, line_no, match, rule_id from found
            where split_part(file_path, '/', -1) <> 'app_7.py' and not regexp_matches(file_path, '^conf/docs/[^/]*$')
                and rule_id <> 'pattern-0' and (entropy >= 3.4 or confidence in ('critical', 'high'))""",
        "strict_cosines": """select a.vec_id, round(list_cosine_similarity(a.embedding, b.embedding)::double, 3)
            as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
        "streamed_findings": f"""with {_STREAMED} select file_path, rule_id, confidence, count(*) as n
            from found group by all""",
        "streamed_suppressed": f"""with {_STREAMED}, accepted as (select distinct concat('app/', kind, '_',
                c_custkey % 50, '.py') as file_path, concat('password = "',
                substr(md5(cast(c_custkey as varchar)), 1, 10)) as match
                from customer, (select unnest(['view', 'click', 'error']) as kind) k)
            select f.file_path, rule_id, count(*) as n from found f anti join accepted a
                on a.file_path = f.file_path and a.match = f.match group by all""",
        "streamed_once": f"""with {_STREAMED} select distinct file_path, rule_id, match,
            {_FINGERPRINT} as fingerprint from found""",
        "streamed_counts": f"""with {_STREAMED}, days as (select date_trunc('day', ts) as day, confidence,
                count(*) as n from found group by all)
            select confidence, count(*) as n_windows, sum(n)::bigint as n from days group by confidence""",
        "streamed_store": f"""with {_STREAMED} select file_path, 1::bigint as line_number, pattern as pattern_type,
            max(floor(epoch(ts))::bigint) as timestamp from found group by all""",
    }
