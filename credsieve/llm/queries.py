"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.llm import (
    alignment, bin_completion, chat, decontaminate, language, near_duplicates, packing, privacy, quality, ranked_search,
    shards, token_counts, token_files,
)
from credsieve.llm.common import table
from credsieve.session import fresh_path, settled

#: A conversation that says what the template must escape.
PLANTED_CONVERSATION, PLANTED_TEXT = -7, "\\### Assistant: </turn> ok"


def op1_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digests(privacy.find(table(spark, sf_dir, "documents")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean(table(spark, sf_dir, "documents"), with_text=False)


def with_planted(conversations: DataFrame) -> DataFrame:
    rows = [(PLANTED_CONVERSATION, 0, "user", PLANTED_TEXT), (PLANTED_CONVERSATION, 1, "assistant", PLANTED_TEXT)]
    names = ["conv_id", "turn", "role", "text"]
    planted = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select(*names).union(planted)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(settled(chat.format_conversations(with_planted(table(spark, sf_dir, "conversations")))))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_extendible_shards": op1_extendible_shards,
    "op2_token_counts": op2_token_counts,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_privacy": op5_privacy,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_chat": op9_chat,
    "op10_token_files": op10_token_files,
    "op11_ranked_search": op11_ranked_search,
    "op12_bin_completion": op12_bin_completion,
    "op13_alignment": op13_alignment,
}

_OP1 = """
with rows as materialized (
    select doc_id, coalesce(octet_length(encode(text)), 0) as n_bytes,
           ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15))::bigint as hash
    from documents),
levels as (
    select depth, hash >> (60 - depth) as prefix, sum(n_bytes) as held
    from rows, range(0, 41) as d(depth) group by all),
fits as (
    select doc_id, n_bytes, min(depth) as depth, any_value(hash) as hash
    from rows join levels on levels.prefix = hash >> (60 - depth) and held <= 1048576
    group by doc_id, n_bytes)
select doc_id, n_bytes, depth, hash >> (60 - depth) as prefix,
       right(lpad(bin(hash >> (60 - depth)), 60, '0'), depth) as shard
from fits
"""

_OP9 = """
with turns as materialized (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
sized as (
    select *, length(text) + length(regexp_replace(text, '[^\\\\<>]', '', 'g'))
              + length(role) + length(regexp_replace(role, '[^\\\\<>]', '', 'g')) + 15 as chars,
           row_number() over (partition by conv_id order by turn desc, role desc, text desc) as from_end
    from turns),
summed as (
    select *, sum(chars) over (partition by conv_id order by turn, role, text rows unbounded preceding) as prefix from sized)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       length(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(prefix) filter (role = 'assistant' or from_end = 1)::bigint as formatted_chars
from summed group by conv_id
"""

_OP6 = r"""
with words as materialized (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as w from documents),
sets as materialized (
    select distinct doc_id, list_slice(w, i, i + 4) as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)),
sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
met as (
    select a.doc_id as x, b.doc_id as y, count(*) as c
    from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as materialized (
    select x, y from met join sizes p on p.doc_id = x join sizes q on q.doc_id = y
    where 100 * c >= 75 * (p.n + q.n - c)),
reach as materialized (
    with recursive r(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from r join links l on l.x = r.y)
    select x, min(y) as least from r group by x)
select d.doc_id, coalesce(n, 0) as n_shingles, least as component_id, d.doc_id = least as kept
from documents d left join sizes using (doc_id) join reach on reach.x = d.doc_id
"""

_OP8 = r"""
with docs as materialized (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
    select doc_id, i, count(*) over (partition by doc_id, list_slice(w, i, i + 4)) as n
    from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from docs where len(w) > 4)),
repeated as (
    select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from windows where n > 1) group by doc_id),
parts as (
    select doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as lw
    from (select doc_id, unnest(string_split(text, chr(10))) as line from docs)),
counted as (
    select *, len(list_filter(lw, lambda x: x in ('|', '/', '>', '»', '›', '·', '•', '-', '–'))) as marks,
        coalesce(list_sum(list_transform(lw, lambda x: length(x))), 0) as chars from parts),
judged as (
    select *, len(lw) > 0 and ((4 * marks >= len(lw) and (marks > 1 or len(lw) <= 3)) or not regexp_matches(line, '[.,;:!?…。！？]')
        or regexp_matches(line, '(?i)all rights reserved|copyright ©|copyright \(c\)|terms of (?:use|service)|privacy policy|cookie policy|uses cookies|accept cookies|enable javascript|click here|sign up for|subscribe to our|log in to|skip to (?:main )?content')) as fails
    from counted),
lines as (
    select doc_id, count(*) filter (len(lw) > 0) - count(distinct line) filter (len(lw) > 0) as dups,
        count(*) filter (fails) as removed, coalesce(sum(chars) filter (not fails), 0) as left_chars from judged group by doc_id),
measured as (
    select d.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, dups as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
        removed as n_removed_lines, left_chars from docs d join lines using (doc_id) left join repeated r using (doc_id))
select * exclude (left_chars), n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * left_chars >= 50 * word_chars as kept
from measured
"""

_OP11 = r"""
with docs as materialized (
    select row_number() over () as r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
totals as materialized (select count(*)::bigint as n_docs, sum(len(w))::bigint as n_words from docs where len(w) > 0),
sized as (select r, doc_id, 10 + (90 * len(w) * n_docs) // n_words as m from docs, totals where len(w) > 0),
tfs as materialized (select r, term, count(*)::bigint as tf from (select r, unnest(w) as term from docs) group by all),
items as materialized (
    select i, item_id, unnest(list_distinct(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term
    from (select row_number() over () as i, * from (select distinct item_id, text from benchmark))),
weights as (
    select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as weight
    from (select term, count(*) as df from tfs group by term), totals),
scored as (
    select i, item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
    from items join tfs using (term) join weights using (term) join sized using (r) group by all),
placed as (
    select item_id, (row_number() over (partition by i order by score desc, doc_id nulls last))::int as rank, doc_id, score
    from scored join docs using (r) where score > 0)
select * from placed where rank <= 10
"""

ORACLES: dict[str, str] = {
    "op1_extendible_shards": _OP1, "op6_near_duplicates": _OP6, "op8_quality": _OP8, "op9_chat": _OP9,
    "op11_ranked_search": _OP11,
}
