"""Queries p1_ … p9_ over the tables of a folder, with production parameters, and SQL for those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import NARROW, WIDE, clean_id
from tessera.llm import conversations, defects, overlap, packing, splits, splitting, stuffing, tokenize, topn
from tessera.session import cut
from tessera.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.left_out(table(spark, d, "app_threads"), table(spark, d, "app_messages"))


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "app_threads"), table(spark, d, "app_messages"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Parents and chunks as items to be kept within size_limits."""
    parents = table(spark, d, "evidence_parents").select(F.lit("parent").alias("item_kind"), F.col("parent_id").alias("item_id"), F.col("original_text").alias("text"))
    chunks = table(spark, d, "retrieval_chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text")
    return parents.unionByName(chunks)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(_items(spark, d), table(spark, d, "size_limits"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_items(spark, d), table(spark, d, "size_limits"))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """What holds for all pieces: none exceeds the limit, all share the overlap, and together they are the text."""
    limits = table(spark, d, "size_limits").select("item_kind", "max_chars", "overlap_chars")
    p = p2_pieces(spark, d).join(F.broadcast(limits), "item_kind")
    new = F.when(F.col("piece") == 0, F.col("text")).otherwise(F.expr("substring(text, overlap_chars + 1)"))
    each = p.groupBy("item_kind", "item_id").agg(
        F.max((F.length("text") > F.col("max_chars")).cast("int")).alias("too_long"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", new.alias("new")))), lambda x: x["new"]), "").alias("whole"),  # the pieces of one item
    )
    return each.select("item_kind", "item_id", "too_long", F.sha2("whole", 256).alias("fingerprint"))


def p3_top(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "tcm_qg_hits"), 5, "parent_id", "score", ["rank", "hit_id"], ["qa_id", "strategy", "chunk_id"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_top(spark, d).select("parent_id", "hit_id")


def p3_skipping(spark: SparkSession, d: str) -> DataFrame:
    return topn.skipping(table(spark, d, "tcm_qg_hits"), 5, "parent_id", "score", ["rank", "hit_id"], ["qa_id", "strategy", "chunk_id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defective(table(spark, d, "formal_answers"), table(spark, d, "tcm_qg_pairs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.broken_documents(table(spark, d, "tcm_qg_pairs"), table(spark, d, "doc_links"), table(spark, d, "tcm_qg_documents"))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "tcm_qg_pairs"), table(spark, d, "doc_links"), table(spark, d, "split_plan"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(p5_splits(spark, d), table(spark, d, "split_plan"))


def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """What holds for the new splits: every record has one, and no document is parted."""
    r = p5_splits(spark, d).select(clean_id(F.col("source_doc_id")).alias("doc"), "new_split")
    docs = r.where("doc is not null").groupBy("doc").agg(F.countDistinct("new_split").alias("n"))
    parted = docs.agg(F.count_if(F.col("n") > 1).alias("parted"), F.count(F.lit(1)).alias("documents"))
    return r.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("new_split").isNull()).alias("unplaced")).join(parted.hint("broadcast"))  # one row each


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found_pairs(table(spark, d, "tcm_qg_pairs"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_classes(table(spark, d, "tcm_qg_pairs"))


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_members(table(spark, d, "tcm_qg_pairs"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_counts(table(spark, d, "tcm_qg_pairs"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(table(spark, d, "documents"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n_bytes, fingerprint) of the texts that the ids decode to; null and empty texts come back empty."""
    return tokenize.decoded(p7_ids(spark, d)).select("doc_id", F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("fingerprint"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(cut(tokenize.token_counts(table(spark, d, "documents"))))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What holds for containers: every document lies in some or has no token, none exceeds 2,048 tokens, no item lies over another,
    and only longer documents are divided."""
    placed = cut(p8_containers(spark, d))
    inside = placed.where("container is not null").groupBy("container").agg(F.sum("n").alias("tokens"), F.max(F.col("container_start") + F.col("n")).alias("end"))
    full = inside.agg(F.count_if((F.col("tokens") > 2048) | (F.col("end") > 2048) | (F.col("end") < F.col("tokens"))).alias("overfull"))
    docs = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("tokens"))
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= 2048)).alias("divided")).join(full.hint("broadcast"))  # one row each


def p8_choices(spark: SparkSession, d: str) -> DataFrame:
    return packing.choices(tokenize.token_counts(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents"))


def p9_curves(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.judged(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_conversations, p2_found, p2_pieces, p2_checks, p3_found, p3_top, p3_skipping, p4_found, p5_found, p5_splits, p5_shares, p5_checks, p6_found, p6_classes, p6_members, p6_counts, p7_ids, p7_checks, p8_containers, p8_checks, p8_fill, p8_choices, p9_found, p9_curves)}


_EDGE = r"[\s\p{Z}\p{Cc}\p{Cf}]"
_INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]*"

_P1 = f"""with m0 as (select lower(trim(thread_id)) as thread_id, coalesce('m' || message_id, 'o' || ordinal || ':' || coalesce(content, '')) as same, * exclude (thread_id) from app_messages where thread_id is not null),
m as (select * from m0 qualify row_number() over (partition by thread_id, same order by received_at, id) = 1),
r as (select *, case when regexp_replace(lower(coalesce(role, '')), '{_EDGE}+', '', 'g') in ('user', 'human') then 'user' when regexp_replace(lower(coalesce(role, '')), '{_EDGE}+', '', 'g') in ('assistant', 'ai') then 'assistant'
    when regexp_replace(lower(coalesce(role, '')), '{_EDGE}+', '', 'g') in ('system', 'tool') then trim(lower(role)) end as a,
  case regexp_replace(lower(coalesce(type, '')), '{_EDGE}+', '', 'g') when 'human' then 'user' when 'ai' then 'assistant' when 'system' then 'system' when 'tool' then 'tool' end as b,
  case json_type(content) when 'VARCHAR' then content->>'$' when 'OBJECT' then content->>'$.text' when 'ARRAY' then array_to_string(list_transform(from_json(content, '["json"]'), lambda x: coalesce(x->>'$.text', '')), '') end as text from m),
w as (select *, case when a is null or b is null or a = b then coalesce(a, b) end as who from r),
k as (select *, who is not null and who in ('user', 'assistant') and (tool_calls is null or regexp_replace(tool_calls, '\\s', '', 'g') in ('null', '[]', '')) and not regexp_full_match(coalesce(text, ''), '{_INVISIBLE}') as kept from w),
o as (select thread_id, who, lag(who) over (partition by thread_id order by ordinal) as was, lead(who) over (partition by thread_id order by ordinal) as following from k where kept),
f as (select thread_id, bool_or(was is null and who = 'assistant') as first_assistant, bool_or(who = 'user' and following is distinct from 'assistant') as missing from o group by 1),
g as (select thread_id, count(*) as n, count(distinct ordinal) as d, min(ordinal) as lo, max(ordinal) as hi, bool_or(who is null) as unknown, count(*) filter (where kept) as kept from k group by 1),
t as (select distinct lower(trim(thread_id)) as thread_id from app_threads where thread_id is not null),
v as (select t.thread_id, case when coalesce(g.kept, 0) = 0 then 'empty' when lo <> 0 or hi <> n - 1 or d <> n or unknown or first_assistant then 'broken' when missing then 'missing_reply' end as reason from t left join g using (thread_id) left join f using (thread_id))
"""

_P3 = """with h as (select * from tcm_qg_hits where parent_id is not null and score is not null and not isnan(score) qualify row_number() over (partition by parent_id, qa_id, strategy, chunk_id order by score desc, rank, hit_id) = 1),
p as (select *, row_number() over (partition by parent_id order by score desc, rank, hit_id) as place from h)
"""


def _clean(x: str) -> str:
    return f"nullif(regexp_replace(lower(translate({x}, '{WIDE}', '{NARROW.replace(chr(39), chr(39) * 2)}')), '^{_EDGE}+|{_EDGE}+$', '', 'g'), '')"


_P5 = f"""with recursive e0 as (select {_clean('source_doc_id')} as a, {_clean('linked_doc_id')} as b from doc_links), e as (select a, b from e0 where a is not null and b is not null union select b, a from e0 where a is not null and b is not null),
reach(v, u) as (select v, v from (select a as v from e) union select r.v, e.b from reach r join e on e.a = r.u),
g as (select v, min(u) as c from reach group by 1),
r as (select {_clean('source_doc_id')} as doc, {_clean('split')} as now from tcm_qg_pairs),
p as (select distinct doc, now, coalesce(g.c, doc) as c from r left join g on g.v = r.doc where doc is not null and now is not null),
mixed as (select c from p group by 1 having count(distinct now) > 1)
select distinct d.source_doc_id from tcm_qg_documents d join p on p.doc = {_clean('d.source_doc_id')} where p.c in (select c from mixed)"""


def oracle_sql() -> dict[str, str]:
    """SQL where SQL can say it. The others are tested against brute force, exact round trips and invariants."""
    return {
        "p1_found": _P1 + "select thread_id, reason from v where reason is not null",
        "p1_conversations": _P1 + "select thread_id, (row_number() over (partition by thread_id order by ordinal) - 1)::int as turn, who as speaker, text from k where kept and thread_id in (select thread_id from v where reason is null)",
        "p2_found": "select distinct 'parent' as item_kind, parent_id as item_id from evidence_parents, size_limits where item_kind = 'parent' and length(original_text) > max_chars union all select distinct 'chunk', chunk_id from retrieval_chunks, size_limits where item_kind = 'chunk' and length(text) > max_chars",
        "p3_found": _P3 + "select parent_id, hit_id from p where place <= 5",
        "p3_top": _P3 + "select parent_id, rank, hit_id, score, place::int as place from p where place <= 5",
        "p5_found": _P5,
        "p2_checks": "select 'parent' as item_kind, parent_id as item_id, 0 as too_long, sha256(arg_max(original_text, length(original_text))) as fingerprint from evidence_parents, size_limits where item_kind = 'parent' and length(original_text) > max_chars group by 2 "
        "union all select 'chunk', chunk_id, 0, sha256(arg_max(text, length(text))) from retrieval_chunks, size_limits where item_kind = 'chunk' and length(text) > max_chars group by 2",
        "p5_checks": f"select count(*) as records, 0 as unplaced, 0 as parted, count(distinct {_clean('source_doc_id')}) as documents from tcm_qg_pairs",
        "p7_checks": "select doc_id, strlen(coalesce(text, ''))::int as n_bytes, sha256(coalesce(text, '')) as fingerprint from documents",
        "p8_checks": "select count(*) as documents, 0 as divided, 0 as overfull from documents",
    }
