"""Queries on texts without treatment, chunk strategies, tagged books, reviews, model output, frozen tables and answer gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.evidence_queries import _CHUNKS, _PARENTS, _SAID, _blank, _chunks, _parents, _said
from tessera.functions import records
from tessera.functions.text import clean_id, is_blank
from tessera.functions.texts import text_key
from tessera.operators import chunking, metrics, quality, reviews, safety, stats
from tessera.operators.skew import salted_join
from tessera.queries import _ANSWERS, _EACH, _LISTS, _QUESTIONS, _RESAMPLES, _answers, _clean, _lists, _pairs, _questions, query
from tessera.sources import files
from tessera.sources.tables import table

#: Herbs are a user's table; these stand for one.
HERBS = ["荻梅", "蕨茱", "碧蕊", "丹皮", "涧橘"]

# ---- treatment ----

_SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
_LITERAL = lambda x: "'" + x.replace("'", "''") + "'"


def _unsafe_sql(c: str) -> str:
    bare = f"regexp_replace({c}, '^[ \\t\\r\\n，,、：:]+|[ \\t\\r\\n，,、：:]+$', '', 'g')"
    compact = f"regexp_replace({bare}, '{_SPACE}+', '', 'g')"
    some = " or ".join(f"regexp_matches({compact}, {_LITERAL(p)})" for p in safety.UNSAFE)
    herbs = " or ".join(f"contains({compact}, '{h}')" for h in HERBS)
    return f"({bare} = '' or {some} or (regexp_matches({compact}, '{safety.DRINK}') and not regexp_matches({compact}, '{safety.DIAGNOSTIC}')) or {herbs})"


# regions don't occur in these tables, so that part of the SQL is an identity; it is tested on small texts
_SENTENCES = f"""with {_PARENTS}, s as (select parent_id, unnest(regexp_extract_all(original_text, '[^。！？!?；;]+[。！？!?；;]*|[。！？!?；;]+')) as s, generate_subscripts(regexp_extract_all(original_text, '[^。！？!?；;]+[。！？!?；;]*|[。！？!?；;]+'), 1) as no from parents),
b as (select parent_id, no, regexp_extract(s, '^([^。！？!?；;]*)', 1) as body, regexp_extract(s, '([。！？!?；;]*)$', 1) as mark from s),
c as (select parent_id, no, mark, unnest(regexp_split_to_array(body, '[，,]')) as c, generate_subscripts(regexp_split_to_array(body, '[，,]'), 1) as i, regexp_extract_all(body, '[，,]') as seps from b),
f as (select *, {_unsafe_sql('c')} as out from c)"""


@query(
    _SENTENCES
    + f""", k as (select *, row_number() over (partition by parent_id, no order by i) as kth from f where not out),
j as (select parent_id, no, string_agg(case when kth = 1 then '' else coalesce(seps[i - 1], '') end || c, '' order by i) || any_value(mark) as s from k group by all)
select p.parent_id, regexp_replace(coalesce(string_agg(s, '' order by no), ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') as text from parents p left join j using (parent_id) group by 1"""
)
def safe_texts(spark, d):
    return _parents(spark, d).select("parent_id", safety.safe_text(F.col("original_text"), HERBS).alias("text"))


@query(_SENTENCES + f" select p.parent_id, coalesce(bool_or(out and regexp_replace(c, '{_SPACE}+', '', 'g') <> ''), false)::int as treatment from parents p left join f using (parent_id) group by 1")
def treatment_found(spark, d):
    return _parents(spark, d).select("parent_id", safety.has_treatment(F.col("original_text"), HERBS).cast("int").alias("treatment"))


# ---- chunk strategies ----


def _units(spark, d) -> DataFrame:
    """Evidence units of the strategies: each section a clause of its chapter."""
    p = _parents(spark, d).where(~is_blank(F.col("original_text")))
    title = F.coalesce(F.nullif(F.col("chapter"), F.lit("")), F.lit("无门"))
    return p.select(
        F.col("parent_id").alias("evidence_id"), F.coalesce("book_id", F.lit("book")).alias("book_id"), F.coalesce("book_title", F.lit("")).alias("book_title"), F.concat_ws("-", F.coalesce("book_id", F.lit("book")), title).alias("chapter_id"), title.alias("chapter_title"),
        F.col("parent_id").alias("clause_id"), F.lit(None).cast("int").alias("clause_number"), F.lit("clause").alias("content_type"), "parent_id", F.col("original_text").alias("normalized_text"),
    )


def _prefix_sql(kind: bool) -> str:
    return "'书名：' || coalesce(book_title, '') || chr(10) || '篇名：' || coalesce(nullif(chapter, ''), '无门') || chr(10)" + (" || '类型：clause' || chr(10)" if kind else "") + " || '正文：'"


_C2, _C3, _C4 = (chunking.UNIT_SIZES[s]["limit"] for s in ("c2", "c3", "c4"))


@query(
    f"""with {_PARENTS}, u as (select *, {_prefix_sql(True)} as prefix from parents where not {_blank('original_text')})
select 'c2' as strategy, parent_id, (length(original_text) <= {_C2})::int as whole, 1 as fits, 1 as held, 1 as led from u union all
select 'c3', parent_id, (length(original_text) <= {_C3} - length(prefix))::int, 1, 1, 1 from u union all select 'c4', parent_id, (length(original_text) <= {_C4} - length(prefix))::int, 1, 1, 1 from u"""
)
def strategy_checks(spark, d):
    """By unit: whether one chunk holds it all, all chunks fit their limit, stand in its text, and begin with the titles."""
    units = _units(spark, d)
    out = []
    for s in ("c2", "c3", "c4"):
        chunks = chunking.evidence_chunks(units, s).withColumn("parent_id", F.get("source_evidence_ids", F.lit(0)))
        both = salted_join(chunks.select("parent_id", "text", "context_text", "char_count"), units.select("parent_id", "normalized_text", "book_title", "chapter_title"), "parent_id", F.xxhash64("text"))
        prefix = F.lit("") if s == "c2" else F.concat(F.lit("书名："), "book_title", F.lit("\n篇名："), "chapter_title", F.lit("\n类型：clause\n正文："))
        body = F.expr("substring(text, length(prefix) + 1)")
        both = both.withColumn("prefix", prefix).withColumn("body", body)
        context = F.col("normalized_text") if s == "c4" else F.col("text")
        flag = lambda c, name: F.min(c.cast("int")).alias(name)
        each = both.groupBy("parent_id").agg(
            ((F.count(F.lit(1)) == 1) & F.first(F.col("body") == F.col("normalized_text"))).cast("int").alias("whole"),
            flag(F.length("text") <= chunking.UNIT_SIZES[s]["limit"], "fits"), flag(F.col("normalized_text").contains(F.col("body")) & (F.col("context_text") == context), "held"), flag(F.col("text").startswith(F.col("prefix")), "led"),
        )
        out.append(each.select(F.lit(s).alias("strategy"), "parent_id", "whole", "fits", "held", "led"))
    return reduce(DataFrame.unionByName, out)


_C5 = chunking.UNIT_SIZES["c5"]


@query(
    f"""with {_PARENTS}, u as (select coalesce(book_id, 'book') || '-' || coalesce(nullif(chapter, ''), '无门') as chapter_id, {_prefix_sql(False)} as prefix, original_text, parent_id from parents where not {_blank('original_text')}),
ch as (select chapter_id, sum(length(original_text)) + count(*) - 1 as n, min(length(prefix)) as p from u group by 1)
select s.strategy, chapter_id, (case s.strategy when 'c5' then n > {_C5['parent']} - p else n > s.size end)::int as divided, 1 as fits, 1 as sourced
from ch, (values ('c0', {chunking.UNIT_SIZES['c0']['size']}), ('c1', {chunking.UNIT_SIZES['c1']['size']}), ('c5', 0)) s(strategy, size)"""
)
def chapter_checks(spark, d):
    """By chapter and strategy: whether it is divided (c5: into parents), all chunks fit, and each names its sources."""
    units = _units(spark, d)
    out = []
    for s in ("c0", "c1", "c5"):
        chunks = chunking.evidence_chunks(units, s)
        most = chunking.UNIT_SIZES[s]["size"] if s != "c5" else chunking.UNIT_SIZES[s]["child"]
        pieces = F.countDistinct("retrieval_parent_id") if s == "c5" else F.count(F.lit(1))
        fits = F.length("text") <= most if s != "c5" else (F.length("text") <= most) & (F.length("context_text") <= chunking.UNIT_SIZES[s]["parent"])
        each = chunks.groupBy("chapter_id").agg((pieces > 1).cast("int").alias("divided"), F.min(fits.cast("int")).alias("fits"), F.min((F.size("source_evidence_ids") > 0).cast("int")).alias("sourced"))
        out.append(each.select(F.lit(s).alias("strategy"), "chapter_id", "divided", "fits", "sourced"))
    return reduce(DataFrame.unionByName, out)


# ---- tagged books ----



def _strip_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


@query(
    f"""with {_PARENTS}, s as (select coalesce(book_id, 'book') as book_id, parent_id, coalesce(nullif(volume, ''), '卷0') as volume, nullif(chapter, '') as chapter, section as title, {_strip_sql('original_text')} as body from parents where section <> '' and not {_blank('original_text')})
select book_id, row_number() over (partition by book_id order by parent_id)::int - 1 as section_no, volume, chapter, title, length(body)::int as characters, sha256(body) as fingerprint from s"""
)
def tagged_books(spark, d):
    """Books written as tagged text, one row a book, and read by the library's parser."""
    p = _parents(spark, d).where((F.col("section") != "") & ~is_blank(F.col("original_text")))
    place = F.concat(F.coalesce(F.nullif(F.col("volume"), F.lit("")), F.lit("卷0")), F.when(F.col("chapter") != "", F.concat(F.lit("\\"), "chapter")).otherwise(""))
    block = F.concat(F.lit("<目录>"), place, F.lit("\n<篇名>"), "section", F.lit("\n属性："), "original_text")
    books = p.select(F.coalesce("book_id", F.lit("book")).alias("path"), "parent_id", block.alias("block")).groupBy("path").agg(F.expr("listagg(block, '\n') within group (order by parent_id)").alias("text"))
    s = files.tagged_sections(books)
    return s.select(F.col("path").alias("book_id"), "section_no", "volume", "chapter", "title", F.length("body").alias("characters"), F.sha2("body", 256).alias("fingerprint"))


# ---- model output and reports ----


@query(
    f"""with {_ANSWERS} select answer_id, coalesce(abstain, false)::int as abstains, case when coalesce(abstain, false) then 0 else len(list_distinct(coalesce(citations, []))) end::int as cited,
case when coalesce(abstain, false) then null when {_blank('answer')} then 'no_answer' when len(list_distinct(coalesce(citations, []))) = 0 then 'no_citation' when len(list_filter(citations, lambda c: not list_contains(['E1', 'E2', 'E3'], c))) > 0 then 'unknown_label' end as violation from answers"""
)
def model_outputs(spark, d):
    """Answers as a model writes them, fenced JSON, read and checked by the library; three labels are known."""
    a = _answers(spark, d)
    written = F.concat(F.lit("```json\n"), F.to_json(F.struct("answer", F.coalesce("abstain", F.lit(False)).alias("abstain"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"))), F.lit("\n```"))
    m = a.select("answer_id", records.model_answer(written, F.array(*map(F.lit, ("E1", "E2", "E3")))).alias("m"))
    return m.select("answer_id", F.col("m.abstain").cast("int").alias("abstains"), F.size("m.citations").alias("cited"), F.col("m.violation").alias("violation"))


@query(f"""with {_LISTS}, t as (select qa_id, list('E' || place || '=' || chunk_id order by place) as rows from lists where strategy = 'child' and place <= 5 group by 1) select qa_id, array_to_string(rows, '|') as blocks from t""")
def report_blocks(spark, d):
    """The five best hits of each question written as a report of labelled blocks, and read again."""
    top = _lists(spark, d).where("strategy = 'child' and place <= 5").groupBy("qa_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))).alias("x"))  # at most five
    text = records.report(F.transform("x", lambda r: F.struct(F.concat(F.lit("E"), r["place"]).alias("label"), r["chunk_id"].alias("text"))))
    return top.select("qa_id", F.array_join(F.transform(records.evidence_blocks(text), lambda b: F.concat(b["label"], F.lit("="), b["text"])), "|").alias("blocks"))


@query("select doc_id, trim(substr(x, 3)) as asked from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ')), lambda l: starts_with(l, '问：') or starts_with(l, '问:'))[1] as x from documents) where x is not null")
def labelled_lines(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", records.labelled(F.col("text"), "问").alias("asked")).where("asked is not null")


# ---- reviews ----

_MAPS = {"answer_correct": {"1": "yes", "0": "no"}, "hallucination": {"1": "yes", "0": "no"}, "completeness": {str(k): f"score_{k}" for k in range(4)}}


def _cells(spark, d) -> DataFrame:
    """Sheets as reviewers fill them: numbers or words, in any case, some blank."""
    a = _answers(spark, d)
    number = lambda c: F.when(c, "1").when(~c, " 0 ")
    return a.select("answer_id", "method", number(F.col("retrieval_supported")).alias("answer_correct"), F.when(F.col("abstain"), "NO").when(~F.col("abstain"), "Yes ").alias("hallucination"), F.when(F.col("latency_ms").isNotNull(), F.col("repeat_index").cast("string")).alias("completeness"))


_CELLS = f"""with {_ANSWERS}, cells as (select answer_id, method, case when retrieval_supported then 'yes' when not retrieval_supported then 'no' end as answer_correct, case when abstain then 'no' when not abstain then 'yes' end as hallucination,
case when latency_ms is not null then 'score_' || repeat_index end as completeness from answers)"""


@query(_CELLS + " select * exclude (method) from cells")
def review_labels(spark, d):
    c = _cells(spark, d)
    return c.select("answer_id", *[reviews.normal_label(F.col(n), m).alias(n) for n, m in _MAPS.items()])


@query(
    _CELLS
    + """ select method, count(*) as rows_n, count_if(answer_correct is not null and hallucination is not null and completeness is not null) as completed, round(count_if(answer_correct = 'yes') / nullif(count_if(answer_correct in ('yes', 'no')), 0), 6) as correct_rate,
round(count_if(hallucination = 'yes') / nullif(count_if(hallucination in ('yes', 'no')), 0), 6) as hallucination_rate, """
    + ", ".join(f"count_if(completeness = 'score_{k}') as score_{k}" for k in range(4))
    + " from cells group by 1"
)
def review_summary(spark, d):
    c = _cells(spark, d)
    labels = c.select("method", *[reviews.normal_label(F.col(n), m).alias(n) for n, m in _MAPS.items()])
    return reviews.summary(labels, ["method"], {"answer_correct": "correct_rate", "hallucination": "hallucination_rate"}, "completeness", 4)


@query(
    f"""with {_QUESTIONS}, k as (select lower(regexp_replace(question, '[\\s\\p{{Z}}]+', '', 'g')) as question_key from pairs where not {_blank('question')} group by 1 having count(*) > 1)
select p.qa_id, case when {_blank('p.question')} then 'blank_question' when contains(lower(p.question), lower(p.qa_id)) then 'id_in_question' when {_blank('p.answer')} then 'blank_answer' when not contains(p.source_text, p.answer) then 'answer_outside' when k.question_key is not null then 'repeated_question' end as violation
from pairs p left join k on k.question_key = lower(regexp_replace(p.question, '[\\s\\p{{Z}}]+', '', 'g'))"""
)
def authoring_checks(spark, d):
    p = _pairs(spark, d).withColumn("question_key", F.when(~is_blank(F.col("question")), text_key(F.col("question"))))
    repeated = p.where("question_key is not null").groupBy("question_key").count().where("count > 1").select("question_key", F.lit(True).alias("again"))
    q = p.join(repeated, "question_key", "left")
    rule = (
        F.when(is_blank(F.col("question")), "blank_question")
        .when(F.lower("question").contains(F.lower("qa_id")), "id_in_question")
        .when(is_blank(F.col("answer")), "blank_answer")
        .when(~F.col("source_text").contains(F.col("answer")), "answer_outside")
        .when(F.col("again"), "repeated_question")
    )
    return q.select("qa_id", rule.alias("violation"))


@query(
    """with a as (select source_doc_id, annotations from tcm_qg_documents where source_doc_id is not null qualify row_number() over (partition by source_doc_id order by loaded_at desc) = 1),
e as (select source_doc_id, unnest(annotations) as x, generate_subscripts(annotations, 1) as no from a) select source_doc_id, (no - 1)::int as place, length(x.Q)::int as question_characters, length(x.A)::int as answer_characters, 2 as relevance from e"""
)
def authoring_rows(spark, d):
    from tessera.operators import catalog

    docs = catalog.latest(table(spark, d, "tcm_qg_documents"), ["source_doc_id"], "loaded_at")
    return docs.select("source_doc_id", F.posexplode("annotations").alias("place", "x")).select("source_doc_id", "place", F.length("x.Q").alias("question_characters"), F.length("x.A").alias("answer_characters"), F.lit(2).alias("relevance"))


# ---- frozen tables, gates ----

_FROZEN = {"tcm_qg_pairs": "qa_id", "evidence_parents": "parent_id", "retrieval_chunks": "chunk_id", "tcm_qg_documents": "source_doc_id", "app_threads": "thread_id"}


@query(" union all ".join(f"select '{t}' as table_name, count(*) as rows_n, count(distinct {k}) as keys_n, sum(('0x' || substr(md5({k}), 1, 8))::bigint)::bigint as checksum from {t} where {k} is not null" for t, k in _FROZEN.items()))
def freeze_manifest(spark, d):
    """Rows, keys and a checksum of keys of each table, which a later run holds against its own."""
    out = []
    for t, k in _FROZEN.items():
        sum_ = F.sum(F.conv(F.substring(F.md5(F.col(k).cast("binary")), 1, 8), 16, 10).cast("bigint"))
        out.append(table(spark, d, t, k).where(F.col(k).isNotNull()).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("rows_n"), F.countDistinct(k).alias("keys_n"), sum_.alias("checksum")))
    return reduce(DataFrame.unionByName, out)


@query(
    f"""with {_ANSWERS}, {_LISTS}, best as (select qa_id, max(score) as best from lists where strategy = 'child' group by 1), g as (select answer_id, method, coalesce(best, 0) < 8 as gated, coalesce(abstain, false) as abstain from answers left join best using (qa_id))
select method, gated::int as gated, count(*) as answers_n, count_if(abstain) as abstained from g group by all"""
)
def answer_gate(spark, d):
    """Answers by whether the best retrieval score of their question lies below a threshold, and how many abstain."""
    best = _lists(spark, d).where("strategy = 'child'").groupBy("qa_id").agg(F.max("score").alias("best"))
    j = salted_join(_answers(spark, d).select("answer_id", "method", "qa_id", "abstain"), best, "qa_id", F.col("answer_id"), how="left")
    gated = (F.coalesce("best", F.lit(0.0)) < 8).cast("int").alias("gated")
    return j.groupBy("method", gated).agg(F.count(F.lit(1)).alias("answers_n"), F.count_if(F.coalesce("abstain", F.lit(False))).alias("abstained"))


@query(f"with {_SAID} select thread_id, max(ordinal) as ordinal, arg_max(name, {{'o': ordinal, 'i': id}}) as tool, arg_max(text, {{'o': ordinal, 'i': id}}) as text from m where type = 'tool' and name is not null and not {_blank('text')} group by 1")
def last_evidence(spark, d):
    some = _said(spark, d).where((F.col("type") == "tool") & F.col("name").isNotNull() & ~is_blank(F.col("text")))
    at = F.struct("ordinal", "id")
    return some.groupBy("thread_id").agg(F.max("ordinal").alias("ordinal"), F.max_by("name", at).alias("tool"), F.max_by("text", at).alias("text"))


@query(f"with {_QUESTIONS}, {_LISTS}, b as (select * from lists where place <= 10 qualify row_number() over (partition by qa_id, strategy, parent_id order by place) = 1) select strategy, count(*) as kept, count_if(parent_id is null) as without_parent, count_if(place = 1) as firsts from b group by 1")
def strict_recovery(spark, d):
    """Hits kept one a parent, with those whose parent isn't known counted instead of dropped."""
    from tessera.operators import fusion

    lists = _lists(spark, d).where("place <= 10").withColumn("qa_id", F.concat("qa_id", F.lit("|"), "strategy"))
    parents = lists.where("parent_id is not null").select("parent_id", F.lit(True).alias("known")).distinct()
    best = fusion.recover_parents(lists, parents, 10, strict=True)
    return best.groupBy("strategy").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("known").isNull()).alias("without_parent"), F.count_if(F.col("place") == 1).alias("firsts"))


# ---- trace events ----


@query(
    f"""with m as (select run_id, ordinal, tool_calls, type, content, name, case when run_id is null then {_clean('thread_id')} end as thread from app_messages), c as (select run_id, thread, unnest(from_json(tool_calls, '["json"]')) as c from m where starts_with(tool_calls, '['))
select run_id, thread, concat_ws(':', 'tool_call', c->>'$.id', c->>'$.name') as event_key, 'tool_call' as event from c group by all union all
select run_id, thread, concat_ws(':', 'tool_result', ordinal::varchar, coalesce(name, ''), substr(md5(substr(content, 1, 500)), 1, 8)), 'tool_result' from m where lower(trim(type)) = 'tool' group by all"""
)
def trace_events(spark, d):
    """Each call and result of a tool once a run, or once a thread where the run is null; results are told apart by their place."""
    from tessera.streaming import trace

    m = table(spark, d, "app_messages", "run_id", "thread_id", "ordinal", "tool_calls", "type", "content", "name")
    return trace.distinct_events(m).select("run_id", F.col("thread_id").alias("thread"), "event_key", "event")


# ---- retrieval with legs that may be missing ----

_LEGS = f"""with {_LISTS}, c as (select * from lists where strategy = 'child'), k as (select qa_id, chunk_id, bm25_score as base, row_number() over (partition by qa_id order by bm25_score desc, chunk_id) as place from c where bm25_score is not null and not isnan(bm25_score) qualify place <= 20),
v as (select qa_id, chunk_id, overlap_score as base, row_number() over (partition by qa_id order by overlap_score desc, chunk_id) as place from c where overlap_score is not null and not isnan(overlap_score) qualify place <= 20),
f as (select qa_id, chunk_id, sum(1.0::double / (60 + place)) as base from (select * from k union all select * from v) group by all), h as (select *, row_number() over (partition by qa_id order by round(base, 12) desc, chunk_id) as place from f qualify place <= 40),
r as (select h.qa_id, h.chunk_id, c.score, row_number() over (partition by h.qa_id order by c.score desc nulls last, h.base desc, h.chunk_id) as place from h join c using (qa_id, chunk_id)),
w as (select v.qa_id, v.chunk_id, c.score, row_number() over (partition by v.qa_id order by c.score desc nulls last, v.base desc, v.chunk_id) as place from v join c using (qa_id, chunk_id))"""


def _missing():
    raise FileNotFoundError("no such model")


@query(
    _LEGS
    + """ select 'whole' as run, qa_id, chunk_id, place::int as place, round(score, 6) as score, 'hybrid' as mode, 0 as degraded, null as reason from r where place <= 10 union all
select 'no_dense', qa_id, chunk_id, place::int, 0, 'keyword', 1, 'FileNotFoundError' from k where place <= 10 union all select 'no_reranker', qa_id, chunk_id, place::int, 0, 'keyword', 1, 'FileNotFoundError' from k where place <= 10 union all
select 'database', qa_id, chunk_id, place::int, round(score, 6), 'hybrid', 0, null from r where place <= 10 union all select 'database_no_keywords', qa_id, chunk_id, place::int, round(score, 6), 'vector', 1, 'FileNotFoundError' from w where place <= 10"""
)
def retrieval_fallbacks(spark, d):
    """The two services' answers with all legs, and with a leg or the reranker missing."""
    from tessera.plans import retrieve

    child = _lists(spark, d).where("strategy = 'child'")
    candidates = child.select("qa_id", "chunk_id", F.col("bm25_score").alias("lexical"), F.col("overlap_score").alias("dense"))
    keywords, dense = (lambda: retrieve.leg(candidates, "lexical", 20)), (lambda: retrieve.leg(candidates, "dense", 20))
    scores = child.select("qa_id", "chunk_id", F.col("score").alias("rerank_score"))
    reranked = lambda few: few.join(scores, ["qa_id", "chunk_id"], "left")
    runs = {
        "whole": retrieve.serve(keywords, dense, reranked, "hybrid", 10),
        "no_dense": retrieve.serve(keywords, _missing, reranked, "hybrid", 10),
        "no_reranker": retrieve.serve(keywords, dense, lambda few: _missing(), "hybrid", 10),
        "database": retrieve.serve_from_database(keywords, dense, reranked, "hybrid", 10),
        "database_no_keywords": retrieve.serve_from_database(_missing, dense, reranked, "hybrid", 10),
    }
    out = [df.select(F.lit(name).alias("run"), "qa_id", "chunk_id", "place", F.round("score", 6).alias("score"), "mode", F.col("degraded").cast("int").alias("degraded"), "reason") for name, df in runs.items()]
    return reduce(DataFrame.unionByName, out)


@query(f"with docs as (select doc_id, text from documents where not {_blank('text')}) select doc_id, 1 as fits, 1 as held, (length(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')) > 500)::int as divided from docs")
def recursive_checks(spark, d):
    """What holds for recursive chunks: they fit 500 characters, stand where they say, and longer texts are divided."""
    docs = table(spark, d, "documents", "doc_id", "text").where(~is_blank(F.col("text")))
    chunks = chunking.recursive_chunks(docs, "doc_id", "text", 500, 80).join(docs, "doc_id")
    own = F.expr("substring(text, start_index + 1, length(chunk))") == F.col("chunk")
    each = chunks.groupBy("doc_id").agg(F.min((F.length("chunk") <= 500).cast("int")).alias("fits"), F.min(own.cast("int")).alias("held"), (F.count(F.lit(1)) > 1).cast("int").alias("divided"))
    return each


# ---- stratified bootstraps ----


def _strata_sql(values: str, names: list[str], seed: str) -> str:
    """Resamples of questions (q, h, m0, m1, …) inside strata h, as the operator draws them."""
    sums = ", ".join(f"sum(m{j}) / (select count(*) from v) as m{j}" for j in range(len(names)))
    rows = " union all ".join(f"select '{n}' as metric, (select avg(m{j}) from v) as value, quantile_cont(m{j}, 0.025) as lower, quantile_cont(m{j}, 0.975) as upper from m" for j, n in enumerate(names))
    return f"""{_EACH.rstrip()}, v as ({values}), c as (select *, row_number() over (partition by h order by sha256('{seed}:' || h || ':' || q), q) - 1 as i from v), n as (select h, count(*) as n from v group by 1),
d as (select h, r, ('0x' || substr(sha256('{seed}:' || r || ':' || h || ':' || k), 1, 12))::bigint % n as i from (select h, n, unnest(range(n)) as k from n), range({_RESAMPLES}) t(r)),
m as (select r, {sums} from d join c using (h, i) group by 1), e as ({rows}) """


_H = """'{"split":"' || split || '"}'"""
_BOTH = "select metric, round({0}, 6) as {1}, round(lower, 6) as lower, round(upper, 6) as upper, {2}(select count(*) from v) as questions, (select count(*) from n) as strata from e"


@query(_strata_sql(f"select qa_id as q, {_H} as h, mrr_10 as m0, recall_5 as m1 from each_ where strategy = 'child' and split is not null", ["mrr_10", "recall_5"], "mean") + _BOTH.format("value", "value", ""))
def stratified_means(spark, d):
    each = metrics.per_question(_lists(spark, d), _questions(spark, d)).where("strategy = 'child' and split is not null")
    out = stats.stratified_bootstrap(each, "qa_id", ["split"], ["mrr_10", "recall_5"], _RESAMPLES, "mean")
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("metric", r("value"), r("lower"), r("upper"), "questions", "strata")


@query(
    _strata_sql(f"select a.qa_id as q, {_H} as h, a.mrr_10 - b.mrr_10 as m0 from (select * from each_ where strategy = 'child') a join (select qa_id, mrr_10 from each_ where strategy = 'b4') b using (qa_id) where split is not null", ["mrr_10"], "pair")
    + _BOTH.format("value", "delta", "(lower <= 0 and upper >= 0)::int as inconclusive, ")
)
def paired_strata(spark, d):
    each = metrics.per_question(_lists(spark, d), _questions(spark, d)).where("split is not null")
    both = each.where("strategy in ('child', 'b4')").groupBy("qa_id").agg(F.countDistinct("strategy").alias("n")).where("n = 2").select("qa_id")
    a, b = (each.where(F.col("strategy") == s).join(both, "qa_id", "left_semi") for s in ("child", "b4"))
    out = stats.paired_stratified_bootstrap(a, b, "qa_id", ["split"], ["mrr_10"], _RESAMPLES, "pair")
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("metric", r("delta"), r("lower"), r("upper"), F.col("inconclusive").cast("int").alias("inconclusive"), "questions", "strata")


# ---- last messages, vectors, review rows ----


@query(f"with {_SAID}, l as (select thread_id, arg_max({{'t': type, 'n': name, 'x': text}}, {{'o': ordinal, 'i': id}}) as x from m group by 1) select thread_id, x.n as tool, x.x as asked from l where x.t = 'tool' and x.n is not null and not {_blank('x.x')}")
def open_questions(spark, d):
    """Threads whose last message is a tool's, with what it says: a run that waits for the user ends so."""
    m = _said(spark, d)
    last = m.groupBy("thread_id").agg(F.max_by(F.struct("type", "name", "text"), F.struct("ordinal", "id")).alias("x"))
    return last.where((F.col("x.type") == "tool") & F.col("x.name").isNotNull() & ~is_blank(F.col("x.text"))).select("thread_id", F.col("x.name").alias("tool"), F.col("x.text").alias("asked"))


@query("select vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::double)), ',') || ']' as literal from embeddings")
def vector_literals(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", records.vector_literal(F.col("embedding")).alias("literal"))


def _review_rows(spark, d) -> DataFrame:
    """Review rows as answers give them: support decides, the model is the reviewer, the first citation the comment."""
    a = _answers(spark, d)
    status = F.when(F.col("retrieval_supported").isNull(), "pending").when(F.col("retrieval_supported"), "pass").otherwise("fail")
    decision = F.when(F.col("abstain"), "wrong").when(~F.col("abstain"), "correct")
    return a.select("answer_id", "method", status.alias("status"), decision.alias("decision"), F.col("model_name").alias("reviewer"), F.get("citations", F.lit(0)).alias("comment"), F.to_date("answered_at").alias("day"))


_REVIEW_ROWS = f"""with {_ANSWERS}, rows_ as (select answer_id, method, case when retrieval_supported is null then 'pending' when retrieval_supported then 'pass' else 'fail' end as status, case when abstain then 'wrong' when not abstain then 'correct' end as decision, model_name as reviewer, citations[1] as comment, answered_at::date as day from answers)"""


@query(
    _REVIEW_ROWS
    + """ select answer_id, case when status = 'pending' and (decision is not null or reviewer is not null) then 'pending_filled' when status in ('pass', 'fail') and reviewer is null then 'no_reviewer' when status = 'pass' and decision is distinct from 'correct' then 'pass_not_correct'
when status = 'fail' and (decision is null or decision = 'correct') then 'fail_without_error' when status = 'fail' and comment is null then 'fail_without_comment' end as violation from rows_"""
)
def review_rules(spark, d):
    return quality.review_violations(_review_rows(spark, d)).select("answer_id", "violation")


@query(_REVIEW_ROWS + " select method, count_if(status = 'pass') as passed, count_if(status = 'fail') as failed, count_if(status = 'fail' and decision = 'wrong') as wrong, coalesce(string_agg(distinct reviewer, ',' order by reviewer), '') as reviewers, min(day)::varchar as first_day, max(day)::varchar as last_day from rows_ group by 1")
def audit_summary(spark, d):
    return reviews.audited(_review_rows(spark, d), ["method"], ["wrong"])
