"""More queries of the core: texts and titles of evidence, gold sets and citations, rules, messages and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import texts
from tessera.functions.records import question_list
from tessera.functions.text import clean_id, is_blank
from tessera.operators import catalog, fusion, gold, metrics, runs
from tessera.queries import _ANSWERS, _DOCS, _LISTS, _QUESTIONS, _answers, _asked, _best, _clean, _documents, _lists, _pairs, _questions, _BM25, ALIASES, SYMPTOMS, query
from tessera.session import cut
from tessera.sources.tables import table

_BLANK = r"[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]*"
_PARENTS = "parents as (select * from evidence_parents where parent_id is not null qualify row_number() over (partition by parent_id order by loaded_at desc) = 1)"
_CHUNKS = "chunks as (select * from retrieval_chunks where chunk_id is not null qualify row_number() over (partition by chunk_id order by loaded_at desc) = 1)"
METHODS = ["B0", "B4", "P", "P-no-parent"]


def _parents(spark, d):
    return catalog.latest(table(spark, d, "evidence_parents"), ["parent_id"], "loaded_at")


def _chunks(spark, d):
    return catalog.latest(table(spark, d, "retrieval_chunks"), ["chunk_id"], "loaded_at")


def _blank(x: str) -> str:
    return f"regexp_full_match(coalesce({x}, ''), '{_BLANK}')"


# ---- texts and titles ----

_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '\\x[ \t]*([^\\\r\n]+?)[ \t]*\\x', '\1', 'g'), '[ \t]+\n', chr(10), 'g'), '\n[ \t]*', ' ', 'g'), '[ \t]{{2,}}', ' ', 'g'), '^[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+|[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+$', '', 'g')"


@query(f"with {_PARENTS} select parent_id, {_NORMAL.format('original_text')} as text from parents where original_text is not null")
def normal_texts(spark, d):
    return _parents(spark, d).where("original_text is not null").select("parent_id", texts.normal_text(F.col("original_text")).alias("text"))


@query(
    f"""with {_PARENTS}, books as (select distinct book_id from parents where book_id is not null)
select book_id, case when p = '' then 'book' else p end as prefix, translate(concat_ws('_', book_id, 'v1.0'), '.-', '__') as index_name
from (select book_id, array_to_string(list_transform(list_filter(regexp_split_to_array(book_id, '[^a-zA-Z0-9]+'), lambda x: x <> ''), lambda x: lower(x[1])), '') as p from books)"""
)
def book_names(spark, d):
    books = _parents(spark, d).where("book_id is not null").select("book_id").distinct()
    return books.select("book_id", texts.initials(F.col("book_id")).alias("prefix"), texts.index_name(F.col("book_id"), F.lit("v1.0")).alias("index_name"))


def _tags_sql(title: str) -> str:
    held = ", ".join(f"case when contains({title}, '{s}')" + (f" or contains({title}, '{ALIASES[s]}')" if s in ALIASES else "") + f" then '{s}' end" for s in SYMPTOMS)
    return f"array_to_string(list_filter([{held}], lambda x: x is not null), ',')"


def _role_sql(title: str) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains({title}, '{w}')" for w in words) + f" then '{name}'" for name, words in texts.ROLE_TITLES) + " else 'syndrome_pattern' end"


@query(f"with {_PARENTS}, t as (select parent_id, concat_ws(' ', volume, chapter, section) as title from parents) select parent_id, {_tags_sql('title')} as tags, {_role_sql('title')} as role from t")
def title_labels(spark, d):
    titled = _parents(spark, d).select("parent_id", F.concat_ws(" ", "volume", "chapter", "section").alias("title"))
    return titled.select("parent_id", F.array_join(texts.title_tags(F.col("title"), SYMPTOMS, ALIASES), ",").alias("tags"), texts.title_role(F.col("title")).alias("role"))


@query(
    f"""with {_QUESTIONS}, t as (select qa_id, question as q, trim(regexp_replace(question, '[\\s\\p{{Z}}]+', ' ', 'g')) as s from pairs where question is not null)
select qa_id, case when length(q) <= 60 then q else substr(q, 1, 29) || '…' || right(q, 29) end as two_ends,
case when length(s) <= 32 then s else substr(s, 1, 10) || '…' || substr(s, greatest(0, (length(s) - 10) // 2)::int + 1, 10) || '…' || right(s, 10) end as three_parts from t"""
)
def question_excerpts(spark, d):
    q = _pairs(spark, d).where("question is not null")
    return q.select("qa_id", texts.two_ends(F.col("question")).alias("two_ends"), texts.three_parts(F.col("question")).alias("three_parts"))


@query(f"with {_QUESTIONS}, k as (select {_clean('split')} as split, lower(regexp_replace(question, '[\\s\\p{{Z}}]+', '', 'g')) as question_key from pairs where not {_blank('question')}) select question_key, count(*) as records, count(distinct split) as splits from k group by 1 having count(*) > 1")
def repeated_questions(spark, d):
    return gold.repeated_questions(_pairs(spark, d).withColumn("split", clean_id(F.col("split"))))


@query(f"with {_QUESTIONS} select coalesce({_clean('split')}, 'none') as split, count(*) as questions, count_if(regexp_matches(coalesce(question, ''), '{'|'.join(texts.CLINICAL)}')) as clinical, count_if(review_status = 'approved') as approved, count_if(review_status = 'approved' and not {_blank('answer')}) as answerable from pairs group by 1")
def question_subsets(spark, d):
    p = _pairs(spark, d)
    approved = F.coalesce(F.col("review_status") == "approved", F.lit(False))
    return p.groupBy(F.coalesce(clean_id(F.col("split")), F.lit("none")).alias("split")).agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(F.coalesce(texts.is_clinical(F.col("question")), F.lit(False))).alias("clinical"), F.count_if(approved).alias("approved"), F.count_if(approved & ~is_blank(F.col("answer"))).alias("answerable")
    )


@query(f"with {_DOCS}, q as (select source_doc_id, list_filter(list_transform(annotations, lambda a: regexp_replace(a.Q, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: x is not null and x <> '') as qs from (select * from tcm_qg_documents where source_doc_id is not null qualify row_number() over (partition by source_doc_id order by loaded_at desc) = 1)), u as (select source_doc_id, list_filter(qs, lambda x, i: list_position(qs, x) = i) as qs from q) select source_doc_id, coalesce(array_to_string(qs[1:3], '|'), '') as questions from u")
def question_items(spark, d):
    docs = catalog.latest(table(spark, d, "tcm_qg_documents"), ["source_doc_id"], "loaded_at")
    return docs.select("source_doc_id", F.coalesce(F.array_join(question_list(F.col("annotations.Q")), "|"), F.lit("")).alias("questions"))


@query(f"with {_PARENTS}, {_CHUNKS}, t as (select parent_id, string_agg(text, chr(10) order by chunk_id) as text, count(*) as chunks from chunks where parent_id is not null and text is not null group by 1) select parent_id, chunks, length(text)::int as characters, contains(text, '主治')::int as indicated, regexp_matches(text, '[一二三四五六七八九十两半]+(钱|两|枚)')::int as dosed from t")
def group_texts(spark, d):
    c = _chunks(spark, d).where("parent_id is not null and text is not null")
    # ordered text of a parent's chunks; a parent is one book section
    t = c.groupBy("parent_id").agg(F.expr("listagg(text, '\n') within group (order by chunk_id)").alias("text"), F.count(F.lit(1)).alias("chunks"))
    return t.select("parent_id", "chunks", F.length("text").alias("characters"), F.col("text").contains("主治").cast("int").alias("indicated"), F.col("text").rlike("[一二三四五六七八九十两半]+(钱|两|枚)").cast("int").alias("dosed"))


@query(f"with {_CHUNKS} select parent_id, chunk_id, coalesce(sum(length(coalesce(text, '')) + 1) over (partition by parent_id order by chunk_id rows between unbounded preceding and 1 preceding), 0)::bigint as start, length(coalesce(text, ''))::int as length from chunks where parent_id is not null")
def unit_offsets(spark, d):
    return gold.joined_units(_chunks(spark, d).where("parent_id is not null"), "parent_id", "chunk_id", "text")


_ROLES = "syndrome_pattern symptom_feature diagnostic_method pathogenesis case differential".split()


@query(f"with {_PARENTS} select book_id, " + ", ".join(f"count_if(evidence_role = '{r}') as {r}_n" for r in _ROLES) + ", round_even(avg(length(original_text)), 4) as mean_length from parents where book_id is not null group by 1")
def evidence_counts(spark, d):
    p = _parents(spark, d).where("book_id is not null")
    return p.groupBy("book_id").agg(*[F.count_if(F.col("evidence_role") == r).alias(f"{r}_n") for r in _ROLES], F.bround(F.avg(F.length("original_text")), 4).alias("mean_length"))


@query("select event_id, label, doc_id, lang from (select vec_id as event_id, label from embeddings) e join documents on doc_id = event_id")
def embedded_documents(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "label").select(F.col("vec_id").alias("event_id"), "label")
    return e.join(table(spark, d, "documents", "doc_id", "lang"), F.col("doc_id") == F.col("event_id"))


@query(f"with {_QUESTIONS} select qa_id, upper(sha256(concat_ws('|', qa_id, coalesce(split, '~'), coalesce(question, '~'), coalesce(answer, '~')))) as fingerprint from pairs")
def fingerprints(spark, d):
    return _pairs(spark, d).select("qa_id", F.upper(F.sha2(F.concat_ws("|", "qa_id", *[F.coalesce(c, F.lit("~")) for c in ("split", "question", "answer")]), 256)).alias("fingerprint"))


# ---- gold sets, citations, rankings ----

_GOLD = f"""links as (select {_clean('source_doc_id')} as a, {_clean('linked_doc_id')} as b from doc_links), both_ as (select a, b from links where a is not null and b is not null and a <> b union select b, a from links where a is not null and b is not null and a <> b),
q as (select distinct qa_id, doc from questions where doc is not null), gold as (select qa_id, doc as key, 2.0::double as rel from q union all select qa_id, b, 1.0 from q join both_ on a = doc)"""
_LABELS = """first_ as (select * from lists where place <= 5 and parent_id is not null qualify row_number() over (partition by qa_id, strategy, parent_id order by place) = 1),
labels as (select *, 'E' || row_number() over (partition by qa_id, strategy order by place) as label from first_)"""


def _links(spark, d):
    return table(spark, d, "doc_links").select(clean_id(F.col("source_doc_id")).alias("a"), clean_id(F.col("linked_doc_id")).alias("b"))


def _gold(spark, d):
    return gold.gold_sets(_questions(spark, d), _links(spark, d))


def _labels(spark, d):
    lists = _lists(spark, d)
    return fusion.citations(lists).join(lists.select("qa_id", "strategy", "chunk_id", "hit_doc", "source_doc_id", "start_index", "char_count"), ["qa_id", "strategy", "chunk_id"])


@query(
    f"""with {_QUESTIONS}, {_LISTS}, {_GOLD}, size as (select qa_id, count(distinct key) as gold from gold group by 1), top as (select distinct qa_id, strategy, hit_doc as key from lists where place <= 10 and hit_doc is not null),
found as (select qa_id, strategy, count(*) as found from top join (select distinct qa_id, key from gold) using (qa_id, key) group by all)
select a.qa_id, a.strategy, gold, coalesce(found, 0) as found, round(coalesce(found, 0) / gold, 6) as recall from (select distinct qa_id, strategy from lists) a join size using (qa_id) left join found using (qa_id, strategy)"""
)
def recall_of_sets(spark, d):
    return gold.recall_of_sets(_lists(spark, d), _gold(spark, d))


@query(
    f"""with {_QUESTIONS}, {_LISTS}, {_GOLD}, g as (select qa_id, key, max(rel) as rel from gold group by all), l as (select * from lists where strategy = 'child'),
f as (select qa_id, key, min(place) as place, max(rel) as rel from l join g on g.qa_id = l.qa_id and g.key = l.hit_doc where place <= 10 group by all),
gain as (select qa_id, place, max(rel) as rel from f group by all), dcg as (select qa_id, sum((pow(2, rel) - 1) / log2(place + 1)) as dcg from gain group by 1),
ideal as (select qa_id, sum((pow(2, rel) - 1) / log2(i + 1)) as idcg from (select *, row_number() over (partition by qa_id order by rel desc, key) as i from g) where i <= 10 group by 1)
select qa_id, round(coalesce(dcg, 0) / idcg, 6) as ndcg from ideal left join dcg using (qa_id)""".replace("f as (select qa_id, key", "f as (select g.qa_id, g.key")
)
def graded_gain(spark, d):
    best = _gold(spark, d).groupBy("qa_id", "key").agg(F.max("rel").alias("rel"))
    hits = _lists(spark, d).where("strategy = 'child' and hit_doc is not null").select("qa_id", "place", F.array("hit_doc").alias("keys"))
    return metrics.graded_ndcg(hits, best).select("qa_id", F.round("ndcg", 6).alias("ndcg"))


@query(
    f"""with {_DOCS}, {_QUESTIONS}, {_LISTS}, p as (select distinct on (parent_id) 'tcmqg-' || {_clean('source_doc_id')} as parent_id, {_clean('source_doc_id')} as doc from docs where not {_blank('text')})
select strategy, count(l.parent_id) as hits, count_if(p.doc = l.hit_doc) as recovered, round(count_if(p.doc = l.hit_doc) / nullif(count(l.parent_id), 0), 6) as rate from lists l left join p using (parent_id) where place <= 10 group by 1"""
)
def parent_recovery_rate(spark, d):
    doc = clean_id(F.col("source_doc_id"))
    parents = _documents(spark, d).select(F.concat(F.lit("tcmqg-"), doc).alias("parent_id"), doc.alias("doc"), "text")
    return gold.parent_recovery(_lists(spark, d), parents)


@query(
    f"""with {_ANSWERS}, {_QUESTIONS}, {_LISTS}, {_LABELS}, {_GOLD}, cited as (select distinct answer_id, qa_id, unnest(citations) as label from answers where qa_id is not null),
docs_ as (select distinct answer_id, c.qa_id, strategy, hit_doc as key from cited c join labels l on l.qa_id = c.qa_id and l.label = c.label),
n as (select answer_id, strategy, count(*) as cited, count(g.key) as right_ from docs_ d left join (select distinct qa_id, key from gold) g on g.qa_id = d.qa_id and g.key = d.key group by all),
size as (select qa_id, count(distinct key) as gold from gold group by 1)
select a.answer_id, s.strategy, coalesce(cited, 0) as cited, coalesce(right_, 0) as "right", round(coalesce(right_, 0) / nullif(coalesce(cited, 0), 0), 6) as precision, round(coalesce(right_, 0) / gold, 6) as recall
from answers a join (select distinct qa_id, strategy from labels) s on s.qa_id = a.qa_id left join size on size.qa_id = a.qa_id left join n on n.answer_id = a.answer_id and n.strategy = s.strategy"""
)
def gold_citations(spark, d):
    return gold.gold_citations(_answers(spark, d), _labels(spark, d).select("qa_id", "strategy", "label", "hit_doc"), _gold(spark, d))


@query(
    f"""with {_ANSWERS}, {_DOCS}, {_QUESTIONS}, {_LISTS}, {_LABELS}, cited as (select distinct answer_id, qa_id, unnest(citations) as label from answers where qa_id is not null),
e as (select l.qa_id, strategy, label, substr(d.text, start_index + 1, char_count) as evidence from labels l left join (select {_clean('source_doc_id')} as doc, max(text) as text from docs group by 1) d on d.doc = l.hit_doc),
h as (select answer_id, strategy, case when not {_blank('p.answer')} then coalesce(contains(evidence, p.answer), false) else false end as holds from cited c join e on e.qa_id = c.qa_id and e.label = c.label left join pairs p on p.qa_id = c.qa_id)
select answer_id, strategy, count(*) as cited, count_if(holds) as holding, round(count_if(holds) / count(*), 6) as precision, (count_if(holds) > 0)::int as recall from h group by all"""
)
def substring_citations(spark, d):
    docs = _documents(spark, d).groupBy(clean_id(F.col("source_doc_id")).alias("hit_doc")).agg(F.max("text").alias("text"))
    evidence = _labels(spark, d).join(docs, "hit_doc", "left").select("qa_id", "strategy", "label", F.substring(F.col("text"), F.col("start_index") + 1, F.col("char_count")).alias("evidence"))
    return gold.substring_citations(_answers(spark, d), evidence, _pairs(spark, d).select("qa_id", F.col("answer").alias("reference")))


@query(
    f"""with {_LISTS}, o as (select qa_id, strategy, list(coalesce(hit_doc, '') order by place) as docs from lists where place <= 10 group by all)
select a.qa_id, (a.docs = b.docs)::int as same, len(list_intersect(list_distinct(a.docs), list_distinct(b.docs)))::int as shared from o a join o b on a.qa_id = b.qa_id and a.strategy = 'child' and b.strategy = 'b4'"""
)
def same_ranking(spark, d):
    return gold.same_ranking(_lists(spark, d), "child", "b4")


@query(
    _BM25
    + """, firsts as (select distinct source_doc_id from docs order by 1 limit 10), filled as (select answer_id, source_doc_id, round(score, 9) as score from scored
union all select a.answer_id, f.source_doc_id, 0 from asked a, firsts f where not exists (select 1 from scored s where s.answer_id = a.answer_id and s.source_doc_id = f.source_doc_id))
select answer_id, source_doc_id, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by answer_id order by score desc, source_doc_id) as rank from filled) where rank <= 10"""
)
def filled_topk(spark, d):
    docs = _documents(spark, d)
    scored = cut(_best(spark, d, 10, gold.first_ids(docs, "source_doc_id", 10)))
    out = gold.filled_top(scored, _asked(spark, d), docs, "answer_id", "source_doc_id", 10)
    return out.select("answer_id", "source_doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""with {_DOCS}, {_QUESTIONS}, {_LISTS}, t as (select {_clean('source_doc_id')} as doc, max(text) as text from docs group by 1)
select hit_id, case when strategy = 'child' then l.start_index else 0 end::int as context_start, case when strategy = 'child' then l.char_count else length(t.text) end::int as context_length, l.strategy || '_parent' as mode, round(coalesce(bm25_score, score), 6) as lexical
from lists l left join t on t.doc = l.hit_doc where place <= 10"""
)
def contexts(spark, d):
    docs = _documents(spark, d).groupBy(clean_id(F.col("source_doc_id")).alias("hit_doc")).agg(F.max("text").alias("text"))
    top = _lists(spark, d).where("place <= 10").join(docs, "hit_doc", "left")
    own = F.col("strategy") == "child"
    return top.select(
        "hit_id", F.when(own, F.col("start_index")).otherwise(0).alias("context_start"), F.when(own, F.col("char_count")).otherwise(F.length("text")).alias("context_length"), F.concat("strategy", F.lit("_parent")).alias("mode"), F.round(F.coalesce("bm25_score", "score"), 6).alias("lexical")
    )


@query(f"with {_LISTS}, c as (select distinct qa_id, strategy, nullif(regexp_extract(chunk_id, '^(.+)-(?:child|b4|c)-?\\d+$', 1), '') as clause from lists where place <= 10) select qa_id, strategy, string_agg(clause, ',' order by clause) as clauses, count(clause) as n from c group by all")
def clause_ids(spark, d):
    c = _lists(spark, d).where("place <= 10").select("qa_id", "strategy", texts.clause_of(F.col("chunk_id")).alias("clause")).distinct()
    # at most ten a list
    return c.groupBy("qa_id", "strategy").agg(F.when(F.count("clause") > 0, F.array_join(F.array_sort(F.collect_list("clause")), ",")).alias("clauses"), F.count("clause").alias("n"))


@query(
    f"""with {_DOCS}, {_QUESTIONS}, {_LISTS}, o as (select l.qa_id, strategy, min(place) as first_place from lists l join questions q on q.qa_id = l.qa_id and l.hit_doc = q.doc group by all)
select l.strategy, count(*) as questions, round(avg((coalesce(first_place, 99) <= 5)::int), 6) as hit_5, round(avg((coalesce(first_place, 99) <= 1)::int), 6) as hit_1, round(avg(case when first_place <= 10 then 1.0 / first_place else 0 end), 6) as mrr_10
from (select distinct lists.qa_id, strategy from lists join questions using (qa_id) where doc is not null) l left join o using (qa_id, strategy) group by 1"""
)
def smoke_run(spark, d):
    q = _questions(spark, d).where("doc is not null").select("qa_id", "doc")
    lists = _lists(spark, d).join(q, "qa_id")
    first = lists.groupBy("qa_id", "strategy").agg(F.min(F.when(F.col("hit_doc") == F.col("doc"), F.col("place"))).alias("p"))
    share = lambda k: F.round(F.avg(F.when(F.col("p") <= k, 1).otherwise(0)), 6).alias(f"hit_{k}")
    return first.groupBy("strategy").agg(F.count(F.lit(1)).alias("questions"), share(5), share(1), F.round(F.avg(F.when(F.col("p") <= 10, 1.0 / F.col("p")).otherwise(0.0)), 6).alias("mrr_10"))


# ---- rules ----


@query(
    f"""with {_DOCS}, {_QUESTIONS}, known as (select distinct {_clean('source_doc_id')} as doc from docs), p as (select p.*, q.doc, k.doc as known from pairs p join questions q using (qa_id) left join known k on k.doc = q.doc),
r as (select count(*) as n from pairs where not {_blank('question')} group by lower(regexp_replace(question, '[\\s\\p{{Z}}]+', '', 'g')) having count(*) > 1)
select 'answer_outside' as "check", count_if(not contains(source_text, answer)) as violations from p union all select 'span_differs', count_if(substr(source_text, answer_start + 1, answer_end - answer_start) <> answer) from p
union all select 'id_in_question', count_if(coalesce(contains(lower(question), lower(qa_id)), false) or coalesce(contains(lower(question), doc), false)) from p union all select 'blank_question', count_if({_blank('question')}) from p
union all select 'unknown_document', count_if(doc is not null and known is null) from p union all select 'repeated_question', coalesce(sum(n), 0)::bigint from r"""
)
def dataset_rules(spark, d):
    pairs = _pairs(spark, d).withColumn("doc", clean_id(F.col("source_doc_id"))).withColumn("split", clean_id(F.col("split")))
    return gold.dataset_rules(pairs, _documents(spark, d).select(clean_id(F.col("source_doc_id")).alias("doc")))


@query(
    f"""with {_PARENTS}, {_CHUNKS}, c as (select c.*, p.parent_id as known, p.source_type as pt, p.evidence_role as pr, p.original_text from chunks c left join parents p using (parent_id))
select 'too_long' as "check", count_if(length(text) > 300) as violations from c union all select 'no_parent', count_if(parent_id is null) from c union all select 'orphan', count_if(parent_id is not null and known is null) from c
union all select 'other_type', count_if(known is not null and source_type <> pt) from c union all select 'other_role', count_if(known is not null and evidence_role <> pr) from c union all select 'not_in_parent', count_if(known is not null and not contains(original_text, text)) from c"""
)
def chunk_rules(spark, d):
    return gold.chunk_rules(_chunks(spark, d), _parents(spark, d), 300)


@query(f"with {_PARENTS}, {_CHUNKS} select chunk_id, c.parent_id, case when c.parent_id is null then 'no_parent' when p.parent_id is null then 'orphan' when c.source_type <> p.source_type then 'other_type' else 'ok' end as state from chunks c left join parents p on p.parent_id = c.parent_id")
def child_parents(spark, d):
    return gold.child_parents(_chunks(spark, d), _parents(spark, d))


@query(
    f"""with {_ANSWERS}, {_QUESTIONS}, plan as (select qa_id, unnest(['B0', 'B4', 'P', 'P-no-parent']) as method from pairs where review_status = 'approved'),
done as (select distinct qa_id, method from answers where not {_blank('answer')}), failed as (select qa_id, method, count(*) as failed from answers where {_blank('answer')} group by all)
select qa_id, method, coalesce(failed, 0) + 1 as attempt from plan left join failed using (qa_id, method) where not exists (select 1 from done d where d.qa_id = plan.qa_id and d.method = plan.method)"""
)
def pending_answers(spark, d):
    return gold.pending(_pairs(spark, d).where("review_status = 'approved'"), METHODS, _answers(spark, d))


@query("select thread_id, row_number() over (order by updated_at desc, thread_id)::int as place from (select lower(trim(thread_id)) as thread_id, max(updated_at) as updated_at from app_threads where thread_id is not null group by 1) qualify place <= 50")
def newest_threads(spark, d):
    t = table(spark, d, "app_threads").where("thread_id is not null").groupBy(F.lower(F.trim("thread_id")).alias("thread_id")).agg(F.max("updated_at").alias("updated_at"))
    top = t.orderBy(F.desc("updated_at"), "thread_id").limit(50)  # a report of the newest fifty
    return top.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("updated_at")).alias("at"), "thread_id"))).alias("x")).select(F.posexplode("x").alias("i", "t")).select("t.thread_id", (F.col("i") + 1).alias("place"))


@query("select lower(trim(thread_id)) as thread_id, coalesce(max(metadata->>'$.title'), '') as title, coalesce(max(metadata->>'$.lang'), 'unknown') as lang, coalesce(max(metadata->>'$.retrieval_mode'), 'unknown') as retrieval_mode from app_threads where thread_id is not null group by 1")
def log_defaults(spark, d):
    field = lambda c, default: F.coalesce(F.max(F.get_json_object("metadata", f"$.{c}")), F.lit(default)).alias(c)
    return table(spark, d, "app_threads").where("thread_id is not null").groupBy(F.lower(F.trim("thread_id")).alias("thread_id")).agg(field("title", ""), field("lang", "unknown"), field("retrieval_mode", "unknown"))


# ---- messages and runs ----

_SAID = """m as (select id, lower(trim(thread_id)) as thread_id, run_id, message_id, ordinal, type, name, tool_calls, content, received_at,
  coalesce(case lower(trim(role)) when 'user' then 'user' when 'human' then 'user' when 'assistant' then 'assistant' when 'ai' then 'assistant' end, case type when 'human' then 'user' when 'ai' then 'assistant' end) as speaker,
  case when starts_with(trim(content), '"') then content->>'$' end as text from app_messages where thread_id is not null)"""


def _said(spark, d):
    role = F.lower(F.trim("role"))
    speaker = F.coalesce(F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "ai"), "assistant"), F.when(F.col("type") == "human", "user").when(F.col("type") == "ai", "assistant"))
    m = table(spark, d, "app_messages").where("thread_id is not null")
    return m.select("id", F.lower(F.trim("thread_id")).alias("thread_id"), "run_id", "message_id", "ordinal", "type", "name", "tool_calls", "content", "received_at", speaker.alias("speaker"), runs.said(F.col("content")).alias("text"))


@query(f"with {_SAID} select thread_id, arg_min(text, {{'o': ordinal, 'i': id}}) as text from m where speaker = 'user' and not {_blank('text')} group by 1")
def first_questions(spark, d):
    return runs.first_said(_said(spark, d), "user")


@query(f"with {_SAID} select thread_id, max(ordinal) as ordinal, arg_max(text, {{'o': ordinal, 'i': id}}) as text from m where speaker = 'assistant' and not {_blank('text')} group by 1")
def last_answers(spark, d):
    return runs.last_said(_said(spark, d), "assistant")


@query(
    f"""with {_SAID}, per as (select thread_id, ordinal, run_id, count(*) as n from m group by all), b as (select *, coalesce(sum(n) over (partition by thread_id order by ordinal range between unbounded preceding and 1 preceding), 0)::bigint as before from per)
select thread_id, run_id, min(ordinal) as start, arg_min(before, ordinal) as before, sum(n)::bigint as messages from b where run_id is not null group by all"""
)
def run_slices(spark, d):
    return runs.run_slices(_said(spark, d))


@query(
    f"""with {_SAID}, s as (select distinct thread_id, ordinal as start from m where speaker = 'user' and ordinal is not null)
select thread_id, start, coalesce(lead(start) over (partition by thread_id order by start), whole) as "end" from s join (select thread_id, max(ordinal) + 1 as whole from m group by 1) using (thread_id)"""
)
def turn_blocks(spark, d):
    return runs.turn_blocks(_said(spark, d))


@query(
    f"""with {_SAID}, n as (select * from m where run_id is not null and not {_blank('text')})
select thread_id, run_id, 0 as place, 'user' as role, arg_min(text, {{'o': ordinal, 'i': id}}) as text from n where speaker = 'user' group by 1, 2 union all
select thread_id, run_id, 1, 'assistant', arg_max(text, {{'o': ordinal, 'i': id}}) from n where speaker = 'assistant' group by 1, 2"""
)
def appended_turns(spark, d):
    return runs.appended(_said(spark, d))


_CALLS = "c as (select id, thread_id, run_id, unnest(from_json(tool_calls, '[\"json\"]')) as c from m where starts_with(tool_calls, '['))"


@query(
    f"""with {_SAID}, {_CALLS}, s as (select id, c->>'$.id' as call_id, c->>'$.name' as name, coalesce(c->>'$.args.query', '') as q, coalesce(c->>'$.args.mode', 'hybrid') as mode from c)
select id, call_id, case when name = 'search_evidence' then '正在使用 ' || mode || ' 模式检索中医知识：' || q else '正在调用工具：' || name end as summary from s"""
)
def call_summaries(spark, d):
    c = runs.calls_of(_said(spark, d))
    return c.select("id", "call_id", runs.call_summary(F.col("name"), F.col("query"), F.col("mode"), "search_evidence").alias("summary"))


@query(
    f"""with {_SAID}, {_CALLS}, a as (select run_id, count(*) as calls from c where run_id is not null group by 1), r as (select run_id, count(*) as results, coalesce(string_agg(distinct name, ',' order by name), '') as tools from m where run_id is not null and type = 'tool' group by 1)
select coalesce(a.run_id, r.run_id) as run_id, coalesce(calls, 0) as calls, coalesce(results, 0) as results, coalesce(tools, '') as tools from a full join r on a.run_id = r.run_id"""
)
def trace_summaries(spark, d):
    return runs.trace_summary(_said(spark, d))


@query(f"with {_SAID} select thread_id, message_id, min(ordinal) as place, arg_max(id, {{'r': received_at, 'i': id}}) as version from m where message_id is not null group by all")
def messages_by_id(spark, d):
    return runs.added_by_id(_said(spark, d))


@query(f"with {_SAID} select name, count(*) as results, count_if(coalesce(json_type(content) = 'OBJECT' and content->>'$.type' = 'subagent_result', false)) as payloads from m where type = 'tool' group by 1")
def subagent_payloads(spark, d):
    return runs.payloads(_said(spark, d), "subagent_result")
