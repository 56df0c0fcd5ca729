"""Queries of the core over the tables of a folder, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import records
from tessera.functions.terms import chief_term, found_terms, rewrite, unsupported
from tessera.functions.text import NARROW, WIDE, clean_id, squeeze, stable_id
from tessera.operators import answers, catalog, chunking, dense, fusion, lexical, metrics, quality, ranges, reviews, sampling, stats
from tessera.operators.skew import salted_join
from tessera.plans import retrieve
from tessera.sources.tables import table
from tessera.streaming import trace

# Symptoms that are looked for in questions, and words that are searched along with them.
SYMPTOMS = ["心悸", "耳鸣", "便秘", "便溏", "呕逆", "自汗", "盗汗", "目赤", "口苦", "胁胀"]
ALIASES = {"心悸": "怔忡", "便秘": "大便难", "自汗": "汗出", "呕逆": "呕吐"}
RULES = {"risk": ["不可", "慎用", "忌"], "cause": ["何以", "为何"], "formula": ["汤", "丸", "散", "饮"], "general": [""]}


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return catalog.latest(table(spark, d, "tcm_qg_pairs"), ["qa_id"], "loaded_at")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("qa_id", clean_id(F.col("split")).alias("split"), clean_id(F.col("source_doc_id")).alias("doc"), "answer_start", "answer_end")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return fusion.ranked(fusion.distinct_hits(table(spark, d, "tcm_qg_hits"))).withColumn("hit_doc", clean_id(F.col("source_doc_id")))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return catalog.latest(table(spark, d, "formal_answers"), ["answer_id"], "loaded_at")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: answers whose id is divisible by 20, with their questions."""
    a = _answers(spark, d).where("answer_id % 20 = 0").select("answer_id", "qa_id")
    return salted_join(a, _pairs(spark, d).select("qa_id", "question"), "qa_id", F.col("answer_id"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return catalog.latest(table(spark, d, "tcm_qg_documents", "source_doc_id", "text", "loaded_at"), ["source_doc_id"], "loaded_at")


def _long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def _clean(x: str) -> str:
    edge = r"[\s\p{Z}\p{Cc}\p{Cf}]+"
    wide, narrow = WIDE, NARROW.replace("'", "''")
    return f"nullif(regexp_replace(lower(translate({x}, '{wide}', '{narrow}')), '^{edge}|{edge}$', '', 'g'), '')"


_TERMS = "list_concat(list_filter(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)), lambda x: regexp_full_match(x, '[\\x{{4e00}}-\\x{{9fff}}]{{2}}')), regexp_extract_all({0}, '[a-z0-9]+'))"
_PAIRS = "pairs as (select * from tcm_qg_pairs where qa_id is not null qualify row_number() over (partition by qa_id order by loaded_at desc) = 1)"
_QUESTIONS = f"{_PAIRS}, questions as (select qa_id, {_clean('split')} as split, {_clean('source_doc_id')} as doc, answer_start, answer_end from pairs)"
_LISTS = f"""hits0 as (select * from tcm_qg_hits where qa_id is not null and chunk_id is not null and score is not null and not isnan(score)
  qualify row_number() over (partition by qa_id, strategy, chunk_id order by hit_id) = 1),
lists as (select *, {_clean('source_doc_id')} as hit_doc, row_number() over (partition by qa_id, strategy order by score desc, chunk_id) as place from hits0)"""
_ANSWERS = "answers as (select * from formal_answers where answer_id is not null qualify row_number() over (partition by answer_id order by loaded_at desc) = 1)"
_DOCS = "docs as (select source_doc_id, text from tcm_qg_documents where source_doc_id is not null qualify row_number() over (partition by source_doc_id order by loaded_at desc) = 1)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- retrieval ----

_BM25 = f"""with {_DOCS}, {_PAIRS}, {_ANSWERS},
asked as (select a.answer_id, lower(p.question) as q from answers a join pairs p using (qa_id) where a.answer_id % 20 = 0),
dt as (select source_doc_id, {_TERMS.format('t')} as terms from (select source_doc_id, coalesce(lower(text), '') as t from docs)),
dl as (select source_doc_id, len(terms) as dl from dt),
tf as (select source_doc_id, term, count(*) as tf from (select source_doc_id, unnest(terms) as term from dt) group by all),
n as (select count(*) as n, avg(dl) as avgdl from dl),
raw as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tf, n group by term, n),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
qt as (select answer_id, {_TERMS.format('q')} as terms from asked where q is not null),
qtf as (select answer_id, term, count(*) as qtf from (select answer_id, unnest(terms) as term from qt) group by all),
scored as (select answer_id, source_doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) as score
  from qtf join idf using (term) join tf using (term) join dl using (source_doc_id), n group by all)
"""


def _best(spark: SparkSession, d: str, k: int, also: list | None = None, counted: bool = False) -> DataFrame:
    docs = _documents(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    return lexical.bm25_top_k(_asked(spark, d), docs, "answer_id", "question", "source_doc_id", {"text": 1.0}, k, also=also, counted=counted)


@query(_BM25 + "select answer_id, source_doc_id, rank, round(score, 6) as score from (select *, row_number() over (partition by answer_id order by round(score, 9) desc, source_doc_id) as rank from scored) where rank <= 10")
def bm25_topk(spark, d):
    top = lexical.top_k(_best(spark, d, 10), "answer_id", 10, F.desc(F.round("score", 9)), F.col("source_doc_id"))
    return top.select("answer_id", "source_doc_id", _long("rank"), F.round("score", 6).alias("score"))


@query(
    _BM25
    + """, few as (select * from scored qualify row_number() over (partition by answer_id order by round(score, 9) desc, source_doc_id) <= 20),
both_ as (select f.*, len(list_intersect(q.terms, t.terms)) / nullif(len(list_distinct(q.terms)), 0) as overlap from few f join qt q using (answer_id) join dt t using (source_doc_id))
select answer_id, source_doc_id, rank, round(overlap, 6) as overlap from (select *, row_number() over (partition by answer_id order by round(score + overlap, 9) desc, overlap desc, source_doc_id) as rank from both_) where rank <= 5"""
)
def bm25_overlap_rerank(spark, d):
    few = lexical.top_k(_best(spark, d, 20, counted=True), "answer_id", 20, F.desc(F.round("score", 9)), F.col("source_doc_id")).drop("rank")
    q = _asked(spark, d).select("answer_id", F.size(F.array_distinct(lexical.terms(F.col("question")))).alias("asked"))
    both = few.join(q, "answer_id").withColumn("overlap", F.col("shared") / F.col("asked"))
    top = lexical.top_k(both, "answer_id", 5, F.desc(F.round(F.col("score") + F.col("overlap"), 9)), F.desc("overlap"), F.col("source_doc_id"))
    return top.select("answer_id", "source_doc_id", _long("rank"), F.round("overlap", 6).alias("overlap"))


_COS = """with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0),
s as (select q.vec_id as query_id, v.vec_id, list_cosine_similarity(q.e, v.e) as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0)
"""


@query(_COS + "select query_id, vec_id, rank, round(score, 5) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from s) where rank <= 10")
def dense_topk(spark, d):
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    return dense.dense_top_k(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).withColumn("score", F.round("score", 5)).withColumn("rank", _long("rank"))


@query(_COS + """, t as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from s qualify rank <= 5)
select q.label as label, count(*) as n, round(avg((q.label = e.label)::int), 6) as same_label, round(avg(1 - t.score), 5) as distance from t join embeddings q on q.vec_id = t.query_id join embeddings e on e.vec_id = t.vec_id group by 1""")
def dense_distance_by_label(spark, d):
    v = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    top = dense.dense_top_k(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    labels = v.select("vec_id", "label")
    both = top.join(labels.withColumnRenamed("label", "own"), "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("own") == F.col("label")).cast("int")), 6).alias("same_label"), F.round(F.avg(1 - F.col("score")), 5).alias("distance"))


@query(f"with {_LISTS}, f as (select qa_id, chunk_id, sum(1.0::double / (60 + place)) as rrf from lists group by all) select qa_id, chunk_id, round(rrf, 9) as rrf, place from (select *, row_number() over (partition by qa_id order by round(rrf, 12) desc, chunk_id) as place from f) where place <= 10")
def rrf_fusion(spark, d):
    return fusion.reciprocal_rank_fusion(_lists(spark, d)).where("place <= 10").withColumn("rrf", F.round("rrf", 9)).withColumn("place", _long("place"))


@query(f"""with {_LISTS}, f as (select * from lists where place <= 5 and parent_id is not null qualify row_number() over (partition by qa_id, strategy, parent_id order by place) = 1)
select qa_id, strategy, parent_id, chunk_id, concat('E', row_number() over (partition by qa_id, strategy order by place)) as label from f""")
def citation_labels(spark, d):
    return fusion.citations(_lists(spark, d))


@query(f"""with {_LISTS}, {_DOCS}, one as (select qa_id, parent_id, chunk_id, score from lists where parent_id is not null qualify row_number() over (partition by qa_id, parent_id order by score desc, chunk_id, strategy) = 1),
j as (select o.*, length(d.text) as chars, row_number() over (partition by qa_id order by score desc, chunk_id) as parent_rank from one o join docs d on o.parent_id = 'tcmqg-' || d.source_doc_id)
select qa_id, parent_id, chunk_id, parent_rank, chars from j where parent_rank <= 5""")
def parent_recovery(spark, d):
    docs = _documents(spark, d).select(F.concat(F.lit("tcmqg-"), "source_doc_id").alias("parent_id"), F.length("text").alias("chars"))
    best = Window.partitionBy("qa_id").orderBy(F.desc("score"), "chunk_id", "strategy")
    hits = _lists(spark, d).where("parent_id is not null").select("qa_id", "parent_id", "chunk_id", "strategy", "score").withColumn("place", F.row_number().over(best))
    return fusion.recover_parents(hits, docs, 5).select("qa_id", "parent_id", "chunk_id", _long("parent_rank"), _long("chars"))


_FIELDS = {"original_text": 3.0, "chapter": 2.0, "section": 2.0, "book_title": 1.0}


def _field_sql() -> str:
    parts = []
    for f, b in _FIELDS.items():
        parts.append(f"""select answer_id, parent_id, {b} * sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) as score from
  (select answer_id, term, count(*) as qtf from (select answer_id, unnest({_TERMS.format('q')}) as term from asked where q is not null) group by all)
  join (select parent_id, term, count(*) as tf from (select parent_id, unnest({_TERMS.format('t')}) as term from (select parent_id, lower({f}) as t from par where {f} is not null)) group by all) using (term)
  join (select term, count(distinct parent_id) as df from (select parent_id, unnest({_TERMS.format('t')}) as term from (select parent_id, lower({f}) as t from par where {f} is not null)) group by 1) using (term)
  join (select parent_id, len({_TERMS.format('t')}) as dl from (select parent_id, lower({f}) as t from par where {f} is not null)) using (parent_id),
  (select count(*) as n, avg(len({_TERMS.format('t')})) as avgdl from (select lower({f}) as t from par where {f} is not null)) group by all""")
    return f"""with {_PAIRS}, {_ANSWERS}, asked as (select a.answer_id, lower(p.question) as q from answers a join pairs p using (qa_id) where a.answer_id % 20 = 0),
par as (select * from evidence_parents where parent_id is not null qualify row_number() over (partition by parent_id order by loaded_at desc) = 1),
s as (select answer_id, parent_id, max(score) as score from ({' union all '.join(parts)}) group by all)
select answer_id, parent_id, rank, round(score, 6) as score from (select *, row_number() over (partition by answer_id order by round(score, 9) desc, parent_id) as rank from s) where rank <= 10"""


@query(_field_sql())
def field_boost_keyword(spark, d):
    parents = catalog.latest(table(spark, d, "evidence_parents", "parent_id", *_FIELDS, "loaded_at"), ["parent_id"], "loaded_at")
    top = lexical.top_k(lexical.bm25_top_k(_asked(spark, d), parents, "answer_id", "question", "parent_id", _FIELDS, 10, server=True), "answer_id", 10, F.desc(F.round("score", 9)), F.col("parent_id"))
    return top.select("answer_id", "parent_id", _long("rank"), F.round("score", 6).alias("score"))


_MODES_SQL = f"""with {_LISTS}, c as (select qa_id, chunk_id, bm25_score as lexical, overlap_score as dense, score from lists where strategy = 'child'),
a as (select qa_id, chunk_id, lexical as base, row_number() over (partition by qa_id order by lexical desc, chunk_id) as place from c where lexical is not null and not isnan(lexical) qualify place <= 20),
b as (select qa_id, chunk_id, dense as base, row_number() over (partition by qa_id order by dense desc, chunk_id) as place from c where dense is not null and not isnan(dense) qualify place <= 20),
h0 as (select qa_id, chunk_id, sum(1.0::double / (60 + place)) as base from (select * from a union all select * from b) group by all),
h as (select *, row_number() over (partition by qa_id order by round(base, 12) desc, chunk_id) as place from h0),
l as (select 'bm25' as mode, qa_id, chunk_id, base, place from a union all select 'dense', qa_id, chunk_id, base, place from b union all select 'hybrid', qa_id, chunk_id, base, place from h),
r as (select mode || '_rerank' as mode, l.qa_id, l.chunk_id, row_number() over (partition by mode, l.qa_id order by c.score desc nulls last, base desc, l.chunk_id) as place from l left join c using (qa_id, chunk_id) where place <= 40)
select qa_id, mode, chunk_id, place from l where place <= 10 union all select qa_id, mode, chunk_id, place from r where place <= 10"""


@query(_MODES_SQL)
def retrieval_modes(spark, d):
    child = _lists(spark, d).where("strategy = 'child'")
    candidates = child.select("qa_id", "chunk_id", F.col("bm25_score").alias("lexical"), F.col("overlap_score").alias("dense"))
    scores = child.select("qa_id", "chunk_id", F.col("score").alias("rerank_score"))
    return retrieve.matrix(candidates, scores, 10).withColumn("place", _long("place"))


@query(f"""with v as (select unnest({SYMPTOMS!r}) as symptom), dt as (select doc_id, symptom_tags, {_TERMS.format('t')} as terms from (select doc_id, symptom_tags, coalesce(lower(text), '') as t from documents)),
n as (select count(*) as n, avg(len(terms)) as avgdl from dt), tf as (select doc_id, len(any_value(terms)) as dl, term, count(*) as tf from (select doc_id, terms, unnest(terms) as term from dt) group by doc_id, term),
raw as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tf, n group by term, n), idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
s as (select symptom, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) as score from v join idf on idf.term = v.symptom join tf using (term), n group by all)
select symptom, doc_id, rank, round(score, 6) as score from (select s.*, row_number() over (partition by symptom order by round(score, 9) desc, doc_id) as rank from s join dt using (doc_id) where list_contains(symptom_tags, symptom)) where rank <= 10""")
def eligible_after_scoring(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "symptom_tags")
    asked = spark.createDataFrame([(s,) for s in SYMPTOMS], "symptom string").withColumn("q", F.col("symptom"))
    scored = lexical.bm25(asked, docs, "symptom", "q", "doc_id", "text")  # statistics of all documents, the tag only afterwards
    ok = scored.join(docs.select("doc_id", "symptom_tags"), "doc_id").where(F.array_contains("symptom_tags", F.col("symptom")))
    top = lexical.top_k(ok, "symptom", 10, F.desc(F.round("score", 9)), F.col("doc_id"))
    return top.select("symptom", "doc_id", _long("rank"), F.round("score", 6).alias("score"))


# ---- metrics ----

_EACH = f"""with {_QUESTIONS}, {_LISTS}, f as (select l.qa_id, l.strategy, q.split, min(case when l.hit_doc = q.doc then place end) as pos from lists l join questions q using (qa_id) group by all),
each_ as (select qa_id, strategy, split, case when pos <= 1 then 1.0 else 0.0 end::double as recall_1, case when pos <= 5 then 1.0 else 0.0 end::double as recall_5, case when pos <= 10 then 1.0 else 0.0 end::double as recall_10,
  case when pos <= 10 then 1.0::double / pos else 0.0 end::double as mrr_10, case when pos <= 10 then 1.0::double / log2(pos + 1.0) else 0.0 end::double as ndcg_10 from f)
"""


@query(_EACH + "select qa_id, strategy, recall_1, recall_5, recall_10, round(mrr_10, 6) as mrr_10, round(ndcg_10, 6) as ndcg_10 from each_")
def ranking_metrics(spark, d):
    each = metrics.per_question(_lists(spark, d), _questions(spark, d))
    return each.select("qa_id", "strategy", "recall_1", "recall_5", "recall_10", F.round("mrr_10", 6).alias("mrr_10"), F.round("ndcg_10", 6).alias("ndcg_10"))


@query(_EACH + "select strategy, split, count(*) as n, " + ", ".join(f"round(avg({m}), 6) as {m}" for m in metrics.METRICS) + " from each_ group by grouping sets ((), (strategy), (strategy, split))")
def metric_sheet(spark, d):
    return metrics.sheet(metrics.per_question(_lists(spark, d), _questions(spark, d)))


_SPAN = f"""with {_QUESTIONS}, {_LISTS}, own as (select l.*, q.answer_start, q.answer_end, row_number() over (partition by l.qa_id, strategy order by place) as nth from lists l join questions q using (qa_id) where place <= 10 and hit_doc = doc),
f as (select qa_id, strategy, max((nth <= 5 and start_index <= answer_start and start_index + char_count >= answer_end)::int) as span_hit, max((place <= 5 and start_index <= answer_start and start_index + char_count >= answer_end)::int) as span_hit_strict from own group by all)
select qa_id, strategy, coalesce(span_hit, 0) as span_hit, coalesce(span_hit_strict, 0) as span_hit_strict from (select distinct qa_id, strategy from lists join questions using (qa_id)) left join f using (qa_id, strategy)"""


@query(_SPAN)
def span_hit(spark, d):
    return metrics.span_hits(_lists(spark, d), _questions(spark, d))


@query(f"""with {_QUESTIONS}, {_LISTS}, c as (select l.qa_id, strategy, answer_start, answer_end, greatest(start_index, answer_start) as lo, least(start_index + char_count, answer_end) as hi from lists l join questions q using (qa_id) where place <= 5 and hit_doc = doc and answer_end > answer_start),
r as (select *, max(hi) over (partition by qa_id, strategy order by lo, hi rows between unbounded preceding and 1 preceding) as reach from c where hi > lo)
select qa_id, strategy, sum(greatest(hi - greatest(coalesce(reach, lo), lo), 0))::bigint as covered, round(sum(greatest(hi - greatest(coalesce(reach, lo), lo), 0)) / max(answer_end - answer_start), 6) as coverage from r group by all""")
def span_coverage(spark, d):
    return metrics.span_coverage(_lists(spark, d), _questions(spark, d))


@query(f"""with {_LISTS} select strategy, count(*) as questions, round(avg(ok::int), 6) as traceable from
  (select qa_id, strategy, count(*) = 5 and bool_and(chunk_id is not null and parent_id is not null and char_count > 0) as ok from lists where place <= 5 group by all) group by strategy""")
def traceability(spark, d):
    each = _lists(spark, d).where("place <= 5").groupBy("qa_id", "strategy").agg(((F.count(F.lit(1)) == 5) & F.bool_and(F.col("chunk_id").isNotNull() & F.col("parent_id").isNotNull() & (F.col("char_count") > 0))).alias("ok"))
    return each.groupBy("strategy").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("traceable"))


@query("""select strategy, count(score) as n, min(score) as least, round(median(score), 6) as middle, max(score) as most from tcm_qg_hits where score is not null and not isnan(score) group by 1""")
def score_distribution(spark, d):
    ok = table(spark, d, "tcm_qg_hits", "strategy", "score").where("score is not null and not isnan(score)")
    middle = stats.quantiles(ok, ["strategy"], "score", {"middle": (0.5, "between")})
    out = ok.groupBy("strategy").agg(F.count("score").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))
    return stats.beside(out, middle, ["strategy"]).withColumn("middle", F.round("middle", 6))


@query(f"with {_ANSWERS} select method, count(latency_ms) as n, round(avg(latency_ms), 4) as mean, round(median(latency_ms), 4) as middle, quantile_disc(latency_ms, 0.95) as p95, max(latency_ms) as most from answers group by 1")
def latency_summary(spark, d):
    a = _answers(spark, d).select("method", "latency_ms")
    out = a.groupBy("method").agg(F.count("latency_ms").alias("n"), F.round(F.avg("latency_ms"), 4).alias("mean"), F.max("latency_ms").alias("most"))
    at = stats.quantiles(a, ["method"], "latency_ms", {"middle": (0.5, "between"), "p95": (0.95, "nearest")})
    return stats.beside(out, at, ["method"]).withColumn("middle", F.round("middle", 4))


# ---- answers ----

_PLAIN = r"regexp_replace(coalesce({}, ''), '[\s\p{{Z}}\p{{P}}\p{{S}}\x{{0085}}]+', '', 'g')"
_JUDGED = f"""with {_ANSWERS}, {_PAIRS}, j as (select a.answer_id, a.method, a.qa_id, {_PLAIN.format('a.answer')} as said, {_PLAIN.format('p.answer')} as reference from answers a join pairs p using (qa_id)),
ca as (select answer_id, c, count(*) as n from (select answer_id, unnest(string_split(said, '')) as c from j where said <> '') group by all),
cb as (select answer_id, c, count(*) as n from (select answer_id, unnest(string_split(reference, '')) as c from j where reference <> '') group by all),
common as (select answer_id, sum(least(ca.n, cb.n)) as common from ca join cb using (answer_id, c) group by 1),
f as (select j.*, case when length(said) = 0 and length(reference) = 0 then 1.0 else 2.0::double * coalesce(common, 0) / (length(said) + length(reference)) end as f1 from j left join common using (answer_id))
"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select("qa_id", F.col("answer").alias("reference"))
    return salted_join(_answers(spark, d).select("answer_id", "method", "qa_id", "answer", "abstain", "citations", "retrieval_supported"), p, "qa_id", F.col("answer_id"))


def _scored_answers(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d)
    return j.withColumn("f1", answers.f1_of(F.col("answer"), F.col("reference"))).withColumn("said", answers.plain(F.col("answer"))).withColumn("exact", (F.col("said") == answers.plain(F.col("reference"))).cast("int"))


@query(_JUDGED + "select answer_id, (said = reference)::int as exact, round(f1, 6) as f1 from f")
def char_f1(spark, d):
    return _scored_answers(spark, d).select("answer_id", "exact", F.round("f1", 6).alias("f1"))


@query(_JUDGED + "select method, count(*) as n, count(distinct qa_id) as questions, round(avg((said = reference)::int), 6) as exact, round(avg(f1), 6) as f1 from f group by 1")
def answer_summary(spark, d):
    return _scored_answers(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("qa_id").alias("questions"), F.round(F.avg("exact"), 6).alias("exact"), F.round(F.avg("f1"), 6).alias("f1"))


@query(_JUDGED + ", g as (select method, qa_id, (count(distinct said) = 1)::int as stable, stddev_pop(f1) as sd from f group by 1, 2) select method, count(*) as questions, round(avg(stable), 6) as stable_rate, round(avg(sd), 6) as mean_stdev from g group by 1")
def answer_stability(spark, d):
    return answers.stability(_scored_answers(spark, d))


_ROUGE = f"""with recursive {_ANSWERS}, {_PAIRS}, j as materialized (select answer_id, coalesce(a.answer, '') as a, coalesce(p.answer, '') as b from answers a join pairs p using (qa_id)),
steps as (select answer_id, a, b, 0 as i, list_transform(range(length(b)), lambda k: 0) as old from j where a <> '' and b <> ''
union all select answer_id, a, b, i + 1, list_transform(range(1, length(b) + 1), lambda k: list_max(list_transform(range(1, k + 1), lambda m: greatest(old[m], case when substr(a, i + 1, 1) = substr(b, m, 1) then 1 + case when m = 1 then 0 else old[m - 1] end else 0 end)))) from steps where i < length(a))
select j.answer_id, round(coalesce(2.0::double * s.old[length(s.b)] / (length(s.a) + length(s.b)), 0), 6) as rouge_l from j left join steps s on s.answer_id = j.answer_id and s.i = length(s.a)"""


@query(_ROUGE)
def rouge_l(spark, d):
    return _judged(spark, d).select("answer_id", F.round(answers.rouge_l("answer", "reference"), 6).alias("rouge_l"))


@query(f"with {_ANSWERS} select method, count(*) as n, round(avg((abstain = (not retrieval_supported))::int), 6) as refusal_accuracy, round(avg((not abstain)::int), 6) as response_rate, round(avg((not abstain and not retrieval_supported)::int), 6) as unsupported_rate from answers group by 1")
def refusal_metrics(spark, d):
    a = _answers(spark, d)
    return a.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("abstain") == ~F.col("retrieval_supported")).cast("int")), 6).alias("refusal_accuracy"), F.round(F.avg((~F.col("abstain")).cast("int")), 6).alias("response_rate"), F.round(F.avg((~F.col("abstain") & ~F.col("retrieval_supported")).cast("int")), 6).alias("unsupported_rate"))


@query(f"""with {_ANSWERS}, {_QUESTIONS}, {_LISTS}, k as (select * from lists where strategy = 'child' and place <= 5 and parent_id is not null qualify row_number() over (partition by qa_id, parent_id order by place) = 1),
labels as (select qa_id, hit_doc, concat('E', row_number() over (partition by qa_id order by place)) as label from k),
c as (select a.answer_id, a.qa_id, q.doc, unnest(list_distinct(a.citations)) as label from answers a join questions q using (qa_id)),
g as (select answer_id, count(*) as n, count(*) filter (where hit_doc = doc) as good from c left join labels using (qa_id, label) group by 1)
select answer_id, round(good / n, 6) as precision, case when good > 0 then 1.0 else 0.0 end::double as recall from (select answer_id from answers join questions using (qa_id)) left join g using (answer_id)""")
def citation_metrics(spark, d):
    child = _lists(spark, d).where("strategy = 'child'")
    labels = fusion.citations(child).join(child.select("qa_id", "chunk_id", "hit_doc"), ["qa_id", "chunk_id"]).select("qa_id", "strategy", "label", "hit_doc")
    cited = salted_join(_answers(spark, d).select("answer_id", "qa_id", "citations"), _questions(spark, d).select("qa_id", "doc"), "qa_id", F.col("answer_id")).withColumn("strategy", F.lit("child"))
    return answers.citation_scores(cited, labels).withColumn("precision", F.round("precision", 6))


@query(f"with {_PAIRS}, {_LISTS} select l.qa_id, strategy, max((p.answer <> '' and contains(p.source_text, p.answer) and l.start_index <= p.answer_start and l.start_index + l.char_count >= p.answer_end)::int) as answered from lists l join pairs p using (qa_id) where place <= 5 group by all")
def proxy_answer(spark, d):
    p = _pairs(spark, d).select("qa_id", "answer", "source_text", "answer_start", "answer_end")
    ok = (F.col("answer") != "") & F.contains("source_text", "answer") & (F.col("start_index") <= F.col("answer_start")) & (F.col("start_index") + F.col("char_count") >= F.col("answer_end"))
    return _lists(spark, d).where("place <= 5").join(p, "qa_id").groupBy("qa_id", "strategy").agg(F.max(ok.cast("int")).alias("answered"))


# ---- statistics ----


@query(f"with {_ANSWERS}, p as (select abstain::varchar as a, (not retrieval_supported)::varchar as b from answers where abstain is not null and retrieval_supported is not null), o as (select count(*) as n, avg((a = b)::int) as o from p), l as (select a as v, count(*) as x from p group by 1), r as (select b as v, count(*) as y from p group by 1), e as (select coalesce(sum(x * y), 0) as s from l join r using (v)) select n, round(o, 6) as observed, round(s / (n * n), 6) as expected, round(case when s / (n * n) = 1 then 1 else (o - s / (n * n)) / (1 - s / (n * n)) end, 6) as kappa from o, e")
def cohen_kappa(spark, d):
    return stats.kappa(_answers(spark, d).select("abstain", (~F.col("retrieval_supported")).alias("unsupported")), "abstain", "unsupported")


@query(f"""with {_QUESTIONS}, {_LISTS}, r as (select score as s, hit_doc = doc as good from lists join questions using (qa_id) where place = 1 and doc is not null and hit_doc is not null),
v as (select s, count(*) filter (where good) as g, count(*) filter (where not good) as b from r group by 1),
c as (select s, sum(g) over (order by s desc) as pg, sum(b) over (order by s desc) as pb, sum(g) over () as tg, sum(b) over () as tb, lead(s) over (order by s) as up from v),
x as (select s as t, (pg / tg + (tb - pb) / tb) / 2 as ba from c union all select (c.s + c.up) / 2, (u.pg / u.tg + (u.tb - u.pb) / u.tb) / 2 from c join c u on u.s = c.up)
select round(t, 6) as threshold, round(ba, 6) as balanced_accuracy from x order by round(ba, 9) desc, t desc limit 1""")
def calibrate_threshold(spark, d):
    r = _lists(spark, d).where("place = 1").join(_questions(spark, d), "qa_id").where("doc is not null and hit_doc is not null")
    return stats.calibrate(r.select("score", (F.col("hit_doc") == F.col("doc")).alias("good")), "score", "good")


# as in every production configuration of the reference (bootstrap_resamples)
_RESAMPLES = 10_000


@query(_EACH.rstrip() + f""", p as (select q.doc, a.mrr_10 - b.mrr_10 as delta from each_ a join each_ b using (qa_id) join questions q using (qa_id) where a.strategy = 'child' and b.strategy = 'b4' and q.doc is not null),
c as (select doc, sum(delta) as s, count(delta) as c, row_number() over (order by sha256('boot:' || doc), doc) - 1 as i from p group by 1), n as (select count(*) as n from c),
d as (select r, ('0x' || substr(sha256('boot:' || r || ':' || k), 1, 12))::bigint % n as i from n, range({_RESAMPLES}) t(r), range(n) u(k)),
m as (select r, sum(s) / sum(c) as m from d join c using (i) group by 1), o as (select m, row_number() over (order by round(m, 12), r) - 1 as k from m)
select (select n from n) as n, round((select sum(s) / sum(c) from c), 6) as delta, round((select m from o where k = {int(0.025 * _RESAMPLES)}), 6) as lower, round((select m from o where k = {int(0.975 * _RESAMPLES) - 1}), 6) as upper""")
def cluster_bootstrap(spark, d):
    q = _questions(spark, d)
    each = metrics.per_question(_lists(spark, d), q)
    a, b = (each.where(F.col("strategy") == s).select("qa_id", F.col("mrr_10").alias(s)) for s in ("child", "b4"))
    delta = a.join(b, "qa_id").join(q.select("qa_id", "doc"), "qa_id").where("doc is not null").select("doc", (F.col("child") - F.col("b4")).alias("delta"))
    return stats.cluster_bootstrap(delta, "doc", "delta", _RESAMPLES, "boot")


@query("select lang, source, count(*) as n, sum(n_chars)::bigint as chars from documents group by rollup (lang, source)")
def tag_rollup(spark, d):
    return table(spark, d, "documents", "lang", "source", "n_chars").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("select tag, count(*) as n from (select unnest(symptom_tags) as tag from documents) group by 1")
def symptom_counts(spark, d):
    return table(spark, d, "documents", "symptom_tags").select(F.explode("symptom_tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


# ---- chunks ----

_WIN = "select doc_id, '{s}' as strategy, k as chunk_no, k * {step} as start_index, least({size}, length(text) - k * {step}) as char_count, md5(substr(text, k * {step} + 1, {size})) as digest from (select doc_id, text, unnest(range(0, greatest(ceil((length(text) - {size})::double / {step}), 0)::bigint + 1)) as k from documents where length(text) > 0)"


def _windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    both = chunking.windows(docs, "doc_id", "text", 500, 420, "b4").unionByName(chunking.windows(docs, "doc_id", "text", 160, 120, "child"))
    return both.select("doc_id", "strategy", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start_index").cast("long").alias("start_index"), F.col("char_count").cast("long").alias("char_count"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


_WINDOWS = _WIN.format(s="b4", size=500, step=420) + " union all " + _WIN.format(s="child", size=160, step=120)


@query(_WINDOWS)
def window_chunks(spark, d):
    return _windows(spark, d)


@query(f"with w as ({_WINDOWS}) select strategy, count(*) as n, round(avg(char_count), 6) as mean, median(char_count)::double as median, quantile_disc(char_count, 0.95) as p95, min(char_count) as least, max(char_count) as most, round(avg((char_count < 100)::int), 6) as below_100, round(avg((char_count > 500)::int), 6) as above_500 from w group by 1")
def chunk_stats(spark, d):
    return stats.length_report(_windows(spark, d), ["strategy"], "char_count").withColumn("p95", _long("p95"))


@query("select doc_id, len(s) as sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) as longest from (select doc_id, list_filter(regexp_extract_all(text, '[^。！？!?；;\\n]*[。！？!?；;\\n]+|[^。！？!?；;\\n]+'), lambda x: not regexp_full_match(x, '[\\s\\p{Z}]*')) as s from documents where text is not null)")
def sentence_split(spark, d):
    s = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", chunking.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


@query()
def recursive_chunks(spark, d):
    return chunking.recursive_chunks(table(spark, d, "documents"), "doc_id", "text", 500, 50)


@query()
def parent_child_chunks(spark, d):
    return chunking.parents_and_children(catalog.latest(table(spark, d, "evidence_parents", "parent_id", "original_text", "loaded_at"), ["parent_id"], "loaded_at"), "parent_id", "original_text")


@query(r"select doc_id, regexp_extract(text, '^<篇名>([^\n\r]*)', 1) as title, length(regexp_replace(text, '^<篇名>[^\n\r]*', '')) as body_chars from documents where text like '<篇名>%'")
def tagged_sections(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").where(F.col("text").startswith("<篇名>"))
    return docs.select("doc_id", F.regexp_extract("text", r"^<篇名>([^\n\r]*)", 1).alias("title"), F.length(F.regexp_replace("text", r"^<篇名>[^\n\r]*", "")).cast("long").alias("body_chars"))



@query(f"""with w as ({_WINDOWS}), a as (select doc_id, chunk_no, start_index as s, start_index + char_count as e from w where strategy = 'b4'), b as (select doc_id, chunk_no, start_index as s, start_index + char_count as e from w where strategy = 'child')
select a.doc_id, a.chunk_no, count(*) as children, min(b.chunk_no) as first_child, max(b.chunk_no) as last_child from a join b on a.doc_id = b.doc_id and b.s < a.e and b.e > a.s group by all""")
def chunk_span_sources(spark, d):
    w = _windows(spark, d).withColumn("end", F.col("start_index") + F.col("char_count"))
    a = w.where("strategy = 'b4'").select("doc_id", "chunk_no", F.col("start_index").alias("a_start"), F.col("end").alias("a_end"))
    b = w.where("strategy = 'child'").select("doc_id", F.col("chunk_no").alias("child"), F.col("start_index").alias("b_start"), F.col("end").alias("b_end"))
    both = ranges.overlapping(a, b, "doc_id")
    return both.groupBy("doc_id", "chunk_no").agg(F.count(F.lit(1)).alias("children"), F.min("child").alias("first_child"), F.max("child").alias("last_child"))


@query("select key, count(*) as n from (select unnest(json_keys(props)) as key from events where props is not null) group by 1")
def json_props(spark, d):
    keys = table(spark, d, "events", "props").where("props is not null").select(F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("select id, case lower(trim(type)) when 'human' then 'user' when 'ai' then 'assistant' else lower(trim(type)) end as speaker, count(*) as n from app_messages where type is not null group by all")
def message_roles(spark, d):
    return table(spark, d, "app_messages", "id", "type").where("type is not null").groupBy("id", records.message_role(F.col("type")).alias("speaker")).agg(F.count(F.lit(1)).alias("n"))


# ---- sampling ----


@query(f"with {_QUESTIONS}, i as (select distinct doc from questions where doc is not null), r as (select doc, row_number() over (order by sha256('split:' || doc), doc) as pos, count(*) over () as n from i) select doc, case when pos <= round_even(n * 0.1::double, 0) then 'dev' when pos <= round_even(n * 0.1::double, 0) + round_even(n * 0.15::double, 0) then 'test' else 'train_pool' end as split from r")
def doc_split(spark, d):
    return sampling.share_split(_questions(spark, d), "doc", 0.1, 0.15, "split")


@query(f"with {_QUESTIONS} select qa_id, split, drawn from (select *, row_number() over (partition by split order by sha256('s7:' || split || ':' || qa_id), qa_id) as drawn from questions where split is not null) where drawn <= 20")
def stable_sample(spark, d):
    return sampling.stable_sample(_questions(spark, d).where("split is not null").select("qa_id", "split"), ["split"], "qa_id", 20, "s7").select("qa_id", "split", _long("drawn"))


@query(f"with {_QUESTIONS}, t as (select *, row_number() over (partition by doc order by sha256('rr:' || doc || ':' || qa_id), qa_id) as turn from questions where doc is not null) select qa_id, doc, turn, n from (select *, row_number() over (order by turn, sha256('rr:' || doc), doc) as n from t) where n <= 40")
def round_robin_sample(spark, d):
    return sampling.round_robin(_questions(spark, d).where("doc is not null").select("qa_id", "doc"), "doc", "qa_id", 40, "rr").select("qa_id", "doc", _long("turn"), _long("n"))


@query(f"with {_QUESTIONS} select qa_id, split, case when (row_number() over (partition by split order by sha256('alt:' || qa_id), qa_id) - 1) % 2 = 0 then 'dev' else 'test' end as side from questions where split is not null")
def alternating_split(spark, d):
    return sampling.alternate(_questions(spark, d).where("split is not null").select("qa_id", "split"), ["split"], "qa_id", "alt")


@query(f"with {_ANSWERS} select answer_id, qa_id, method, chr((64 + row_number() over (partition by qa_id order by sha256('blind:' || qa_id || ':' || method), method))::int) as letter from (select * from answers where repeat_index = 0 and qa_id is not null qualify row_number() over (partition by qa_id, method order by answer_id) = 1)")
def blind_sample(spark, d):
    one = Window.partitionBy("qa_id", "method").orderBy("answer_id")
    a = _answers(spark, d).where("repeat_index = 0 and qa_id is not null").withColumn("i", F.row_number().over(one)).where("i = 1")
    return sampling.blind_labels(a.select("answer_id", "qa_id", "method"), "qa_id", "method", "blind")


# ---- quality ----


@query(f"""with {_PAIRS} select 'parents_exported_again' as "check", count(*) - count(distinct parent_id) as violations from evidence_parents
union all select 'chunks_without_parent', count(*) from (select distinct chunk_id, parent_id from retrieval_chunks where parent_id is not null) c where not exists (select 1 from evidence_parents p where p.parent_id = c.parent_id)
union all select 'chunks_without_text', count(*) from retrieval_chunks where text is null
union all select 'chunks_too_long', count(*) from retrieval_chunks where length(text) > 300
union all select 'hash_not_of_text', count(*) from evidence_parents where original_text is not null and upper(sha256(original_text)) is distinct from upper(source_hash)
union all select 'answer_not_at_its_place', count(*) from pairs where substr(source_text, answer_start + 1, answer_end - answer_start) is distinct from answer
union all select 'length_not_of_text', count(*) from documents where length(text) is distinct from n_chars""")
def dq_doctor(spark, d):
    parents = table(spark, d, "evidence_parents", "parent_id", "original_text", "source_hash")
    chunks, docs = table(spark, d, "retrieval_chunks", "chunk_id", "parent_id", "text"), table(spark, d, "documents", "text", "n_chars")
    at = F.substring("source_text", F.col("answer_start") + 1, F.col("answer_end") - F.col("answer_start"))
    # each table is read once for all rules on single rows
    one = [
        quality.counts(parents, hash_not_of_text=F.col("original_text").isNotNull() & ~F.upper(F.sha2("original_text", 256)).eqNullSafe(F.upper("source_hash"))),
        quality.counts(chunks, chunks_without_text=F.col("text").isNull(), chunks_too_long=F.length("text") > 300),
        quality.counts(_pairs(spark, d), answer_not_at_its_place=~at.eqNullSafe(F.col("answer"))),
        quality.counts(docs, length_not_of_text=~F.length("text").cast("long").eqNullSafe(F.col("n_chars"))),
        parents.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.when(F.col("parent_id").isNotNull(), F.col("n") - 1).otherwise(F.col("n"))).alias("violations")).select(F.lit("parents_exported_again").alias("check"), F.coalesce("violations", F.lit(0)).alias("violations")),
    ]
    orphans = quality.checks(("chunks_without_parent", quality.orphans(chunks.select("chunk_id", "parent_id").distinct(), parents, "parent_id")))
    return reduce(DataFrame.unionByName, one, orphans)


@query("select 'tcm_qg_pairs' as source, (count(*) - count(distinct qa_id))::bigint as surplus from tcm_qg_pairs union all select 'formal_answers', (count(*) - count(distinct answer_id))::bigint from formal_answers")
def duplicate_surplus(spark, d):
    one = lambda t, k: quality.duplicate_surplus(table(spark, d, t, k), k).select(F.lit(t).alias("source"), F.col("surplus").cast("long").alias("surplus"))
    return one("tcm_qg_pairs", "qa_id").unionByName(one("formal_answers", "answer_id"))


@query(f"with {_QUESTIONS}, h as (select distinct qa_id from tcm_qg_hits where qa_id is not null) select qa_id, 'left' as side from h where qa_id not in (select qa_id from questions) union all select qa_id, 'right' from questions where qa_id not in (select qa_id from h)")
def set_difference(spark, d):
    return quality.set_difference(table(spark, d, "tcm_qg_hits", "qa_id"), _questions(spark, d), "qa_id")


@query(f"with {_QUESTIONS} select doc, count(distinct split) as splits, min(split) as one, max(split) as other from questions where doc is not null and split is not null group by 1 having count(distinct split) > 1")
def split_leakage(spark, d):
    q = _questions(spark, d).where("doc is not null and split is not null")
    return q.groupBy("doc").agg(F.countDistinct("split").alias("splits"), F.min("split").alias("one"), F.max("split").alias("other")).where("splits > 1")


@query("select count(*) as vectors, count(*) filter (where embedding is null or len(embedding) = 0) as unsound, min(len(embedding)) as least, max(len(embedding)) as most from embeddings")
def dq_vectors(spark, d):
    v = table(spark, d, "embeddings", "embedding")
    return v.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(quality.unsound_vector(F.col("embedding"))).alias("unsound"), F.min(F.size("embedding")).cast("long").alias("least"), F.max(F.size("embedding")).cast("long").alias("most"))



@query(f"""with {_QUESTIONS}, p as (select q.doc, p.answer_start, p.question, p.answer, p.review_status, p.qa_id, p.loaded_at from pairs p join questions q using (qa_id) where q.doc is not null),
o as (select doc, answer_start, count(*) as n, min(question) as question, min(answer) as answer, min(review_status) as review_status from p where loaded_at < timestamptz '2025-10-01 00:00:00+00' group by 1, 2),
w as (select *, count(*) over (partition by doc, answer_start) as m from p)
select w.qa_id, case when o.n is null then 'added' when o.n > 1 or w.m > 1 then 'ambiguous' when w.question is not distinct from o.question and w.answer is not distinct from o.answer then 'inherited' else 'changed' end as outcome,
  case when o.n = 1 and w.m = 1 and w.question is not distinct from o.question and w.answer is not distinct from o.answer then o.review_status end as review_status from w left join o using (doc, answer_start)""")
def review_migration(spark, d):
    p = _pairs(spark, d).withColumn("doc", clean_id(F.col("source_doc_id"))).where("doc is not null").select("qa_id", "doc", "answer_start", "question", "answer", "review_status", "loaded_at")
    earlier = p.where("loaded_at < timestamp '2025-10-01 00:00:00'").drop("qa_id")  # the round of that day
    return reviews.migrate(earlier, p, ["doc", "answer_start"], ["question", "answer"], ["review_status"]).select("qa_id", "outcome", "review_status")


@query(f"""with {_PAIRS}, e as (select * from tcm_qg_pairs where qa_id is not null qualify row_number() over (partition by qa_id order by loaded_at) = 1)
select e.qa_id, 'answer' as "column" from e join pairs p using (qa_id) where e.answer is distinct from p.answer union all select e.qa_id, 'question' from e join pairs p using (qa_id) where e.question is distinct from p.question""")
def altered_cells(spark, d):
    first = Window.partitionBy("qa_id").orderBy("loaded_at")
    earliest = table(spark, d, "tcm_qg_pairs").where("qa_id is not null").withColumn("i", F.row_number().over(first)).where("i = 1")
    return reviews.altered(earliest, _pairs(spark, d), "qa_id", ["answer", "question"])


@query(_EACH + """, m as (select avg(recall_5) as recall_5, avg(mrr_10) as mrr_10, avg(ndcg_10) as ndcg_10 from each_ where strategy = 'child')
select 'recall_5' as rule, recall_5 as value, recall_5 >= 0.3 as passed from m union all select 'mrr_10', mrr_10, mrr_10 > 0.5 from m union all select 'ndcg_10', ndcg_10, ndcg_10 <= 1 from m""".replace("recall_5 as value", "round(recall_5, 6) as value").replace("'mrr_10', mrr_10,", "'mrr_10', round(mrr_10, 6),").replace("'ndcg_10', ndcg_10,", "'ndcg_10', round(ndcg_10, 6),"))
def success_gate(spark, d):
    each = metrics.per_question(_lists(spark, d), _questions(spark, d)).where("strategy = 'child'")
    figures = each.agg(*[F.avg(m).alias(m) for m in ("recall_5", "mrr_10", "ndcg_10")])
    return reviews.gate(figures, {"recall_5": (">=", 0.3), "mrr_10": (">", 0.5), "ndcg_10": ("<=", 1.0)}).withColumn("value", F.round("value", 6))


@query(f"with {_QUESTIONS}, g as (select split, count(*) as got from questions where split is not null group by 1), w as (select split, round_even(share * (select sum(got) from g), 0)::bigint as wanted from split_plan) select split, coalesce(wanted, 0) as wanted, coalesce(got, 0) as got from w full join g using (split) where coalesce(wanted, 0) <> coalesce(got, 0)")
def quota_gaps(spark, d):
    q = _questions(spark, d).where("split is not null")
    total = q.agg(F.count(F.lit(1)).alias("total")).withColumn("k", F.lit(1))
    plan = table(spark, d, "split_plan").withColumn("k", F.lit(1)).join(F.broadcast(total), "k").select("split", F.bround(F.col("share") * F.col("total")).cast("long").alias("wanted"))
    return reviews.quota_gaps(q, plan, ["split"])


# ---- ids, order, latest rows ----


@query("select doc_id, 'doc-' || substr(sha256(concat_ws(chr(0), coalesce(source, ''), coalesce(section, ''), coalesce(text, ''), n::varchar)), 1, 24) as stable, n from (select *, row_number() over (partition by source, section, text order by doc_id) - 1 as n from documents)")
def stable_ids(spark, d):
    w = Window.partitionBy("source", "section", "text").orderBy("doc_id")
    docs = table(spark, d, "documents", "doc_id", "source", "section", "text").withColumn("n", F.row_number().over(w) - 1)
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("source", "section", "text")]
    return docs.select("doc_id", stable_id("doc", *parts, F.col("n").cast("string")).alias("stable"), F.col("n").cast("long").alias("n"))


@query(f"with {_QUESTIONS}, o as (select qa_id, doc, answer_start, lead(qa_id) over w as following, floor((row_number() over w - 1) / 2)::bigint as pair_no from questions where doc is not null window w as (partition by doc order by answer_start, qa_id)) select * from o")
def adjacent_pairs(spark, d):
    w = Window.partitionBy("doc").orderBy("answer_start", "qa_id")
    q = _questions(spark, d).where("doc is not null")
    return q.select("qa_id", "doc", "answer_start", F.lead("qa_id").over(w).alias("following"), F.floor((F.row_number().over(w) - 1) / 2).alias("pair_no"))


@query("select chunk_id, parent_id, book_title, chapter, md5(text) as digest from (select * from retrieval_chunks where text is not null and chunk_id is not null qualify row_number() over (partition by chunk_id order by loaded_at desc) = 1) c join (select parent_id, book_title, chapter from evidence_parents where parent_id is not null qualify row_number() over (partition by parent_id order by loaded_at desc) = 1) p using (parent_id)")
def denormalize(spark, d):
    chunks = catalog.latest(table(spark, d, "retrieval_chunks"), ["chunk_id"], "loaded_at")
    parents = catalog.latest(table(spark, d, "evidence_parents"), ["parent_id"], "loaded_at")
    return catalog.denormalize(chunks, parents).select("chunk_id", "parent_id", "book_title", "chapter", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""with o as (select * from app_threads where thread_id is not null qualify row_number() over (partition by thread_id order by updated_at) = 1), n as (select * from app_threads where thread_id is not null qualify row_number() over (partition by thread_id order by updated_at desc) = 1)
select o.thread_id, n.status, epoch_us(o.created_at) as created_us, epoch_us(n.updated_at) as updated_us from o join n using (thread_id)""")
def upsert_threads(spark, d):
    t = table(spark, d, "app_threads").where("thread_id is not null")
    ends = lambda order: t.withColumn("i", F.row_number().over(Window.partitionBy("thread_id").orderBy(order))).where("i = 1").drop("i")
    merged = catalog.upsert(ends(F.col("updated_at")), ends(F.desc("updated_at")), ["thread_id"], ["status", "updated_at", "metadata"])
    return merged.select("thread_id", "status", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"))


# ---- terms ----


@query(f"""with {_PAIRS}, v as (select unnest({SYMPTOMS!r}) as term, unnest(range({len(SYMPTOMS)})) as i), f as (select qa_id, list(term order by length(term) desc, i) as terms from pairs join v on contains(question, term) group by 1)
select p.qa_id, coalesce(array_to_string(f.terms, ','), '') as terms, f.terms[1] as chief from pairs p left join f using (qa_id)""")
def term_extract(spark, d):
    p = _pairs(spark, d)
    return p.select("qa_id", F.array_join(found_terms(F.col("question"), SYMPTOMS), ",").alias("terms"), chief_term(F.col("question"), SYMPTOMS).alias("chief"))


@query(f"""with {_PAIRS} select qa_id, trim(question, ' ') || case """ + " ".join(f"when contains(question, '{k}') then ' {v}'" for k, v in ((s, ALIASES[s]) for s in SYMPTOMS if s in ALIASES)) + " else '' end as rewritten from pairs where question is not null and trim(question, ' ') <> ''")
def rewrite_query(spark, d):
    first = chief_term(F.col("question"), [s for s in SYMPTOMS if s in ALIASES])
    alias = F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), first)
    p = _pairs(spark, d).where("question is not null and trim(question) <> ''")
    return p.select("qa_id", rewrite(F.col("question"), F.when(alias.isNotNull(), F.array(alias))).alias("rewritten"))


@query(f"""with {_ANSWERS}, {_PAIRS}, v as (select unnest({SYMPTOMS!r}) as term), a as (select answer_id, term from answers join v on contains(answer, term)), q as (select x.answer_id, term from answers x join pairs p using (qa_id) join v on contains(p.question, term)),
n as (select answer_id, count(*) as allowed from q group by 1), u as (select answer_id, count(*) as c from a where (answer_id, term) not in (select answer_id, term from q) group by 1)
select x.answer_id, case when coalesce(n.allowed, 0) = 0 then 0 else coalesce(u.c, 0) end as unsupported from answers x join pairs p using (qa_id) left join n using (answer_id) left join u using (answer_id)""")
def validate_terms(spark, d):
    j = salted_join(_answers(spark, d).select("answer_id", "qa_id", "answer"), _pairs(spark, d).select("qa_id", "question"), "qa_id", F.col("answer_id"))
    return j.select("answer_id", F.size(unsupported(found_terms(F.col("answer"), SYMPTOMS), found_terms(F.col("question"), SYMPTOMS))).cast("long").alias("unsupported"))


@query(f"with {_PAIRS} select qa_id, case " + " ".join("when " + " or ".join(f"contains(question, '{w}')" for w in ws) + f" then '{k}'" for k, ws in RULES.items()) + " end as signal from pairs")
def rule_signals(spark, d):
    rule = None
    for name, words in RULES.items():
        hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("question", w))
        rule = F.when(hit, name) if rule is None else rule.when(hit, name)
    return _pairs(spark, d).select("qa_id", rule.alias("signal"))


@query(r"select doc_id, md5(trim(regexp_replace(text, '[\s\p{Z}\x{000B}\x{0085}]+', ' ', 'g'), ' ')) as digest from documents where text is not null")
def squeezed(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.md5(squeeze(F.col("text")).cast("binary")).alias("digest"))


# ---- messages and events ----

_TYPE = "lower(trim(type))"


@query(f"""select thread, count(*) as visible_messages, max(ordinal) as last_ordinal from (select lower(trim(thread_id)) as thread, * from app_messages) where {_TYPE} in ('human', 'ai') and content not in ('null', '""', '[]') and (tool_calls is null or tool_calls in ('null', '[]')) group by 1""")
def visible_messages(spark, d):
    m = table(spark, d, "app_messages").withColumn("thread", F.lower(F.trim("thread_id")))
    ok = m.where("lower(trim(type)) in ('human', 'ai') and content not in ('null', '\"\"', '[]') and (tool_calls is null or tool_calls in ('null', '[]'))")
    return ok.groupBy("thread").agg(F.count(F.lit(1)).alias("visible_messages"), F.max("ordinal").alias("last_ordinal"))


@query("select run_id, event_key, event from (select run_id, 'tool_call:' || (c->>'id') || ':' || (c->>'name') as event_key, 'tool_call' as event from (select run_id, unnest(from_json(tool_calls, '[\"json\"]')) as c from app_messages where tool_calls is not null and tool_calls <> 'null') union all select run_id, 'tool_result:' || coalesce(name, '') || ':' || substr(md5(substr(content, 1, 500)), 1, 8), 'tool_result' from app_messages where lower(trim(type)) = 'tool') group by all")
def trace_dedup(spark, d):
    return trace.distinct_events(table(spark, d, "app_messages", "run_id", "thread_id", "ordinal", "tool_calls", "type", "content", "name")).select("run_id", "event_key", "event")


@query("select thread_id, status from (select thread_id, status, row_number() over (partition by thread_id order by updated_at desc, status desc) as i from app_threads where thread_id is not null and status is not null) where i = 1")
def run_state(spark, d):
    return catalog.latest(table(spark, d, "app_threads", "thread_id", "status", "updated_at"), ["thread_id"], "updated_at").where("status is not null").select("thread_id", "status")


@query("select event_type, count(*) as n, round(sum(value), 4) as total, count(distinct user_id) as users from events group by 1")
def event_totals(spark, d):
    return table(spark, d, "events", "event_type", "value", "user_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("users"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import_module("tessera.record_queries")  # adds its own and those of evidence_queries
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    import_module("tessera.record_queries")
    return dict(SQL)
