"""Ranking metrics over hits: recall, reciprocal rank, gain, coverage of answer spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_question(lists: DataFrame, questions: DataFrame) -> DataFrame:
    """(qa_id, strategy, split, recall_1, recall_5, recall_10, mrr_10, ndcg_10): a hit of the question's own document counts.

    ``lists`` (qa_id, strategy, place, hit_doc), ``questions`` (qa_id, split, doc). The document is one relevant thing, so
    only its first hit gains.
    """
    first = lists.join(questions, "qa_id").groupBy("qa_id", "strategy", "split").agg(F.min(F.when(F.col("hit_doc") == F.col("doc"), F.col("place"))).alias("at"))
    inside = lambda k: F.when(F.col("at") <= k, 1.0).otherwise(0.0)
    return first.select(
        "qa_id", "strategy", "split", inside(1).alias("recall_1"), inside(5).alias("recall_5"), inside(10).alias("recall_10"),
        F.when(F.col("at") <= 10, 1.0 / F.col("at")).otherwise(0.0).alias("mrr_10"),
        F.when(F.col("at") <= 10, 1.0 / F.log2(F.col("at") + 1.0)).otherwise(0.0).alias("ndcg_10"),
    )


METRICS = ("recall_1", "recall_5", "recall_10", "mrr_10", "ndcg_10")


def sheet(each: DataFrame) -> DataFrame:
    """Means by strategy, by strategy and split, and in all, by grouping sets; null stands for "all"."""
    by = F.col("strategy"), F.col("split")
    sets = each.groupingSets([[], [by[0]], list(by)], *by)
    return sets.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def graded_ndcg(hits: DataFrame, relevance: DataFrame, k: int = 10) -> DataFrame:
    """(qa_id, ndcg) for hits (qa_id, place, keys array) and graded relevance (qa_id, key, rel).

    A key gains only at its first place, a hit gains the greatest relevance among its new keys; the ideal counts every key
    by itself, so a perfect list may stay below 1 where one hit has several keys. Questions without hits get 0.
    """
    each = hits.where(F.col("place") <= k).select("qa_id", "place", F.explode("keys").alias("key")).join(relevance, ["qa_id", "key"])
    first = each.groupBy("qa_id", "key").agg(F.min("place").alias("place"), F.max("rel").alias("rel"))
    gain = first.groupBy("qa_id", "place").agg(F.max("rel").alias("rel"))
    dcg = gain.groupBy("qa_id").agg(F.sum((F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("place") + 1.0)).alias("dcg"))
    w = Window.partitionBy("qa_id").orderBy(F.desc("rel"), "key")
    ideal = relevance.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).groupBy("qa_id").agg(F.sum((F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("i") + 1.0)).alias("idcg"))
    return ideal.join(dcg, "qa_id", "left").select("qa_id", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def span_hits(lists: DataFrame, questions: DataFrame, top: int = 5, of: int = 10) -> DataFrame:
    """(qa_id, strategy, span_hit, span_hit_strict): whether a context holds the whole answer span.

    ``span_hit`` looks at the first ``top`` hits of the question's document among the first ``of`` hits, as the published
    figures do; ``span_hit_strict`` at hits of that document among the first ``top``.
    """
    own = lists.where(F.col("place") <= of).join(questions, "qa_id").where("hit_doc = doc")
    w = Window.partitionBy("qa_id", "strategy").orderBy("place")
    own = own.withColumn("nth", F.row_number().over(w))
    holds = (F.col("start_index") <= F.col("answer_start")) & (F.col("start_index") + F.col("char_count") >= F.col("answer_end"))
    found = own.groupBy("qa_id", "strategy").agg(F.max(F.when((F.col("nth") <= top) & holds, 1).otherwise(0)).alias("span_hit"), F.max(F.when((F.col("place") <= top) & holds, 1).otherwise(0)).alias("span_hit_strict"))
    asked = lists.join(questions.select("qa_id"), "qa_id").select("qa_id", "strategy").distinct()
    return asked.join(found, ["qa_id", "strategy"], "left").select("qa_id", "strategy", F.coalesce("span_hit", F.lit(0)).alias("span_hit"), F.coalesce("span_hit_strict", F.lit(0)).alias("span_hit_strict"))


def span_coverage(lists: DataFrame, questions: DataFrame, top: int = 5) -> DataFrame:
    """(qa_id, strategy, covered, coverage): how much of the answer span the contexts of the first ``top`` hits cover together.

    Contexts are clipped to the span; those that overlap or touch merge into islands, a new one starting where a context
    begins beyond the greatest end so far.
    """
    own = lists.where(F.col("place") <= top).join(questions, "qa_id").where("hit_doc = doc and answer_end > answer_start")
    clip = own.select("qa_id", "strategy", "answer_start", "answer_end", F.greatest("start_index", "answer_start").alias("lo"), F.least(F.col("start_index") + F.col("char_count"), F.col("answer_end")).alias("hi")).where("hi > lo")
    before = Window.partitionBy("qa_id", "strategy").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = clip.withColumn("reach", F.max("hi").over(before))
    fresh = F.greatest(F.col("hi") - F.greatest(F.coalesce("reach", F.col("lo")), F.col("lo")), F.lit(0))
    return reach.groupBy("qa_id", "strategy").agg(F.sum(fresh).alias("covered"), F.max(F.col("answer_end") - F.col("answer_start")).alias("length")).select("qa_id", "strategy", "covered", F.round(F.col("covered") / F.col("length"), 6).alias("coverage"))
