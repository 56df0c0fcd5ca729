"""Ranked lists: fusion, reranking, recovery of parents, citation labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def distinct_hits(hits: DataFrame) -> DataFrame:
    """One row a (qa_id, strategy, chunk_id), that with the smallest hit_id; hits without a usable score or question fall out."""
    ok = hits.where("qa_id is not null and chunk_id is not null and score is not null and not isnan(score)")
    rest = [c for c in ok.columns if c not in ("qa_id", "strategy", "chunk_id", "hit_id", "logged_at", "hit_at")]
    return ok.groupBy("qa_id", "strategy", "chunk_id").agg(F.min(F.struct("hit_id", *rest)).alias("x")).select("qa_id", "strategy", "chunk_id", "x.*")


def ranked(hits: DataFrame) -> DataFrame:
    """Ranks anew within question and strategy by falling score, ties by chunk_id."""
    w = Window.partitionBy("qa_id", "strategy").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("place", F.row_number().over(w))


def reciprocal_rank_fusion(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qa_id, chunk_id, rrf, place): sum of 1 / (k + place) over the lists of a question, ties by chunk_id."""
    fused = lists.groupBy("qa_id", "chunk_id").agg(F.sum(1.0 / (F.lit(k) + F.col("place"))).alias("rrf"))
    w = Window.partitionBy("qa_id").orderBy(F.desc(F.round("rrf", 12)), "chunk_id")
    return fused.withColumn("place", F.row_number().over(w))


def citations(lists: DataFrame, top: int = 5) -> DataFrame:
    """(qa_id, strategy, parent_id, chunk_id, label): of the first ``top`` hits, the first of each parent, labelled E1 … in order.

    The cut comes before the removal of repeated parents, so there may be fewer labels than ``top``.
    """
    first = lists.where((F.col("place") <= top) & F.col("parent_id").isNotNull())
    own = Window.partitionBy("qa_id", "strategy", "parent_id").orderBy("place")
    kept = first.withColumn("n", F.row_number().over(own)).where("n = 1")
    order = Window.partitionBy("qa_id", "strategy").orderBy("place")
    return kept.select("qa_id", "strategy", "parent_id", "chunk_id", F.concat(F.lit("E"), F.row_number().over(order)).alias("label"))


def recover_parents(hits: DataFrame, parents: DataFrame, limit: int, strict: bool = False) -> DataFrame:
    """The best hit of each parent with the parent's text, up to ``limit`` a question; hits of unknown parents are skipped, or
    kept with a null text where ``strict`` wants them counted as violations."""
    own = Window.partitionBy("qa_id", "parent_id").orderBy("place")
    best = hits.withColumn("n", F.row_number().over(own)).where("n = 1").drop("n")
    joined = best.join(parents, "parent_id", "left" if strict else "inner")
    order = Window.partitionBy("qa_id").orderBy("place")
    return joined.withColumn("parent_rank", F.row_number().over(order)).where(F.col("parent_rank") <= limit)
