"""Plans of retrieval: legs, fusion and reranking put together by mode, for a whole batch of questions at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.fusion import RRF_K

Leg = Callable[[], DataFrame]
MODES = ("bm25", "dense", "hybrid", "bm25_rerank", "dense_rerank", "hybrid_rerank")


def _place(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy("qa_id").orderBy(*order)))


def leg(candidates: DataFrame, score: str, k: int) -> DataFrame:
    """(qa_id, chunk_id, place, base): the k best candidates of each question by one score, ties by chunk_id; null scores take no part."""
    ok = candidates.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return _place(ok.select("qa_id", "chunk_id", F.col(score).alias("base")), F.desc("base"), F.col("chunk_id")).where(F.col("place") <= k)


def fuse(legs: list[DataFrame]) -> DataFrame:
    """(qa_id, chunk_id, place, base) by reciprocal ranks."""
    both = reduce(DataFrame.unionByName, legs).groupBy("qa_id", "chunk_id").agg(F.sum(1.0 / (F.lit(RRF_K) + F.col("place"))).alias("base"))
    return _place(both, F.desc(F.round("base", 12)), F.col("chunk_id"))


def rerank(ranked: DataFrame, scores: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` of a list in a new order: reranker's score, then the base score, then chunk_id. Without a score of the
    reranker a candidate comes last."""
    few = ranked.where(F.col("place") <= cap).join(scores, ["qa_id", "chunk_id"], "left")
    return _place(few, F.desc_nulls_last("rerank_score"), F.desc("base"), F.col("chunk_id")).drop("rerank_score")


def retrieve(candidates: DataFrame, scores: DataFrame, mode: str, top: int, leg_k: int = 20, cap: int = 40) -> DataFrame:
    """(qa_id, mode, chunk_id, place) of one mode. ``candidates`` (qa_id, chunk_id, lexical, dense), ``scores`` (qa_id, chunk_id,
    rerank_score). A leg goes as deep as the output at least."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    k = max(leg_k, top)
    base = mode.removesuffix("_rerank")
    legs = {"bm25": ["lexical"], "dense": ["dense"], "hybrid": ["lexical", "dense"]}[base]
    lists = [leg(candidates, s, k) for s in legs]
    ranked = fuse(lists) if len(lists) > 1 else lists[0]
    if mode.endswith("_rerank"):
        ranked = rerank(ranked, scores, cap)
    return ranked.where(F.col("place") <= top).select("qa_id", F.lit(mode).alias("mode"), "chunk_id", "place")


def matrix(candidates: DataFrame, scores: DataFrame, top: int, modes: tuple[str, ...] = MODES) -> DataFrame:
    """All modes over the same candidates."""
    return reduce(DataFrame.unionByName, [retrieve(candidates, scores, m, top) for m in modes])


def _answered(df: DataFrame, mode: str, why: str | None, top: int) -> DataFrame:
    return df.where(F.col("place") <= top).select("qa_id", "chunk_id", "place", "score", F.lit(mode).alias("mode"), F.lit(why is not None).alias("degraded"), F.lit(why).cast("string").alias("reason"))


def serve(keywords: Leg, dense: Leg, reranked: Callable[[DataFrame], DataFrame], mode: str, top: int, cap: int = 40) -> DataFrame:
    """(qa_id, chunk_id, place, score, mode, degraded, reason) as the service over files answers: by keyword, vector or hybrid.

    A leg is a function that plans (qa_id, chunk_id, place, base); ``reranked`` gives candidates (…, place, base) their
    rerank_score. Only hybrid reranks. Where the dense leg or the reranker can't be planned (a model or an index is missing),
    the answer is that of the keyword leg with a score of 0, marked as degraded with the name of the error. Failures of single
    tasks are Spark's to repeat.
    """
    if mode not in ("hybrid", "vector", "keyword"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "keyword":
        return _answered(keywords().withColumn("score", F.col("base")), mode, None, top)
    try:
        if mode == "vector":
            found = dense().withColumn("score", F.col("base"))
        else:
            few = fuse([keywords(), dense()]).where(F.col("place") <= cap)
            scored = reranked(few).withColumn("score", F.col("rerank_score"))
            found = _place(scored, F.desc_nulls_last("rerank_score"), F.desc("base"), F.col("chunk_id"))
        return _answered(found, mode, None, top)
    except Exception as problem:
        return _answered(keywords().withColumn("score", F.lit(0.0)), "keyword", type(problem).__name__, top)


def serve_from_database(keywords: Leg, dense: Leg, reranked: Callable[[DataFrame], DataFrame], mode: str, top: int, cap: int = 40) -> DataFrame:
    """The same columns as the service over a database answers: all modes rerank, a keyword leg that can't be planned leaves the
    vector leg (degraded), and a dense leg that can't be planned is an error."""
    if mode not in ("hybrid", "vector", "keyword"):
        raise ValueError(f"no such mode: {mode}")
    legs, why, used = [], None, mode
    if mode != "vector":
        try:
            legs.append(keywords())
        except Exception as problem:
            why, used = type(problem).__name__, "vector"
    if mode != "keyword" or why:
        legs.append(dense())
    few = (fuse(legs) if len(legs) > 1 else legs[0]).where(F.col("place") <= cap)
    scored = reranked(few).withColumn("score", F.col("rerank_score"))
    return _answered(_place(scored, F.desc_nulls_last("rerank_score"), F.desc("base"), F.col("chunk_id")), used, why, top)


def degrading(plan: DataFrame | None, fallback: DataFrame) -> DataFrame:
    """The plan, or the fallback where a leg could not be planned at all; failures while a job runs are Spark's to retry."""
    return fallback if plan is None else plan
