"""Answers against references: exact match, character F1, longest common subsequence, citations, refusals, stability."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(text: Column) -> Column:
    """Without white space, marks and symbols; compatibility forms are left as they are, which keeps it inside the JVM."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\p{P}\p{S}]+", "")


@F.pandas_udf(T.StringType())
def normalized(texts: pd.Series) -> pd.Series:
    """NFKC, then without white space, marks and symbols; null is empty."""
    import unicodedata

    import regex

    drop = regex.compile(r"[\s\p{P}\p{S}]+")
    return texts.map(lambda s: drop.sub("", unicodedata.normalize("NFKC", s)) if s is not None else "")


@F.pandas_udf(T.DoubleType())
def rouge_l(answers: pd.Series, references: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of characters, bit-parallel; 0 where a side is empty or null."""

    def one(a, b) -> float:
        if not a or not b:
            return 0.0
        n = lcs(a, b)
        return 2 * n / (len(a) + len(b)) if n else 0.0

    return pd.Series([one(a, b) for a, b in zip(answers, references)], dtype="float64")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table is one large integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        m = places.get(c, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.LongType())
def common_characters(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many characters two texts have in common, each as often as in the text that has it less often."""
    from collections import Counter

    return pd.Series([(Counter(x) & Counter(y)).total() if x and y else 0 for x, y in zip(a, b)], dtype="int64")


def f1_of(answer: Column, reference: Column) -> Column:
    """F1 of the bags of characters of two texts of one row, without white space, marks and symbols: both empty 1, one empty 0."""
    a, b = plain(answer), plain(reference)
    na, nb = F.length(a), F.length(b)
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(2.0 * common_characters(a, b) / (na + nb))


def char_f1(pairs: DataFrame, keys: list[str], answer: str, reference: str) -> DataFrame:
    """keys and f1 of each row, without a shuffle. Nulls are empty."""
    return pairs.select(*keys, f1_of(F.col(answer), F.col(reference)).alias("f1"))


def citation_scores(cited: DataFrame, labels: DataFrame) -> DataFrame:
    """(answer_id, precision, recall): of the cited labels those that stand for the reference document, and whether one does.

    ``cited`` (answer_id, qa_id, strategy, doc, citations), ``labels`` (qa_id, strategy, label, hit_doc). Unknown labels
    count in the denominator alone. Without citations precision is null and recall 0.
    """
    each = cited.select("answer_id", "qa_id", "strategy", "doc", F.explode(F.array_distinct("citations")).alias("label"))
    good = each.join(labels, ["qa_id", "strategy", "label"], "left").groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("hit_doc") == F.col("doc"), F.lit(False))).alias("good"))
    return cited.select("answer_id").join(good, "answer_id", "left").select("answer_id", (F.col("good") / F.col("n")).alias("precision"), F.when(F.col("good") > 0, 1.0).otherwise(0.0).alias("recall"))


def stability(rows: DataFrame) -> DataFrame:
    """(method, questions, stable_rate, mean_stdev): questions whose repeats all say the same, and the mean over questions of
    the population deviation of f1. ``rows`` (method, qa_id, said, f1)."""
    each = rows.groupBy("method", "qa_id").agg((F.countDistinct("said") == 1).cast("int").alias("stable"), F.stddev_pop("f1").alias("sd"))
    return each.groupBy("method").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("stable"), 6).alias("stable_rate"), F.round(F.avg("sd"), 6).alias("mean_stdev"))


def latest_message(messages: DataFrame, who: Column) -> DataFrame:
    """(thread_id, ordinal, content) of the last message of each thread for which ``who`` holds."""
    return messages.where(who).groupBy("thread_id").agg(F.max_by(F.struct("ordinal", "content"), F.struct("ordinal", "content")).alias("x")).select("thread_id", "x.*")


def attempts(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Number of the attempt within its key, from 1."""
    return rows.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
