"""Joins and ranks that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.005


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = 20_000) -> DataFrame:
    """The 1 / share keys with the most rows that have at least ``least`` rows: (key, tessera_n).

    Every key with more than ``share`` of the rows is among them. Counted after map-side pre-aggregation; the number of
    rows is bounded, so the result may be collected or broadcast.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("tessera_n"))
    return counts.where(F.col("tessera_n") >= least).orderBy(F.desc("tessera_n"), key).limit(int(1 / share))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "inner", salts: int = 32, share: float = HOT_SHARE, least: int = 20_000) -> DataFrame:
    """Equi-join of a skewed ``left`` with a ``right`` that has few rows per key.

    Rows of a hot key of ``left`` are spread over ``salts`` by ``spread``, and the rows of ``right`` with that key are
    repeated once a salt. Rows of any other key travel once. ``how``: inner or left. Both sides may not share other names.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join does inner and left joins")
    hot = [r[0] for r in hot_keys(left, key, share, least).collect()]  # at most 1 / share keys
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    a = left.withColumn("tessera_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    b = right.withColumn("tessera_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "tessera_salt"], how).drop("tessera_salt")


def spread_row_number(df: DataFrame, key: str, order: Column, spread: Column, name: str, buckets: int = 64) -> DataFrame:
    """A dense 1-based number within ``key``, without bringing a key's rows into one task.

    Rows are numbered inside (key, bucket), buckets by hash of ``spread``; the bucket's offset comes from its counts. The
    numbers are a permutation that depends on ``spread`` and ``order`` only, not a global order.
    """
    d = df.withColumn("tessera_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    counts = d.groupBy(key, "tessera_bucket").agg(F.count(F.lit(1)).alias("tessera_n"))
    before = Window.partitionBy(key).orderBy("tessera_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "tessera_bucket", F.coalesce(F.sum("tessera_n").over(before), F.lit(0)).alias("tessera_offset"))
    inside = F.row_number().over(Window.partitionBy(key, "tessera_bucket").orderBy(order))
    numbered = d.withColumn("tessera_rank", inside)
    return numbered.join(offsets, [key, "tessera_bucket"]).withColumn(name, F.col("tessera_rank") + F.col("tessera_offset")).drop("tessera_bucket", "tessera_rank", "tessera_offset")
