"""Samples and splits that come out the same anywhere: order by hash instead of a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lot(seed: str, *parts: Column) -> Column:
    """The hash by which a row is drawn."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def stable_sample(rows: DataFrame, strata: list[str], key: str, count: int, seed: str) -> DataFrame:
    """The ``count`` rows of each stratum with the smallest lots, numbered from 1. A sampling operator: the limit is its point."""
    w = Window.partitionBy(*strata).orderBy("lot", key)
    return rows.withColumn("lot", lot(seed, *[F.col(c) for c in strata], F.col(key))).withColumn("drawn", F.row_number().over(w)).where(F.col("drawn") <= count)


def round_robin(rows: DataFrame, group: str, key: str, count: int, seed: str) -> DataFrame:
    """``count`` rows taken one from each group in turn, groups and rows in the order of their lots."""
    inside = Window.partitionBy(group).orderBy(lot(seed, F.col(group), F.col(key)), key)
    turn = rows.withColumn("turn", F.row_number().over(inside)).where(F.col("turn") <= count)
    across = Window.orderBy("turn", lot(seed, F.col(group)), group)
    # at most `count` rows of each group are left; of those the first `count` in turn
    first = turn.orderBy("turn", lot(seed, F.col(group)), group).limit(count)
    return first.withColumn("n", F.row_number().over(across))


def numbered_by_lot(ids: DataFrame, key: str, seed: str) -> DataFrame:
    """(key, i, total): different ids numbered from 1 in the order of their lots, and how many there are.

    The place in the order comes from counts of ranges of lots and a rank inside the range, not from one sorted task.
    """
    one = ids.where(F.col(key).isNotNull()).select(key).distinct().withColumn("lot", lot(seed, F.col(key)))
    one = one.withColumn("range", F.substring("lot", 1, 3))
    counts = one.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # 4,096 rows
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    placed = one.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy("lot", key))).join(F.broadcast(offsets), "range")
    return placed.select(key, (F.col("at") + F.col("offset")).alias("i"), "total")


def share_split(ids: DataFrame, key: str, dev: float, test: float, seed: str) -> DataFrame:
    """(key, split): ids in the order of their lots, the first round(n dev) to dev, the next round(n test) to test, the rest to
    train_pool; halves round to even. Repeated ids count once, null ids fall out."""
    a, b = F.bround(F.col("total") * dev), F.bround(F.col("total") * test)
    at = F.col("i")
    return numbered_by_lot(ids, key, seed).select(key, F.when(at <= a, "dev").when(at <= a + b, "test").otherwise("train_pool").alias("split"))


def alternate(rows: DataFrame, strata: list[str], key: str, seed: str) -> DataFrame:
    """Rows of each stratum in the order of their lots, to dev and test by turns.

    A row's place in its stratum is its place in a range of lots, 4,096 of a stratum, and how many lie in the ranges before.
    """
    drawn = rows.withColumn("tessera_lot", lot(seed, F.col(key))).withColumn("tessera_range", F.substring("tessera_lot", 1, 3))
    counts = drawn.groupBy(*strata, "tessera_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*strata).orderBy("tessera_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"tessera_{i}") for i, c in enumerate(strata)], F.col("tessera_range").alias("tessera_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("tessera_offset"))
    inside = Window.partitionBy(*strata, "tessera_range").orderBy("tessera_lot", key)
    placed = drawn.withColumn("tessera_at", F.row_number().over(inside))
    same = F.col("tessera_range") == F.col("tessera_r")
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"tessera_{i}"))
    side = F.when(F.pmod(F.col("tessera_at") + F.col("tessera_offset") - 1, F.lit(2)) == 0, "dev").otherwise("test")
    return placed.join(offsets, same).select(*rows.columns, side.alias("side"))


def numbered_inside(rows: DataFrame, stratum: str, key: str, seed: str) -> DataFrame:
    """Rows with i, their number from 1 in their stratum in the order of their lots, ties by key; ranges of lots as in ``alternate``."""
    drawn = rows.withColumn("tessera_lot", lot(seed, F.col(stratum), F.col(key))).withColumn("tessera_range", F.substring("tessera_lot", 1, 3))
    counts = drawn.groupBy(stratum, "tessera_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(stratum).orderBy("tessera_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(stratum, "tessera_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("tessera_offset"))
    inside = F.row_number().over(Window.partitionBy(stratum, "tessera_range").orderBy("tessera_lot", key))
    return drawn.withColumn("tessera_at", inside).join(offsets, [stratum, "tessera_range"]).select(*rows.columns, (F.col("tessera_at") + F.col("tessera_offset")).alias("i"))


def blind_labels(rows: DataFrame, key: str, method: str, seed: str) -> DataFrame:
    """Methods of each question behind letters, in an order drawn anew for each question."""
    w = Window.partitionBy(key).orderBy(lot(seed, F.col(key), F.col(method)), method)
    return rows.withColumn("letter", F.chr(F.lit(64) + F.row_number().over(w)))
