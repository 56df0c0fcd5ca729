"""Statistics: quantiles, agreement, thresholds, bootstraps by document."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sampling import numbered_by_lot, numbered_inside
from tessera.session import cut

#: Clusters in a row of the packed table, and draws hashed at a time.
_BLOCK = 1 << 14
#: Resamples a task draws.
_EACH = 100


def beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Columns of two tables with one row a group side by side; null groups meet."""
    other = b.select(*[F.col(c).alias(f"{c}_b") for c in by], *[c for c in b.columns if c not in by])
    return a.join(other, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in by]), "left").drop(*[f"{c}_b" for c in by])


def quantiles(rows: DataFrame, by: list[str], column: str, wanted: dict[str, tuple[float, str]], width: float = 0.001) -> DataFrame:
    """by and, for each name of ``wanted`` (p, kind), the exact quantile: "nearest" is the value at place ceil(p n), "between" the
    linear interpolation at place 1 + p (n - 1). Null values take no part; a group without values has nulls.

    An approximate quantile names a narrow band around each place (``width`` of the group's values on either side, ten times
    the sketch's error); what lies below the band is only counted, and the few different values inside it, counted
    too, are walked through in order. So a group's values are never gathered in one task.
    """
    x = F.col(column)
    values = rows.where(x.isNotNull()).select(*by, x.alias("x"))
    names = list(wanted)
    edges = [e for n in names for e in (max(0.0, wanted[n][0] - width), min(1.0, wanted[n][0] + width))]
    bands = values.groupBy(*by).agg(F.count(F.lit(1)).alias("all"), F.percentile_approx("x", F.array(*map(F.lit, edges)), F.lit(10_000)).alias("edges"))
    of = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(wanted[n][0]).alias("p"), F.lit(wanted[n][1] == "nearest").alias("nearest"), F.get("edges", F.lit(2 * i)).alias("lo"), F.get("edges", F.lit(2 * i + 1)).alias("hi")) for i, n in enumerate(names)])
    each = beside(values, bands, by).withColumn("w", F.explode(of)).select(*by, "x", "all", "w.*")
    # one value stands for all below the band, so each band has few rows
    each = each.where("x <= hi").withColumn("v", F.when(F.col("x") >= F.col("lo"), F.col("x")))
    counts = each.groupBy(*by, "name", "p", "nearest", "all", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "name").orderBy(F.asc_nulls_first("v"))))
    low = F.when(F.col("nearest"), F.ceil(F.col("p") * F.col("all"))).otherwise(F.floor(F.col("p") * (F.col("all") - 1)) + 1)
    part = F.col("p") * (F.col("all") - 1) + 1 - low
    at = lambda place: F.min(F.when(F.col("v").isNotNull() & (F.col("upto") >= place), F.col("v")))
    found = upto.groupBy(*by, "name").agg(at(F.greatest(low, F.lit(1))).alias("one"), at(low + 1).alias("two"), F.max(F.when(F.col("nearest"), 0.0).otherwise(part)).alias("part"))
    value = F.when(F.col("part") > 0, F.col("one") + (F.col("two") - F.col("one")) * F.col("part")).otherwise(F.col("one"))
    wide = found.withColumn("value", value).groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    return beside(rows.select(*by).distinct(), wide, by)


def length_report(rows: DataFrame, by: list[str], length: str) -> DataFrame:
    """count, mean, median, nearest-rank p95, min, max and shares below 100 and above 500 of lengths."""
    n = F.col(length)
    out = rows.groupBy(*by).agg(
        F.count(n).alias("n"), F.round(F.avg(n), 6).alias("mean"),
        F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg((n < 100).cast("int")), 6).alias("below_100"), F.round(F.avg((n > 500).cast("int")), 6).alias("above_500"),
    )
    return beside(out, quantiles(rows, by, length, {"median": (0.5, "between"), "p95": (0.95, "nearest")}), by)


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, expected, kappa) of two raters' labels; null labels are left out, no rows give a null, full expected
    agreement gives 1. The label counts are a table of a few rows."""
    pairs = rows.where(f"{a} is not null and {b} is not null").groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    left = F.sum("n").over(Window.partitionBy("a"))
    right = F.sum("n").over(Window.partitionBy("b"))
    cells = pairs.select("a", "b", "n", total.alias("total"), left.alias("left"), right.alias("right"))
    mine = cells.groupBy(F.col("a").alias("label")).agg(F.max("left").alias("left"))
    theirs = cells.groupBy(F.col("b").alias("label")).agg(F.max("right").alias("right"))
    chance = mine.join(theirs, "label").agg(F.sum(F.col("left") * F.col("right")).alias("product"))
    same = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    one = same.withColumn("k", F.lit(1)).join(chance.withColumn("k", F.lit(1)), "k").drop("k")
    observed, expected = F.col("same") / F.col("n"), F.coalesce("product", F.lit(0)) / (F.col("n") * F.col("n"))
    return one.select("n", F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(F.when(F.col("n") > 0, F.when(expected == 1, 1.0).otherwise((observed - expected) / (1 - expected))), 6).alias("kappa"))


def calibrate(rows: DataFrame, score: str, good: str) -> DataFrame:
    """(threshold, balanced_accuracy): the threshold that separates good from bad rows best, the higher one of equal ones.

    Candidates are the scores themselves and the middles between neighbours. Counts at or above each score come from one
    running sum over distinct scores, in 256 ranges cut at quantiles of them, so that no task sees them all.
    """
    points = rows.where(f"{score} is not null and not isnan({score}) and {good} is not null").groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(good)).alias("g"), F.count_if(~F.col(good)).alias("b"))
    points = cut(points)
    edges = points.agg(F.percentile_approx("s", F.array(*[F.lit(i / 256) for i in range(1, 256)]), F.lit(10_000))).first()[0] or []
    points = points.withColumn("range", F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]), lambda e: e <= F.col("s"))) if edges else F.lit(0))
    sums = points.groupBy("range").agg(F.sum("g").alias("rg"), F.sum("b").alias("rb"), F.min("s").alias("first"))
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("range")
    sums = sums.select("range", F.coalesce(F.sum("rg").over(later), F.lit(0)).alias("og"), F.coalesce(F.sum("rb").over(later), F.lit(0)).alias("ob"), F.lead("first").over(ahead).alias("beyond"))
    inside = Window.partitionBy("range").orderBy(F.desc("s"))
    total = points.agg(F.sum("g").alias("tg"), F.sum("b").alias("tb")).withColumn("k", F.lit(1))
    at = points.join(sums, "range").select("s", (F.col("og") + F.sum("g").over(inside)).alias("pg"), (F.col("ob") + F.sum("b").over(inside)).alias("pb"), F.coalesce(F.lead("s").over(Window.partitionBy("range").orderBy("s")), F.col("beyond")).alias("up"))
    counted = at.withColumn("k", F.lit(1)).join(F.broadcast(total), "k")
    balanced = (F.col("pg") / F.col("tg") + (F.col("tb") - F.col("pb")) / F.col("tb")) / 2
    # rows at or above the middle of s and the next score are those at or above the next score
    up = counted.select(F.col("s").alias("threshold"), balanced.alias("ba"))
    lower = counted.select("s", "up", balanced.alias("ba"))
    middle = lower.where("up is not null").select(((F.col("s") + F.col("up")) / 2).alias("threshold"), "up").join(up.withColumnRenamed("threshold", "up"), "up").select("threshold", "ba")
    return up.unionByName(middle).where("ba is not null").agg(F.max(F.struct(F.round("ba", 9).alias("ba"), F.col("threshold"))).alias("x")).select(F.round("x.threshold", 6).alias("threshold"), F.round("x.ba", 6).alias("balanced_accuracy"))


def _drawn(head: str, numbers: list[bytes], n: int) -> np.ndarray:
    """For each number d, the first 48 bits of SHA-256 of ``head`` and d, modulo n."""
    start = head.encode()
    digests = b"".join([sha256(start + d).digest() for d in numbers])
    return ((np.frombuffer(digests, ">u8")[::4].astype(np.uint64) >> np.uint64(16)) % np.uint64(n)).astype(np.int64)


def _resampled(blocks_of: pa.Table, seed: str, first: int, last: int) -> Iterator[tuple[int, float | None]]:
    """(r, mean) of the resamples first … last - 1 over blocks of clusters (b, s, c).

    The d-th draw of resample r is cluster number h mod n, where h are the first 48 bits of SHA-256 of "seed:r:d": the same on
    every engine.
    """
    blocks = sorted(zip(blocks_of.column("b").to_pylist(), blocks_of.column("s").to_pylist(), blocks_of.column("c").to_pylist()), key=lambda x: x[0])
    s = np.concatenate([np.asarray(x[1], float) for x in blocks])
    c = np.concatenate([np.asarray(x[2], np.int64) for x in blocks])
    n = len(s)
    sums, counts = np.zeros(last - first), np.zeros(last - first, np.int64)
    for lo in range(0, n, _BLOCK):
        numbers = [b"%d" % d for d in range(lo, min(n, lo + _BLOCK))]
        for r in range(first, last):
            i = _drawn(f"{seed}:{r}:", numbers, n)
            sums[r - first] += s[i].sum()
            counts[r - first] += c[i].sum()
    for r in range(first, last):
        yield r, sums[r - first] / counts[r - first] if counts[r - first] else None


def cluster_bootstrap(deltas: DataFrame, cluster: str, delta: str, resamples: int, seed: str) -> DataFrame:
    """(n, delta, lower, upper): mean difference and the 2.5 and 97.5 percentiles by index over resampled clusters.

    Clusters are reduced to (sum, count) first and packed into blocks. Each resample draws as many clusters as there are; a
    draw is a hash, so the result doesn't depend on partitions. Every task gets all blocks through a shuffle and draws its own
    hundred resamples, so that no draw is shuffled: 16 bytes a cluster and task instead of a row a draw.
    """
    spark = deltas.sparkSession
    parts = cut(deltas.groupBy(cluster).agg(F.coalesce(F.sum(delta), F.lit(0)).cast("double").alias("s"), F.count(delta).alias("c")).where(F.col(cluster).isNotNull()))
    n = parts.count()
    mean = parts.agg((F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("delta"))
    if not n:
        return mean.select(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("delta"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    numbered = parts.join(numbered_by_lot(parts, cluster, seed).select(cluster, (F.col("i") - 1).alias("i")), cluster)
    packed = numbered.groupBy(F.floor(F.col("i") / _BLOCK).alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "s", "c"))).alias("x")).select("b", F.col("x.s").alias("s"), F.col("x.c").alias("c"))
    tasks = -(-resamples // _EACH)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        first = key[0].as_py() * _EACH
        r, m = zip(*_resampled(rows, seed, first, min(first + _EACH, resamples)))
        return pa.table({"r": pa.array(r, pa.int64()), "m": pa.array(m, pa.float64())})

    each = packed.crossJoin(spark.range(tasks).withColumnRenamed("id", "t")).repartition(tasks, "t").groupBy("t").applyInArrow(run, "r long, m double")
    ordered = each.withColumn("k", F.row_number().over(Window.orderBy(F.round("m", 12), "r")) - 1)
    lo, hi = max(0, int(0.025 * resamples)), max(0, int(0.975 * resamples) - 1)
    ends = ordered.agg(F.max(F.when(F.col("k") == lo, F.col("m"))).alias("lower"), F.max(F.when(F.col("k") == hi, F.col("m"))).alias("upper"))
    return mean.withColumn("z", F.lit(1)).join(ends.withColumn("z", F.lit(1)), "z").select(F.lit(n).cast("long").alias("n"), F.round("delta", 6).alias("delta"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


def comparisons(rows: DataFrame, cluster: str, question: str, method: str, specs: list[tuple[str, str, list[str]]], resamples: int, seed: str) -> DataFrame:
    """(method_a, method_b, metric, n, delta, lower, upper): cluster_bootstrap of each metric of each (a, b, metrics).

    A question's value is the mean of a method's values that aren't null; questions without a value of both methods fall out.
    A comparison without any has n = 0.
    """
    out = []
    for a, b, names in specs:
        for name in names:
            of = [F.avg(F.when(F.col(method) == m, F.col(name).cast("double"))).alias(x) for m, x in ((a, "a"), (b, "b"))]
            paired = rows.where(F.col(method).isin(a, b)).groupBy(question).agg(F.min(cluster).alias("cluster"), *of).where("a is not null and b is not null")
            ends = cluster_bootstrap(paired.select("cluster", (F.col("a") - F.col("b")).alias("delta")), "cluster", "delta", resamples, seed)
            out.append(ends.select(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), F.lit(name).alias("metric"), "n", "delta", "lower", "upper"))
    return reduce(DataFrame.unionByName, out)


def stratified_bootstrap(rows: DataFrame, question: str, strata: list[str], metrics: list[str], resamples: int, seed: str, level: float = 0.95) -> DataFrame:
    """(metric, value, lower, upper, questions, strata): means and their interpolated percentiles over stratified resamples.

    Each resample draws from every stratum as many questions as it has, the same ones for all metrics; draws are hashes. Missing
    or repeated questions, missing strata and missing values are errors.
    """
    if resamples <= 0 or not 0 < level < 1 or not metrics or not strata:
        raise ValueError("resamples, level, metrics or strata out of range")
    whole = reduce(lambda x, y: x & y, [F.col(s).isNotNull() for s in strata])
    values = cut(rows.select(F.col(question).cast("string").alias("q"), F.when(whole, F.to_json(F.struct(*strata))).alias("h"), F.array(*[F.col(m).cast("double") for m in metrics]).alias("v")))
    seen = values.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("q").alias("different"), F.count_distinct("h").alias("strata"), F.count_if(F.col("h").isNull() | (F.coalesce("q", F.lit("")) == "") | F.exists("v", F.isnull)).alias("missing")).first()
    if not seen.n or seen.missing or seen.different < seen.n:
        raise ValueError(f"{seen.n} rows, {seen.missing} with something missing, {seen.different} different questions")
    numbered = numbered_inside(values, "h", "q", seed)
    packed = numbered.groupBy("h", F.floor((F.col("i") - 1) / _BLOCK).alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("x")).select("h", "b", F.col("x.v").alias("v"))
    tasks = -(-resamples // _EACH)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        members: dict[str, list] = {}
        for h, _, v in sorted(zip(*[table.column(c).to_pylist() for c in ("h", "b", "v")]), key=lambda x: x[:2]):
            members.setdefault(h, []).extend(v)
        first = key[0].as_py() * _EACH
        sums = np.zeros((min(first + _EACH, resamples) - first, len(metrics)))
        total = 0
        for h, v in members.items():
            m = np.asarray(v, float)
            total += len(m)
            for lo in range(0, len(m), _BLOCK):
                numbers = [b"%d" % d for d in range(lo, min(len(m), lo + _BLOCK))]
                for r in range(len(sums)):
                    sums[r] += m[_drawn(f"{seed}:{first + r}:{h}:", numbers, len(m))].sum(axis=0)
        out = [(j, x) for row in sums / total for j, x in enumerate(row.tolist())]
        return pa.table({"j": pa.array([x[0] for x in out], pa.int32()), "m": pa.array([x[1] for x in out], pa.float64())})

    each = packed.crossJoin(rows.sparkSession.range(tasks).withColumnRenamed("id", "t")).repartition(tasks, "t").groupBy("t").applyInArrow(run, "j int, m double")
    alpha = (1 - level) / 2
    ends = each.groupBy("j").agg(F.percentile("m", alpha).alias("lower"), F.percentile("m", 1 - alpha).alias("upper"))
    observed = values.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("value"))
    name = F.element_at(F.array(*[F.lit(m) for m in metrics]), F.col("j") + 1)
    return observed.join(ends, "j").select(name.alias("metric"), "value", "lower", "upper", F.lit(seen.n).alias("questions"), F.lit(seen.strata).alias("strata"))


def paired_stratified_bootstrap(a: DataFrame, b: DataFrame, question: str, strata: list[str], metrics: list[str], resamples: int, seed: str, level: float = 0.95) -> DataFrame:
    """(metric, delta, lower, upper, inconclusive, questions, strata): stratified_bootstrap of a - b question by question.

    Both must have the same questions, each once and in the same stratum; else it is an error. ``inconclusive``: the interval
    holds zero.
    """
    sides = []
    for x, name in ((a, "a"), (b, "b")):
        if x.groupBy(question).count().where("count > 1").limit(1).count():
            raise ValueError(f"repeated questions in {name}")
        sides.append(x.select(F.col(question).alias("q"), F.struct(*strata).alias(f"{name}_in"), *[F.col(m).cast("double").alias(f"{name}_{m}") for m in metrics]))
    both = sides[0].join(sides[1], "q", "full")
    if both.where("a_in is null or b_in is null or not (a_in <=> b_in)").limit(1).count():
        raise ValueError("the two sides differ in questions or strata")
    deltas = both.select("q", *[F.col(f"a_in.{s}").alias(s) for s in strata], *[(F.col(f"a_{m}") - F.col(f"b_{m}")).alias(m) for m in metrics])
    ends = stratified_bootstrap(deltas, "q", strata, metrics, resamples, seed, level)
    return ends.select("metric", F.col("value").alias("delta"), "lower", "upper", ((F.col("lower") <= 0) & (F.col("upper") >= 0)).alias("inconclusive"), "questions", "strata")
