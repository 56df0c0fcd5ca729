"""Data quality as tables of violations, never as exceptions inside a job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(*counted: tuple[str, DataFrame]) -> DataFrame:
    """(check, violations): one row for each named table of offending rows."""
    rows = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in counted]
    return reduce(DataFrame.unionByName, rows)


def counts(rows: DataFrame, **broken: Column) -> DataFrame:
    """(check, violations): how many rows break each named rule, in one pass over the table; an unknown outcome isn't a breach."""
    each = [F.struct(F.lit(name).alias("check"), F.count_if(F.coalesce(rule, F.lit(False))).alias("violations")) for name, rule in broken.items()]
    return rows.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def duplicate_surplus(df: DataFrame, key: str) -> DataFrame:
    """(surplus): rows beyond the first of each key; a null key is a key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("surplus"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with a key that no parent has."""
    return children.where(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two tables has; none means the sets are equal."""
    x, y = a.select(key).where(F.col(key).isNotNull()).distinct(), b.select(key).where(F.col(key).isNotNull()).distinct()
    left = x.join(y, key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def unsound_vector(v: Column) -> Column:
    """Null, empty, zero, or with an element that is null or not finite."""
    return v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)


def review_violations(rows: DataFrame) -> DataFrame:
    """Rule broken by each review row (status, decision, reviewer, comment), null where none is.

    Pending rows have no decision; a pass and only a pass is "correct"; finished rows name a reviewer; a failure has a comment.
    """
    done = F.col("status").isin("pass", "fail")
    rule = (
        F.when(~F.coalesce(done | (F.col("status") == "pending"), F.lit(False)), "unknown_status")
        .when((F.col("status") == "pending") & (F.col("decision").isNotNull() | F.col("reviewer").isNotNull()), "pending_filled")
        .when(done & F.col("reviewer").isNull(), "no_reviewer")
        .when((F.col("status") == "pass") & ~F.col("decision").eqNullSafe(F.lit("correct")), "pass_not_correct")
        .when((F.col("status") == "fail") & (F.col("decision").isNull() | (F.col("decision") == "correct")), "fail_without_error")
        .when((F.col("status") == "fail") & F.col("comment").isNull(), "fail_without_comment")
    )
    return rows.withColumn("violation", rule)
