"""Review rounds: migration of earlier reviews, import against frozen sources, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def migrate(old: DataFrame, new: DataFrame, key: list[str], same: list[str], carried: list[str]) -> DataFrame:
    """New rows with the earlier round's columns where exactly one old and one new row have the key and all of ``same`` are
    equal (null equals null); outcome says inherited, changed, ambiguous or added."""
    w = Window.partitionBy(*key)
    o = old.withColumn("old_n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy(*same))).where("i = 1").select(*key, "old_n", *[F.col(c).alias(f"old_{c}") for c in [*same, *carried]])
    n = new.withColumn("new_n", F.count(F.lit(1)).over(w))
    j = n.join(o, key, "left")
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    outcome = F.when(F.col("old_n").isNull(), "added").when((F.col("old_n") > 1) | (F.col("new_n") > 1), "ambiguous").when(equal, "inherited").otherwise("changed")
    keep = [c for c in new.columns if c not in carried]
    return j.withColumn("outcome", outcome).select(*keep, *[F.when(F.col("outcome") == "inherited", F.col(f"old_{c}")).alias(c) for c in carried], "outcome")


def altered(frozen: DataFrame, returned: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column): cells that may not change but differ from the frozen source, and rows that are missing or foreign."""
    a = frozen.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns], F.lit(True).alias("is_a"))
    b = returned.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns], F.lit(True).alias("is_b"))
    both = a.join(b, key, "full")
    wrong = [F.when(F.col("is_a").isNull(), "foreign row").when(F.col("is_b").isNull(), "missing row")]
    wrong += [F.when(F.col("is_a") & F.col("is_b") & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c) for c in columns]
    return both.select(key, F.explode(F.filter(F.array(*wrong), lambda x: x.isNotNull())).alias("column"))


def rates(rows: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """Share of "yes" among yes and no for each label column; not_applicable and blank cells don't count, no cells give null."""
    one = lambda c: F.round(F.count_if(F.col(c) == "yes") / F.nullif(F.count_if(F.col(c).isin("yes", "no")), F.lit(0)), 6).alias(c)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[one(c) for c in labels])


def normal_label(value: Column, numbers: dict[str, str]) -> Column:
    """A cell in lower case without outer blanks, numbers by the column's table; null for a blank one."""
    low = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv]), low)
    return F.when(low != "", F.coalesce(named, low))


def summary(rows: DataFrame, by: list[str], yes: dict[str, str], scored: str, scores: int) -> DataFrame:
    """by, rows_n, completed, a rate of "yes" among yes and no for each column of ``yes`` under its name there, and how many rows have each score.

    A row is completed when none of these cells is null; not_applicable cells count in no rate, and no cells give null.
    """
    whole = F.col(scored).isNotNull()
    for c in yes:
        whole = whole & F.col(c).isNotNull()
    rate = lambda c: F.round(F.count_if(F.col(c) == "yes") / F.nullif(F.count_if(F.col(c).isin("yes", "no")), F.lit(0)), 6)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_n"), F.count_if(whole).alias("completed"), *[rate(c).alias(name) for c, name in yes.items()], *[F.count_if(F.col(scored) == f"score_{k}").alias(f"score_{k}") for k in range(scores)])


def audited(rows: DataFrame, by: list[str], errors: list[str]) -> DataFrame:
    """by, passed, failed, failures by decision, the reviewers in order and the first and last day of (status, decision, reviewer, day).

    Reviewers of a group are gathered as a set: they are people, a few.
    """
    failed = F.col("status") == "fail"
    return rows.groupBy(*by).agg(
        F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(failed).alias("failed"), *[F.count_if(failed & (F.col("decision") == e)).alias(e) for e in errors],
        F.array_join(F.array_sort(F.collect_set("reviewer")), ",").alias("reviewers"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"),
    )


def quota_gaps(rows: DataFrame, quotas: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, wanted, got): strata whose number of rows isn't the wanted one, on either side."""
    got = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("got"))
    return quotas.join(got, keys, "full").select(*keys, F.coalesce("wanted", F.lit(0)).alias("wanted"), F.coalesce("got", F.lit(0)).alias("got")).where("wanted <> got")


def gate(rates_row: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """(rule, value, passed) for rules like {"recall_5": (">=", 0.9)} over one row of figures; a null figure doesn't pass."""
    tests = []
    for name, (op, bound) in rules.items():
        c = F.col(name).cast("double")
        ok = {">=": c >= bound, ">": c > bound, "<=": c <= bound, "<": c < bound, "=": c == bound}[op]
        tests.append(F.struct(F.lit(name).alias("rule"), c.alias("value"), F.coalesce(ok, F.lit(False)).alias("passed")))
    return rates_row.select(F.explode(F.array(*tests)).alias("t")).select("t.*")
