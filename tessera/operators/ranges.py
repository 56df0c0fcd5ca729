"""Joins on ranges, by cells of the range instead of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of one cell.
CELL = 512


def overlapping(a: DataFrame, b: DataFrame, key: str, cell: int = CELL) -> DataFrame:
    """Pairs of rows of a (key, a_start, a_end, …) and b (key, b_start, b_end, …) whose half-open ranges overlap.

    Each range is repeated once a cell it touches, so the join is an equi-join on (key, cell) and a key with many ranges is
    spread over its cells; a pair counts in the first cell that both touch. Empty ranges overlap nothing.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell)))
    x = a.where("a_end > a_start").withColumn("cell", cells("a_start", "a_end"))
    y = b.where("b_end > b_start").withColumn("cell", cells("b_start", "b_end"))
    both = x.join(y, [key, "cell"]).where("a_start < b_end and a_end > b_start")
    return both.where(F.col("cell") == F.floor(F.greatest("a_start", "b_start") / cell)).drop("cell")


def sources_of(chunks: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """(key, chunk_id, source_ids): ids of the units that a chunk's range touches, in the order of their starts."""
    both = overlapping(chunks.select(key, "chunk_id", "a_start", "a_end"), units.select(key, "unit_id", "b_start", "b_end"), key)
    return both.groupBy(key, "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("b_start", "unit_id"))), lambda u: u["unit_id"]).alias("source_ids"))
