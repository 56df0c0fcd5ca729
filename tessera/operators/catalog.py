"""Tables kept by key: latest rows, upserts by rewriting, denormalized documents, merged maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """The newest row of each key; of rows as new as each other the one with the greatest other columns.

    Rows are reduced before they are shuffled, so a crowded key costs one row a task. Rows with a null key are left out.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    order = F.struct(newest, *[F.xxhash64(c) for c in rest])
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, *[F.col("x")[c].alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """old with new rows added and, where the key is there, the columns of ``update`` replaced; other columns stay."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in rest], F.lit(True).alias("is_new"))
    o = old.select(*old.columns, F.lit(True).alias("is_old"))
    pick = [F.when(F.col("is_old") & (~F.coalesce("is_new", F.lit(False)) | F.lit(c not in update)), F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in rest]
    return o.join(n, keys, "full").select(*keys, *pick)


def denormalize(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Search documents: each chunk with its parent's place in the book; chunks without a parent are left out."""
    p = parents.select("parent_id", "book_id", "book_title", "volume", "chapter", "section")
    return chunks.where("text is not null").select("chunk_id", "parent_id", "text", "symptom_tags").join(p, "parent_id")


def merge_maps(base: F.Column, patch: F.Column) -> F.Column:
    """Shallow merge of two maps, the second winning."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(patch, k), F.lit(False))), patch)
