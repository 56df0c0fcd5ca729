"""Dense retrieval over precomputed vectors, exact, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors of one block, about. A task multiplies one block of queries with one of the corpus.
BLOCK, PART = 4096, 65_536


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    m = flat.reshape(len(column), -1).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def dense_top_k(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, key, rank, score): the k nearest other vectors of each query by cosine, ties by key.

    Queries and corpus are cut into blocks by hash; every pair of blocks meets in one task as a matrix product, which keeps its
    own k best a query, and a window merges them. Nothing passes through the driver but two counts. Null, empty, zero and
    non-finite vectors take no part.
    """
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double"))) & F.exists(vector, lambda x: x != 0)
    corpus, asked = vectors.where(F.col(key).isNotNull() & ok).select(F.col(key).alias("own"), F.col(vector).alias("v")), queries.where(F.col(key).isNotNull() & ok).select(F.col(key).alias("query_id"), F.col(vector).alias("v"))
    blocks, parts = max(1, -(-asked.count() // BLOCK)), max(1, -(-corpus.count() // PART))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("c", every(parts))
    c = corpus.withColumn("c", F.pmod(F.xxhash64("own"), F.lit(parts)).cast("int")).withColumn("b", every(blocks))
    best = q.groupBy("b", "c").cogroup(c.groupBy("b", "c")).applyInArrow(lambda x, y: _scored(x, y, k), "query_id long, own long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "own")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("own").alias(key), "rank", "score")


def _scored(asked: pa.Table, corpus: pa.Table, k: int) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("own", pa.int64()), ("score", pa.float64())])
    if not asked.num_rows or not corpus.num_rows:
        return schema.empty_table()
    m = _matrix(asked.column("v").combine_chunks())
    ids = asked.column("query_id").to_numpy().astype(np.int64)
    batches = corpus.select(["own", "v"]).combine_chunks().to_batches(max_chunksize=8192)
    return pa.Table.from_batches(list(_score(iter(batches), (ids, m), k)), schema=schema)


def _score(it: Iterator[pa.RecordBatch], asked: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    ids, m = asked
    best_ids = np.zeros((len(ids), 0), dtype=np.int64)
    best = np.zeros((len(ids), 0))
    for batch in it:
        own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        s = m @ _matrix(batch.column(1)).T
        s[ids[:, None] == own[None, :]] = -np.inf
        best_ids = np.hstack([best_ids, np.broadcast_to(own, s.shape)])
        best = np.hstack([best, s])
        order = np.lexsort((best_ids, -np.round(best, 9)), axis=1)[:, :k]
        best, best_ids = np.take_along_axis(best, order, 1), np.take_along_axis(best_ids, order, 1)
    q = np.repeat(ids, best.shape[1])
    keep = np.isfinite(best.ravel())
    yield pa.RecordBatch.from_arrays([pa.array(q[keep].astype(np.int64)), pa.array(best_ids.ravel()[keep]), pa.array(best.ravel()[keep])], names=["query_id", "own", "score"])
