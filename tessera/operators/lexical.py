"""Lexical retrieval: terms, postings, BM25 over the whole corpus, and top-k with stable ties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessera.operators.skew import hot_keys
from tessera.session import cut

#: Weighted query terms that are sent to all tasks at most; more of them are joined by shuffling.
FEW = 1 << 17
#: Queries of one block, terms of one part of the documents, and scores that a task holds at once, about.
BLOCK, PART, CELLS = 8192, 1 << 22, 1 << 20
# Fixed values of the scoring formula.
K1, B, EPSILON = 1.5, 0.75, 0.25


def terms(text: Column) -> Column:
    """Overlapping pairs of Han characters, and words of Latin letters and digits in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.regexp_extract_all(low, F.lit(r"(?=([\x{4e00}-\x{9fff}]{2}))"), F.lit(1)), F.regexp_extract_all(low, F.lit(r"[a-z0-9]+"), F.lit(0)))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): one row a document and term. Counting starts before the shuffle."""
    each = docs.select(key, terms(F.col(text)).alias("terms")).select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return each.groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def server_idf(posts: DataFrame, n_docs: int) -> DataFrame:
    """(term, idf) as search servers have it: never negative."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", F.log1p((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def idf(posts: DataFrame, n_docs: int) -> DataFrame:
    """(term, idf): negative values become a share of the mean over all terms."""
    raw = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", (F.ln(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    raw = cut(raw)
    mean = raw.agg(F.avg("raw")).first()[0]
    return raw.select("term", F.when(F.col("raw") < 0, F.lit(EPSILON * (mean or 0.0))).otherwise(F.col("raw")).alias("idf"))


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, query_text: str, doc_key: str, doc_text: str, server: bool = False) -> DataFrame:
    """(query_key, doc_key, score) of every pair that shares a term; statistics are those of all documents.

    A join of postings on the term; documents without a common term have score 0 and no row. Counted query terms of a bounded
    number go to the postings, which lie by document, so that a document's terms are summed where they are. More of them are
    joined by shuffling, and terms that many documents have are salted by document on both sides' behalf, so one term's
    postings are spread over tasks. ``server``: the constants of
    search servers, k1 = 1.2 and an idf that is never negative.
    """
    k1 = 1.2 if server else K1
    posts = cut(postings(docs, doc_key, doc_text))
    n = docs.count()  # documents without a term count too
    length = (posts.agg(F.sum("tf")).first()[0] or 0) / max(n, 1) or 1.0
    weights = (server_idf if server else idf)(posts, n)
    asked = queries.select(query_key, F.explode(terms(F.col(query_text))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = cut(asked.join(weights, "term"))
    if asked.count() <= FEW:
        both = posts.join(F.broadcast(asked), "term")
    else:
        hot = [r[0] for r in hot_keys(posts, "term").collect()]
        salts = 16
        spread = F.when(F.col("term").isin(hot), F.pmod(F.xxhash64(doc_key), F.lit(salts))).otherwise(F.lit(0)).cast("int") if hot else F.lit(0)
        copies = F.when(F.col("term").isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
        both = posts.withColumn("salt", spread).join(asked.withColumn("salt", F.explode(copies)), ["term", "salt"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - B + B * F.col("dl") / F.lit(float(length))))
    return both.groupBy(query_key, doc_key).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, query_key: str, k: int, *order: Column) -> DataFrame:
    """rank 1 … k within each query by the given total order."""
    w = Window.partitionBy(query_key).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def overlap_ratio(query_terms: Column, doc_terms: Column) -> Column:
    """Share of a query's different terms that a document has; 0 for a query without terms."""
    q = F.array_distinct(query_terms)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, doc_terms)) / F.size(q)).otherwise(F.lit(0.0))


def bm25_top_k(queries: DataFrame, docs: DataFrame, query_key: str, query_text: str, doc_key: str, boosts: dict[str, float], k: int, server: bool = False, also: list | None = None, counted: bool = False) -> DataFrame:
    """(query_key, doc_key, score, shared) of at least the k best documents of each query, by score to nine places and then by key.

    The score is the greatest boosted one of a document's fields, each with the statistics of all documents that have the
    field; ``shared``, null unless ``counted``, counts the query's different terms in each field. Documents without a common
    term have no row.
    Pairs of queries and documents are too many to be shuffled, so blocks of queries meet parts of the documents in one task
    each, which sums up a few documents at a time for all of its queries and passes on its own k best; ``top_k`` merges them.
    Pairs with a document of ``also`` (a few keys) are passed on in any case. ``doc_key`` is unique and never null.
    """
    k1 = 1.2 if server else K1
    names = {f"f{i}": f for i, f in enumerate(boosts)}
    rows = cut(docs.select(F.col(doc_key), *[F.when(F.col(f).isNotNull(), F.array_join(terms(F.col(f)), " ")).alias(n) for n, f in names.items()]))
    size = lambda n: F.when(F.length(n) > 0, F.length(n) - F.length(F.translate(n, " ", "")) + 1).otherwise(0)
    totals = rows.agg(*[F.count(n).alias(n) for n in names], *[F.coalesce(F.sum(size(n)), F.lit(0)).alias(f"{n}_terms") for n in names]).first()
    asked = cut(queries.select(query_key, F.explode(terms(F.col(query_text))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("qtf")))
    weighted = None
    for i, n in enumerate(names):
        each = rows.select(F.explode(F.array_distinct(F.split(n, " "))).alias("term")).where("term <> ''")
        weights = (server_idf if server else idf)(each, totals[n])
        part = asked.join(weights, "term").select(F.col(query_key), F.lit(i).alias("field"), "term", (F.col("qtf") * F.col("idf")).alias("weight"))
        weighted = part if weighted is None else weighted.unionByName(part)
    weighted = cut(weighted)
    blocks = max(1, -(-weighted.select(query_key).distinct().count() // BLOCK))
    parts = max(1, -(-sum(totals[f"{n}_terms"] for n in names) // PART))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = weighted.withColumn("b", F.pmod(F.xxhash64(query_key), F.lit(blocks)).cast("int")).withColumn("c", every(parts))
    c = rows.withColumn("c", F.pmod(F.xxhash64(doc_key), F.lit(parts)).cast("int")).withColumn("b", every(blocks))
    fields = [(n, boosts[f], totals[f"{n}_terms"] / max(totals[n], 1) or 1.0) for n, f in names.items()]
    kept = set(also or ())
    out = StructType([StructField(query_key, weighted.schema[query_key].dataType), StructField(doc_key, rows.schema[doc_key].dataType), StructField("score", DoubleType()), StructField("shared", LongType())])
    return q.groupBy("b", "c").cogroup(c.groupBy("b", "c")).applyInArrow(lambda x, y: _best(x, y, query_key, doc_key, fields, k1, k, kept, counted), out)


class _Best:
    """The k best (query, document) of each query so far. Documents come in rising order, so one that only equals the k-th loses."""

    def __init__(self, queries: int, k: int):
        self.k, self.least, self.held, self.size = k, np.full(queries, -np.inf), [], 0

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray, shared: np.ndarray) -> None:
        self.held.append((query, doc, score, shared))
        self.size += len(query)
        if self.size > CELLS // 2:
            self.rest()

    def rest(self) -> list[np.ndarray]:
        q, d, s, n = (np.concatenate(x) for x in zip(*self.held))
        places = np.round(s, 9)
        order = np.lexsort((d, -places, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.least[q[last]] = places[order[last]]
        order = order[rank < self.k]
        out = [q[rank < self.k], d[order], s[order], n[order]]
        self.held, self.size = [tuple(out)], 0  # counts new ones only, for the held ones may be many
        return out


def _best(asked: pa.Table, docs: pa.Table, query_key: str, doc_key: str, fields: list[tuple[str, float, float]], k1: float, k: int, also: set, counted: bool) -> pa.Table:
    ids = asked.column(query_key).combine_chunks().dictionary_encode("encode")
    own = docs.column(doc_key).combine_chunks()
    in_order = sorted(range(len(own)), key=own.to_pylist().__getitem__)
    own, docs = own.take(pa.array(in_order, pa.int64())), docs.take(pa.array(in_order, pa.int64()))
    field, weight, nq = asked.column("field").to_numpy(), asked.column("weight").to_numpy(), len(ids.dictionary)
    queries, lists = ids.indices.to_numpy().astype(np.int64), []
    for i, (name, boost, mean) in enumerate(fields):
        mine = field == i
        words = asked.column("term").combine_chunks().filter(pa.array(mine)).dictionary_encode()
        codes = words.indices.to_numpy()
        by = np.argsort(codes, kind="stable")
        lists.append((docs.column(name).combine_chunks(), mean, words.dictionary, np.searchsorted(codes[by], np.arange(len(words.dictionary) + 1)), queries[mine][by], weight[mine][by] * boost))
    low = 0.0 if (weight > 0).all() else -np.inf  # the score of a pair without a common term
    kept = np.array([i for i, x in enumerate(own.to_pylist()) if x in also], dtype=np.int64)
    best, sure, rows = _Best(nq, k), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))], max(1, min(1024, CELLS // max(nq, 1)))
    best.held = list(sure)
    for at in range(0, len(own) if nq else 0, rows):
        n = min(rows, len(own) - at)
        score, shared = np.full((n, nq), low), np.zeros((n, nq), dtype=np.int32) if counted else None
        for texts, mean, words, first, query, worth in lists:
            _add(score, shared, texts.slice(at, n), words, first, query, worth, mean, k1, low == 0)
        for r in kept[(kept >= at) & (kept < at + n)] - at:
            q = np.flatnonzero(score[r] > low)
            sure.append((q, np.full(len(q), r + at), score[r, q], shared[r, q] if counted else q))
            score[r] = -np.inf
        d, q = np.nonzero(score > np.maximum(best.least + 4e-10, low))
        best.add(q, d + at, score[d, q], shared[d, q] if counted else q)
    q, d, s, n = (np.concatenate(x) for x in zip(best.rest(), *sure))
    return pa.table([ids.dictionary.take(pa.array(q)), own.take(pa.array(d)), pa.array(s, pa.float64()), pa.array(n.astype(np.int64)) if counted else pa.nulls(len(n), pa.int64())], names=[query_key, doc_key, "score", "shared"])


def _add(score: np.ndarray, shared: np.ndarray | None, texts: pa.Array, words: pa.Array, first: np.ndarray, query: np.ndarray, worth: np.ndarray, mean: float, k1: float, positive: bool) -> None:
    """Raise (document, query) of ``score`` to what a field gives, and add the common terms to ``shared``. Without a common term
    it is 0 where all weights are positive, else -inf. The term of code c has the queries and weights from first[c] to
    first[c + 1]."""
    split = pc.split_pattern(texts, " ")
    length = np.where(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0, pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False), 0)
    code = pc.index_in(split.flatten(), value_set=words)
    known = code.is_valid().to_numpy(zero_copy_only=False)
    doc = pc.list_parent_indices(split).to_numpy()[known].astype(np.int64)
    pair, tf = np.unique(doc * max(len(words), 1) + code.drop_null().to_numpy(), return_counts=True)
    doc, code = np.divmod(pair, max(len(words), 1))
    part = tf * (k1 + 1) / (tf + k1 * (1 - B + B * length[doc] / mean))
    start, end = first[code], first[code + 1]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    nq = score.shape[1]
    for r in np.flatnonzero(np.diff(bounds)):
        own = slice(bounds[r], bounds[r + 1])
        spans = [slice(a, b) for a, b in zip(start[own].tolist(), end[own].tolist())]
        q = np.concatenate([query[s] for s in spans])
        sums = np.bincount(q, np.concatenate([worth[s] for s in spans]) * np.repeat(part[own], end[own] - start[own]), nq)
        if shared is not None or not positive:
            n = np.bincount(q, minlength=nq)
            if shared is not None:
                shared[r] += n
            if not positive:
                sums[n == 0] = -np.inf
        np.maximum(score[r], sums, out=score[r])
