"""Same and near-same texts across splits: a join of weighted term vectors over inverted lists, then exact checks.

Texts are vectors of character 4-grams (shorter ones for short texts) weighted by inverse document frequency. Two texts
are near when at most a fifth of the longer one's characters must be edited. An edit spoils at most one of several
disjoint terms, so of d + 1 disjoint terms of the longer text one stands whole in the other: only these go into the
inverted lists, those of greatest weight, and the rest is residual that can't make a pair alone. The lists' matches are
bounded at once by lengths, shift and a parity signature of the characters; then come the exact dot product against the
bound that d edits leave, and the exact edit distance. No step loses a near pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import clean_id
from tessera.session import cut

#: Length of a term in characters, and the share of the longer text's characters that may be edited: one in FIFTH.
TERM, FIFTH = 4, 5
#: Document frequencies are counted in this many hashed cells (2 to the power): a bound on what is broadcast.
CELL_BITS = 18
#: A term that stands more often than this, by its cell, is salted: its list is cut into so many parts, and probed in each.
HOT_TERM = 50_000
_STEP = 8_000_000


def edits(length: int) -> int:
    """How many characters of a text of this length, the longer one of a pair, may be edited."""
    return length // FIFTH


def term_length(length: int) -> int:
    """The longest terms of which edits + 1 disjoint ones fit into a text of this length; at most TERM."""
    return min(TERM, length // (edits(length) + 1))


def partner_terms(length: int) -> list[int]:
    """Term lengths of the texts, as long or longer, that can be near a text of this length."""
    longest = length
    while longest + 1 - edits(longest + 1) <= length:
        longest += 1
    return sorted({term_length(n) for n in range(length, longest + 1)})


@F.pandas_udf(T.StringType())
def plain_letters(texts: pd.Series) -> pd.Series:
    """Compatibility forms folded, lower case, only letters and digits."""
    import unicodedata

    import regex

    drop = regex.compile(r"[^\p{L}\p{N}]+")
    return texts.map(lambda s: drop.sub("", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s).lower())) if s is not None else None)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q-grams of texts of one length: rows of code points -> rows of 64-bit hashes."""
    n = codes.shape[1] - q + 1
    h = np.full((codes.shape[0], n), np.uint64(q), dtype=np.uint64)
    for k in range(q):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[:, k : k + n])
    return h


def _signature(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity of the number of characters in each of 128 cells: an edit flips at most two bits."""
    cell = _mix(codes + np.uint64(77)) & np.uint64(127)
    bit = np.uint64(1) << (cell & np.uint64(63))
    low = cell < np.uint64(64)
    zero = np.uint64(0)
    return np.bitwise_xor.reduce(np.where(low, bit, zero), axis=1), np.bitwise_xor.reduce(np.where(low, zero, bit), axis=1)


#: Texts longer than this carry counts of the characters on either side of each term, and themselves: with many characters
#: of few kinds, as in alphabets, the parity signature tells little, and candidates would be many.
LONG = 64
#: Texts longer than this don't carry themselves: a list would hold them as often as they have terms. They are fetched as
#: candidates, and their terms are chosen one from each of equal stretches instead of by dynamic programming.
CARRIED = 1000
SIDES = [f"{side}{k}" for side in "lr" for k in range(4)]


def _sides(codes: np.ndarray, at: np.ndarray, q: int) -> list[np.ndarray]:
    """Eight words a term: counts up to 8 of 32 classes of characters left and right of it, one bit a character.

    The bits in which two such counts differ are at most twice the edits on that side, less what its length changes by.
    """
    n, length = codes.shape
    if length <= LONG:
        zero = np.zeros(at.size, dtype=np.int64)
        return [zero] * 8
    kinds = (_mix(codes + np.uint64(131)) & np.uint64(31)).astype(np.int64)
    # a class may occur as often as the text is long
    up_to = np.zeros((n, length + 1, 32), dtype=np.int16 if length <= np.iinfo(np.int16).max else np.int32)
    np.put_along_axis(up_to[:, 1:], kinds[:, :, None], 1, axis=2)
    np.cumsum(up_to, axis=1, out=up_to)
    rows = np.arange(n)[:, None]
    left = up_to[rows, at]
    right = up_to[:, -1:] - up_to[rows, at + q]
    bits = np.array([(1 << c) - 1 for c in range(9)], dtype=np.uint8)
    words = [np.ascontiguousarray(bits[np.minimum(side, 8)]).view(np.int64).reshape(-1, 4) for side in (left, right)]
    return [w[:, k] for w in words for k in range(4)]


def _by_length(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions in the batch, code points) of texts of equal length, in portions of bounded size."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    for length in np.unique(lengths):
        if length == 0:
            continue
        at = np.flatnonzero(lengths == length)
        step = max(1, _STEP // int(length * (edits(int(length)) + 2)))
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            joined = "".join(texts[i] for i in some).encode("utf-32-le", "surrogatepass")
            yield int(length), some, np.frombuffer(joined, dtype="<u4").reshape(len(some), length).astype(np.uint64)


def rarest_disjoint(cost: np.ndarray, q: int, k: int) -> np.ndarray:
    """Starts of k disjoint windows of length q for each row: those with the least total cost, by dynamic programming; in long
    texts the cheapest of each of k equal stretches."""
    n, starts = cost.shape
    length = starts + q - 1
    if length > CARRIED:
        edges = np.arange(k + 1) * length // k
        return np.stack([lo + np.argmin(cost[:, lo : hi - q + 1], axis=1) for lo, hi in zip(edges, edges[1:])], axis=1).astype(np.int32)
    best = np.full((length + 1, k + 1, n), np.inf, dtype=np.float32)
    best[:, 0] = 0
    for i in range(q, length + 1):
        best[i, 1:] = np.minimum(best[i - 1, 1:], best[i - q, :-1] + cost[:, i - q])
    out = np.zeros((n, k), dtype=np.int32)
    left = np.full(n, k)
    row = np.arange(n)
    i = np.full(n, length)
    while (left > 0).any():
        on = left > 0
        taken = on & (best[i, left, row] < best[np.maximum(i - 1, 0), left, row])
        left[taken] -= 1
        out[row[taken], left[taken]] = i[taken] - q
        i = np.where(taken, i - q, np.where(on, i - 1, i))
    return out


def _count_cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << CELL_BITS, dtype=np.int64)
    for batch in it:
        for length, _, codes in _by_length(batch.column(0).to_pylist()):
            for q in partner_terms(length):
                total += np.bincount((_grams(codes, q) >> np.uint64(64 - CELL_BITS)).astype(np.int64).ravel(), minlength=len(total))
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])


def document_frequencies(texts: DataFrame, text: str) -> np.ndarray:
    """How often the terms of each hashed cell stand in the texts; a fixed number of cells comes to the driver."""
    rows = texts.select(text).mapInArrow(_count_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(1 << CELL_BITS, dtype=np.float32)
    cells[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return cells


_NARROW = "term long, id long, length int, at int, nth int, sig1 long, sig2 long"
_POSTING = f"{_NARROW}, " + ", ".join(f"{c} long" for c in SIDES) + ", own string"


def _salted(grams: np.ndarray, cells: np.ndarray, ids: np.ndarray, index: bool) -> tuple[np.ndarray, np.ndarray]:
    """(terms, how often each place is repeated): a hot term's list is cut by id, and a probe goes to each of its parts."""
    parts = (cells[(grams >> np.uint64(64 - CELL_BITS)).astype(np.int64)] // HOT_TERM).astype(np.int64) + 1
    if parts.max(initial=1) == 1:
        return grams.ravel(), np.ones(grams.size, dtype=np.int64)
    flat, parts = grams.ravel(), parts.ravel()
    if index:
        part = (np.repeat(ids.astype(np.uint64), grams.shape[1]) % parts.astype(np.uint64)).astype(np.uint64)
        return flat ^ _mix(part) * (part > 0), np.ones(flat.size, dtype=np.int64)
    first = np.cumsum(parts) - parts
    part = (np.arange(parts.sum()) - np.repeat(first, parts)).astype(np.uint64)
    return np.repeat(flat, parts) ^ _mix(part) * (part > 0), parts


def _postings(it: Iterator[pa.RecordBatch], cells, index: bool, wide: bool) -> Iterator[pa.RecordBatch]:
    """Terms of texts (text, id, train, eval). Lists of train are probed by eval texts as long or shorter, and those of
    eval by train texts that are shorter; which lists are meant is part of the term. ``wide``: with what stands around."""
    for batch in it:
        frame = {c: batch.column(c) for c in ("text", "id", "train", "eval")}
        texts = frame["text"].to_pylist()
        ids = frame["id"].to_numpy(zero_copy_only=False)
        sides = [(frame["train" if index else "eval"].to_numpy(zero_copy_only=False), np.uint64(0)), (frame["eval" if index else "train"].to_numpy(zero_copy_only=False), np.uint64(0x5851F42D4C957F2D))]
        for length, some, codes in _by_length(texts):
            sig1, sig2 = _signature(codes)
            for q in [term_length(length)] if index else partner_terms(length):
                grams = _grams(codes, q)
                if index:
                    at = rarest_disjoint(cells[(grams >> np.uint64(64 - CELL_BITS)).astype(np.int64)] + np.float32(1), q, edits(length) + 1)
                    grams = np.take_along_axis(grams, at, axis=1)
                else:
                    at = np.broadcast_to(np.arange(grams.shape[1], dtype=np.int32), grams.shape)
                around = [w.reshape(at.shape) for w in _sides(codes, at, q)] if wide else []
                for flag, salt in sides:
                    on = np.flatnonzero(flag[some])
                    if not len(on):
                        continue
                    width = grams.shape[1]
                    terms, times = _salted(grams[on], cells, ids[some][on], index)
                    rep = lambda x: np.repeat(np.repeat(x[on], width), times)
                    each = lambda x: np.repeat(np.ascontiguousarray(x[on]).ravel(), times)
                    columns = [
                        pa.array((terms ^ salt).view(np.int64)),
                        pa.array(rep(ids[some])),
                        pa.array(np.full(len(terms), length, dtype=np.int32)),
                        pa.array(each(at).astype(np.int32)),
                        pa.array(np.repeat(np.tile(np.arange(width, dtype=np.int32), len(on)), times)),
                        pa.array(rep(sig1).view(np.int64)),
                        pa.array(rep(sig2).view(np.int64)),
                    ]
                    if wide:
                        columns += [pa.array(each(w)) for w in around]
                        own = pa.array([texts[i] for i in some[on]], pa.string()) if length <= CARRIED else pa.nulls(len(on), pa.string())
                        columns.append(own.take(pa.array(np.repeat(np.repeat(np.arange(len(on)), width), times))))
                    yield pa.RecordBatch.from_arrays(columns, names=["term", "id", "length", "at", "nth", "sig1", "sig2", *([*SIDES, "own"] if wide else [])])


def _weights(cells: np.ndarray) -> np.ndarray:
    """Squared inverse document frequencies by cell."""
    return np.square(np.log1p(cells.sum() / np.maximum(cells, 1.0)))


def _occurrences(texts: list[str], q: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, weight) of all terms of some texts; the n-th occurrence of a term is a term of its own."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(codes) < q:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0)
    inside = owner[: len(owner) - q + 1] == owner[q - 1 :]
    grams, owner = _grams(codes.reshape(1, -1), q)[0][inside], owner[: len(owner) - q + 1][inside]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    at = np.arange(len(grams))
    first = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])] if len(grams) else np.zeros(0, dtype=bool)
    nth = at - np.maximum.accumulate(np.where(first, at, 0)) if len(at) else at
    return owner, _mix(grams + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), weights[(grams >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(float)


def exact_dots(a: list[str], b: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dot product, least dot product of near texts, cosine) of the weighted term vectors of pairs of texts, all at once.

    Each edit spoils at most as many terms of the longer text as a term has characters; what the heaviest ones weigh may be
    missing at most.
    """
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b)]
    dot, least, cosine = (np.zeros(len(pairs)) for _ in range(3))
    sizes = np.array([term_length(len(x)) for x, _ in pairs], dtype=np.int64)
    for q in np.unique(sizes):
        some = np.flatnonzero(sizes == q)
        n = len(some)
        xo, xt, xw = _occurrences([pairs[i][0] for i in some], int(q), weights)
        yo, yt, yw = _occurrences([pairs[i][1] for i in some], int(q), weights)
        owner, term, side, w = np.r_[xo, yo], np.r_[xt, yt], np.r_[np.zeros(len(xo)), np.ones(len(yo))], np.r_[xw, yw]
        order = np.lexsort((side, term, owner))
        owner, term, side, w = owner[order], term[order], side[order], w[order]
        both = np.flatnonzero((owner[1:] == owner[:-1]) & (term[1:] == term[:-1]) & (side[1:] != side[:-1]))
        dot[some] = np.bincount(owner[both], w[both], n)
        order = np.lexsort((-xw, xo))
        place = np.arange(len(xo)) - np.searchsorted(xo[order], xo[order])
        light = place >= q * np.array([edits(len(pairs[i][0])) for i in some])[xo[order]]
        least[some] = np.bincount(xo[order][light], xw[order][light], n)
        norms = np.sqrt(np.bincount(xo, xw, n) * np.bincount(yo, yw, n))
        cosine[some] = np.divide(dot[some], norms, out=np.zeros(n), where=norms > 0)
    return dot, least, cosine


def near_texts(texts: DataFrame) -> DataFrame:
    """(train_text, eval_text, distance, cosine) of different or equal texts near each other, one in train, one in eval.

    ``texts`` (text, train, eval) has every text once, with flags for where it stands; it is read several times and should
    be written. Empty texts take no part; without texts there are no pairs. Nothing is capped.
    """
    spark = texts.sparkSession
    t = texts.where(F.length("text") > 0).select("text", F.xxhash64("text").alias("id"), "train", "eval")
    cells = document_frequencies(t, "text")
    shared = spark.sparkContext.broadcast(cells)

    def postings(some: DataFrame, index: bool, wide: bool) -> DataFrame:
        return some.mapInArrow(lambda it: _postings(it, shared.value, index, wide), _POSTING if wide else _NARROW).alias("x" if index else "y")

    short, long = t.where(F.length("text") <= LONG), t.where(F.length("text") > LONG)
    # "eval" lists are probed by strictly shorter texts; for equal lengths the lists of train suffice, so both may stay
    d = F.floor(F.col("x.length") / FIFTH)
    delta = F.col("y.length") - F.col("x.length")
    shift = F.col("y.at") - F.col("x.at")
    flips = F.bit_count(F.col("x.sig1").bitwiseXOR(F.col("y.sig1"))) + F.bit_count(F.col("x.sig2").bitwiseXOR(F.col("y.sig2")))
    # of the disjoint terms take the first before whose end no more edits lie than terms before it: it stands whole, and at
    # most so many edits lie on its left as terms do, the rest on its right; edits on a side bound the shift on that side. Of
    # e edits that change a length by s at least s add or drop a character, so counts of characters differ by 2 e - s at most
    left, right = F.col("x.nth"), d - F.col("x.nth")
    near = (delta <= 0) & (-delta <= d) & (F.abs(shift) <= left) & (F.abs(delta - shift) <= right) & (flips <= 2 * d + delta)
    sides = (_bits("l") <= 2 * left - F.abs(shift)) & (_bits("r") <= 2 * right - F.abs(delta - shift)) & (F.col("x.own").isNull() | F.col("y.own").isNull() | F.expr(_AROUND))
    same = F.col("x.term") == F.col("y.term")
    # of two long texts the characters around the term are compared too; lists for the others don't carry any. Sizes of
    # what Python yields are guessed too low, so no side may be broadcast on a guess
    plain = postings(t, True, False).join(postings(short, False, False).hint("merge"), same & near)
    both_long = postings(long, True, True).join(postings(long, False, True).hint("merge"), same & near & sides)
    named = lambda found: found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    ids = named(plain).unionByName(named(both_long)).distinct()
    one, two = t.select(F.col("id").alias("a"), F.col("text").alias("a_text"), F.col("train").alias("a_train"), F.col("eval").alias("a_eval")), t.select(F.col("id").alias("b"), F.col("text").alias("b_text"), F.col("train").alias("b_train"), F.col("eval").alias("b_eval"))
    pairs = ids.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    most = f"cast(greatest(length(a_text), length(b_text)) div {FIFTH} as int)"
    pairs = pairs.withColumn("dot", _dots(F.col("a_text"), F.col("b_text"), shared)).where("dot.dot >= dot.least - 1e-3")
    pairs = pairs.withColumn("distance", F.expr(f"levenshtein(a_text, b_text, {most})")).where(f"distance between 0 and {most}")
    both = F.array(
        F.when(F.col("a_train") & F.col("b_eval"), F.struct(F.col("a_text").alias("train_text"), F.col("b_text").alias("eval_text"))),
        F.when(F.col("b_train") & F.col("a_eval") & (F.col("a_text") != F.col("b_text")), F.struct(F.col("b_text").alias("train_text"), F.col("a_text").alias("eval_text"))),
    )
    return pairs.select(F.explode(F.filter(both, lambda p: p.isNotNull())).alias("p"), "distance", F.col("dot.cosine").alias("cosine")).select("p.train_text", "p.eval_text", "distance", "cosine")


#: The edit distances on both sides of the term that two texts share, the side with fewer edits first. One of the terms of a
#: near pair passes, and what passes is a near pair, so long texts need no candidates to be gathered and fetched.
_LEFT = "levenshtein(substring(x.own, 1, x.at), substring(y.own, 1, y.at), x.nth) >= 0"
_RIGHT = f"levenshtein(substring(x.own, x.at + {TERM} + 1), substring(y.own, y.at + {TERM} + 1), cast(x.length div {FIFTH} as int) - x.nth) >= 0"
_AROUND = f"case when 2 * x.nth <= x.length div {FIFTH} then {_LEFT} and {_RIGHT} else {_RIGHT} and {_LEFT} end"


def _bits(side: str) -> Column:
    total = F.lit(0)
    for c in SIDES:
        if c[0] == side:
            total = total + F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
    return total


def _dots(a: Column, b: Column, shared) -> Column:
    @F.pandas_udf("dot double, least double, cosine double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        weights = _weights(shared.value)
        return pd.DataFrame(dict(zip(("dot", "least", "cosine"), exact_dots(list(x), list(y), weights))))

    return run(a, b)


def _members(pairs: DataFrame, train: tuple[str, ...], evals: tuple[str, ...]) -> DataFrame:
    split = clean_id(F.col("split"))
    rows = pairs.select("qa_id", split.alias("split"), clean_id(F.col("source_doc_id")).alias("source_doc_id"), "question")
    rows = rows.where(F.col("qa_id").isNotNull() & F.col("question").isNotNull() & F.col("split").isin(*train, *evals))
    return rows.select("qa_id", "split", "source_doc_id", plain_letters("question").alias("text"), F.col("split").isin(*train).alias("train")).where(F.length("text") > 0)


def _classes(members: DataFrame) -> DataFrame:
    return cut(members.groupBy("text").agg(F.bool_or("train").alias("train"), F.bool_or(~F.col("train")).alias("eval")))


def found_pairs(pairs: DataFrame, train: tuple[str, ...] = ("train_pool",), evals: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """(qa_id_a, qa_id_b): records with the same or nearly the same question, one in train, the other in dev or test.

    The smaller qa_id comes first; a record exported twice counts once. Null or blank splits, null ids and questions without
    letters and digits take no part. Of a record that stands in both splits the pair with itself is left out.
    """
    members = cut(_members(pairs, train, evals))
    near = near_texts(_classes(members))
    a = members.where("train").select(F.col("text").alias("train_text"), F.col("qa_id").alias("t"))
    b = members.where("not train").select(F.col("text").alias("eval_text"), F.col("qa_id").alias("e"))
    out = near.join(a, "train_text").join(b, "eval_text").where("t <> e")
    return out.select(F.least("t", "e").alias("qa_id_a"), F.greatest("t", "e").alias("qa_id_b")).distinct()


def overlap_classes(pairs: DataFrame, train: tuple[str, ...] = ("train_pool",), evals: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """(train_text, eval_text, distance, cosine): pairs between class representatives, a class being one folded text."""
    return near_texts(_classes(_members(pairs, train, evals))).select("train_text", "eval_text", "distance", F.round("cosine", 6).alias("cosine"))


def overlap_members(pairs: DataFrame, train: tuple[str, ...] = ("train_pool",), evals: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """(qa_id, split, text, links): every record with its class, named by the folded text, and the number of classes across the
    splits that are the same or near; 0 where there are none. With overlap_classes it says what found_pairs does, without
    multiplying copies. Cases as for found_pairs; a record exported twice is one row a class and split.
    """
    members = cut(_members(pairs, train, evals))
    near = cut(near_texts(_classes(members)))
    of = lambda c, side: near.groupBy(F.col(c).alias("text")).agg(F.count(F.lit(1)).alias("links")).withColumn("train", F.lit(side))
    links = of("train_text", True).unionByName(of("eval_text", False))
    rows = members.select("qa_id", "split", "text", "train").distinct()
    return rows.join(links, ["text", "train"], "left").select("qa_id", "split", "text", F.coalesce("links", F.lit(0)).alias("links"))


def overlap_counts(pairs: DataFrame, train: tuple[str, ...] = ("train_pool",), evals: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """(split, source_doc_id, records, same, near): evaluation records by split and source, how many stand in train the same
    after folding, and how many nearly so but not the same. Copies aren't expanded into pairs. A null source is a source.
    """
    members = cut(_members(pairs, train, evals))
    near = near_texts(_classes(members)).groupBy(F.col("eval_text").alias("text")).agg(F.min("distance").alias("distance"))
    rows = members.where("not train").select("qa_id", "split", "source_doc_id", "text").distinct().join(near, "text", "left")
    each = rows.groupBy("split", "source_doc_id", "qa_id").agg(F.min("distance").alias("distance"))
    return each.groupBy("split", "source_doc_id").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("distance") == 0).alias("same"), F.count_if(F.col("distance") > 0).alias("near"))
