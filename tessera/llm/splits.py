"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import clean_id
from tessera.operators.skew import salted_join
from tessera.session import cut

#: Rounds in which the weights of the splits are fitted to the wanted shares, and the deviation that needs none.
ROUNDS, CLOSE = 12, 0.002


def _minima(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("v").agg(F.min("u").alias("m"))


def components(edges: DataFrame, a: str, b: str, rounds: int = 60, salts: int = 32, least: int = 20_000) -> DataFrame:
    """(node, component) of every node that stands in an edge; the component is named by its smallest node.

    Hash-to-min: every node holds a cluster, at first itself and its neighbours, as rows (v, u). In a round each node sends
    its cluster to the smallest member and the smallest member to all others. Clusters settle after a number of rounds
    that grows with the logarithm of the longest path; then the smallest node of a component holds all of it. The row
    form needs no collected clusters, and the rows of a large cluster are salted for the join with its minimum. Every
    round is written to the shared folder.

    Nulls make no edge; loops keep their node; repeated and two-way edges count once; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
    loops = both.select("v", F.col("v").alias("u"))
    clusters = cut(both.unionByName(loops).distinct())
    seen = _fingerprint(clusters)
    for _ in range(rounds):
        held = salted_join(clusters, _minima(clusters), "v", F.col("u"), salts=salts, least=least)
        sent = held.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.v", "x.u")
        clusters = cut(sent.distinct())
        now = _fingerprint(clusters)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return clusters.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("node"), F.least("v", "m").alias("component"))


def _fingerprint(clusters: DataFrame) -> tuple:
    """Count and two independent sums of row hashes: equal for equal sets, and for others only by a 128-bit accident."""
    h = [F.sum(F.xxhash64("v", "u", F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(clusters.agg(F.count(F.lit(1)), *h).first())


def related_groups(records: DataFrame, links: DataFrame, key: str, link_a: str, link_b: str) -> DataFrame:
    """(doc, component) of all documents of records and links, ids without case, width and outer blanks."""
    pairs = links.select(clean_id(F.col(link_a)).alias("a"), clean_id(F.col(link_b)).alias("b"))
    found = components(pairs, "a", "b")
    docs = records.select(clean_id(F.col(key)).alias("doc")).where("doc is not null").distinct()
    linked = found.select(F.col("node").alias("doc"), "component")
    return docs.join(linked, "doc", "full").select("doc", F.coalesce("component", "doc").alias("component"))


def broken_documents(records: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """(source_doc_id): documents, as ``documents`` writes them, whose group has records in more than one split today.

    Only documents with at least one record that has a split. Null or blank ids and splits count as none.
    """
    r = records.select(clean_id(F.col("source_doc_id")).alias("doc"), clean_id(F.col("split")).alias("now")).where("doc is not null and now is not null").groupBy("doc").agg(F.min("now").alias("lo"), F.max("now").alias("hi"))
    groups = related_groups(records, links, "source_doc_id", "source_doc_id", "linked_doc_id")
    r = r.join(groups, "doc")
    mixed = r.groupBy("component").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("component")
    inside = salted_join(r.select("doc", "component"), mixed, "component", F.col("doc"))
    names = documents.select("source_doc_id", clean_id(F.col("source_doc_id")).alias("doc")).where("doc is not null").groupBy("doc").agg(F.min("source_doc_id").alias("source_doc_id"))
    return names.join(inside, "doc").select("source_doc_id")


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from 48 bits of SHA-256, the same on every engine."""
    return (F.conv(F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def _winner(draws: Column, weights: dict[str, float]) -> Column:
    """The split with the largest -weight / ln(h), which is the one with the least draw a weight."""
    races = [F.struct((draws[i] / F.lit(w)).alias("at"), F.lit(s).alias("split")) for i, (s, w) in enumerate(weights.items()) if w > 0]
    return F.least(*races, races[0])["split"]


def _fit(free: DataFrame, target: dict[str, float]) -> dict[str, float]:
    """Weights by which rendezvous hashing gives each split about its target of rows: every round counts what the weights
    would give and scales them by what is wanted of it. The best round stands. Only one number a split comes to the driver."""
    whole = math.fsum(target.values())
    weights, best = {s: x / whole for s, x in target.items()}, None
    for _ in range(ROUNDS):
        got = {r[0]: float(r[1]) for r in free.groupBy(_winner(F.col("draws"), weights).alias("split")).agg(F.sum("n")).collect()}
        rows = math.fsum(got.values())
        if not rows:
            return weights
        off = max(abs(got.get(s, 0.0) / rows - x / whole) for s, x in target.items())
        if best is None or off < best[0]:
            best = (off, weights)
        if off <= CLOSE:
            break
        scaled = {s: w * (target[s] / whole / max(got.get(s, 0.0) / rows, 1e-6)) ** 0.7 if w > 0 else 0.0 for s, w in weights.items()}
        weights = {s: w / math.fsum(scaled.values()) for s, w in scaled.items()}
    return best[1]


def assign_splits(records: DataFrame, links: DataFrame, plan: DataFrame, key: str = "qa_id", doc: str = "source_doc_id", held: DataFrame | None = None) -> DataFrame:
    """(key, doc, component, new_split): a new split for every record, one for all records of a component.

    Weighted rendezvous hashing: a component goes to the split with the largest -weight / ln(h), h a hash of component and
    split, whatever its size. The weights are fitted so that the splits get about the shares of the plan in records; a
    changed weight moves only as many components as it must. ``held`` (key, new_split), the result of an earlier run, is
    kept: a component with held records stays where most of them are (ties to the smaller name), so new records move no old
    ones unless a new link joins what was apart; the weights then see to the room that is left.

    A record without a document is a component of its own, by its key. ``plan`` (split, share) is a fixed table of a few
    rows; splits with a null name or no share get nothing, and a plan without any is an error. Records exported twice get the
    same split twice.
    """
    groups = related_groups(records, links, doc, doc, "linked_doc_id")
    r = records.select(F.col(key), F.col(doc), clean_id(F.col(doc)).alias("doc"))
    r = cut(salted_join(r, groups, "doc", F.col(key), how="left").withColumn("component", F.coalesce("component", F.concat(F.lit("\x00"), F.coalesce(F.col(key).cast("string"), F.lit(""))))).drop("doc"))
    shares = {str(s): float(w) for s, w in plan.where("split is not null and share > 0").groupBy("split").agg(F.max("share")).orderBy("split").collect()}
    if not shares:
        raise ValueError("the plan has no split with a share")
    draws = F.array(*[-F.ln(uniform(F.col("component"), F.lit(s))) for s in shares])
    sizes = r.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    if held is not None:
        earlier = held.where(F.col(key).isNotNull() & F.col("new_split").isin(list(shares))).groupBy(key).agg(F.min("new_split").alias("was"))
        most = r.select(key, "component").distinct().join(earlier, key).groupBy("component", "was").agg(F.count(F.lit(1)).alias("of"))
        most = most.groupBy("component").agg(F.min_by("was", F.struct(-F.col("of"), F.col("was"))).alias("was"))
        sizes = sizes.join(most, "component", "left")
    else:
        sizes = sizes.withColumn("was", F.lit(None).cast("string"))
    sizes = cut(sizes.withColumn("draws", draws))
    taken = {x[0]: float(x[1]) for x in sizes.groupBy("was").agg(F.sum("n")).collect()}
    whole, total = math.fsum(shares.values()), math.fsum(taken.values())
    target = {s: max(0.0, w / whole * total - taken.get(s, 0.0)) for s, w in shares.items()}
    weights = _fit(sizes.where("was is null"), target if any(target.values()) else shares)
    chosen = sizes.select("component", F.coalesce("was", _winner(F.col("draws"), weights)).alias("new_split"))
    named = F.when(~F.col("component").startswith("\x00"), F.col("component")).alias("component")
    return salted_join(r, chosen, "component", F.col(key), how="left").select(key, doc, named, "new_split")


def split_report(assigned: DataFrame, plan: DataFrame) -> DataFrame:
    """(split, share, records, got): the wanted and the reached share of each split."""
    n = assigned.groupBy(F.col("new_split").alias("split")).agg(F.count(F.lit(1)).alias("records"))
    wanted = plan.groupBy("split").agg(F.max("share").alias("share"))
    both = wanted.join(n, "split", "left").select("split", "share", F.coalesce("records", F.lit(0)).alias("records"))
    return both.withColumn("got", F.col("records") / F.sum("records").over(Window.partitionBy(F.lit(1))))  # one row a split
