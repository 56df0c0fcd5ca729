"""Operators on small tables whose results are known by hand or by a brute-force version."""

import hashlib
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.terms import chief_term, found_terms, rewrite, unsupported
from tessera.functions.text import clean_id, is_blank, squeeze
from tessera.operators import answers, catalog, chunking, dense, fusion, lexical, metrics, quality, sampling, skew, stats


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_clean_id_and_blank(spark):
    df = spark.createDataFrame([(" Sd01\t",), ("ｓｄ０１",), ("　​",), (None,), ("",), ("﻿SD 01 ",)], "x string")
    assert [r[0] for r in df.select(clean_id(F.col("x"))).collect()] == ["sd01", "sd01", None, None, None, "sd 01"]
    assert [r[0] for r in df.select(is_blank(F.col("x"))).collect()] == [False, False, True, True, True, False]
    assert df.select(squeeze(F.lit(" a　 b\n"))).first()[0] == "a b"


def test_salted_join_equals_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.col("id").alias("a"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k7", 3), (None, 4)], "key string, b int")
    for how in ("inner", "left"):
        got = skew.salted_join(left, right, "key", F.col("a"), how, least=100)
        assert rows(got.fillna(-1), "key", "a", "b") == rows(left.join(right, "key", how).fillna(-1), "key", "a", "b")


def test_spread_row_number_is_dense(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    got = skew.spread_row_number(df, "k", F.col("id"), F.col("id"), "n", 8)
    for k in (0, 1):
        assert sorted(r.n for r in got.where(F.col("k") == k).collect()) == list(range(1, 501))


def brute_bm25(queries, docs):
    def terms(t):
        t = t or ""
        import re

        return [t[i : i + 2] for i in range(len(t) - 1) if all("一" <= c <= "鿿" for c in t[i : i + 2])] + re.findall("[a-z0-9]+", t.lower())

    bags = {k: Counter(terms(t)) for k, t in docs.items()}
    n, avg = len(docs), sum(sum(b.values()) for b in bags.values()) / len(docs)
    df = Counter(t for b in bags.values() for t in b)
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    out = {}
    for q, text in queries.items():
        for d, bag in bags.items():
            s = sum(idf[t] * bag[t] * 2.5 / (bag[t] + 1.5 * (0.25 + 0.75 * sum(bag.values()) / avg)) for t in terms(text) if t in bag)
            if any(t in bag for t in terms(text)):
                out[q, d] = s
    return out


def test_bm25_against_brute_force(spark):
    rng = random.Random(3)
    words = ["心悸", "耳鸣", "便秘", "人参", "甘草", "abc", "x1"]
    docs = {f"d{i}": "，".join(rng.choices(words, k=rng.randint(1, 9))) for i in range(12)} | {"empty": "", "null": None}
    queries = {"q1": "心悸，耳鸣 abc", "q2": "甘草甘草", "q3": "", "q4": None}
    got = lexical.bm25(spark.createDataFrame(list(queries.items()), "q string, qt string"), spark.createDataFrame(list(docs.items()), "d string, dt string"), "q", "qt", "d", "dt")
    want = brute_bm25(queries, docs)
    assert {(r.q, r.d): round(r.score, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    top = lexical.top_k(got, "q", 2, F.desc(F.round("score", 9)), F.col("d"))
    assert max(r.rank for r in top.collect()) == 2


def test_dense_against_brute_force(spark):
    rng = random.Random(1)
    v = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100, None), (101, []), (102, [0.0] * 8)]
    df = spark.createDataFrame(v, "vec_id long, e array<double>")
    got = rows(dense.dense_top_k(df, df.where("vec_id % 20 = 0"), "vec_id", "e", 3), "query_id", "rank", "vec_id")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = []
    for i, a in v[:60]:
        if i % 20 == 0:
            best = sorted(((-round(cos(a, b), 9), j) for j, b in v[:60] if j != i))[:3]
            want += [(i, r + 1, j) for r, (_, j) in enumerate(best)]
    assert got == sorted(want)


def test_fusion_and_citations(spark):
    lists = spark.createDataFrame([("q", "a", "c1", 1, "p1"), ("q", "a", "c2", 2, "p1"), ("q", "a", "c3", 3, "p2"), ("q", "a", "c9", 6, "p9"), ("q", "b", "c3", 1, "p2"), ("q", "b", "c4", 2, None)], "qa_id string, strategy string, chunk_id string, place int, parent_id string")
    fused = rows(fusion.reciprocal_rank_fusion(lists), "place", "chunk_id")
    assert fused[0] == (1, "c3") and [c for _, c in fused][1] == "c1"
    assert rows(fusion.citations(lists), "strategy", "label", "chunk_id") == [("a", "E1", "c1"), ("a", "E2", "c3"), ("b", "E1", "c3")]


def test_ranking_metrics_by_hand(spark):
    lists = spark.createDataFrame([("q1", "s", 1, "d1"), ("q2", "s", 2, "d2"), ("q2", "s", 1, "x"), ("q3", "s", 11, "d3")], "qa_id string, strategy string, place int, hit_doc string")
    q = spark.createDataFrame([("q1", "test", "d1"), ("q2", "test", "d2"), ("q3", "dev", "d3")], "qa_id string, split string, doc string")
    got = {r.qa_id: r for r in metrics.per_question(lists, q).collect()}
    assert (got["q1"].recall_1, got["q2"].recall_1, got["q2"].recall_5, got["q3"].recall_10) == (1.0, 0.0, 1.0, 0.0)
    assert got["q2"].mrr_10 == 0.5 and abs(got["q2"].ndcg_10 - 1 / math.log2(3)) < 1e-12
    whole = [r for r in metrics.sheet(metrics.per_question(lists, q)).collect() if r.strategy is None]
    assert len(whole) == 1 and whole[0].n == 3


def test_graded_gain_counts_a_key_once(spark):
    hits = spark.createDataFrame([("q", 1, ["a"]), ("q", 2, ["a", "b"]), ("q", 3, ["b"])], "qa_id string, place int, keys array<string>")
    rel = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("z", "a", 1)], "qa_id string, key string, rel int")
    got = {r.qa_id: r.ndcg for r in metrics.graded_ndcg(hits, rel).collect()}
    assert abs(got["q"] - (1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3))) < 1e-12 and got["z"] == 0.0


def test_span_coverage_merges_touching_contexts(spark):
    lists = spark.createDataFrame([("q", "s", 1, "d", 0, 5), ("q", "s", 2, "d", 5, 3), ("q", "s", 3, "d", 20, 9), ("q", "s", 4, "x", 0, 99)], "qa_id string, strategy string, place int, hit_doc string, start_index int, char_count int")
    q = spark.createDataFrame([("q", "d", 2, 12)], "qa_id string, doc string, answer_start int, answer_end int")
    assert rows(metrics.span_coverage(lists, q), "covered", "coverage") == [(6, 0.6)]
    strict = metrics.span_hits(lists, q).first()
    assert (strict.span_hit, strict.span_hit_strict) == (0, 0)


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("ab中𠀀", max_size=12), st.text("ab中𠀀", max_size=12))
def test_lcs(a, b):
    assert answers.lcs(a, b) == brute_lcs(a, b) if a else True


def test_answer_scores(spark):
    p = spark.createDataFrame([(1, "人参，甘草", "甘草。"), (2, "", None), (3, "abc", ""), (4, None, "x")], "answer_id int, answer string, reference string")
    got = {r.answer_id: r.f1 for r in answers.char_f1(p, ["answer_id"], "answer", "reference").collect()}
    assert got == {1: 2 * 2 / 6, 2: 1.0, 3: 0.0, 4: 0.0}
    assert rows(p.select(answers.normalized("answer").alias("n")), "n") == [("",), ("",), ("abc",), ("人参甘草",)]


def test_kappa_and_threshold(spark):
    k = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), (None, "a")], "x string, y string")
    r = stats.kappa(k, "x", "y").first()
    assert (r.n, r.observed, r.expected, r.kappa) == (4, 0.75, 0.5, 0.5)
    assert stats.kappa(k.limit(1), "x", "y").first().kappa == 1.0
    c = spark.createDataFrame([(0.1, False), (0.4, False), (0.6, True), (3.5, True), (float("nan"), True), (None, False)], "s double, g boolean")
    assert tuple(stats.calibrate(c, "s", "g").first()) == (0.6, 1.0)


def test_bootstrap_of_equal_methods_is_zero(spark):
    d = spark.range(20).select((F.col("id") % 5).alias("doc"), F.lit(0.0).alias("delta"))
    assert tuple(stats.cluster_bootstrap(d, "doc", "delta", 50, "s").first()) == (5, 0.0, 0.0, 0.0)
    assert stats.cluster_bootstrap(d.limit(0), "doc", "delta", 50, "s").first().n == 0


def test_bootstrap_takes_all_production_resamples(spark):
    import inspect

    from tessera import queries

    assert queries._RESAMPLES == 10_000 and "_RESAMPLES" in inspect.getsource(queries.cluster_bootstrap)
    rng = random.Random(3)
    deltas = [(f"d{rng.randrange(12)}", rng.random() - 0.4) for _ in range(60)]
    by: dict = {}
    for doc, x in deltas:
        s, c = by.get(doc, (0.0, 0))
        by[doc] = s + x, c + 1
    docs = sorted(by, key=lambda d: (hashlib.sha256(f"b:{d}".encode()).hexdigest(), d))
    means = []
    for r in range(10_000):
        drawn = [by[docs[int(hashlib.sha256(f"b:{r}:{k}".encode()).hexdigest()[:12], 16) % len(docs)]] for k in range(len(docs))]
        means.append(sum(s for s, _ in drawn) / sum(c for _, c in drawn))
    means.sort()
    df = spark.createDataFrame(deltas, "doc string, delta double").repartition(3)
    got = stats.cluster_bootstrap(df, "doc", "delta", 10_000, "b").first()
    assert got.n == len(docs)
    assert (got.lower, got.upper) == pytest.approx((means[250], means[9749]), abs=1e-6)


def test_stratified_bootstraps(spark):
    import numpy as np

    rng = random.Random(8)
    a = [(f"q{i}", "x" if i < 9 else "y", i % 2, rng.random(), float(i % 3)) for i in range(23)]
    b = [(q, s, k, rng.random(), 1.0) for q, s, k, _, _ in a]
    schema = "q string, book string, kind int, m double, n double"
    da, db = (spark.createDataFrame(x, schema).repartition(3) for x in (a, b))
    got = {r.metric: r for r in stats.paired_stratified_bootstrap(da, db, "q", ["book", "kind"], ["m", "n"], 250, "s").collect()}
    deltas = {x[0]: (x[3] - y[3], x[4] - y[4]) for x, y in zip(a, b)}
    for j, name in enumerate(("m", "n")):
        r = got[name]
        assert (r.questions, r.strata) == (23, 4)
        assert r.delta == pytest.approx(np.mean([d[j] for d in deltas.values()]))
        assert r.lower <= r.delta <= r.upper and r.inconclusive == (r.lower <= 0 <= r.upper)
    # a stratum always keeps its number of draws: a value that is constant inside strata has no spread
    flat = spark.createDataFrame([(f"q{i}", "x" if i < 9 else "y", 1.0 if i < 9 else 5.0) for i in range(23)], "q string, book string, v double")
    one = stats.stratified_bootstrap(flat, "q", ["book"], ["v"], 250, "s").first()
    assert (one.lower, one.value, one.upper) == pytest.approx(((9 + 14 * 5) / 23,) * 3)
    # one stratum: the interval lies around the mean and inside the values
    v = spark.createDataFrame([(f"q{i}", "x", float(i * i)) for i in range(3)], "q string, book string, v double")
    r = stats.stratified_bootstrap(v, "q", ["book"], ["v"], 150, "s").first()
    assert r.value == pytest.approx(5 / 3) and 0 <= r.lower < r.value < r.upper <= 4
    for bad in (da.where("q <> 'q1'"), da.union(da.limit(1)), da.withColumn("kind", F.lit(3))):
        with pytest.raises(ValueError):
            stats.paired_stratified_bootstrap(bad, db, "q", ["book", "kind"], ["m"], 10, "s")
    with pytest.raises(ValueError):
        stats.stratified_bootstrap(da.withColumn("m", F.when(F.col("q") != "q1", F.col("m"))), "q", ["book"], ["m"], 10, "s")


def test_comparisons_of_methods(spark):
    data = [("d1", "q1", "A", 1.0), ("d1", "q1", "A", 0.0), ("d1", "q1", "B", 0.25), ("d2", "q2", "A", 1.0), ("d2", "q2", "B", 0.75), ("d3", "q3", "A", 1.0), ("d3", "q3", "B", None)]
    df = spark.createDataFrame(data, "doc string, q string, method string, f double")
    got = stats.comparisons(df, "doc", "q", "method", [("A", "B", ["f"]), ("A", "C", ["f"])], 40, "s").collect()
    assert [(r.method_a, r.method_b, r.metric, r.n, r.delta, r.lower, r.upper) for r in got] == [("A", "B", "f", 2, 0.25, 0.25, 0.25), ("A", "C", "f", 0, None, None, None)]


def _units(spark, *rows):
    return spark.createDataFrame([(e, "b", "书", "ch", "篇", c, n, kind, p, t) for e, c, n, kind, p, t in rows], "evidence_id string, book_id string, book_title string, chapter_id string, chapter_title string, clause_id string, clause_number int, content_type string, parent_id string, normalized_text string")


def test_character_splits_by_hand():
    assert chunking.character_splits("甲乙。丙丁。戊", 4, 0) == [(0, "甲乙"), (2, "。丙丁"), (5, "。戊")]
    assert chunking.character_splits("abcdefgh", 4, 1) == [(0, "abcd"), (3, "defg"), (6, "gh")]
    assert chunking.character_splits("ab cd\n\nef", 5, 2) == [(0, "ab cd"), (7, "ef")]
    assert chunking.character_splits("ab cd\n\nef", 4, 2) == [(0, "ab"), (3, "cd"), (7, "ef")]
    assert chunking.character_splits(" \n ", 4, 0) == []


def test_evidence_chunks_by_strategy(spark):
    units = _units(spark, ("c2", "c2", 2, "clause", "c2", "乙" * 1001), ("c1", "c1", 1, "clause", "c1", "甲" * 30), ("f1", "c1", 1, "formula", "c1", "丙" * 290))
    def made(strategy):
        return {r.chunk_id: r for r in chunking.evidence_chunks(units, strategy).collect()}

    got = made("c0")
    first = got["c0-ch-000000"]
    assert len(first.text) == 30 and first.source_evidence_ids == ["c1"] and first.clause_id is None
    assert all(r.source_evidence_ids == ["c2"] and len(r.text) <= 500 for k, r in got.items() if k != "c0-ch-000000")
    got = made("c2")
    assert set(got) == {"c2-c1-001", "c2-c2-001", "c2-c2-002", "c2-c2-003"}
    assert [got[f"c2-c2-00{i}"].char_count for i in (1, 2, 3)] == [500, 500, 161] and got["c2-c1-001"].retrieval_parent_id == "c1"
    got = made("c3")
    prefix = "书名：书\n篇名：篇\n类型：formula\n正文："
    assert got["c3-f1-001"].text == prefix + "丙" * 290 and got["c3-f1-001"].retrieval_parent_id == "c1"
    assert {len(r.text) for k, r in got.items() if k.startswith("c3-c2")} == {500, 500, len(prefix) - 1 + 1001 - 2 * (500 - len(prefix) + 1)}
    got = made("c4")
    assert sum(r.char_count - len(prefix) for k, r in got.items() if k.startswith("c4-f1")) == 290 and all(r.char_count <= 300 for r in got.values())
    assert all(r.context_text == "甲" * 30 and r.clause_id == "c1" for k, r in got.items() if k.startswith("c4-f1"))
    got = made("c5")
    assert all(r.char_count <= 300 and len(r.context_text) <= 1000 and r.text.removeprefix("书名：书\n篇名：篇\n正文：") in r.context_text for r in got.values())
    assert got["c5-ch-000000-000000"].source_evidence_ids == ["c1"] and got["c5-ch-000000-000000"].retrieval_parent_id == "c5-parent-ch-000000"
    text = "甲" * 30 + "\n" + "丙" * 290 + "\n" + "乙" * 1001
    covered = set()
    for r in got.values():
        body = r.text.split("正文：", 1)[1]
        assert text[r.start_index : r.start_index + len(body)] == body
        covered |= set(range(r.start_index, r.start_index + len(body)))
    assert {i for i, c in enumerate(text) if c != "\n"} <= covered
    with pytest.raises(ValueError):
        chunking.evidence_chunks(units, "c9")
    with pytest.raises(Exception, match="no clause"):
        chunking.evidence_chunks(units.where("evidence_id <> 'c1'"), "c4").collect()


def test_split_shares_and_samples_repeat(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("doc"))
    a = sampling.share_split(ids, "doc", 0.1, 0.15, "s")
    assert {r.split: r["count"] for r in a.groupBy("split").count().collect()} == {"dev": 100, "test": 150, "train_pool": 750}
    assert rows(a, "doc", "split") == rows(sampling.share_split(ids.repartition(7).union(ids), "doc", 0.1, 0.15, "s"), "doc", "split")
    r = sampling.round_robin(ids.withColumn("g", F.length("doc")), "g", "doc", 9, "s")
    assert Counter(x.g for x in r.collect()) == {1: 3, 2: 3, 3: 3}


def test_latest_upsert_and_maps(spark):
    t = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("k", 2, "new"), (None, 9, "x")], "key string, at int, v string")
    assert rows(catalog.latest(t, ["key"], "at"), "key", "at", "v") == [("k", 2, "new")]
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "key string, n int, v string")
    new = spark.createDataFrame([("b", 5, "y"), ("c", 6, "z")], "key string, n int, v string")
    assert rows(catalog.upsert(old, new, ["key"], ["v"]).fillna({"v": "~"}), "key", "n", "v") == [("a", 1, "x"), ("b", 2, "y"), ("c", 6, "z")]
    m = spark.range(1).select(catalog.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(9))).alias("m"))
    assert m.first().m == {"a": 1, "b": 9}


def test_quality(spark):
    a, b = spark.createDataFrame([("x",), ("y",), (None,)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert rows(quality.set_difference(a, b, "k"), "k", "side") == [("x", "left"), ("z", "right")]
    assert rows(quality.orphans(a, b, "k"), "k") == [("x",)]
    r = spark.createDataFrame([("pending", None, None, None), ("pass", "correct", "r", None), ("pass", "wrong", "r", None), ("fail", "wrong", "r", None), ("fail", "wrong", None, "c"), (None, None, None, None), ("pending", "correct", None, None)], "status string, decision string, reviewer string, comment string")
    assert [x.violation for x in quality.review_violations(r).collect()] == [None, None, "pass_not_correct", "fail_without_comment", "no_reviewer", "unknown_status", "pending_filled"]


def test_terms(spark):
    df = spark.createDataFrame([("少腹胀与腹胀",), (None,)], "t string")
    v = ["腹胀", "少腹胀", "心悸"]
    got = df.select(found_terms(F.col("t"), v).alias("f"), chief_term(F.col("t"), v).alias("c")).collect()
    assert got[0].f == ["少腹胀", "腹胀"] and got[0].c == "少腹胀" and got[1].f == [] and got[1].c is None
    one = spark.range(1).select(rewrite(F.lit(" a "), F.array(F.lit("b"), F.lit("a"), F.lit(""))).alias("r"), unsupported(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"))).alias("u")).first()
    assert one.r == "a b" and one.u == ["b"]


@settings(max_examples=100, deadline=None)
@given(st.text("甲乙。；，\n ", max_size=80), st.integers(3, 20), st.integers(0, 2))
def test_recursive_chunks_lose_nothing(text, size, overlap):
    spans = chunking.recursive_spans(text, size, overlap)
    assert all(b - a <= size for a, b in spans)
    held = set()
    for a, b in spans:
        held.update(range(a, b))
    assert all(text[i].isspace() for i in range(len(text)) if i not in held)


def test_context_window_grows_by_turns():
    assert chunking.context_window([4, 4, 2, 4, 4], 2, 10) == (1, 3)
    assert chunking.context_window([9, 1, 2, 3, 9], 2, 7) == (1, 3)
    assert chunking.context_window([5], 0, 1) == (0, 0)


def test_windows(spark):
    d = spark.createDataFrame([(1, "abcdefghij"), (2, "ab"), (3, ""), (4, None)], "doc_id int, t string")
    assert rows(chunking.windows(d, "doc_id", "t", 4, 3, "w"), "doc_id", "start_index", "chunk") == [(1, 0, "abcd"), (1, 3, "defg"), (1, 6, "ghij"), (2, 0, "ab")]


def test_safe_text():
    assert chunking.safe_text("主治心悸，用甘草三钱，久服安神。水煎服。") == "主治心悸，久服安神。"
    assert not chunking.UNSAFE.search(chunking.safe_text("研末冲服，日三服；口苦者宜之。"))


@pytest.mark.parametrize("x, want", [(None, True), ([], True), ([0.0, 0.0], True), ([1.0, float("nan")], True), ([1.0, None], True), ([0.0, 1.0], False)])
def test_unsound_vectors(spark, x, want):
    df = spark.createDataFrame([(x,)], "v array<double>")
    assert df.select(quality.unsound_vector(F.col("v"))).first()[0] is want
