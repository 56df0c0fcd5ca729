"""Operators on texts, gold sets, runs and quantiles: small cases, nulls, ties, empty tables."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import texts
from tessera.operators import gold, reviews, runs, safety, sampling, stats


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_texts(spark):
    assert one(spark, texts.normal_text, "甲 \r\n  乙\r\\x 某汤 \\x丙   丁 　", None) == ["甲 乙 某汤丙 丁", None]
    assert one(spark, texts.initials, "jing_yue_quan_shu", "--", "Book 12", None) == ["jyqs", "book", "b1", None]
    assert one(spark, lambda c: texts.initials(c, {"a_b": "zz"}), "a_b", "a_c") == ["zz", "ac"]
    assert one(spark, texts.title_role, "十问篇脉案", "某脉案", "脉候病机", "病机论", "头痛") == ["diagnostic_method", "case", "differential", "pathogenesis", "syndrome_pattern"]
    assert one(spark, lambda c: texts.title_tags(c, ["头痛", "便秘"], {"便秘": "大便难"}), "大便难兼头痛", "无", "") == [["头痛", "便秘"], [], []]
    assert one(spark, lambda c: texts.two_ends(c, 7), "一二三四五六七", "一二三四五六七八") == ["一二三四五六七", "一二三…六七八"]
    assert one(spark, lambda c: texts.three_parts(c, 14), "一  二", "一二三四五六七八九十甲乙丙丁戊") == ["一 二", "一二三四…六七八九…乙丙丁戊"]
    assert one(spark, texts.is_clinical, "请给出处方", "何为头痛") == [True, False]
    assert one(spark, texts.clause_of, "a-1-child-002", "x", None) == ["a-1", None, None]


def test_texts_without_treatment(spark):
    safe = lambda c: safety.safe_text(c, ["荻梅", "蕨茱"])
    got = one(
        spark, safe,
        "头痛恶寒，脉浮。用麻黄三钱，水煎服。此为表证。", "\\x病机\\x 风寒外束。\\x用药\\x 某方。后文。\\x脉象\\x 脉浮。", "荻梅味甘，脉弱，蕨茱味苦；舌红。", "某汤主之。", None, "  　", "甲，乙,丙用三钱，丁。", "。。头痛",
    )
    assert got == ["头痛恶寒，脉浮。此为表证。", "风寒外束。脉浮。", "脉弱；舌红。", "", "", "", "甲，乙，丁。", "头痛"]
    has = lambda c: safety.has_treatment(c, ["荻梅"])
    assert one(spark, has, "头痛恶寒，脉浮。", "荻梅味甘。", "\\x病机\\x风寒。", None, "某饮。", "畏某饮。", "，。") == [False, True, True, False, True, True, False]


def test_quantiles_against_sorting(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([rng.randrange(5), rng.uniform(0, 100)]) * 1.0) for g in ("a", "b", None) for _ in range(3000)] + [("one", 7.0), ("none", None)] + [("same", 3.0)] * 500
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in stats.quantiles(df, ["g"], "v", {"mid": (0.5, "between"), "high": (0.95, "nearest"), "top": (1.0, "nearest"), "low": (0.0, "between")}).collect()}
    for g in ("a", "b", None, "one", "same"):
        v = sorted(x for k, x in rows if k == g)
        assert got[g].mid == pytest.approx(median(v)) and got[g].high == v[int(np.ceil(0.95 * len(v))) - 1] and got[g].top == v[-1] and got[g].low == v[0]
    assert got["none"].mid is None and len(got) == 6
    assert stats.quantiles(df.limit(0), ["g"], "v", {"mid": (0.5, "between")}).count() == 0


def test_alternate_is_by_turns(spark):
    df = spark.createDataFrame([(f"k{i}", ("s", "t", None)[i % 3], "x") for i in range(601)], "k string, stratum string, n string")
    got = sampling.alternate(df, ["stratum"], "k", "z").withColumn("lot", sampling.lot("z", F.col("k"))).collect()
    assert len(got) == 601 and got[0].asDict().keys() >= {"k", "stratum", "n", "side"}
    for s in ("s", "t", None):
        sides = [r.side for r in sorted((r for r in got if r.stratum == s), key=lambda r: (r.lot, r.k))]
        assert sides == [("dev", "test")[i % 2] for i in range(len(sides))]


def test_gold(spark):
    q = spark.createDataFrame([("q1", "a"), ("q2", "c"), ("q3", None)], "qa_id string, doc string")
    links = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "a"), (None, "c")], "a string, b string")
    g = gold.gold_sets(q, links)
    assert sorted(tuple(r) for r in g.collect()) == [("q1", "a", 2.0), ("q1", "b", 1.0), ("q2", "c", 2.0)]
    lists = spark.createDataFrame([("q1", "s", 1, "b", "p"), ("q1", "s", 2, "x", None), ("q2", "s", 11, "c", "p"), ("q3", "s", 1, "a", "p"), ("q1", "t", 1, "b", None)], "qa_id string, strategy string, place int, hit_doc string, parent_id string")
    assert {(r.qa_id, r.strategy): r.recall for r in gold.recall_of_sets(lists, g).collect()} == {("q1", "s"): 0.5, ("q2", "s"): 0.0, ("q1", "t"): 0.5}
    parents = spark.createDataFrame([("p", "b", "text"), ("r", "x", " ")], "parent_id string, doc string, text string")
    assert {r.strategy: (r.hits, r.recovered, r.rate) for r in gold.parent_recovery(lists, parents).collect()} == {"s": (2, 1, 0.5), "t": (0, 0, None)}
    labels = spark.createDataFrame([("q1", "s", "E1", "b"), ("q1", "s", "E2", "x")], "qa_id string, strategy string, label string, hit_doc string")
    answers = spark.createDataFrame([(1, "q1", ["E1", "E2", "E9"]), (2, "q1", []), (3, None, ["E1"])], "answer_id long, qa_id string, citations array<string>")
    assert {r.answer_id: (r.cited, r.right, r.precision, r.recall) for r in gold.gold_citations(answers, labels, g).collect()} == {1: (2, 1, 0.5, 0.5), 2: (0, 0, None, 0.0)}
    assert [(r.qa_id, r.same, r.shared) for r in gold.same_ranking(lists, "s", "t").collect()] == [("q1", 0, 1)]
    docs = spark.createDataFrame([(x,) for x in "abcd"], "doc string")
    scored = spark.createDataFrame([("q1", "c", 2.0)], "qa_id string, doc string, score double")
    top = gold.filled_top(scored, q, docs, "qa_id", "doc", 2).orderBy("qa_id", "rank").collect()
    assert [(r.qa_id, r.doc, r.score) for r in top] == [("q1", "c", 2.0), ("q1", "a", 0.0), ("q2", "a", 0.0), ("q2", "b", 0.0), ("q3", "a", 0.0), ("q3", "b", 0.0)]
    tried = spark.createDataFrame([("q1", "m", " "), ("q1", "m", None), ("q2", "m", "x")], "qa_id string, method string, answer string")
    assert sorted((r.qa_id, r.method, r.attempt) for r in gold.pending(q, ["m", "n"], tried).collect()) == [("q1", "m", 3), ("q1", "n", 1), ("q2", "n", 1), ("q3", "m", 1), ("q3", "n", 1)]


def test_runs(spark):
    m = spark.createDataFrame(
        [(1, "t", None, 0, "user", "u", "human", None, None), (2, "t", "r", 1, "user", "v", "human", None, None), (3, "t", "r", 2, "assistant", " ", "ai", None, '[{"id": "c", "name": "find", "args": {"query": "x"}}]'), (4, "t", "r", 3, None, None, "tool", "find", None), (5, "t", "r", 4, "assistant", "w", "ai", None, "null")],
        "id long, thread_id string, run_id string, ordinal int, speaker string, text string, type string, name string, tool_calls string",
    )
    assert [tuple(r) for r in runs.first_said(m, "user").collect()] == [("t", "u")] and [tuple(r) for r in runs.last_said(m, "assistant").collect()] == [("t", 4, "w")]
    assert [tuple(r) for r in runs.run_slices(m).collect()] == [("t", "r", 1, 1, 4)]
    assert sorted(tuple(r) for r in runs.turn_blocks(m).collect()) == [("t", 0, 1), ("t", 1, 5)]
    assert sorted((r.place, r.text) for r in runs.appended(m).collect()) == [(0, "v"), (1, "w")]
    assert [tuple(r) for r in runs.trace_summary(m).collect()] == [("r", 1, 1, "find")]
    assert [r[0] for r in runs.calls_of(m).select(runs.call_summary(F.col("name"), F.col("query"), F.col("mode"), "find")).collect()] == ["正在使用 hybrid 模式检索中医知识：x"]
    assert runs.trace_summary(m.limit(0)).count() == 0 and runs.turn_blocks(m.limit(0)).count() == 0
    assert one(spark, runs.said, '"a\\u4e00"', "{}", None) == ["a一", None, None]


def test_review_labels(spark):
    assert one(spark, lambda c: reviews.normal_label(c, {"1": "yes"}), " 1 ", "NO", "", None, "　") == ["yes", "no", None, None, None]
    rows = spark.createDataFrame([("m", "yes", "score_1"), ("m", "not_applicable", None), ("n", None, "score_0")], "method string, ok string, full string")
    got = {r.method: tuple(r)[1:] for r in reviews.summary(rows, ["method"], {"ok": "rate"}, "full", 2).collect()}
    assert got == {"m": (2, 1, 1.0, 0, 1), "n": (1, 0, None, 1, 0)}


def test_both_ways_of_joining_query_terms_agree(spark, monkeypatch):
    from tessera.operators import lexical

    rng = random.Random(12)
    words = ["气虚", "血瘀", "痰湿", "ginseng", "tea", "阴亏"]
    docs = spark.createDataFrame([(f"d{i}", " ".join(rng.choices(words, k=rng.randrange(0, 9))), "x") for i in range(60)] + [("d60", None, "x")], "doc string, body string, term string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=3))) for i in range(9)] + [(9, None)], "q long, said string")
    score = lambda: {(r.q, r.doc): round(r.score, 9) for r in lexical.bm25(asked, docs.drop("term"), "q", "said", "doc", "body").collect()}
    few = score()
    monkeypatch.setattr(lexical, "FEW", 0)
    assert few and score() == few


def test_best_documents_block_by_block_are_those_of_all_pairs(spark, monkeypatch):
    from tessera.operators import lexical

    rng = random.Random(13)
    words = ["气虚", "血瘀", "痰湿", "ginseng", "tea", "阴亏", "x"]
    body = lambda: rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 9)))])
    docs = spark.createDataFrame([(f"d{i}", body(), body()) for i in range(90)], "doc string, body string, title string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices([*words, "z"], k=3))) for i in range(9)] + [(9, None), (10, "z")], "q long, said string")
    order = (F.desc(F.round("score", 9)), F.col("doc"))
    rows = lambda df: {(r.q, r.doc, r["rank"]): round(r.score, 9) for r in df.collect()}
    for server, boosts in ((False, {"body": 1.0}), (True, {"body": 3.0, "title": 2.0})):
        parts = [lexical.bm25(asked, docs.where(F.col(f).isNotNull()), "q", "said", "doc", f, server).withColumn("score", F.col("score") * b) for f, b in boosts.items()]
        pairs = parts[0].unionByName(parts[-1]).groupBy("q", "doc").agg(F.max("score").alias("score"))
        want = rows(lexical.top_k(pairs, "q", 5, *order))
        for block, part, cells in ((8192, 1 << 22, 1 << 20), (3, 40, 30)):
            monkeypatch.setattr(lexical, "BLOCK", block)
            monkeypatch.setattr(lexical, "PART", part)
            monkeypatch.setattr(lexical, "CELLS", cells)
            got = lexical.bm25_top_k(asked, docs, "q", "said", "doc", boosts, 5, server, also=["d0", "d1"])
            assert want and rows(lexical.top_k(got, "q", 5, *order)) == want
            kept = F.col("doc").isin("d0", "d1")
            assert sorted((r.q, r.doc) for r in got.where(kept).collect()) == sorted((r.q, r.doc) for r in pairs.where(kept).collect())
    low = lexical.bm25_top_k(asked.where("q < 0"), docs, "q", "said", "doc", {"body": 1.0}, 5)
    assert low.count() == 0 and lexical.bm25_top_k(asked, docs.limit(0), "q", "said", "doc", {"body": 1.0}, 5).count() == 0
    few = spark.createDataFrame([("a", "tea tea x"), ("b", "tea")], "doc string, body string")  # each term in half of the documents or more
    got = {(r.q, r.doc): (round(r.score, 9), r.shared) for r in lexical.bm25_top_k(asked, few, "q", "said", "doc", {"body": 1.0}, 5, counted=True).collect()}
    said, held = {r.q: set((r.said or "").split()) for r in asked.collect()}, {"a": {"tea", "x"}, "b": {"tea"}}
    assert got == {(r.q, r.doc): (round(r.score, 9), len(said[r.q] & held[r.doc])) for r in lexical.bm25(asked, few, "q", "said", "doc", "body").collect()}
