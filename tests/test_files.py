"""Sources, sinks, reviews and plans on small files and tables."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import reviews
from tessera.plans import retrieve
from tessera.sources import files, sinks

S = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "c": 3}\n')
    assert rows(files.json_lines(spark, str(p), S), "a") == [(1,), (2,)]
    assert rows(files.unknown_fields(spark, str(p), S), "field", "rows") == [("c", 1)]
    assert files.torn_files(spark, str(p)).count() == 0
    p.write_text('{"a": 1}\n{"a": ')
    assert files.torn_files(spark, str(p)).count() == 1
    with pytest.raises(Exception):
        files.json_lines(spark, str(p), S).collect()
    assert rows(files.json_lines(spark, str(p), S, strict=False), "a") == [(1,)]


def test_json_array_and_sheet(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_bytes(b"\xef\xbb\xbf" + json.dumps([{"a": 1, "b": "y"}, {"a": 2}]).encode())
    assert rows(files.json_array(spark, str(p), S), "a") == [(1,), (2,)]
    c = tmp_path / "r.csv"
    c.write_text('﻿id,note\n1,"a, ""b"""\n', encoding="utf-8")
    assert rows(files.review_sheet(spark, str(c), ["id", "note"]), "id", "note") == [("1", 'a, "b"')]
    with pytest.raises(ValueError):
        files.review_sheet(spark, str(c), ["note", "id"])


BOOK = "前言\n<目录>卷一\\肺门\n<篇名>咳嗽论\n属性：1．咳者，肺病也。（按：旧本缺）\n\\x甘草汤\\x\n甘草二两，桔梗一两\n水煮服。\n2．喘者同。\n<目录>卷二\n<篇名>空\n\n<目录>卷二\n无题\n"


def test_tagged_book(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(BOOK.encode("gb18030"))
    (tmp_path / "u.txt").write_text("x", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xff\xff")
    books = files.decoded(spark, str(tmp_path))
    assert {r.path.rsplit("/")[-1]: r.encoding for r in books.collect()} == {"b.txt": "gb18030", "u.txt": "utf-8-sig", "bad.txt": None}
    s = files.tagged_sections(books.where("text is not null"))
    assert rows(s, "volume", "chapter", "title") == [("卷一", "肺门", "咳嗽论")]
    u = files.evidence_units(s)
    got = [(r.content_type, r.clause_number, r.parent_no, r.text) for r in u.orderBy("unit_no").collect()]
    assert got == [("clause", 1, 0, "咳者，肺病也。"), ("note", 1, 0, "（按：旧本缺）"), ("formula", 1, 0, "甘草汤"), ("ingredients", 1, 2, "甘草二两，桔梗一两"), ("preparation", 1, 2, "水煮服。"), ("clause", 2, 5, "喘者同。")]
    assert files.broken_units(u).count() == 0
    assert files.broken_units(u.where("content_type <> 'formula'")).count() == 2
    picked = files.selected_sections(s, [], {"咳": ["嗽"], "喘": []}, ["妇人"])
    assert [r.tags for r in picked.collect()] == [["咳"]]
    assert files.selected_sections(s, [], {"咳": []}, ["肺门"]).count() == 0
    assert files.selected_sections(s, ["咳嗽论"], {}, ["肺门"]).count() == 1
    assert rows(files.ambiguous_titles(s, ["咳嗽论", "无"]), "title", "places") == [("无", 0)]


def test_log_tail_comes_before_dropping(spark, tmp_path):
    spark.createDataFrame([(1, "{}"), (2, "{"), (3, '{"a": 1}')], "seq long, line string").write.parquet(str(tmp_path / "log"))
    assert rows(files.recent_log(spark, str(tmp_path / "log"), 2), "seq") == [(3,)]


def test_newest_folder(spark, tmp_path):
    import os

    for i, name in enumerate(("a", "b")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.json").write_text("{}")
        os.utime(tmp_path / name / "m.json", (10 - i, 1000 - 10 * i))
    assert files.newest_folder(spark, str(tmp_path), "m.json").endswith("/a")
    assert files.newest_folder(spark, str(tmp_path), "none") is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "y"), (1, None), (3, "z")], "a int, b string")
    sinks.write_json_lines(df, str(tmp_path / "j"), ["a"])
    lines = [x for p in sorted((tmp_path / "j").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"a":1,"b":null}', '{"a":2,"b":"y"}', '{"a":3,"b":"z"}']
    sinks.write_version(df, str(tmp_path / "t"))
    sinks.write_version(df.where("a > 1"), str(tmp_path / "t"), ["a"])
    assert sinks.read_version(spark, str(tmp_path / "t")).count() == 2
    assert sinks.fingerprint(df, ["a"]) == sinks.fingerprint(df.repartition(3), ["a"]) != sinks.fingerprint(df.limit(2), ["a"])
    sinks.write_manifest(spark, str(tmp_path / "m.json"), {"b": 1, "a": "中"})
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": "中", "b": 1}
    nested = T.StructType([T.StructField("id", T.StringType()), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("text", T.StringType())])))])
    assert sinks.content_columns(nested, frozenset({"text"})) == ["hits.text"]
    done = spark.createDataFrame([(1, "ok"), (2, "failed")], "a int, status string")
    assert rows(sinks.remaining(df, done, ["a"]), "a") == [(2,), (3,)]


def test_reviews(spark):
    old = spark.createDataFrame([("k1", "t", "pass"), ("k2", "t", "pass"), ("k3", "t", "pass"), ("k3", "t", "fail")], "k string, text string, status string")
    new = spark.createDataFrame([("k1", "t", None), ("k2", "u", None), ("k3", "t", None), ("k4", None, None)], "k string, text string, status string")
    got = rows(reviews.migrate(old, new, ["k"], ["text"], ["status"]), "k", "outcome", "status")
    assert got == [("k1", "inherited", "pass"), ("k2", "changed", None), ("k3", "ambiguous", None), ("k4", "added", None)]
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (9, "z")], "id int, v string")
    assert rows(reviews.altered(a, b, "id", ["v"]), "id", "column") == [(1, "v"), (3, "missing row"), (9, "foreign row")]
    r = spark.createDataFrame([("m", "yes"), ("m", "no"), ("m", "not_applicable"), ("n", None)], "m string, q string")
    assert rows(reviews.rates(r, ["m"], ["q"]), "m", "n", "q") == [("m", 3, 0.5), ("n", 1, None)]
    g = reviews.gate(spark.createDataFrame([(0.5, None)], "a double, b double"), {"a": (">=", 0.5), "b": (">", 0)})
    assert [r.passed for r in g.collect()] == [True, False]


def test_modes(spark):
    c = spark.createDataFrame([("q", "a", 3.0, 0.1), ("q", "b", 2.0, 0.9), ("q", "c", None, 0.9), ("q", "d", float("nan"), None)], "qa_id string, chunk_id string, lexical double, dense double")
    s = spark.createDataFrame([("q", "c", 9.0), ("q", "a", 1.0)], "qa_id string, chunk_id string, rerank_score double")
    order = lambda m: [r.chunk_id for r in retrieve.retrieve(c, s, m, 3).orderBy("place").collect()]
    assert order("bm25") == ["a", "b"] and order("dense") == ["b", "c", "a"]
    assert order("hybrid") == ["b", "a", "c"] and order("hybrid_rerank") == ["c", "a", "b"] and order("bm25_rerank") == ["a", "b"]
    assert retrieve.matrix(c.limit(0), s, 3).count() == 0
    assert retrieve.degrading(None, c) is c
    with pytest.raises(ValueError):
        retrieve.retrieve(c, s, "none", 3)
    assert c.select(F.col("qa_id")).count() == 4
