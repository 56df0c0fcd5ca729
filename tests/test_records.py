from pyspark.sql import functions as F

from tessera.functions import records as r
from tessera.operators import ranges


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_small_functions(spark):
    lit = F.lit
    assert one(spark, r.message_role(lit(" AI ")), r.message_role(lit("Custom")), r.message_role(lit(None).cast("string"))) == ("assistant", "custom", None)
    assert one(spark, r.question_list(F.array(lit(" a"), lit("a"), lit(""), lit("b"), lit("c"), lit("d")))) == (["a", "b", "c"],)
    assert one(spark, r.excerpt(lit("abcdefgh"), 2, 2), r.excerpt(lit("abc"), 2, 2)) == ("ab…gh", "abc")
    assert one(spark, r.labelled(lit("x\n 症状：心悸 \n症状：b"), "症状"), r.labelled(lit("x"), "症状")) == ("心悸", None)
    text = lit("head\n[E1] a\nb\n[E2] \n[E3] c")
    assert [tuple(x) for x in one(spark, r.evidence_blocks(text))[0]] == [("E1", "a\nb"), ("E3", "c")]
    assert one(spark, r.report(r.evidence_blocks(text))) == ("[E1] a\nb\n[E3] c",)
    assert one(spark, r.best_score(lit(None), lit(None), lit(2.0), lit(1.0)), r.index_name(lit("rag"), lit("v1.2-a"))) == (2.0, "rag_v1_2_a")
    assert one(spark, r.clause_ids(lit(None).cast("string"), F.array(lit("SH-001-n1"), lit("SH-001-f"), lit("x")))) == (["SH-001"],)
    assert one(spark, r.cost(lit(10), lit(1000), lit(100), 2.0, 8.0)) == (0.028,)
    parts = F.from_json(lit('[{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]'), "array<struct<type:string,text:string>>")
    assert one(spark, r.parts_text(parts), r.public_fields(F.create_map(lit("a"), lit(1), lit("__p"), lit(2), lit("c"), lit(3)), ["a", "__p"])) == ("ab", {"a": 1})


def test_model_answers(spark):
    labels = F.array(F.lit("E1"), F.lit("E2"))
    def got(x):
        v = one(spark, r.model_answer(F.lit(x), labels))[0]
        return v.answer, v.abstain, v.citations, v.violation

    assert got('```json\n{"answer": "a", "citations": ["E1", "E1"]}\n```') == ("a", False, ["E1"], None)
    assert got('{"answer": "x", "abstain": true, "citations": ["E9"]}') == (r.ABSTAIN, True, [], None)
    assert [got(x)[3] for x in ("none", '{"answer": " ", "citations": ["E1"]}', '{"answer": "a"}', '{"answer": "a", "citations": ["E3"]}')] == ["not_json", "no_answer", "no_citation", "unknown_label"]


def test_ranges_against_brute_force(spark):
    a = [("k", i, i * 37 % 900, i * 37 % 900 + i % 60) for i in range(60)]
    b = [("k", i, i * 53 % 900, i * 53 % 900 + i % 90) for i in range(60)] + [("z", 0, 0, 9999), (None, 1, 0, 9)]
    x = spark.createDataFrame(a, "k string, chunk_id int, a_start int, a_end int")
    y = spark.createDataFrame(b, "k string, unit_id int, b_start int, b_end int")
    want = sorted((i, j) for k, i, s, e in a for m, j, p, q in b if k == m and e > s and q > p and s < q and e > p)
    for cell in (16, 512):
        assert sorted((r_.chunk_id, r_.unit_id) for r_ in ranges.overlapping(x, y, "k", cell).collect()) == want
    first = ranges.sources_of(x, y, "k").where("chunk_id = 59").first()
    assert sorted(first.source_ids) == sorted(j for i, j in want if i == 59)
