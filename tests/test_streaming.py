import hashlib

from pyspark.sql import functions as F

from tessera.streaming import trace

SCHEMA = "run_id string, tool_calls string, type string, content string, name string"


def test_stream_equals_batch_and_repeats_count_once(spark, tmp_path):
    rows = [("r1", '[{"id": "c1", "name": "f"}]', "ai", "", None), ("r1", None, "tool", "out", "f"), ("r1", None, "tool", "out", "f"), ("r2", "null", "ai", "x", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.json(str(tmp_path / "in"))
    df.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    trace.write_events(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in trace.distinct_events(df).collect()) and len(got) == 2


def test_results_are_told_apart_by_ordinal_and_null_runs_by_thread(spark):
    long = "x" * 500
    rows = [
        ("r1", "t1", 1, None, "tool", "out", "f"), ("r1", "t1", 4, None, "tool", "out", "f"), ("r1", " T1", 4, None, "tool", "out", "f"),
        ("r1", "t1", 6, None, "tool", long + "a", "f"), ("r1", "t1", 8, None, "tool", long + "b", "f"),
        (None, "t1", 1, None, "tool", "out", "f"), (None, "t2", 1, None, "tool", "out", "f"), (None, " T2", 1, None, "tool", "out", "f"),
    ]
    got = trace.distinct_events(spark.createDataFrame(rows, "run_id string, thread_id string, ordinal int, tool_calls string, type string, content string, name string")).collect()
    out, cut = (hashlib.md5(x.encode()).hexdigest()[:8] for x in ("out", long))
    want = [("r1", f"tool_result:{i}:f:{h}", None) for i, h in ((1, out), (4, out), (6, cut), (8, cut))] + [(None, f"tool_result:1:f:{out}", t) for t in ("t1", "t2")]
    assert sorted(map(str, [(r.run_id, r.event_key, r.thread_id) for r in got])) == sorted(map(str, want))


def test_last_state(spark):
    e = spark.createDataFrame([("r", "pending", 1), ("r", "running", 2), ("r", "success", 2), ("s", "error", 1), (None, "error", 1)], "run string, status string, at int")
    assert sorted(tuple(r) for r in trace.last_states(e, "run", "status", "at").collect()) == [("r", "success"), ("s", "error")]


def test_server_sent(spark):
    r = spark.range(1).select(trace.server_sent(F.lit("final"), F.struct(F.lit(1).alias("a"))).alias("x")).first().x
    assert r == 'event: final\ndata: {"a":1}\n\n'
