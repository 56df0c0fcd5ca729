"""Trace events and run states, in batches and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import clean_id

CALLS = "array<struct<id:string,name:string>>"


def trace_events(messages: DataFrame) -> DataFrame:
    """(run_id, event_key, event, thread_id): calls of tools and their results, each known by its key.

    tool_call:{id}:{name} for a call, tool_result:{ordinal}:{name}:{first 8 digits of the MD5 of the first 500 characters} for a
    result; the ordinal tells results apart that say the same or begin alike. thread_id, cleaned, is given only where run_id
    is null, and keeps such events of different threads apart. Messages without an ordinal have none in their keys.
    """
    thread = clean_id(F.col("thread_id")) if "thread_id" in messages.columns else F.lit(None).cast("string")
    ordinal = F.col("ordinal").cast("string") if "ordinal" in messages.columns else F.lit(None).cast("string")
    messages = messages.withColumns({"thread_id": F.when(F.col("run_id").isNull(), thread), "ordinal": ordinal})
    calls = messages.where("tool_calls is not null").select("run_id", "thread_id", F.explode(F.from_json("tool_calls", CALLS)).alias("c")).select("run_id", F.concat_ws(":", F.lit("tool_call"), "c.id", "c.name").alias("event_key"), F.lit("tool_call").alias("event"), "thread_id")
    short = F.substring(F.md5(F.substring("content", 1, 500).cast("binary")), 1, 8)
    results = messages.where("lower(trim(type)) = 'tool'").select("run_id", F.concat_ws(":", F.lit("tool_result"), "ordinal", F.coalesce("name", F.lit("")), short).alias("event_key"), F.lit("tool_result").alias("event"), "thread_id")
    return calls.unionByName(results)


def distinct_events(messages: DataFrame) -> DataFrame:
    """Each event of a run, or of a thread where the run is null, once, however often its messages are seen; for batches and
    streams."""
    return trace_events(messages).dropDuplicates(["run_id", "thread_id", "event_key"])


def write_events(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append new events of a stream of messages to a table, exactly once, and stop when all there is has been read."""
    return distinct_events(messages).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_state(status: Column) -> Column:
    """Order of the states of a run; a later one is never left for an earlier one."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in zip(("pending", "running", "waiting_clarification", "success", "error", "cancelled"), range(6)) for x in kv]), status)


def last_states(events: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """(key, status): the last state of each run; of states of one moment the one further on."""
    return events.where(F.col(key).isNotNull() & F.col(status).isNotNull()).groupBy(key).agg(F.max_by(status, F.struct(at, run_state(F.col(status)), F.col(status))).alias(status))


def server_sent(event: Column, data: Column) -> Column:
    """The lines of one server-sent event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))
