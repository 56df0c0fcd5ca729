"""Messages by thread and run: offsets, blocks of turns, first and last texts, traces, appended turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_blank

CALLS = "array<struct<id: string, name: string, args: struct<query: string, mode: string>>>"


def said(content: Column) -> Column:
    """The text of a message's content where it is one JSON string; null for other shapes."""
    whole = F.get_json_object(F.concat(F.lit('{"t":'), F.trim(content), F.lit("}")), "$.t")
    return F.when(F.trim(content).startswith('"'), whole)


def first_said(messages: DataFrame, role: str) -> DataFrame:
    """(thread_id, text): the first text of a speaker in each thread that isn't blank, by ordinal and id."""
    some = messages.where((F.col("speaker") == role) & ~is_blank(F.col("text")))
    return some.groupBy("thread_id").agg(F.min_by("text", F.struct("ordinal", "id")).alias("text"))


def last_said(messages: DataFrame, role: str) -> DataFrame:
    """(thread_id, ordinal, text): the last one."""
    some = messages.where((F.col("speaker") == role) & ~is_blank(F.col("text")))
    return some.groupBy("thread_id").agg(F.max("ordinal").alias("ordinal"), F.max_by("text", F.struct("ordinal", "id")).alias("text"))


def run_slices(messages: DataFrame) -> DataFrame:
    """(thread_id, run_id, start, before, messages): the first ordinal of each run, how many messages of its thread lie before it,
    and how many messages at or behind it belong to the run."""
    per = messages.groupBy("thread_id", "ordinal", "run_id").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("thread_id").orderBy("ordinal").rangeBetween(Window.unboundedPreceding, -1)
    placed = per.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = placed.where("run_id is not null")
    return own.groupBy("thread_id", "run_id").agg(F.min("ordinal").alias("start"), F.min_by("before", "ordinal").alias("before"), F.sum("n").alias("messages"))


def turn_blocks(messages: DataFrame) -> DataFrame:
    """(thread_id, start, end): each user turn with where its block ends: at the next user turn, or behind the thread's last message.

    ``messages`` (thread_id, ordinal, speaker); a null ordinal is no place.
    """
    last = messages.groupBy("thread_id").agg((F.max("ordinal") + 1).alias("whole"))
    starts = messages.where("speaker = 'user' and ordinal is not null").select("thread_id", F.col("ordinal").alias("start")).distinct()
    after = Window.partitionBy("thread_id").orderBy("start")
    return starts.withColumn("next", F.lead("start").over(after)).join(last, "thread_id").select("thread_id", "start", F.coalesce("next", "whole").alias("end"))


def appended(messages: DataFrame) -> DataFrame:
    """(thread_id, run_id, place, role, text): what each run adds to its thread's conversation: the first user text (place 0), then
    the last assistant text with the run's id (place 1); blank ones are left out."""
    named = messages.where(F.col("run_id").isNotNull() & ~is_blank(F.col("text")))
    user = named.where("speaker = 'user'").groupBy("thread_id", "run_id").agg(F.min_by("text", F.struct("ordinal", "id")).alias("text"))
    other = named.where("speaker = 'assistant'").groupBy("thread_id", "run_id").agg(F.max_by("text", F.struct("ordinal", "id")).alias("text"))
    return user.select("thread_id", "run_id", F.lit(0).alias("place"), F.lit("user").alias("role"), "text").unionByName(other.select("thread_id", "run_id", F.lit(1).alias("place"), F.lit("assistant").alias("role"), "text"))


def calls_of(messages: DataFrame) -> DataFrame:
    """(id, thread_id, run_id, call_id, name, query, mode): the tool calls inside messages."""
    calls = messages.where(F.col("tool_calls").startswith("[")).select("id", "thread_id", "run_id", F.explode(F.from_json("tool_calls", CALLS)).alias("c"))
    return calls.select("id", "thread_id", "run_id", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.args.query").alias("query"), F.col("c.args.mode").alias("mode"))


def call_summary(name: Column, query: Column, mode: Column, search: str) -> Column:
    """What is shown while a tool runs: the search tool with its mode and query, others by their name."""
    q, m = F.coalesce(query, F.lit("")), F.coalesce(mode, F.lit("hybrid"))
    return F.when(name == search, F.concat(F.lit("正在使用 "), m, F.lit(" 模式检索中医知识："), q)).otherwise(F.concat(F.lit("正在调用工具："), name))


def trace_summary(messages: DataFrame) -> DataFrame:
    """(run_id, calls, results, tools): how many tools a run called, how many answered, and which, in order of name."""
    calls = calls_of(messages).where("run_id is not null").groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"))
    results = messages.where("run_id is not null and type = 'tool'").groupBy("run_id").agg(F.count(F.lit(1)).alias("results"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tools"))
    both = calls.join(results, "run_id", "full")
    return both.select("run_id", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("tools", F.lit("")).alias("tools"))


def added_by_id(messages: DataFrame) -> DataFrame:
    """(thread_id, message_id, place, version): messages added by id: a later delivery replaces the content, the place stays that
    of the first; ``version`` is the id of the row that stands."""
    some = messages.where("thread_id is not null and message_id is not null")
    return some.groupBy("thread_id", "message_id").agg(F.min("ordinal").alias("place"), F.max_by("id", F.struct("received_at", "id")).alias("version"))


def payloads(messages: DataFrame, kind: str) -> DataFrame:
    """(name, results, payloads): tool messages by tool, and how many hold a JSON object of the given type."""
    held = F.coalesce(F.get_json_object("content", "$.type") == kind, F.lit(False))
    return messages.where("type = 'tool'").groupBy("name").agg(F.count(F.lit(1)).alias("results"), F.count_if(held).alias("payloads"))
