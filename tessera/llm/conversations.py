"""Conversations rebuilt from message rows, checked by a finite-state automaton that runs over blocks of a thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_blank
from tessera.session import cut

#: Ordinals of one block. A thread of any length is cut into blocks, so no task gets a whole long thread.
BLOCK = 4096

# How roles and types name the speakers.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "system": "system", "tool": "tool"}
TYPES = {"human": "user", "ai": "assistant", "system": "system", "tool": "tool"}

# The automaton. Symbols: u and a, a turn of the user or the assistant; - , a message outside the conversation; x, a
# message whose speaker can't be told or is contradictory. States: 0 nothing said, 1 the user waits, 2 answered, 3 and 4
# the same after a reply was once missing, 5 broken for good.
SYMBOLS = "ua-x"
STATES = 6
NEXT = (
    (1, 5, 0, 5),
    (3, 2, 1, 5),
    (1, 2, 2, 5),
    (3, 4, 3, 5),
    (3, 4, 4, 5),
    (5, 5, 5, 5),
)


def _named(c: Column, names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))


def speaker(role: Column, type_: Column) -> Column:
    """user, assistant, system or tool; null where neither tells it or the two contradict each other."""
    a, b = _named(role, ROLES), _named(type_, TYPES)
    return F.when(a.isNull() | b.isNull() | (a == b), F.coalesce(a, b))


def message_text(content: Column) -> Column:
    """The text of a message's JSON: a string, an object with text or content, or a list of such parts, joined.

    Null for null, JSON null and what has no text; content that isn't JSON counts as its own text.
    """
    c = F.trim(content)
    part = lambda e: F.when(e.startswith("{"), F.coalesce(F.get_json_object(e, "$.text"), F.get_json_object(e, "$.content"), F.lit(""))).otherwise(F.coalesce(e, F.lit("")))
    parts = F.array_join(F.transform(F.from_json(c, "array<string>"), part), "")
    return (
        F.when(c == "null", F.lit(None).cast("string"))
        .when(c.startswith('"'), F.coalesce(F.get_json_object(F.concat(F.lit('{"t":'), c, F.lit("}")), "$.t"), content))
        .when(c.startswith("["), F.coalesce(parts, content))
        .when(c.startswith("{"), F.coalesce(F.get_json_object(c, "$.text"), F.get_json_object(c, "$.content"), F.when(F.get_json_object(c, "$").isNull(), content)))
        .otherwise(content)
    )


def calls_no_tool(tool_calls: Column) -> Column:
    """tool_calls is null, JSON null or an empty list."""
    return F.coalesce(F.regexp_replace(tool_calls, r"\s", "").isin("", "null", "[]"), F.lit(True))


def thread_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def _messages(messages: DataFrame, with_text: bool) -> DataFrame:
    """One row a message: (thread_id, ordinal, symbol[, speaker, text]); duplicates are one message.

    Of several rows of one message, the one received first stands, ties going to the smaller id.
    """
    text = message_text(F.col("content"))
    who = speaker(F.col("role"), F.col("type"))
    in_talk = who.isin("user", "assistant") & calls_no_tool(F.col("tool_calls"))
    symbol = F.when(who.isNull(), "x").when(in_talk & ~is_blank(F.col("text")), F.when(who == "user", "u").otherwise("a")).otherwise("-")
    same = F.coalesce(F.concat(F.lit("m"), F.col("message_id")), F.concat_ws("\x00", F.lit("o"), F.col("ordinal").cast("string"), F.md5(F.col("content").cast("binary"))))
    rows = messages.where(F.col("thread_id").isNotNull()).withColumn("text", text)
    what = ["ordinal", "symbol"] + (["speaker", "text"] if with_text else [])
    rows = rows.select(thread_key(F.col("thread_id")).alias("thread_id"), same.alias("same"), F.col("received_at"), F.col("id"), F.col("ordinal").cast("long").alias("ordinal"), symbol.alias("symbol"), *([who.alias("speaker"), F.when(symbol.isin("u", "a"), F.col("text")).alias("text")] if with_text else []))
    first = F.min_by(F.struct(*what), F.struct(F.coalesce(F.col("received_at"), F.timestamp_seconds(F.lit(2**40))), F.coalesce(F.col("id"), F.lit(2**62)))).alias("m")
    return rows.groupBy("thread_id", "same").agg(first).select("thread_id", "m.*")


def _states(messages: DataFrame, block: int) -> DataFrame:
    """(thread_id, kept, state, whole): the automaton's end state of each thread that has messages."""
    # one symbol an ordinal; a repeated ordinal breaks the thread, so there its symbol doesn't matter
    spots = messages.groupBy("thread_id", "ordinal").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("symbol"), F.count_if(F.col("symbol").isin("u", "a")).alias("kept"))
    at = F.floor(F.coalesce(F.col("ordinal"), F.lit(-1)) / block).alias("block")
    blocks = spots.groupBy("thread_id", at).agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "symbol"))).alias("spots"),  # at most `block` of them
        F.sum("n").alias("n"), F.count("ordinal").alias("distinct"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.sum("kept").alias("kept"),
    )
    # the block as a function from state to state: one byte a state, so blocks compose in order
    table = F.array(*[F.array(*[F.lit(NEXT[s][k]) for s in range(STATES)]) for k in range(len(SYMBOLS))])
    step = lambda f, spot: F.transform(f, lambda s: F.element_at(F.element_at(F.col("table"), F.instr(F.lit(SYMBOLS), spot["symbol"])), s + 1))
    start = F.array(*[F.lit(s) for s in range(STATES)])
    blocks = blocks.withColumn("table", table).withColumn("f", F.aggregate("spots", start, step)).drop("spots", "table")
    ends = blocks.groupBy("thread_id").agg(
        F.sort_array(F.collect_list(F.struct("block", "f"))).alias("fs"),  # one for every `block` ordinals
        F.sum("n").alias("n"), F.sum("distinct").alias("distinct"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("kept").alias("kept"),
    )
    state = F.aggregate("fs", F.lit(0), lambda s, b: F.element_at(b["f"], s + 1))
    whole = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("distinct") == F.col("n"))
    return ends.select("thread_id", "kept", state.alias("state"), whole.alias("whole"))


def _verdicts(threads: DataFrame, messages: DataFrame, block: int) -> DataFrame:
    ids = threads.where(F.col("thread_id").isNotNull()).select(thread_key(F.col("thread_id")).alias("thread_id")).distinct()
    reason = (
        F.when(F.coalesce(F.col("kept"), F.lit(0)) == 0, "empty")
        .when(~F.coalesce("whole", F.lit(False)) | (F.col("state") == 5), "broken")
        .when(F.col("state").isin(1, 3, 4), "missing_reply")
    )
    return ids.join(_states(messages, block), "thread_id", "left").select("thread_id", reason.alias("reason"))


def left_out(threads: DataFrame, messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(thread_id, reason): threads that are no whole conversation, and why: empty, broken or missing_reply.

    thread_id in lower case; threads listed twice count once; a null thread_id is no thread. Messages of a thread that
    isn't listed take no part. Messages with a null ordinal break their thread. Text of blanks and invisible characters is
    no turn. Extra columns aren't read. Without messages every thread is empty.
    """
    return _verdicts(threads, _messages(messages, with_text=False), block).where(F.col("reason").isNotNull())


def conversations(threads: DataFrame, messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(thread_id, turn, speaker, text): the turns, numbered from 0, of the threads that are whole conversations.

    The number comes from counts of whole blocks of ordinals and a window inside the block, so a thread of any length is
    spread over tasks. Cases as for left_out.
    """
    m = cut(_messages(messages, with_text=True))  # read for the verdicts and for the turns
    good = _verdicts(threads, m.drop("speaker", "text"), block).where(F.col("reason").isNull()).select("thread_id")
    turns = m.where(F.col("symbol").isin("u", "a")).withColumn("block", F.floor(F.col("ordinal") / block))
    counts = turns.groupBy("thread_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("thread_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("thread_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    offsets = offsets.join(good, "thread_id", "left_semi")
    inside = F.row_number().over(Window.partitionBy("thread_id", "block").orderBy("ordinal")) - 1
    return turns.withColumn("i", inside).join(offsets, ["thread_id", "block"]).select("thread_id", (F.col("i") + F.col("offset")).cast("int").alias("turn"), "speaker", "text")
