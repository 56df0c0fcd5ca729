"""Small functions of the retrieval service's records: messages, reports, model output, excerpts, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import is_blank

# Names of speakers as clients and models write them.
SPEAKERS = {"human": "user", "user": "user", "ai": "assistant", "assistant": "assistant", "system": "system", "tool": "tool"}
#: Text of an answer that declines.
ABSTAIN = "证据不足"


def message_role(type_: Column) -> Column:
    """user, assistant, system or tool; other types keep their name in lower case."""
    low = F.lower(F.trim(type_))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv]), low), low)


def parts_text(parts: Column) -> Column:
    """The texts of a list of content parts (type, text), joined; parts of other types fall out."""
    return F.array_join(F.transform(F.filter(parts, lambda p: F.coalesce(p["type"] == "text", F.lit(True)) & p["text"].isNotNull()), lambda p: p["text"]), "")


def question_list(items: Column, most: int = 3) -> Column:
    """Questions trimmed, without blanks and repeats, at most three."""
    bare = F.transform(items, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: x.isNotNull() & (x != ""))), 1, most)


def excerpt(text: Column, head: int, tail: int) -> Column:
    """A text, or where it is longer than both its head and tail around an ellipsis."""
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("…"), F.substring(text, F.length(text) - tail + 1, F.lit(tail))))


def labelled(text: Column, label: str) -> Column:
    """What follows "label：" on the first line that begins so; null where none does."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    hits = F.filter(lines, lambda x: x.startswith(f"{label}：") | x.startswith(f"{label}:"))
    return F.trim(F.substring(F.get(hits, F.lit(0)), len(label) + 2, F.lit(2**30)))


def evidence_blocks(report: Column, most: int = 5) -> Column:
    """Blocks (label, text) of a report: a line [E1] … [E5] opens one, the lines up to the next belong to it; blocks without text
    fall out."""
    blocks = F.slice(F.split(F.concat(F.lit("\n"), report), r"\n(?=\[E[1-5]\])"), 2, most)
    both = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"^\[(E[1-5])\]", 1).alias("label"), F.regexp_replace(F.regexp_replace(b, r"^\[E[1-5]\]", ""), r"(?U)^\s+|\s+$", "").alias("text")))
    return F.filter(both, lambda b: b["text"] != "")


def report(rows: Column) -> Column:
    """The text of labelled results (label, text), one block each; the inverse of evidence_blocks."""
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), r["label"], F.lit("] "), r["text"])), "\n")


ANSWER = "struct<answer:string,abstain:boolean,citations:array<string>>"


def model_answer(output: Column, labels: Column) -> Column:
    """(answer, abstain, citations, violation) of a model's JSON, fenced or not: what lies between the outer braces.

    Declining is written one way and cites nothing. Violations: not_json, no_answer, no_citation, unknown_label.
    """
    body = F.regexp_extract(output, r"(?s)(\{.*\})", 1)
    a = F.from_json(body, ANSWER)
    abstain = F.coalesce(a["abstain"], F.lit(False))
    cited = F.coalesce(F.array_distinct(a["citations"]), F.array().cast("array<string>"))
    violation = (
        F.when(a.isNull() | (a["answer"].isNull() & a["abstain"].isNull() & a["citations"].isNull()), "not_json")
        .when(abstain, F.lit(None).cast("string"))
        .when(is_blank(a["answer"]), "no_answer")
        .when(F.size(cited) == 0, "no_citation")
        .when(F.size(F.array_except(cited, labels)) > 0, "unknown_label")
    )
    return F.struct(F.when(abstain, ABSTAIN).otherwise(a["answer"]).alias("answer"), abstain.alias("abstain"), F.when(abstain, F.array().cast("array<string>")).otherwise(cited).alias("citations"), violation.alias("violation"))


def best_score(rerank: Column, fused: Column, dense: Column, lexical: Column) -> Column:
    """The reranker's score, else the fused, else the dense, else the lexical one."""
    return F.coalesce(rerank, fused, dense, lexical)


def clause_ids(own: Column, evidence_ids: Column) -> Column:
    """A chunk's own clause, else the clauses in its evidence ids, once each in order."""
    found = F.array_distinct(F.filter(F.transform(evidence_ids, lambda e: F.regexp_extract(e, r"^([A-Za-z]+-\d+)", 1)), lambda x: x != ""))
    return F.when(own.isNotNull(), F.array(own)).otherwise(found)


def index_name(alias: Column, version: Column) -> Column:
    """Name of an index version; dots and dashes of the version become underscores."""
    return F.concat_ws("_", alias, F.translate(version, ".-", "__"))


def cost(calls: Column, tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price of calls with so many tokens each, prices a million tokens."""
    return calls * (tokens_in * price_in + tokens_out * price_out) / 1e6


def public_fields(values: Column, allowed: list[str]) -> Column:
    """A map without fields that aren't allowed and without private ones, whose names begin with two underscores."""
    return F.map_filter(values, lambda k, v: k.isin(allowed) & ~k.startswith("__"))


def vector_literal(vector: Column) -> Column:
    """A vector as text between brackets, six decimals each; null for null."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]"))
