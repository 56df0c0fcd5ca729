"""Texts into parents and chunks: windows, sentences, recursive separators, safety filter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where sentences end, as a Java and RE2 class.
ENDS = "。！？!?；;\\n"
# Fixed value: separators of the recursive splitter, from the coarsest to none.
SEPARATORS = ("\n\n", "\n", "。", "；", "，", "")


def windows(docs: DataFrame, key: str, text: str, size: int, step: int, strategy: str) -> DataFrame:
    """(key, strategy, chunk_no, start_index, char_count, chunk): windows of ``size`` every ``step`` characters; the last one
    that starts is the first to reach the end. Null and empty texts give none."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int"))
    rows = docs.where(n > 0).select(key, F.col(text).alias("t"), F.posexplode(starts).alias("chunk_no", "k"))
    start = F.col("k") * step
    return rows.select(key, F.lit(strategy).alias("strategy"), "chunk_no", start.alias("start_index"), F.least(F.lit(size), F.length("t") - start).alias("char_count"), F.substring("t", start + 1, F.lit(size)).alias("chunk"))


def sentences(text: Column) -> Column:
    """Sentences with their end marks; pieces of white space only fall out."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"[^{ENDS}]*[{ENDS}]+|[^{ENDS}]+"), F.lit(0)), lambda s: ~s.rlike(r"^(?U)\s*$"))


def recursive_spans(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """(start, end) of chunks: the coarsest separator that occurs splits the text, parts too long are split by the next ones,
    neighbours are merged up to ``size`` and each chunk starts again with what of the last ``overlap`` characters are whole parts."""

    def atoms(lo: int, hi: int, level: int) -> list[tuple[int, int]]:
        if hi - lo <= size:
            return [(lo, hi)]
        while level < len(separators) - 1 and text.find(separators[level], lo, hi) < 0:
            level += 1
        sep = separators[min(level, len(separators) - 1)]
        if not sep:
            return [(i, min(i + 1, hi)) for i in range(lo, hi)]
        out, at = [], lo
        while at < hi:
            found = text.find(sep, at, hi)
            end = hi if found < 0 else found + len(sep)
            out += atoms(at, end, level + 1)
            at = end
        return out

    spans: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for a in atoms(0, len(text), 0):
        if held and a[1] - held[0][0] > size:
            spans.append((held[0][0], held[-1][1]))
            while held and (a[1] - held[0][0] > size or spans[-1][1] - held[0][0] > overlap):
                held.pop(0)
        held.append(a)
    if held:
        spans.append((held[0][0], held[-1][1]))
    return [(a, b) for a, b in spans if text[a:b].strip()]


def recursive_chunks(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, chunk_no, start_index, chunk) by recursive_spans. Null and blank texts give none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [(k, i, a, t[a:b]) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, (a, b) in enumerate(recursive_spans(t, size, overlap))]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["key", "chunk_no", "start_index", "chunk"])

    out = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, chunk_no int, start_index int, chunk string")
    return out.withColumnRenamed("key", key)


def context_window(lengths: list[int], anchor: int, limit: int) -> tuple[int, int]:
    """First and last unit of a context grown around an anchor by turns, left first, while the total stays within the limit; a
    side that once doesn't fit is closed."""
    lo = hi = anchor
    total = lengths[anchor]
    sides = {"left": anchor > 0, "right": anchor < len(lengths) - 1}
    while any(sides.values()):
        for side in ("left", "right"):
            if not sides[side]:
                continue
            i = lo - 1 if side == "left" else hi + 1
            if total + lengths[i] > limit:
                sides[side] = False
                continue
            total += lengths[i]
            lo, hi = min(lo, i), max(hi, i)
            sides[side] = lo > 0 if side == "left" else hi < len(lengths) - 1
    return lo, hi


# Patterns of clauses that say how much of what to take; such clauses are kept out of retrievable text.
UNSAFE = re.compile(r"[0-9０-９一二三四五六七八九十百半两]+\s*(?:克|钱|两|分|枚|握|升|斗|合|斤|铢|丸|剂|服|次)|(?:日|每日)[0-9一二三四五六七八九十]*服|水煎|研末|捣汁|煎服|顿服|酒浸|蜜炙|醋淬|烊化|温服|外敷")


def safe_text(text: str) -> str:
    """A text without the clauses that give doses and preparations; a sentence of which nothing is left goes with its mark."""
    out = []
    for sentence in re.findall(rf"[^{ENDS}]*[{ENDS}]+|[^{ENDS}]+", text):
        mark = re.search(rf"[{ENDS}]+$", sentence)
        body, end = (sentence[: mark.start()], mark.group()) if mark else (sentence, "")
        kept = [c for c in re.split(r"(?<=[，,、])", body) if not UNSAFE.search(c)]
        joined = "".join(kept).rstrip("，,、") if kept and kept[-1] != body else "".join(kept)
        if joined.strip():
            out.append(joined + end)
        elif not body.strip():
            out.append(sentence)
    return "".join(out)


def parents_and_children(docs: DataFrame, key: str, text: str, parent: int = 1000, child: int = 300) -> DataFrame:
    """(key, parent_no, child_no, parent_start, parent_text, child_text): safe text, cut into sentences; each child is a run of
    sentences up to ``child`` characters, its parent the context grown around it up to ``parent``. Sentences above the limit are cut."""
    kind = docs.schema[key].dataType.simpleString()

    def bounded(t: str, limit: int) -> list[str]:
        cut = [s[i : i + limit] for s in re.findall(rf"[^{ENDS}]*[{ENDS}]+|[^{ENDS}]+", t) for i in range(0, len(s), limit)]
        return [s for s in cut if s.strip()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units: list[str] = []
                for s in bounded(safe_text(t), child):
                    if units and len(units[-1]) + len(s) <= child:
                        units[-1] += s
                    else:
                        units.append(s)
                lengths = [len(u) for u in units]
                seen: dict[tuple[int, int], int] = {}
                for i in range(len(units)):
                    lo, hi = context_window(lengths, i, parent)
                    rows.append((k, seen.setdefault((lo, hi), len(seen)), i, sum(lengths[:lo]), "".join(units[lo : hi + 1]), units[i]))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [batch.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds)], names=["key", "parent_no", "child_no", "parent_start", "parent_text", "child_text"])

    out = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, parent_no int, child_no int, parent_start int, parent_text string, child_text string")
    return out.withColumnRenamed("key", key)


# Fixed value: sizes of the chunk strategies over evidence units and their separators, the last one none.
UNIT_SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ", "")
UNIT_SIZES = {"c0": {"size": 500, "overlap": 80}, "c1": {"size": 250, "overlap": 40}, "c2": {"limit": 1000, "size": 500, "overlap": 80}, "c3": {"limit": 500}, "c4": {"limit": 300}, "c5": {"parent": 1000, "child": 300, "overlap": 40}}


def character_splits(text: str, size: int, overlap: int, separators: tuple[str, ...] = UNIT_SEPARATORS) -> list[tuple[int, str]]:
    """(start, chunk) as the reference's splitter gives them: the first separator that occurs splits the text and leads the part
    after it, parts from ``size`` on are split by the next ones, neighbours are merged up to ``size`` with up to ``overlap``
    characters of whole parts again, chunks are stripped, and a start is searched from the end of the previous chunk."""

    def merged(parts: list[str]) -> list[str]:
        out, held, total = [], [], 0
        for p in parts:
            if total + len(p) > size and held:
                out.append("".join(held).strip())
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        return [x for x in (*out, "".join(held).strip()) if x]

    def split(t: str, rest: tuple[str, ...]) -> list[str]:
        k = next((i for i, s in enumerate(rest) if not s or s in t), len(rest) - 1)
        sep, finer = rest[k], rest[k + 1 :] if rest[k] in t and rest[k] else ()
        pieces = t.split(sep) if sep else list(t)
        parts = [x for x in ([pieces[0], *[sep + x for x in pieces[1:]]] if sep else pieces) if x]
        out: list[str] = []
        good: list[str] = []
        for p in parts:
            if len(p) < size:
                good.append(p)
                continue
            if good:
                out += merged(good)
                good = []
            out += split(p, finer) if finer else [p]
        return out + merged(good) if good else out

    found, at, before = [], 0, 0
    for chunk in split(text, separators):
        at = text.find(chunk, max(0, at + before - overlap))
        before = len(chunk)
        found.append((at, chunk))
    return found


def _parts(text: str, limit: int, size: int, overlap: int) -> list[tuple[int, str]]:
    return [(0, text)] if len(text) <= limit else character_splits(text, size, overlap)


def _titles(unit: dict, kind: bool) -> str:
    return f"书名：{unit['book_title']}\n篇名：{unit['chapter_title']}\n" + (f"类型：{unit['content_type']}\n" if kind else "") + "正文："


def _room(limit: int, prefix: str, unit: dict) -> int:
    if limit <= len(prefix):
        raise ValueError(f"titles exceed the chunk limit: {unit['evidence_id']}")
    return limit - len(prefix)


def _unit_chunks(unit: dict, context: str | None, strategy: str) -> Iterator[tuple]:
    """Chunks of one unit by c2, c3 or c4, as (chunk_id, clause_id, retrieval_parent_id, source_evidence_ids, text, context_text, start_index)."""
    own, s = unit["evidence_id"], UNIT_SIZES[strategy]
    if strategy == "c2":
        prefix, parts = "", _parts(unit["normalized_text"], s["limit"], s["size"], s["overlap"])
    else:
        prefix = _titles(unit, True)
        body = _room(s["limit"], prefix, unit)
        parts = _parts(unit["normalized_text"], body, body, 0)
    if strategy == "c4" and context is None:
        raise ValueError(f"no clause {unit['clause_id']} of unit {own}")
    clause, parent = {"c2": (own, own), "c3": (unit["clause_id"], unit["parent_id"]), "c4": (unit.get("clause_of"),) * 2}[strategy]
    for i, (start, part) in enumerate(parts, 1):
        yield f"{strategy}-{own}-{i:03d}", clause, parent, [own], prefix + part, context if strategy == "c4" else prefix + part, start


def _chapter_chunks(units: list[dict], strategy: str) -> Iterator[tuple]:
    """Chunks of a chapter's units in order, joined by line ends, by c0, c1 or c5."""
    text, s = "\n".join(u["normalized_text"] for u in units), UNIT_SIZES[strategy]
    spans, at = [], 0
    for u in units:
        spans.append((at, at + len(u["normalized_text"]), u))
        at = spans[-1][1] + 1
    first = units[0]

    def sources(lo: int, hi: int) -> list[dict]:
        return [u for a, b, u in spans if a < hi and b > lo]

    if strategy != "c5":
        for start, chunk in character_splits(text, s["size"], s["overlap"]):
            yield f"{strategy}-{first['chapter_id']}-{start:06d}", None, None, [u["evidence_id"] for u in sources(start, start + len(chunk))], chunk, chunk, start
        return
    prefix = _titles(first, False)
    child = _room(s["child"], prefix, first)
    for parent_start, parent in character_splits(text, _room(s["parent"], prefix, first), 0):
        for inside, chunk in character_splits(parent, child, min(s["overlap"], child - 1)):
            start = parent_start + inside
            found = sources(start, start + len(chunk))
            clauses = {u["clause_id"] for u in found}
            yield f"c5-{first['chapter_id']}-{parent_start:06d}-{start:06d}", clauses.pop() if len(clauses) == 1 else None, f"c5-parent-{first['chapter_id']}-{parent_start:06d}", [u["evidence_id"] for u in found], prefix + chunk, prefix + parent, start


def evidence_chunks(units: DataFrame, strategy: str) -> DataFrame:
    """(chunk_id, strategy, book_id, chapter_id, clause_id, retrieval_parent_id, source_evidence_ids, text, context_text, char_count,
    start_index) of evidence units by one of the six strategies.

    c0 and c1 cut a chapter's clauses, c2 clauses, c3 units under three lines of titles, c4 the same with the clause as
    context, c5 chapters into parents and those into children. Units are (evidence_id, book_id, book_title, chapter_id,
    chapter_title, clause_id, clause_number, content_type, parent_id, normalized_text), evidence_id different and no text null. A chapter is one row. Titles that leave
    no room, and with c4 units without their clause, are errors.
    """
    if strategy not in UNIT_SIZES:
        raise ValueError(f"unknown strategy: {strategy}")
    names = ["evidence_id", "book_id", "book_title", "chapter_id", "chapter_title", "clause_id", "content_type", "parent_id", "normalized_text"]
    chosen = units.where("content_type = 'clause'") if strategy in ("c0", "c1", "c2") else units
    if strategy in ("c0", "c1", "c5"):
        one = F.struct(F.coalesce("clause_number", F.lit(0)).alias("at"), *names)
        rows = chosen.groupBy("book_id", "chapter_id").agg(F.sort_array(F.collect_list(one)).alias("units")).select("units", F.lit(None).cast("string").alias("context"))
    elif strategy == "c4":
        of = F.when(F.col("content_type") == "clause", F.col("evidence_id")).otherwise(F.col("clause_id"))
        clauses = units.where("content_type = 'clause'").select(F.col("evidence_id").alias("clause_of"), F.col("normalized_text").alias("context"))
        rows = chosen.withColumn("clause_of", of).join(clauses, "clause_of", "left").select(F.array(F.struct(*names, "clause_of")).alias("units"), "context")
    else:
        rows = chosen.select(F.array(F.struct(*names)).alias("units"), F.lit(None).cast("string").alias("context"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        kinds = {"chunk_id": text, "strategy": text, "book_id": text, "chapter_id": text, "clause_id": text, "retrieval_parent_id": text, "source_evidence_ids": pa.list_(text), "text": text, "context_text": text, "char_count": pa.int32(), "start_index": pa.int32()}
        for batch in it:
            out = []
            for row in batch.to_pylist():
                first = row["units"][0]
                made = _chapter_chunks(row["units"], strategy) if strategy in ("c0", "c1", "c5") else _unit_chunks(first, row["context"], strategy)
                for name, clause, parent, ids, chunk, context, start in made:
                    out.append((name, strategy, first["book_id"], first["chapter_id"], clause, parent, ids, chunk, context, len(chunk), start))
            cols = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values())], names=list(kinds))

    return rows.mapInArrow(run, "chunk_id string, strategy string, book_id string, chapter_id string, clause_id string, retrieval_parent_id string, source_evidence_ids array<string>, text string, context_text string, char_count int, start_index int")
