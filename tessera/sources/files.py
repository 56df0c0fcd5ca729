"""Files as tables: strict JSON lines, JSON arrays, tagged books in legacy encodings, review sheets, index folders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file; a malformed row fails the read where ``strict``, else falls out. Blank lines don't count."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def unknown_fields(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(field, rows): fields of JSON lines that the closed schema doesn't know."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.explode(F.json_object_keys("value")).alias("field")).where(~F.col("field").isin(schema.fieldNames())).groupBy("field").agg(F.count(F.lit(1)).alias("rows"))


def torn_files(spark: SparkSession, path: str) -> DataFrame:
    """(path): files that don't end with a line end, as an append that was broken off leaves them."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.where(F.expr("substring(content, length(content), 1)") != F.lit(bytearray(b"\n"))).select("path")


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a file that is one JSON array; a byte-order mark is no obstacle."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def review_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV sheet, all text; its header must be exactly ``columns`` in this order."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    got = [c.lstrip("﻿") for c in df.columns]
    if got != columns:
        raise ValueError(f"the sheet's columns are {got}")
    return df.toDF(*columns)


#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "gb18030", "cp936")


def decoded(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """(path, encoding, text) of whole files by the first encoding that decodes them without error; null where none does."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            names, texts = [], []
            for content in batch.column(1).to_pylist():
                for name in encodings:
                    try:
                        texts.append(content.decode(name))
                        names.append(name)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    names.append(None)
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["path", "encoding", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, encoding string, text string")


def tagged_sections(books: DataFrame) -> DataFrame:
    """(path, section_no, volume, chapter, title, body) of tagged books (path, text).

    A line <目录> opens a block and names volume and chapter, parted by a backslash; the first line <篇名> in it is the title,
    what follows, without a leading 属性：, the body. Blocks without a title or body fall out.
    """
    block = F.posexplode(F.split(F.concat(F.lit("\n"), F.regexp_replace("text", "\r\n?", "\n")), r"\n<目录>")).alias("no", "block")
    b = books.select("path", block).where("no > 0")
    place = F.split(F.trim(F.regexp_extract("block", r"^([^\n]*)", 1)), r"\\")
    title = F.trim(F.regexp_extract("block", r"\n<篇名>([^\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace(F.regexp_extract("block", r"(?s)\n<篇名>[^\n]*\n(.*)$", 1), r"^\s*(?:属性：)?", ""), r"(?U)^\s+|\s+$", "")
    out = b.select("path", (F.col("no") - 1).alias("section_no"), F.get(place, F.lit(0)).alias("volume"), F.when(F.size(place) > 1, F.element_at(place, -1)).alias("chapter"), title.alias("title"), body.alias("body"))
    return out.where("title <> '' and body <> ''")


def recent_log(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The last ``limit`` rows of a log (seq, line) as JSON text, newest first; malformed ones among them fall out after the
    cut, so there may be fewer."""
    tail = spark.read.parquet(path).orderBy(F.desc("seq")).limit(limit)
    return tail.where(F.expr("try_parse_json(line) is not null"))


def newest_folder(spark: SparkSession, root: str, name: str) -> str | None:
    """The folder below ``root`` whose file ``name`` was changed last."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/{name}")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getModificationTime(), s.getPath().getParent().toString()) for s in fs.globStatus(hadoop) or []]
    return max(found)[1] if found else None


def selected_sections(sections: DataFrame, titles: list[str], symptoms: dict[str, list[str]], excluded: list[str]) -> DataFrame:
    """Sections by exact title, or with at least one symptom in the title and no excluded pattern in volume, chapter or title;
    exact titles aren't asked for patterns. Column tags: the symptoms in order, each if itself or an alias stands in the title."""
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("title", w))
    tags = F.filter(F.array(*[F.when(has([s, *a]), F.lit(s)) for s, a in symptoms.items()]), lambda x: x.isNotNull()) if symptoms else F.array().cast("array<string>")
    where = F.concat_ws("\n", "volume", "chapter", "title")
    barred = F.lit(False)
    for pattern in excluded:
        barred = barred | F.contains(where, F.lit(pattern))
    return sections.withColumn("tags", tags).where(F.col("title").isin(titles) | ((F.size("tags") > 0) & ~barred)).orderBy("path", "volume", "chapter", "title", "section_no")


def ambiguous_titles(sections: DataFrame, titles: list[str]) -> DataFrame:
    """(title, places): wanted titles that stand nowhere or in more than one place."""
    wanted = sections.sparkSession.createDataFrame([(t,) for t in titles], "title string")
    places = sections.where(F.col("title").isin(titles)).groupBy("title").agg(F.countDistinct("path", F.coalesce("volume", F.lit("")), F.coalesce("chapter", F.lit(""))).alias("places"))
    return wanted.join(places, "title", "left").select("title", F.coalesce("places", F.lit(0)).alias("places")).where("places <> 1")


CLAUSE = re.compile(r"(?m)^\s*(?:属性：)?\s*(\d{1,4})．")
NOTE = re.compile(r"[（(〔\[]\s*(?:按|注|校注|原注)[^）)〕\]]*[）)〕\]]")
FORMULA = re.compile(r"(?m)^\s*\\x([^\\\n]{1,20})\\x\s*$")
INGREDIENTS = re.compile(r"[（(]?[^\n。]*(?:[一二三四五六七八九十半]+(?:两|钱|枚|升|斤|合|铢|分|握))[^\n。]*")


def evidence_units(sections: DataFrame) -> DataFrame:
    """(path, section_no, unit_no, content_type, clause_number, parent_no, text): clauses, notes, formulas, ingredients and
    preparations of sections (path, section_no, body), each with the unit it belongs to.

    A number with a full-width full stop at a line's start opens a clause, which reaches to the next; \\xname\\x on a line of its
    own opens a formula in it; the first line below with doses is its ingredients, what follows its preparation; bracketed
    remarks that begin like notes are notes. A clause is its own parent, formulas and notes belong to the clause, the rest to the
    formula. Text before the first clause is a clause without a number.
    """

    def units(body: str) -> list[tuple]:
        out: list[tuple] = []
        marks = [(m.start(), m.end(), int(m.group(1))) for m in CLAUSE.finditer(body)]
        spans = [(0, marks[0][0] if marks else len(body), None)] + [(e, marks[i + 1][0] if i + 1 < len(marks) else len(body), n) for i, (_, e, n) in enumerate(marks)]
        for lo, hi, number in spans:
            text = body[lo:hi]
            if not text.strip():
                continue
            clause = len(out)
            formulas = list(FORMULA.finditer(text))
            head = text[: formulas[0].start()] if formulas else text
            out.append(("clause", number, clause, NOTE.sub("", head).strip()))
            out += [("note", number, clause, m.group().strip()) for m in NOTE.finditer(head)]
            for i, f in enumerate(formulas):
                part = text[f.end() : formulas[i + 1].start() if i + 1 < len(formulas) else len(text)]
                own = len(out)
                out.append(("formula", number, clause, f.group(1).strip()))
                dosed = INGREDIENTS.search(part)
                rest = part
                if dosed:
                    out.append(("ingredients", number, own, dosed.group().strip()))
                    rest = part[dosed.end() :].lstrip("。")
                if rest.strip():
                    out.append(("preparation", number, own, rest.strip()))
        return out

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [(p, s, i, *u) for p, s, b in zip(*[batch.column(k).to_pylist() for k in range(3)]) for i, u in enumerate(units(b or ""))]
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["path", "section_no", "unit_no", "content_type", "clause_number", "parent_no", "text"])

    return sections.select("path", F.col("section_no").cast("int").alias("section_no"), "body").mapInArrow(run, "path string, section_no int, unit_no int, content_type string, clause_number int, parent_no int, text string")


def broken_units(units: DataFrame) -> DataFrame:
    """Units whose parent is missing or of the wrong kind: a clause is its own, formulas and notes have a clause, the rest a formula."""
    p = units.select("path", "section_no", F.col("unit_no").alias("parent_no"), F.col("content_type").alias("parent_type"))
    wanted = F.when(F.col("content_type").isin("ingredients", "preparation"), "formula").otherwise("clause")
    own = (F.col("content_type") != "clause") | (F.col("unit_no") == F.col("parent_no"))
    return units.join(p, ["path", "section_no", "parent_no"], "left").where(~(F.coalesce(F.col("parent_type") == wanted, F.lit(False)) & own))
