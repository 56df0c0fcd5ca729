"""Titles, clause texts and keys of evidence: normal forms, tags and roles by title, excerpts, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title words that name the role of a section, the first that holds; others are syndrome patterns.
ROLE_TITLES = (
    ("diagnostic_method", ("十问", "问病", "望色", "闻声", "辨息", "切脉", "合色脉", "问诊")),
    ("case", ("脉案",)),
    ("differential", ("脉候", "危险")),
    ("pathogenesis", ("病机",)),
)
# Requests for treatment that a question for a data set must not make.
CLINICAL = ("患者应该", "建议服用", "请给出处方", "如何治疗我", "为我诊断", "应该用多少剂量")


def normal_text(text: Column) -> Column:
    """Line ends unified, formula markers unwrapped, lines joined by one blank, runs of blanks collapsed, none outside."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"\\x[ \t]*([^\\\r\n]+?)[ \t]*\\x", "$1")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r"\n[ \t]*", " ")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def text_key(text: Column) -> Column:
    """A text without white space and case, by which repeats are known."""
    return F.lower(F.regexp_replace(text, r"[\s\p{Z}]+", ""))


def initials(book_id: Column, known: dict[str, str] | None = None) -> Column:
    """A book's prefix: that of the table of known ones, else the first letters of the id's parts, else "book"."""
    parts = F.filter(F.split(book_id, "[^a-zA-Z0-9]+"), lambda p: p != "")
    made = F.array_join(F.transform(parts, lambda p: F.lower(F.substring(p, 1, 1))), "")
    made = F.when(made == "", "book").otherwise(made)
    if not known:
        return made
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), book_id), made)


def title_tags(title: Column, symptoms: list[str], aliases: dict[str, str]) -> Column:
    """The symptoms a title names by themselves or by an alias, in the order of the list."""
    held = [F.when(title.contains(s) | (title.contains(aliases[s]) if s in aliases else F.lit(False)), s) for s in symptoms]
    return F.filter(F.array(*held), lambda x: x.isNotNull())


def title_role(title: Column) -> Column:
    """The role of a section by the words of its title; the first group of words that holds."""
    role = None
    for name, words in ROLE_TITLES:
        some = F.lit(False)
        for w in words:
            some = some | title.contains(w)
        role = F.when(some, name) if role is None else role.when(some, name)
    return role.otherwise("syndrome_pattern")


def is_clinical(question: Column) -> Column:
    return question.rlike("|".join(CLINICAL))


def two_ends(text: Column, limit: int = 60) -> Column:
    """A text within the limit, or as much of both its ends around an ellipsis."""
    half = (limit - 1) // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("…"), F.right(text, F.lit(half))))


def three_parts(text: Column, limit: int = 32) -> Column:
    """A text with its blanks collapsed, or its head, middle and tail around ellipses."""
    t = F.regexp_replace(F.regexp_replace(text, r"[\s\p{Z}]+", " "), "^ | $", "")
    part = max(4, (limit - 2) // 3)
    middle = F.greatest(F.lit(0), F.floor((F.length(t) - part) / 2)).cast("int")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, part), F.lit("…"), F.substring(t, middle + 1, F.lit(part)), F.lit("…"), F.right(t, F.lit(part))))


def clause_of(chunk_id: Column) -> Column:
    """The clause a chunk's id begins with; null where the id has no such form."""
    found = F.regexp_extract(chunk_id, r"^(.+)-(?:child|b4|c)-?\d+$", 1)
    return F.when(found != "", found)


def index_name(*parts: Column) -> Column:
    """Parts of a versioned index's name, dots and hyphens turned to underscores."""
    return F.translate(F.concat_ws("_", *parts), ".-", "__")
