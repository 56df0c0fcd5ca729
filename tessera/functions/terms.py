"""Terms in texts: detection, rewriting, validation. Vocabularies are parameters of a bounded size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def found_terms(text: Column, vocabulary: list[str]) -> Column:
    """Terms that stand in a text, longest first, ties in the order of the vocabulary; overlapping ones are all named."""
    ordered = sorted(dict.fromkeys(v for v in vocabulary if v), key=lambda t: -len(t))
    return F.filter(F.array(*[F.lit(t) for t in ordered]), lambda t: F.contains(F.coalesce(text, F.lit("")), t))


def chief_term(text: Column, vocabulary: list[str]) -> Column:
    """The first of found_terms, null where there is none."""
    return F.get(found_terms(text, vocabulary), F.lit(0))


def rewrite(query: Column, extra: Column) -> Column:
    """The query and further words, each once, joined by blanks."""
    return F.array_join(F.array_distinct(F.filter(F.concat(F.array(F.trim(query)), F.coalesce(extra, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))), " ")


def unsupported(answer_terms: Column, allowed: Column) -> Column:
    """Terms of an answer beyond the allowed ones; where nothing is allowed nothing is tested."""
    return F.when(F.size(F.coalesce(allowed, F.array().cast("array<string>"))) > 0, F.array_except(answer_terms, allowed)).otherwise(F.array().cast("array<string>"))
