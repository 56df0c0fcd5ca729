"""Oversized texts cut at natural boundaries: a structure tree of headings, lists, lines and sentences, packed to the limit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Headings by depth, the outermost first: volumes, numbered parts, book markup, bracketed labels. Markdown names its depth.
HEADINGS = (r"卷[^\n]{1,30}$", r"第[^\n]{1,12}[卷篇][^\n]{0,20}$", r"第[^\n]{1,12}[章回门][^\n]{0,20}$", r"第[^\n]{1,12}节[^\n]{0,20}$", r"<[^<>\n]{1,12}>", r"【[^】\n]{1,16}】")
HEADING = re.compile("^(?:" + "|".join(f"({x})" for x in (*HEADINGS, "#{1,6} ")) + ")", re.M)
# A list item: its indent, then a bullet or a number.
ITEM = re.compile(r"(?:(?<=\n)|(?<=\r)|\A)([ \t　]*)(?:[-*•·]|\d{1,3}[.、)）]|[（(]\d{1,3}[)）])")
# Where nodes of each level end, from the coarsest to the finest.
PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[ \t　]*(?:\r\n|\r|\n)+")
LINE = re.compile(r"\r\n|\r|\n|\x0b|\x0c|\x85|\u2028|\u2029")
SENTENCE = re.compile(r"(?:[。！？!?…]+|\.(?=\s|$)|\.(?=[^\x00-\x7f]))[”’』」》）\"')\]]*[ \t　]*")
CLAUSE = re.compile(r"[；;：:，,、][”’』」》）\"')\]]*[ \t　]*")
WORD = re.compile(r"[ \t　]+")
ENDS = (PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD)
# Levels of the tree: sections by headings, paragraphs, list items, then the rest of ENDS.
SECTIONS, PARAGRAPHS, ITEMS, REST = 0, 1, 2, 3


def _depth(m: re.Match) -> int:
    return len(m.group().rstrip()) if m.group().startswith("#") else m.lastindex


def _outermost(found: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
    """Parts of a node that start at its outermost marks; what lies deeper stays inside them."""
    top = min((d for at, d in found if at > lo), default=None)
    starts = [lo, *[at for at, d in found if at > lo and d == top]]
    return list(zip(starts, [*starts[1:], hi]))


def children(text: str, lo: int, hi: int, level: int) -> tuple[list[tuple[int, int]], int]:
    """The children of a node and the level they are looked at first. Sections and lists nest, so theirs is the same level."""
    if level == SECTIONS:
        parts = _outermost([(m.start(), _depth(m)) for m in HEADING.finditer(text, lo, hi)], lo, hi)
    elif level == ITEMS:
        parts = _outermost([(m.start(), len(m.group(1).expandtabs(4))) for m in ITEM.finditer(text, lo, hi)], lo, hi)
    else:
        cuts = [m.end() for m in ENDS[level - 1 if level == PARAGRAPHS else level - 2].finditer(text, lo, hi)]
        ends = [c for c in cuts if lo < c < hi] + [hi]
        parts = list(zip([lo, *ends[:-1]], ends))
    return parts, level if level in (SECTIONS, ITEMS) and len(parts) > 1 else level + 1


def _leaf(level: int) -> bool:
    return level > REST + len(ENDS) - 2


def merged(parts: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """Neighbouring siblings joined from the left while both fit and so does what they make; larger ones stay alone."""
    out: list[tuple[int, int]] = []
    for a, b in parts:
        if out and b - out[-1][0] <= room:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def segments(text: str, room: int) -> list[tuple[int, int]]:
    """The text as the tree's whole subtrees of at most ``room`` characters, siblings merged.

    A node that fits is one unit, whatever is below. Of a node that doesn't, the children that fit are merged with their
    neighbours among the same parent's children, and only those that don't are entered. So no segment holds parts of two
    parents one of which is divided. What has no boundary inside is cut to the limit.
    """
    out: list[tuple[int, int]] = []
    stack = [(0, len(text), SECTIONS)]
    while stack:
        lo, hi, level = stack.pop()
        if hi - lo <= room:
            out.append((lo, hi))
        elif _leaf(level):
            out += [(a, min(a + room, hi)) for a in range(lo, hi, room)]
        else:
            parts, below = children(text, lo, hi, level)
            stack.extend((a, b, below) for a, b in reversed(merged(parts, room)))
    return out


def pieces(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece of a text, in code points.

    The structure tree (sections by depth of heading, paragraphs, nested list items, lines, sentences, clauses, words) is
    packed into segments of the limit less the overlap. A piece is a segment, and each after the first starts ``overlap``
    characters before it. So a piece ends at a coarse boundary where it can, and inside a sentence only if that alone is too
    long. First segments that are shorter than the overlap make one piece with what follows. A text within the limit is
    one piece, an empty one none.
    """
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError("the limit must be positive and exceed the overlap")
    if len(text) <= most:
        return [(0, len(text))] if text else []
    ends = [b for _, b in segments(text, most - overlap) if b >= overlap]
    return list(zip([0, *[e - overlap for e in ends[:-1]]], ends))


def _cut(it: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in it:
        kinds, ids, texts, most, over = (batch.column(c).to_pylist() for c in ("item_kind", "item_id", "text", "most", "over"))
        rows: list[tuple] = []
        for k, i, t, m, o in zip(kinds, ids, texts, most, over):
            found = pieces(t, m, o)
            rows += [(k, i, no, a, b, len(found), t[a:b] if with_text else None) for no, (a, b) in enumerate(found)]
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds_ = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds_)], names=["item_kind", "item_id", "piece", "start", "end", "n_pieces", "text"])


_PIECES = "item_kind string, item_id string, piece int, start int, end int, n_pieces int, text string"


def split_oversized(items: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """(item_kind, item_id, piece, start, end, n_pieces, text): the pieces of every item longer than its kind's limit.

    ``items`` (item_kind, item_id, text), ``limits`` (item_kind, max_chars, overlap_chars), a fixed table of a few rows that
    is broadcast. Lengths and places count code points. Items within the limit, null and empty texts and kinds without a
    limit give no rows; null ids are left out. An id exported several times counts once; where its texts
    differ, the longest stands. Pieces of an item, each without its first
    ``overlap_chars`` except the first, make up the whole text. An overlap not below the limit is an error.
    """
    few = F.broadcast(limits.where("item_kind is not null").groupBy("item_kind").agg(F.min("max_chars").alias("most"), F.max("overlap_chars").alias("over")))
    large = items.where("item_id is not null").select("item_kind", "item_id", "text").join(few, "item_kind").where("length(text) > most")
    once = large.groupBy("item_kind", "item_id", "most", "over").agg(F.max_by("text", F.struct(F.length("text"), F.xxhash64("text"), F.xxhash64("text", F.lit(1)))).alias("text"))
    return once.select("item_kind", "item_id", "text", "most", F.coalesce("over", F.lit(0)).alias("over")).mapInArrow(lambda it: _cut(it, with_text), _PIECES)


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, item_id): items that come out in more than one piece. Cases as for split_oversized."""
    return split_oversized(items, limits, with_text=False).where("piece = 1").select("item_kind", "item_id")
