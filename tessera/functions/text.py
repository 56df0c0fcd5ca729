"""Column functions on text that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java character class of what is neither ink nor meaning: white space, separators, controls, format characters,
#: and the letters and marks that show nothing (Hangul fillers, braille blank, joiner and variation marks).
INVISIBLE = r"\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def is_blank(c: Column) -> Column:
    """True for null and for text of blanks, line ends and invisible characters only."""
    return F.coalesce(c.rlike(rf"^[{INVISIBLE}]*+$"), F.lit(True))


def clean_id(c: Column) -> Column:
    """An id without case, width and outer blanks; null where nothing is left."""
    narrow = F.lower(F.translate(c, WIDE, NARROW))
    bare = F.regexp_replace(narrow, rf"^[{INVISIBLE}]+|[{INVISIBLE}]+$", "")
    return F.when(F.length(bare) > 0, bare)


def squeeze(c: Column) -> Column:
    """White space of any kind collapsed to one blank, none outside."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix-<24 hex digits> of the SHA-256 of the parts joined by NUL."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 24))
