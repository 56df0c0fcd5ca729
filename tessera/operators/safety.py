"""Texts without treatment: regions of treatment, and clauses that name doses, preparations, formulas or herbs, are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles of regions that are left out up to the next title.
REGIONS = ("用药", "方剂", "选方", "附方", "快捷方式法", "制法", "服法", "煎服法")
# What makes a clause, without its white space, one of treatment.
UNSAFE = (
    r"(?:[（(][^）)]*(?:毫升|钱|两|分|枚|升|合|斗|撮|铢|斤|克|片|粒|盏)[^）)]*[）)])|(?:[0-9]+(?:\.[0-9]+)?|[一二三四五六七八九十百半]+)(?:毫升|钱|两|分|枚|升|合|斗|撮|铢|斤|克|片|粒|盏)",
    r"为末|为丸|水煎|主之|治|服|煎|煮|熬|炙|炒|焙|研|捣|浸|泡|上[一二三四五六七八九十百0-9]+味|(?:空心|食前|食后|温水|白汤|米汤|姜汤|酒|姜汁)下|送下|下之|[一二三四五六七八九十百0-9]+下",
    r"宜(?:用|服|投)|当用|可用|止用|用之|服用|方用|治以|加味|加减|化裁|速灸|针灸|针刺",
    r"药|方剂|处方|用方|古方|灸",
    r"[\x{3400}-\x{9fff}]{1,12}(?:汤|散|丸|膏|丹)",
)
# A clause that is a drink's name alone is one, unless a word of diagnosis stands in it.
DRINK, DIAGNOSTIC = r"^[\x{3400}-\x{9fff}]{1,12}饮(?:方)?$", "[因者恶喜脉证症]"


def without_regions(text: Column) -> Column:
    """The text outside regions under a title of treatment; titles stand between two marks of a backslash and x and go too.

    Titles are set between two control characters first, which a text may not hold itself.
    """
    marked = F.regexp_replace(F.translate(text, "\x01\x02", ""), r"\\x([^\\\r\n]+)\\x", "\x01$1\x02")
    parts = F.split(marked, "\x01")
    kept = F.transform(F.slice(parts, 2, 1 << 30), _after_title)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(kept, ""))


def _after_title(part: Column) -> Column:
    title, rest = F.regexp_extract(part, "^([^\x02]*)\x02", 1), F.regexp_replace(part, "^[^\x02]*\x02", "")
    barred = F.lit(False)
    for word in REGIONS:
        barred = barred | title.contains(word)
    return F.when(barred, "").otherwise(F.regexp_replace(rest, r"(?U)^\s+", ""))


def herb_count(text: Column, herbs: list[str]) -> Column:
    total = F.lit(0)
    for h in herbs:
        total = total + text.contains(h).cast("int")
    return total


def is_unsafe(clause: Column, herbs: list[str]) -> Column:
    """Whether a clause is blank, of treatment, or names one of the given herbs."""
    bare = F.regexp_replace(clause, r"^[ \t\r\n，,、：:]+|[ \t\r\n，,、：:]+$", "")
    compact = F.regexp_replace(bare, r"(?U)\s+", "")
    some = bare == ""
    for pattern in UNSAFE:
        some = some | compact.rlike(pattern)
    return some | (compact.rlike(DRINK) & ~compact.rlike(DIAGNOSTIC)) | (herb_count(compact, herbs) >= 1)


def sentences(text: Column) -> Column:
    """(body, mark) of each sentence."""
    found = F.regexp_extract_all(text, F.lit(r"[^。！？!?；;]+[。！？!?；;]*|[。！？!?；;]+"), F.lit(0))
    return F.transform(found, lambda s: F.struct(F.regexp_extract(s, r"^([^。！？!?；;]*)", 1).alias("body"), F.regexp_extract(s, r"([。！？!?；;]*)$", 1).alias("mark")))


def safe_sentence(body: Column, mark: Column, herbs: list[str]) -> Column:
    """A sentence without its unsafe clauses, each kept one but the first after the separator before it; empty where none is left.

    Two herbs in one sentence make every clause with a herb unsafe.
    """
    clauses, separators = F.split(body, "[，,]"), F.regexp_extract_all(body, F.lit("[，,]"), F.lit(0))
    kept = F.filter(F.transform(clauses, lambda c, i: F.struct(i.alias("i"), c.alias("c"), is_unsafe(c, herbs).alias("out"))), lambda x: ~x["out"])
    # the separator of the kept clause k is the one before it
    joined = F.transform(kept, lambda x, k: F.concat(F.when(k == 0, "").otherwise(F.coalesce(F.get(separators, x["i"] - 1), F.lit(""))), x["c"]))
    return F.when(F.size(kept) == 0, "").otherwise(F.concat(F.array_join(joined, ""), mark))


def safe_text(text: Column, herbs: list[str]) -> Column:
    """A text without regions and clauses of treatment; "" for null and blank ones."""
    kept = F.transform(sentences(without_regions(F.coalesce(text, F.lit("")))), lambda s: safe_sentence(s["body"], s["mark"], herbs))
    return F.regexp_replace(F.array_join(kept, ""), r"(?U)^\s+|\s+$", "")


def has_treatment(text: Column, herbs: list[str]) -> Column:
    """Whether a region or a clause, if not blank, is one of treatment."""
    t = F.coalesce(text, F.lit(""))
    clauses = F.flatten(F.transform(sentences(t), lambda s: F.split(s["body"], "[，,]")))
    return (without_regions(t) != t) | F.exists(clauses, lambda c: (F.regexp_replace(c, r"(?U)\s+", "") != "") & is_unsafe(c, herbs))
