"""Pages of keywords, links or product tags instead of sentences.

Each page has a rank-frequency curve of its terms, fitted in log-log by SQL windows, and a profile of its characters.
Slope, residual, head and spread of the curve and the divergence of the profile are held against prose of the same language
and a comparable length. A quadratic logistic model of these deviations, fitted to a bounded sample of pages that were read
closely, flags the extreme ones, some seven in a hundred; these alone are then read: a case has more than half of its
characters in keywords, links or tags.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.defects import STOPWORDS
from tessera.session import cut

#: Share of a page's characters that makes it a case.
SHARE = 0.5
#: Pages that are read closely to fit the model: about so many of any corpus, chosen by hash. What lies below the weakest case
#: among them by more than the margin (in logits) isn't flagged.
SAMPLE, MARGIN = 8_192, 8.0
#: A norm of few pages leans on its language's and all pages' norms as if these were so many pages.
LEAN = 20.0
_PORTION = 4_000_000

# Classes of characters. Their shares make a page's profile.
CLASSES = ("end", "pause", "tag", "digit", "letter", "space", "line", "han", "kana", "hangul", "rest")
END, PAUSE, TAG, DIGIT, LETTER, SPACE, LINE, HAN, KANA, HANGUL, REST = range(len(CLASSES))
_FIXED = {c: k for k, some in ((END, "。．！？!?."), (PAUSE, "，、；：,;:"), (TAG, "#|>[]()<>/=&%_@*￥¥$·~+"), (LINE, "\n\r"), (SPACE, "\t ")) for c in some}
#: What a page is judged by: the curve's four measures, then the logarithms of the shares.
MEASURES = ("slope", "residual", "head", "spread", *CLASSES)


def _class(c: str) -> int:
    if c in _FIXED:
        return _FIXED[c]
    o = ord(c)
    if 0x3400 <= o <= 0x9FFF or 0x20000 <= o <= 0x323AF or o == 0x3007:
        return HAN
    if 0x3041 <= o <= 0x30FF and o != 0x30FB:
        return KANA
    if 0xAC00 <= o <= 0xD7A3:
        return HANGUL
    kind = unicodedata.category(c)
    return LETTER if kind[0] in "LM" else DIGIT if kind == "Nd" else SPACE if kind[0] == "Z" else REST


_classes = np.full(0x110000, 255, dtype=np.uint8)


def classes_of(codes: np.ndarray) -> np.ndarray:
    """The class of each code point; what was never met is looked up once a worker."""
    out = _classes[codes]
    if (out == 255).any():
        for o in np.unique(codes[out == 255]):
            _classes[o] = _class(chr(o))
        out = _classes[codes]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _words(codes: np.ndarray, cls: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(page, hash) of every run of letters; the hash depends on the letters and their places in the word."""
    ink = (cls == LETTER) | (cls == HANGUL)
    if not ink.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    apart = np.r_[True, page[1:] != page[:-1]]
    begins = ink & (np.r_[True, ~ink[:-1]] | apart)
    at = np.flatnonzero(ink)
    starts = np.flatnonzero(begins)
    word = np.cumsum(begins[at]) - 1
    low = np.where((codes[at] >= 65) & (codes[at] <= 90), codes[at] + 32, codes[at]).astype(np.uint64)
    mixed = _mix(low + (at - starts[word]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
    whole = np.r_[np.uint64(0), np.cumsum(mixed, dtype=np.uint64)]
    first = np.flatnonzero(begins[at])
    return page[starts], whole[np.r_[first[1:], len(at)]] - whole[first]


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _votes() -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, and sorted hashes of their stopwords with the language each speaks for."""
    names = sorted(STOPWORDS)
    pairs = []
    for k, name in enumerate(names):
        words = [w for w in STOPWORDS[name].split()]
        codes = _codes(words)
        _, hashes = _words(codes, np.full(len(codes), LETTER), np.repeat(np.arange(len(words)), [len(w) for w in words]))
        pairs += [(int(h), k) for h in hashes]
    pairs.sort()
    return names, np.array([h for h, _ in pairs], dtype=np.uint64), np.array([k for _, k in pairs])


def portion(texts: list[str], votes: tuple) -> tuple[np.ndarray, np.ndarray, list[str], list[list[dict]]]:
    """(lengths, counts of classes, language, frequencies) of some pages, all at once.

    Terms are pairs of neighbours in Han and kana, and runs of other letters. Frequencies are those of the page's curve:
    each frequency f with the number m of terms that have it. What a page says of its language isn't used.
    """
    names, hashes, speaks = votes
    n = np.array([len(t) for t in texts], dtype=np.int64)
    codes = _codes(texts)
    page = np.repeat(np.arange(len(texts)), n)
    cls = classes_of(codes)
    counts = np.bincount(page * len(CLASSES) + cls, minlength=len(texts) * len(CLASSES)).reshape(-1, len(CLASSES))
    wide = (cls == HAN) | (cls == KANA)
    pair = np.flatnonzero(wide[:-1] & wide[1:] & (page[:-1] == page[1:]))
    word_page, word = _words(codes, cls, page)
    # the language of spaced scripts by votes of stopwords; one word may speak for several
    tally = np.zeros((len(texts), len(names)), dtype=np.int64)
    for shift in range(int(np.bincount(np.unique(hashes, return_inverse=True)[1]).max())):
        spot = np.searchsorted(hashes, word) + shift
        hit = spot < len(hashes)
        hit[hit] = hashes[spot[hit]] == word[hit]
        np.add.at(tally, (word_page[hit], speaks[spot[hit]]), 1)
    han, kana, hangul, letter = (counts[:, k] for k in (HAN, KANA, HANGUL, LETTER))
    spaced = np.where(tally.max(axis=1) >= 2, tally.argmax(axis=1), len(names))
    lang = np.array([*names, "other", "ja", "zh", "ko"])[np.where(kana * 8 > han + kana, len(names) + 1, np.where(han * 4 > n - han, len(names) + 2, np.where(hangul > letter, len(names) + 3, spaced)))]
    # terms counted a page: the page in the upper bits, 43 bits of the term's hash below
    terms = np.concatenate([_mix((codes[pair] << 21 | codes[pair + 1]).astype(np.uint64)), _mix(word)])
    of = np.concatenate([page[pair], word_page]).astype(np.uint64)
    keys, f = np.unique(of << np.uint64(43) | terms >> np.uint64(21), return_counts=True)
    both, m = np.unique((keys >> np.uint64(43)).astype(np.int64) << 32 | f, return_counts=True)
    owner = both >> 32
    f = both & 0xFFFFFFFF
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    freqs = [[{"f": a, "m": b} for a, b in zip(f[lo:hi].tolist(), m[lo:hi].tolist())] for lo, hi in zip(edges, edges[1:])]
    return n, counts, lang.tolist(), freqs


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of a batch with a bounded number of characters; a longer page is alone."""
    lo = held = 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t) > _PORTION:
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _profiles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes = _votes()
    freq = pa.list_(pa.struct([("f", pa.int64()), ("m", pa.int64())]))
    for batch in it:
        texts, picked = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for lo, hi in _portions(texts):
            n, counts, lang, freqs = portion(texts[lo:hi], votes)
            read = [(lambda r: r[0] > SHARE * r[1])(stuffed(t)) if p else None for t, p in zip(texts[lo:hi], picked[lo:hi])]
            columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(lang), pa.array(counts.tolist(), pa.list_(pa.int64())), pa.array(freqs, freq), pa.array(read, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "h", "n", "lang", "counts", "freqs", "case"])


def curves(pages: DataFrame) -> DataFrame:
    """(key, h, slope, residual, head, spread): the line through log frequency over log rank of each page's terms.

    ``pages`` (key, h, freqs) has the number of terms m of each frequency f. Terms of one frequency share their last rank, so a
    page is as many points as it has frequencies; a window over falling frequency sums up the ranks. A page of one
    frequency has slope and residual 0, one without terms no row.
    """
    each = pages.select("key", "h", F.explode("freqs").alias("x")).select("key", "h", "x.f", "x.m")
    falling = Window.partitionBy("key", "h").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, 0)
    points = each.select("key", "h", "f", "m", F.ln(F.sum("m").over(falling)).alias("x"), F.ln("f").alias("y"))
    return points.groupBy("key", "h").agg(
        F.coalesce(F.expr("regr_slope(y, x)"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.expr("sqrt(greatest((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / nullif(regr_sxx(y, x), 0)) / count(1), 0))"), F.lit(0.0)).alias("residual"),
        F.ln(F.max("f") / F.sum(F.col("f") * F.col("m")) + 1e-3).alias("head"),
        F.ln(F.sum("m") / F.sum(F.col("f") * F.col("m")) + 1e-3).alias("spread"),
    )


def measured(pages: DataFrame, key: str, text: str, sample: int = SAMPLE) -> DataFrame:
    """(key, h, lang, size, n, slope, residual, head, spread, one logarithm of a share a class, case): all pages, written.

    ``size`` is the power of two of the length; ``case`` says for the sampled pages whether they are cases and is null for
    others. Texts don't leave the first pass.
    """
    rows = pages.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    rate = min(1.0, sample / max(1, pages.count()))
    picked = rows.withColumn("picked", F.pmod(F.xxhash64("key", "h"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    kind = pages.schema[key].dataType.simpleString()
    profiles = picked.mapInArrow(_profiles, f"key {kind}, h long, n long, lang string, counts array<long>, freqs array<struct<f: long, m: long>>, case boolean")
    profiles = cut(profiles.dropDuplicates(["key", "h"]))
    fits = curves(profiles)
    shares = [F.ln((F.get("counts", F.lit(i)) + 0.5) / (F.col("n") + 5.0)).alias(c) for i, c in enumerate(CLASSES)]
    flat = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("slope", "residual", "head", "spread")]
    both = profiles.join(fits.hint("merge"), ["key", "h"], "left")
    return cut(both.select("key", "h", "lang", F.floor(F.log2("n")).cast("int").alias("size"), "n", *flat, *shares, "case"))


@dataclass
class Norms:
    """Middle and width of each measure of prose by language and size, and the fitted model. A table of a bounded size:
    languages by powers of two by measures."""

    cells: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]
    langs: dict[str, tuple[np.ndarray, np.ndarray]]
    overall: tuple[np.ndarray, np.ndarray]
    weights: np.ndarray | None = None
    threshold: float = 0.0

    def of(self, lang: str, size: int) -> tuple[np.ndarray, np.ndarray]:
        return self.cells.get((lang, size)) or self.langs.get(lang) or self.overall

    def deviations(self, rows: pd.DataFrame) -> np.ndarray:
        """How many widths each measure lies beside the middle of prose of the page's language and size, at most 8."""
        pairs = [self.of(a, b) for a, b in zip(rows["lang"], rows["size"])]
        middle, width = (np.array([p[i] for p in pairs]).reshape(len(pairs), len(MEASURES)) for i in (0, 1))
        return np.clip((rows[list(MEASURES)].to_numpy(dtype=float) - middle) / width, -8, 8)

    def divergence(self, rows: pd.DataFrame) -> np.ndarray:
        """Sum of a ln(a/b) - a + b over the classes: never negative, zero for the profile of prose."""
        b = np.array([self.of(*p)[0][4:] for p in zip(rows["lang"], rows["size"])]).reshape(len(rows), len(CLASSES))
        a = rows[list(CLASSES)].to_numpy(dtype=float)
        return (np.exp(a) * (a - b) - np.exp(a) + np.exp(b)).sum(axis=1)

    def scores(self, rows: pd.DataFrame) -> np.ndarray:
        return _terms(self.deviations(rows)) @ self.weights


def _terms(z: np.ndarray) -> np.ndarray:
    """One, the deviations, their squares and products."""
    i, j = np.triu_indices(z.shape[1])
    return np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j] / 8], axis=1)


def _lean(n: float, own: np.ndarray, on: np.ndarray) -> np.ndarray:
    return (n * own + LEAN * on) / (n + LEAN)


def norms_of(pages: DataFrame) -> Norms:
    """Norms over all pages with an ordinary share of sentence ends and few marks of tags and links."""
    prose = pages.where(f"`end` >= ln(0.006) and tag < ln(0.02)")
    quarters = [F.percentile_approx(c, F.array(*map(F.lit, (0.25, 0.5, 0.75))), F.lit(1000)).alias(c) for c in MEASURES]
    rows = prose.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("seen"), *quarters).collect()  # languages by at most 32 sizes
    if not rows:
        flat = (np.zeros(len(MEASURES)), np.ones(len(MEASURES)))
        return Norms({}, {}, flat)
    q = {(r.lang, r.size): (r.seen, np.array([r[c] for c in MEASURES]).T) for r in rows}
    weigh = lambda some: sum(n * x for n, x in some) / sum(n for n, _ in some)
    overall = weigh(q.values())
    langs = {}
    for lang in {k[0] for k in q}:
        some = [v for k, v in q.items() if k[0] == lang]
        langs[lang] = _lean(sum(n for n, _ in some), weigh(some), overall)
    shape = lambda x: (x[1], (x[2] - x[0]) / 1.35 + 0.05)
    return Norms({k: shape(_lean(n, x, langs[k[0]])) for k, (n, x) in q.items()}, {k: shape(x) for k, x in langs.items()}, shape(overall))


def fit(norms: Norms, sampled: pd.DataFrame, margin: float = MARGIN) -> Norms:
    """The model of the sampled pages: a ridge logistic fit, and the threshold that keeps all its cases with a margin to spare.

    Without a case, or with nothing else, in the sample there is nothing to learn, and every page is flagged.
    """
    y = sampled["case"].to_numpy(dtype=float)
    x = _terms(norms.deviations(sampled)) if len(sampled) else np.zeros((0, 1))
    norms.weights = np.zeros(1 + len(MEASURES) + len(MEASURES) * (len(MEASURES) + 1) // 2)
    if not 0 < y.sum() < len(y):
        return norms
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ norms.weights, -30, 30)))
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.eye(x.shape[1])
        norms.weights = norms.weights + np.linalg.solve(curve, x.T @ (y - p) - norms.weights)
    norms.threshold = float((x @ norms.weights)[y > 0].min() - margin)
    return norms


# ---- the close reading ----

URL = re.compile(r"(?:https?|ftp)://[^\s<>\"'）)\]]+|\bwww\.[^\s<>\"'）)\]]+|\b(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/[^\s<>\"'）)\]，。、]*)?", re.I)
ANCHOR = re.compile(r"<a\b[^>]*>.*?</a>|\[[^\[\]\n]{1,60}\]\([^()\s]*\)", re.I | re.S)
MARKUP = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>|&[a-zA-Z]{2,8};|&#\d+;")
PRICE = re.compile(r"[￥¥$€]\s?\d|\d\s?元|\d+(?:\.\d+)?\s?(?:g|kg|ml|克|斤)\s?[*×x]\s?\d", re.I)
HASH = re.compile(r"[#＃][^#＃\s，。！？,!?]{1,16}[#＃]?")
DOSE = re.compile(r"(?:[\d０-９]+(?:\.\d+)?|[一二三四五六七八九十半两几各]+)\s?(?:克|钱|两|分|枚|片|握|升|合|斤|g|ml|钱半)(?:半)?$", re.I)
MARKED = re.compile(r"[。！？!?…]|[^\W\d_]\.(?=\s|$)")
SPLIT = re.compile(r"(?<=[。！？!?])|(?<=[^\W\d_]\.)(?=\s)|[\r\n]+")
ITEMS = re.compile(r"[,，、·;；|｜/\\\t　 ]+|\s[-–—>»]+\s")
SPACED_ITEMS = re.compile(r"\s*[,，、·;；|｜/\\\t　]+\s*|\s[-–—>»]+\s|\s{2,}")
LABEL = re.compile(r"^\s*(?:标签|关键词|关键字|热搜|相关搜索|友情链接|友链|链接|导航|tags?|keywords?|links?)\s*[:：]?", re.I)
#: Ink of a run without any mark or blank, above which it is no clause of a script without spaces.
RUN = 36


def ink(s: str) -> int:
    return sum(not c.isspace() for c in s)


def _listed(items: list[str]) -> bool:
    """Whether items are keywords: many, short, without doses."""
    if len(items) < 6:
        return False
    if sum(bool(DOSE.search(x)) for x in items) > 0.3 * len(items):
        return False
    wide = sum(len(x) for x in items if x[0] > "⹿")
    mean = sum(map(len, items)) / len(items)
    if 2 * wide > sum(map(len, items)):
        return mean <= 6.5 and max(map(len, items)) <= 16
    words = [len(x.split()) for x in items]
    return sum(words) / len(words) <= 3.5


def stuffed(text: str) -> tuple[int, int]:
    """(ink in keywords, links and tags; all ink) of a text."""
    text = unicodedata.normalize("NFKC", text).replace("\u200b", "").replace("\ufeff", "")
    total = ink(text)
    bad = 0
    lines = [x for x in re.split(r"[\r\n]+", text) if x.strip()]
    plain: list[str] = []
    for line in lines:
        links = [m.span() for m in ANCHOR.finditer(line)]
        masked = ANCHOR.sub(lambda m: "\x00" * len(m.group()), line)
        links += [m.span() for m in URL.finditer(masked)]
        if links:
            rest = URL.sub(" ", masked.replace("\x00", " "))
            rest = MARKUP.sub(" ", rest)
            left = ink(re.sub(r"[^\w]", "", rest))
            if left <= 14 * len(links) and not (MARKED.search(rest) and left > 6 * len(links)):
                bad += ink(line)
                continue
            bad += sum(ink(line[a:b]) for a, b in links)
            line = rest
        bare = MARKUP.sub(" ", line)
        tags = HASH.findall(bare)
        if len(tags) >= 3 and sum(map(len, tags)) >= 0.6 * ink(bare):
            bad += ink(bare)
            continue
        if PRICE.search(bare) and not MARKED.search(bare):
            bad += ink(bare)
            continue
        plain.append(bare)
    bad += _keywords(plain)
    return bad, total


def _keywords(lines: list[str]) -> int:
    bad = 0
    short: list[str] = []  # consecutive lines that are one short item each

    def close() -> int:
        n = sum(map(ink, short)) if len(short) >= 6 and _listed([x.strip() for x in short]) and _repeats(short) else 0
        short.clear()
        return n

    for line in lines:
        sentences = [x for x in SPLIT.split(line) if x and x.strip()]
        if len(sentences) == 1 and len(line.strip()) <= 12 and not re.search(r"[，。！？,!?：:]", line):
            short.append(line)
            continue
        bad += close()
        clauses = [x for x in (c.strip() for c in re.split(r"[。！？!?，,；;、]+", line)) if x]
        if len(clauses) >= 8 and sum(map(len, clauses)) <= 14 * len(clauses) and _around_one(clauses):
            bad += ink(line)
            continue
        for s in sentences:
            ended = bool(MARKED.search(s.rstrip()[-3:]))
            body = LABEL.sub("", s)
            items = [x.strip(" 。.！!？?：:“”\"'《》（）()") for x in (ITEMS if _wide(re.sub(r"[^\w]", "", body), 0.3) else SPACED_ITEMS).split(body)]
            items = [x for x in items if x]
            if not items:
                continue
            if not ended and (_listed(items) or len(items) >= 6 and _phrases(items)):
                bad += ink(s)
            elif not ended and LABEL.match(s) and len(items) >= 3:
                bad += ink(s)
            elif ended and len(items) >= 12 and (_listed(items) and sum(map(len, items)) / len(items) <= 4.5 or _phrases(items)):
                bad += ink(s)
            else:
                bad += sum(len(x) for x in items if len(x) > RUN and x[0] > "⹿" and _wide(x))
    return bad + close()


def _wide(x: str, share: float = 0.8) -> bool:
    return sum(c > "⹿" for c in x) > share * len(x)


def _repeats(items: list[str]) -> bool:
    return len({x.strip() for x in items}) <= 0.7 * len(items)


def _phrases(items: list[str]) -> bool:
    """Phrases said over and over, or all around one word."""
    kinds = Counter(items)
    return len(kinds) <= 0.5 * len(items) or _around_one(items)


def _around_one(items: list[str]) -> bool:
    """One word stands in most of at least eight items."""
    pairs: Counter = Counter()
    for x in items:
        words = x.lower().split() if x[0] <= "⹿" else [x[i : i + 2] for i in range(len(x) - 1)]
        pairs.update(set(words))
    return bool(pairs) and len(items) >= 8 and pairs.most_common(1)[0][1] >= 0.8 * len(items)


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = [stuffed(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a / b if b else 0.0 for a, b in rows], pa.float64())], names=["key", "share"])


def _scored(it: Iterator[pd.DataFrame], norms: Norms) -> Iterator[pd.DataFrame]:
    for rows in it:
        if len(rows):
            score = norms.scores(rows)
            yield rows[["key", "h", "lang", "size", "slope", "residual"]].assign(divergence=norms.divergence(rows), score=score, extreme=score >= norms.threshold)


def _judged(pages: DataFrame, key: str, text: str, sample: int) -> DataFrame:
    rows = measured(pages, key, text, sample)
    # about `sample` pages come to the driver
    norms = fit(norms_of(rows), rows.where("case is not null").select("lang", "size", *MEASURES, "case").toPandas())
    kind = pages.schema[key].dataType.simpleString()
    return rows.mapInPandas(lambda it: _scored(it, norms), f"key {kind}, h long, lang string, size int, slope double, residual double, divergence double, score double, extreme boolean")


def judged(pages: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, lang, size, slope, residual, divergence, extreme): every page with what it is judged by.

    ``extreme`` is the model's word on how its measures deviate from prose of its language and size. Null and empty texts and
    null keys give no rows; rows with the same key and text are one page, other rows with the key pages of their own; an empty table
    gives no rows. Extra columns aren't read.
    """
    r = lambda c: F.round(c, 6).alias(c)
    return _judged(pages, key, text, sample).select(F.col("key").alias(key), "lang", "size", r("slope"), r("residual"), r("divergence"), "extreme")


def stuffed_pages(pages: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key): pages more than half of whose characters are keywords, links or tags; only extreme pages are read.

    A key is listed once if any of its pages is a case. Cases as for judged.
    """
    flagged = _judged(pages, key, text, sample).where("extreme").select("key", "h")
    texts = pages.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    # sizes of what Python yields are guessed too low, so nothing may be broadcast on a guess
    some = texts.join(flagged.hint("merge"), ["key", "h"], "left_semi").select("key", "text")
    kind = pages.schema[key].dataType.simpleString()
    return some.mapInArrow(_read, f"key {kind}, share double").where(F.col("share") > SHARE).select(F.col("key").alias(key)).distinct()
