"""Token ids of whole texts by a public byte-level BPE, as a reduction over a tree of text pieces."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a leaf of the tree, of a block of text that one task encodes, and how many neighbours one round joins.
LEAF, BLOCK, FAN = 256, 65_536, 32
#: Rounds that join blocks: a string of Spark has fewer than 2^31 bytes, so at most FAN ** 3 blocks.
ROUNDS = 3
#: Tokens on either side of a seam that are encoded again at first; the number grows until the seam is settled.
SEAM = 8
_encoders: dict[str, object] = {}


def default_vocabulary() -> str:
    """Path of byte_bpe_50k's ranks in the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The tokenizer of a file of ranks; once a Python worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


#: The property White_Space of Unicode, which the tokenizer's pattern means by white space.
WHITE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


@lru_cache(1 << 16)
def kind(c: str) -> str:
    """white, letter, number, mark (punctuation and symbols) or other, by Unicode category."""
    if c in WHITE:
        return "white"
    return {"L": "letter", "N": "number", "P": "mark", "S": "mark"}.get(unicodedata.category(c)[0], "other")


def settled(before: str, after: str) -> bool:
    """Whether the pattern ends a word between these neighbours in any text.

    It does before white space that follows ink, and after a letter or digit that a character of another class follows: no
    alternative of the pattern spans such a place, since letters, digits and white space are followed only by their own
    class inside one word, and contractions start with their apostrophe. Classes that may be unassigned count as unknown.
    """
    a, b = kind(before), kind(after)
    if "other" in (a, b):
        return False
    return a != "white" if b == "white" else a in ("letter", "number") and a != b


def encode(text: str, enc, leaf: int = LEAF, seam: int = SEAM) -> list[int]:
    """Ids of a text: halves are encoded recursively and joined at their seam.

    At a seam a window of tokens of both halves is encoded anew. It grows until both of its edges lie where a word of the
    pattern surely ends; merges never cross such a place, so what is outside stays as it is. Without such a place the
    window grows to the halves' outer ends, which amounts to encoding the text at once.
    """
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    middle = len(text) // 2
    return join(text[:middle], encode(text[:middle], enc, leaf, seam), text[middle:], encode(text[middle:], enc, leaf, seam), enc, seam)


def join(a: str, left: list[int], b: str, right: list[int], enc, seam: int = SEAM) -> list[int]:
    """Ids of ``a + b`` from the ids of both."""
    if not a or not b:
        return left or right
    keep_left, cut_a = _outside(a, left, enc, seam, from_end=True)
    keep_right, cut_b = _outside(b, right, enc, seam, from_end=False)
    head = left[:keep_left]
    tail = right[keep_right:]
    return head + enc.encode_ordinary(a[cut_a:] + b[:cut_b]) + tail


def _outside(text: str, ids: list[int], enc, seam: int, from_end: bool) -> tuple[int, int]:
    """(token, character) where the window ends inside this half: the nearest settled place at least ``seam`` tokens away."""
    n, chars = len(ids), 0
    begun, whole = _characters(enc)
    for width in range(1, n):
        chars += begun[ids[n - width] if from_end else ids[width - 1]]
        # the window's edge must not lie inside a character
        if width >= seam and whole[ids[n - width] if from_end else ids[width]]:
            at = len(text) - chars if from_end else chars
            if 0 < at < len(text) and settled(text[at - 1], text[at]):
                return (n - width, at) if from_end else (width, at)
    return (0, 0) if from_end else (n, len(text))


_begun: dict[int, tuple[list[int], list[bool]]] = {}


def _characters(enc) -> tuple[list[int], list[bool]]:
    """How many characters begin in each token, and whether it begins with one; once an encoder."""
    if id(enc) not in _begun:
        raw = [enc.decode_single_token_bytes(i) if i in ranks else b"" for ranks in [set(enc._mergeable_ranks.values())] for i in range(enc.n_vocab)]
        _begun[id(enc)] = ([sum(c & 0xC0 != 0x80 for c in x) for x in raw], [bool(x) and x[0] & 0xC0 != 0x80 for x in raw])
    return _begun[id(enc)]


def decode(ids: list[int], enc, leaf: int = LEAF) -> str:
    """The text of ids; bytes concatenate up the tree."""

    def tree(lo: int, hi: int) -> bytes:
        if hi - lo <= leaf:
            return b"".join(enc.decode_tokens_bytes(ids[lo:hi]))
        middle = (lo + hi) // 2
        return tree(lo, middle) + tree(middle, hi)

    return tree(0, len(ids)).decode("utf-8")


def join_all(parts: list[tuple[str, list[int]]], enc, seam: int = SEAM) -> list[int]:
    """Ids of neighbouring pieces of text joined pairwise, level by level."""
    while len(parts) > 1:
        odd = parts[len(parts) & ~1 :]
        parts = [(a + b, join(a, left, b, right, enc, seam)) for (a, left), (b, right) in zip(parts[::2], parts[1::2])] + odd
    return parts[0][1] if parts else []


def _column(lists: list, counts: bool) -> pa.Array:
    import numpy as np

    if counts:
        return pa.array([len(x) for x in lists], type=pa.int32())
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in lists]) if lists else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, leaf: int, counts: bool) -> Iterator[pa.RecordBatch]:
    """The last column, texts, replaced by their ids or the number of these."""
    enc = encoder(path)
    for batch in batches:
        *others, texts = batch.columns
        ids = [encode(text, enc, leaf) if text else [] for text in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([*others, _column(ids, counts)], names=batch.schema.names)


def _joined(batches: Iterator[pa.RecordBatch], path: str, counts: bool) -> Iterator[pa.RecordBatch]:
    """The last column, lists of (no, ids) of neighbours, replaced by the ids of them joined or the number of these."""
    enc = encoder(path)
    for batch in batches:
        *others, parts = batch.columns
        ids = [join_all([(enc.decode(x["value"]), x["value"]) for x in sorted(some, key=lambda x: x["no"])], enc) for some in parts.to_pylist()]
        yield pa.RecordBatch.from_arrays([*others, _column(ids, counts)], names=batch.schema.names)


def _with(schema: T.StructType, last: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields[:-1], T.StructField(schema.fields[-1].name, last)])


def _over(docs: DataFrame, key: str, text: str, path: str | None, leaf: int, block: int, counts: bool, name: str) -> DataFrame:
    path = path or default_vocabulary()
    list_type = T.ArrayType(T.IntegerType())
    value = T.IntegerType() if counts else list_type
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("value"))
    fits = F.coalesce(F.length("value"), F.lit(0)) <= block
    short = narrow.where(fits)
    short = short.mapInArrow(lambda it: _encoded(it, path, leaf, counts), _with(short.schema, value))
    # longer texts: one row a block, then as many neighbours as FAN are joined in each round
    last = F.floor((F.length("value") - 1) / block)
    blocks = narrow.where(~fits).select("key", F.xxhash64("value").alias("h1"), F.xxhash64("value", F.lit(1)).alias("h2"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("no"), "value")
    blocks = blocks.withColumn("value", F.substring(F.col("value"), (F.col("no") * block + 1).cast("int"), F.lit(block)))
    spread = blocks.groupBy("key", "h1", "h2", "no").agg(F.count(F.lit(1)).alias("copies"), F.any_value("value").alias("value"))
    rows = spread.mapInArrow(lambda it: _encoded(it, path, leaf, False), _with(spread.schema, list_type))
    for k in range(ROUNDS):
        up = rows.groupBy("key", "h1", "h2", F.floor(F.col("no") / FAN).alias("no")).agg(F.max("copies").alias("copies"), F.collect_list(F.struct("no", "value")).alias("value"))  # at most FAN
        done = counts and k == ROUNDS - 1
        rows = up.mapInArrow(lambda it, done=done: _joined(it, path, done), _with(up.schema, T.IntegerType() if done else list_type))
    long = rows.select("key", "value", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
    return short.unionByName(long).select(F.col("key").alias(key), F.col("value").alias(name))


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(key, ids): the ids of each row's whole text, without special tokens.

    Every text is a tree of halves down to leaves of ``leaf`` characters, whose ids are joined upwards. A text longer than
    ``block`` characters is first cut into blocks that are encoded as rows of their own, by as many tasks as there are; three
    rounds join neighbouring blocks. Other texts take one pass without a shuffle. Other columns aren't read. A null or empty
    text gives an empty list, a null key stays null, repeated rows give repeated rows, an empty table gives no rows. Strings
    that look like special tokens are ordinary text.
    """
    return _over(docs, key, text, path, leaf, block, False, "ids")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(key, n_tokens) of each row; of texts within a block only the lengths leave the Python workers. Cases as for token_ids."""
    return _over(docs, key, text, path, leaf, block, True, "n_tokens")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        *others, ids = batch.columns
        yield pa.RecordBatch.from_arrays([*others, pa.array([decode(x, enc) if x else "" for x in ids.to_pylist()], pa.string())], names=batch.schema.names)


def decoded(ids: DataFrame, key: str = "doc_id", name: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the texts of lists of ids; a null or empty list is an empty text. Ids that are no text are an error."""
    path = path or default_vocabulary()
    rows = ids.select(F.col(key).alias("key"), F.col(name).alias("text"))
    return rows.mapInArrow(lambda it: _decoded(it, path), _with(rows.schema, T.StringType())).select(F.col("key").alias(key), "text")
