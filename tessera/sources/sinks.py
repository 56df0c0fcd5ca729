"""Tables as files: ordered JSON lines, versioned tables behind a pointer, index tables, manifests without content."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a total order, keys sorted, in files whose names follow the order; nothing is gathered in one task."""
    cols = sorted(df.columns)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_version(df: DataFrame, root: str, by: list[str] | None = None) -> str:
    """Write a new version of a table beside the old ones and point to it only when it is whole; returns its folder."""
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(f"{root}/{name}")
    _put(spark, f"{root}/CURRENT", name)
    return f"{root}/{name}"


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The version of a table that its pointer names."""
    return spark.read.parquet(f"{root}/{spark.read.text(f'{root}/CURRENT').first()[0]}")


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file by writing beside it and renaming over it, which readers see as a whole or not at all."""
    jvm = spark.sparkContext._jvm
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fresh), fs.makeQualified(target), how)


def write_manifest(spark: SparkSession, path: str, payload: dict) -> None:
    """A manifest as sorted, indented JSON."""
    _put(spark, path, json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def content_columns(schema: T.StructType, forbidden: frozenset[str], at: str = "") -> list[str]:
    """Names, with their paths, of columns that a table meant for publication must not have."""
    out = []
    for f in schema.fields:
        name = f"{at}{f.name}"
        if f.name in forbidden:
            out.append(name)
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(kind, T.StructType):
            out += content_columns(kind, forbidden, f"{name}.")
    return out


def fingerprint(df: DataFrame, key: list[str]) -> str:
    """SHA-256 over the sorted row digests' sums: the same for the same rows in any order or partitioning."""
    d = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(d, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    row = df.select(*[c for c in dict.fromkeys([*key, *df.columns])]).agg(F.count(F.lit(1)), *[part(i) for i in range(5)]).first()
    import hashlib

    return hashlib.sha256("|".join(str(x) for x in row).encode()).hexdigest().upper()


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key isn't among the finished rows, so that a batch goes on where it stopped."""
    return work.join(done.where("status = 'ok'").select(*keys).distinct(), keys, "left_anti")
