"""The N best rows of every group, by statistics-guided skipping over a table clustered by group.

The rows are written once, clustered by group and falling score. A row group of the files holds either a bundle of whole
groups or a slice of one large group, and its statistics say which: the largest score in it and the N-th of its different
rows. The best N-th score that any row group of a group proves is known to all files, so of a crowded group only the row
groups that reach it are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.skew import hot_keys, salted_join
from tessera.session import cut, fresh_path

#: Rows of a row group of the clustered table; a group with as many rows in a task gets row groups of its own.
ROWS = 4_096
#: A hot group's rows are spread over tasks by ranges of score, and each range by hash, for many rows may have one score.
RANGES, SPREAD = 8, 4

_STATS = "path string, place int, g string, nth {low}, low {low}, n int"


def _negative(score: Column, kind: T.DataType) -> Column:
    """The score with its sign turned, in a type that keeps its order: doubles stay doubles, whole numbers become decimals."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return -score.cast("double")
    return -score.cast(kind if isinstance(kind, T.DecimalType) else "decimal(20,0)")


def _rows(hits: DataFrame, group: str, score: str, ties: list[str], same: list[str]) -> DataFrame:
    """(g, low, t0…, same1, same2) of the rows that take part."""
    x = F.col(score)
    known = x.isNotNull() & ~F.isnan(x) if isinstance(hits.schema[score].dataType, (T.FloatType, T.DoubleType)) else x.isNotNull()
    whole = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in same]
    return hits.where(F.col(group).isNotNull() & known).select(
        F.col(group).cast("string").alias("g"),
        _negative(x, hits.schema[score].dataType).alias("low"),
        *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)],
        F.xxhash64(*whole, F.lit(1)).alias("same1"),
        F.hash(*whole, F.lit(2)).alias("same2"),
    )


def _spread(rows: DataFrame) -> Column:
    """0 for the rows of ordinary groups; for hot groups (at most 200) the range of the score and a hash of the row."""
    hot = [r[0] for r in hot_keys(rows, "g").collect()]
    if not hot:
        return F.lit(0)
    at = [k / RANGES for k in range(1, RANGES)]
    cuts = rows.where(F.col("g").isin(hot)).groupBy("g").agg(F.percentile_approx("low", F.array(*map(F.lit, at)), F.lit(1000)).alias("cuts")).collect()
    of = F.create_map(*[c for r in cuts for c in (F.lit(r.g), F.array(*map(F.lit, r.cuts)))])
    below = F.size(F.filter(F.element_at(of, F.col("g")), lambda c: c < F.col("low")))
    return F.when(F.col("g").isin(hot), below * SPREAD + F.pmod(F.xxhash64("same1", "same2"), F.lit(SPREAD)) + 1).otherwise(0).cast("int")


def _open(uri: str, write: bool = False):
    import pyarrow.fs as pafs

    if uri.startswith("file:"):
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    fs, inner = pafs.FileSystem.from_uri(uri)
    if not write:
        return fs.open_input_file(inner)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(inner)


def different(same1: np.ndarray, same2: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Marks the first of the rows of a run that are one row; the rows come in placing order."""
    order = np.lexsort((np.arange(len(run)), same2, same1, run))
    first = np.ones(len(run), dtype=bool)
    again = np.ones(max(0, len(run) - 1), dtype=bool)
    for x in (same1, same2, run):
        again &= x[order[1:]] == x[order[:-1]]
    first[order[1:][again]] = False
    return first


def _run_starts(g: pa.Array) -> np.ndarray:
    if not len(g):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.r_[True, np.asarray(pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)))])


def best_of(table: pa.Table, n: int) -> pa.Table:
    """The n best different rows of each group of rows in placing order, with their place."""
    table = table.combine_chunks()
    starts = _run_starts(table.column("g").combine_chunks() if table.num_rows else pa.array([], pa.string()))
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, table.num_rows]))
    same1, same2 = (table.column(c).to_numpy() for c in ("same1", "same2"))
    at = np.flatnonzero(different(same1, same2, run))
    runs = run[at]
    heads = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]]) if len(runs) else runs
    place = np.arange(len(runs)) - np.repeat(heads, np.diff(np.r_[heads, len(runs)])) + 1
    keep = place <= n
    return table.take(pa.array(at[keep])).append_column("place", pa.array(place[keep].astype(np.int32)))


class _Writer:
    """One file of the clustered table; rows come by group and in placing order."""

    def __init__(self, folder: str, schema: pa.Schema, n: int, rows: int) -> None:
        import pyarrow.parquet as pq

        self.path = f"{folder}/{uuid.uuid4().hex}.parquet"
        self.sink = _open(self.path, write=True)
        self.file = pq.ParquetWriter(self.sink, schema, compression="zstd")
        self.n, self.rows, self.stats = n, rows, []
        self.bundle: list[pa.Table] = []
        self.group: list[pa.Table] = []
        self.large = False

    def _flush(self, tables: list[pa.Table], group: str | None) -> None:
        size = sum(t.num_rows for t in tables)
        if not size:
            return
        table = pa.concat_tables(tables).combine_chunks()
        nth = None
        if group is not None:
            best = best_of(table, self.n).column("low")
            nth = best[self.n - 1].as_py() if len(best) == self.n else None
        low = table.column("low")[0].as_py() if group is not None else None
        self.stats.append((self.path, len(self.stats), group, nth, low, size))
        self.file.write_table(table, row_group_size=size)

    def _end_group(self) -> None:
        if self.large:
            self._flush(self.group, self.group[0].column("g")[0].as_py() if self.group else None)
        else:
            self.bundle += self.group
            if sum(t.num_rows for t in self.bundle) >= self.rows:
                self._flush(self.bundle, None)
                self.bundle = []
        self.group, self.large = [], False

    def _more(self, part: pa.Table) -> None:
        self.group.append(part)
        while sum(t.num_rows for t in self.group) >= self.rows:
            if not self.large:
                self._flush(self.bundle, None)
                self.bundle, self.large = [], True
            whole = pa.concat_tables(self.group)
            self._flush([whole.slice(0, self.rows)], whole.column("g")[0].as_py())
            self.group = [whole.slice(self.rows)] if whole.num_rows > self.rows else []

    def take(self, table: pa.Table, last: str | None) -> str | None:
        g = table.column("g").combine_chunks()
        starts = _run_starts(g)
        ends = np.r_[starts[1:], len(g)]
        if len(starts) and last is not None and g[0].as_py() != last:
            self._end_group()
        k = 0
        while k < len(starts):
            lo, hi = int(starts[k]), int(ends[k])
            if k == len(starts) - 1:
                self._more(table.slice(lo))  # may go on in the next batch
                return g[lo].as_py()
            if k == 0 or hi - lo >= self.rows:
                self._more(table.slice(lo, hi - lo))
                self._end_group()
                k += 1
                continue
            # small groups that lie wholly inside the batch, as many as fill a bundle
            room = max(1, self.rows - sum(t.num_rows for t in self.bundle))
            j = k
            while j < len(starts) - 1 and ends[j] - starts[j] < self.rows and ends[j] - lo < room:
                j += 1
            j = max(j, k + 1)
            self.group = [table.slice(lo, int(ends[j - 1]) - lo)]
            self._end_group()
            k = j
        return last

    def close(self) -> list[tuple]:
        self._end_group()
        self._flush(self.bundle, None)
        self.file.close()
        self.sink.close()
        return self.stats


def _write(it: Iterator[pa.RecordBatch], folder: str, n: int, rows: int, stats: pa.Schema) -> Iterator[pa.RecordBatch]:
    writer, last = None, None
    for batch in it:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            writer = writer or _Writer(folder, table.schema, n, rows)
            last = writer.take(table, last)
    if writer is not None:
        found = writer.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found), stats)], schema=stats)


def cluster(hits: DataFrame, folder: str, n: int, group: str, score: str, ties: list[str], same: list[str], rows_a_group: int = ROWS) -> DataFrame:
    """Write the rows that take part, clustered by group and inside by falling score; returns the statistics.

    (path, place, g, nth, low, n), one row a row group: its file and place there, and for a slice of one group the group,
    the negative score of its N-th different row and of its best row. A bundle of whole groups has no g.
    """
    rows = _rows(hits, group, score, ties, same)
    order = ["g", "low", *[F.asc_nulls_last(f"t{i}") for i in range(len(ties))]]
    placed = rows.withColumn("at", _spread(rows)).repartition("g", "at").drop("at").sortWithinPartitions(*order)
    low = placed.schema["low"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(_STATS.format(low=low))
    arrow = to_arrow_schema(schema)
    return cut(placed.mapInArrow(lambda it: _write(it, folder, n, rows_a_group, arrow), schema))


def kept(stats: DataFrame) -> DataFrame:
    """The row groups to read: bundles, and slices whose best row isn't strictly below the best N-th score known of their group."""
    slices = stats.where("g is not null")
    bounds = slices.where("nth is not null").groupBy("g").agg(F.min("nth").alias("bound"))
    reach = salted_join(slices, bounds, "g", F.col("path"), how="left").where("bound is null or low <= bound").drop("bound")
    return stats.where("g is null").unionByName(reach.select(*stats.columns))


def _read(it: Iterator[pa.RecordBatch], n: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    for batch in it:
        for path, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            file = pq.ParquetFile(_open(path))
            nth: dict[str, object] = {}
            # falling maximum score; bundles have none and lie apart
            for spot in sorted(spots, key=lambda s: (s["low"] is not None, s["low"] if s["low"] is not None else 0, s["place"])):
                g = spot["g"]
                if g in nth and spot["low"] > nth[g]:
                    continue
                best = best_of(file.read_row_group(spot["place"]), n)
                if g is not None and best.num_rows == n:
                    reached = best.column("low")[n - 1].as_py()
                    nth[g] = min(reached, nth.get(g, reached))
                yield from best.select(out.names).cast(out).to_batches()


def _best(chosen: DataFrame, n: int, schema: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    files = chosen.groupBy("path").agg(F.collect_list(F.struct("place", "g", "low")).alias("spots"))  # the row groups of one file
    return files.repartition("path").mapInArrow(lambda it: _read(it, n, out), schema)


def _remove(hits: DataFrame, folder: str) -> None:
    context = hits.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def top_n(hits: DataFrame, n: int, group: str, score: str, ties: list[str], same: list[str], rows_a_group: int = ROWS) -> DataFrame:
    """(group, *ties, score, place): the n rows of every group with the highest score, all where there are fewer.

    Ties go to the smaller value of each column of ``ties`` in turn (null last; numbers, the last one the row's id). Rows
    equal in all columns of ``same`` (null equals null; compared by 96 bits of hashes inside a group) are one row: the best
    placed stands for them, which among rows of equal score is the one with the smallest ties. Rows with a null group or a
    null or NaN score take no part. Infinite scores are scores; whole numbers and decimals keep their full precision. A
    table without rows gives none. Other columns aren't read.

    The rows are shuffled and written once, clustered by group and falling score, to the shared folder (see ``cluster``);
    hot groups are spread over tasks by ranges of score. Bundles of whole groups are read and done with. Of a large group
    the row groups are read in falling order of their maximum score; those strictly below the best N-th score that the
    statistics of any of its row groups prove aren't read. What several row groups of a group yield, at most n rows each,
    is merged by a window. The result is written too, and the clustered table removed.
    """
    folder = fresh_path(hits.sparkSession, "topn")
    stats = cluster(hits, folder, n, group, score, ties, same, rows_a_group)
    chosen = kept(stats)
    kinds = [hits.schema[c].dataType for c in ties]
    fields = [T.StructField("g", T.StringType()), T.StructField("low", stats.schema["low"].dataType), *[T.StructField(f"t{i}", k) for i, k in enumerate(kinds)], T.StructField("same1", T.LongType()), T.StructField("same2", T.IntegerType()), T.StructField("place", T.IntegerType())]
    whole = _best(chosen.where("g is null"), n, T.StructType(fields))
    parts = _best(chosen.where("g is not null"), n, T.StructType(fields)).drop("place")
    order = [F.col("low"), *[F.asc_nulls_last(f"t{i}") for i in range(len(ties))]]
    first = Window.partitionBy("g", "same1", "same2").orderBy(*order)
    once = parts.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy")
    merged = once.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("place") <= n)
    found = cut(whole.unionByName(merged))
    _remove(hits, folder)
    back = (-F.col("low")).cast(hits.schema[score].dataType)
    return found.select(F.col("g").cast(hits.schema[group].dataType).alias(group), *[F.col(f"t{i}").alias(c) for i, c in enumerate(ties)], back.alias(score), "place")


def skipping(hits: DataFrame, n: int, group: str, score: str, ties: list[str], same: list[str], rows_a_group: int = ROWS) -> DataFrame:
    """(kind, row_groups, row_groups_read, rows, rows_read): what the statistics spare; kind is bundle or slice."""
    folder = fresh_path(hits.sparkSession, "topn")
    stats = cluster(hits, folder, n, group, score, ties, same, rows_a_group)
    read = kept(stats).select("path", "place", F.lit(1).alias("read"))
    kind = F.when(F.col("g").isNull(), "bundle").otherwise("slice").alias("kind")
    out = stats.join(read, ["path", "place"], "left").groupBy(kind).agg(
        F.count(F.lit(1)).alias("row_groups"), F.count("read").alias("row_groups_read"), F.sum("n").alias("rows"), F.sum(F.when(F.col("read") == 1, F.col("n")).otherwise(0)).alias("rows_read")
    )
    out = cut(out)
    _remove(hits, folder)
    return out
