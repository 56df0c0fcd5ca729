"""Items of varying length into containers: variable-capacity best fit on the histogram of lengths.

A container of the largest length is filled by sequences of the permitted lengths, each of which divides the next larger
one. A sequence costs its length, the square of it for attention, and a fixed amount, so short sequences are cheaper a
token while they are full, and long ones are opened only for what needs them or fills them better.

Only the histogram (one count a length, at most as many as the largest capacity) comes to the driver. The plan made
from it says how many containers of which contents there are; items find their places by a distributed numbering.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.skew import spread_row_number

#: Permitted lengths of sequences; the largest is the container, which decides what is oversized.
CAPACITIES = (512, 1024, 2048)
#: Fixed cost of one sequence in tokens, and the length at which attention costs as much as all else: six times a width of 768.
OVERHEAD, QUADRATIC = 32, 4608


def cost(length: int, overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> float:
    """What a sequence of a permitted length costs, full or not, in tokens."""
    return length + length * length / quadratic + overhead


class _Bins:
    """Groups of like bins by remaining room: (capacity, contents) -> number. Contents: tuple of (length, how many)."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.by_room: dict[int, dict[tuple[int, tuple], int]] = {}

    def put(self, room: int, capacity: int, contents: tuple, n: int) -> None:
        if room not in self.by_room:
            insort(self.rooms, room)
            self.by_room[room] = {}
        group = self.by_room[room]
        group[(capacity, contents)] = group.get((capacity, contents), 0) + n

    def take(self, at_least: int, most: int) -> tuple[int, int, tuple, int] | None:
        """Up to ``most`` like bins with the least room that is enough."""
        i = bisect_left(self.rooms, at_least)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        group = self.by_room[room]
        (capacity, contents), n = next(iter(group.items()))
        used = min(n, most)
        if used == n:
            del group[(capacity, contents)]
            if not group:
                del self.by_room[room]
                self.rooms.pop(i)
        else:
            group[(capacity, contents)] = n - used
        return room, capacity, contents, used

    def all(self):
        for room in self.rooms:
            for (capacity, contents), n in self.by_room[room].items():
                yield room, capacity, contents, n


def _add(contents: tuple, length: int, k: int) -> tuple:
    if contents and contents[-1][0] == length:
        return (*contents[:-1], (length, contents[-1][1] + k))
    return (*contents, (length, k))


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> list[tuple[int, tuple, int]]:
    """Patterns (capacity, ((length, how many), …), number of sequences) for counts by length.

    Lengths go from long to short. Each item goes into the open container with the least room that is enough. Where none
    is, the size with the least cost a token is opened: its cost over what this length and
    the shorter ones still to come can fill of it. At the end each one shrinks to the smallest permitted length
    that holds its contents. Like containers are handled as one group, so the work depends on the number of different
    lengths, not on the number of items.
    """
    sizes = sorted(capacities)
    largest = sizes[-1]
    if any(not 0 < s <= largest for s in histogram):
        raise ValueError("lengths must lie between 1 and the largest capacity")
    bins = _Bins()
    left = sum(s * n for s, n in histogram.items())
    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        left -= s * n
        while n:
            got = bins.take(s, n)
            if got is None:
                fitting = [c for c in sizes if c >= s]

                def price(c: int) -> tuple[float, int]:
                    own = min(n, c // s) * s
                    filled = own + min(c - own, left)
                    return cost(c, overhead) / filled, c

                c = min(fitting, key=price)
                per = c // s
                full, rest = divmod(n, per)
                if full:
                    bins.put(c - per * s, c, ((s, per),), full)
                if rest and full:
                    n = rest
                    # the last of them: chosen anew, for a smaller container may do
                    if rest < per:
                        c = min(fitting, key=price)
                        rest = min(rest, c // s)
                        bins.put(c - rest * s, c, ((s, rest),), 1)
                        n -= rest
                    continue
                if rest:
                    bins.put(c - rest * s, c, ((s, rest),), 1)
                n = 0
                continue
            room, capacity, contents, used = got
            per = min(room // s, n // used) or 1
            bins.put(room - per * s, capacity, _add(contents, s, per), used)
            n -= per * used
    patterns: dict[tuple[int, tuple], int] = {}
    for room, capacity, contents, n in bins.all():
        need = capacity - room
        c = next(x for x in sizes if x >= need)
        patterns[(c, contents)] = patterns.get((c, contents), 0) + n
    return [(c, contents, n) for (c, contents), n in sorted(patterns.items(), key=lambda x: (-x[0][0], x[0][1]))]


def planned_cost(patterns: list[tuple[int, tuple, int]], overhead: int = OVERHEAD) -> float:
    return sum(n * cost(c, overhead) for c, _, n in patterns)


def _places(patterns: list[tuple[int, tuple, int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank, place of the first sequence, how many each, start inside, capacity).

    Sequences lie one after the other, the longest first, in one line of tokens that is cut into containers. As lengths
    divide each other, none lies across a cut.
    """
    rows, used, at = [], {}, 0
    for capacity, contents, n in patterns:
        start = 0
        for length, per in contents:
            lo = used.get(length, 0)
            rows.append((length, lo, lo + per * n - 1, at, per, start, capacity))
            used[length] = lo + per * n
            start += length * per
        at += n * capacity
    return rows


def _items(sizes: DataFrame, key: str, size: str, largest: int) -> DataFrame:
    """(key, part, item_start, length) of the parts of all items."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    narrow = sizes.select(F.col(key).alias("key"), n.alias("size"))
    last = F.greatest(F.floor((F.col("size") - 1) / largest), F.lit(0))
    parts = narrow.select("key", "size", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("part"))
    return parts.select("key", "part", (F.col("part") * largest).alias("item_start"), F.least(F.col("size") - F.col("part") * largest, F.lit(largest)).cast("int").alias("length"))


def _histogram(items: DataFrame) -> dict[int, int]:
    return {r[0]: r[1] for r in items.where("length > 0").groupBy("length").count().collect()}  # at most `largest` rows


def _checked(capacities: tuple[int, ...]) -> tuple[int, ...]:
    sizes = tuple(sorted(set(capacities)))
    if not sizes or sizes[0] <= 0 or any(b % a for a, b in zip(sizes, sizes[1:])):
        raise ValueError("each permitted length must divide the next larger one")
    return sizes


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, buckets: int = 64) -> DataFrame:
    """(key, part, item_start, n, container, container_start, sequence_start, capacity): where each item or part of one lies.

    A container has C tokens, C the largest permitted length, and holds sequences of permitted lengths: ``capacity`` is
    the sequence's length, ``sequence_start`` its start in the container, ``container_start`` the item's. Items of 1 … C
    tokens stay whole. A longer item becomes parts of C tokens and a last part of the rest; each part is placed like an item.
    An item of size 0 or null takes no room: one row with part 0, n 0 and a null container. A null key is a key like others,
    repeated rows are items of their own. An empty table gives no rows. The result is the same however the rows are
    partitioned, up to the interchange of repeated rows.

    ``sizes`` is read twice; hand in a table that is written, not a costly plan.
    """
    capacities = _checked(capacities)
    largest = capacities[-1]
    items = _items(sizes, key, size, largest)
    places = _place_table(sizes.sparkSession, _places(plan(_histogram(items), capacities, overhead)))
    spread = F.struct("key", "part")
    ranked = spread_row_number(items.where("length > 0"), "length", spread, spread, "rank", buckets).withColumn("rank", F.col("rank") - 1)
    # the intervals of a length lie in order of rank; the item's is the last that doesn't begin behind it
    found = ranked.join(F.broadcast(places), "length").withColumn("p", F.expr(_SEARCH))
    nth = F.col("rank") - F.col("p.lo")
    at = (F.col("p.place") + F.floor(nth / F.col("p.per")) * F.col("p.capacity")).cast("long")
    placed = found.withColumn("at", at).select(
        F.col("key").alias(key),
        F.col("part").cast("int").alias("part"),
        F.col("item_start"),
        F.col("length").alias("n"),
        F.floor(F.col("at") / largest).cast("long").alias("container"),
        (F.pmod(F.col("at"), F.lit(largest)) + F.col("p.start_in") + F.pmod(nth, F.col("p.per").cast("long")) * F.col("length")).cast("int").alias("container_start"),
        F.pmod(F.col("at"), F.lit(largest)).cast("int").alias("sequence_start"),
        F.col("p.capacity").alias("capacity"),
    )
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    nothing = items.where("length <= 0").select(
        F.col("key").alias(key), F.lit(0).alias("part"), F.lit(0).cast("long").alias("item_start"), F.lit(0).alias("n"),
        none("long", "container"), none("int", "container_start"), none("int", "sequence_start"), none("int", "capacity"),
    )
    return placed.unionByName(nothing)


#: Binary search in the sorted starts of a length's intervals.
_HALVE = "aggregate(sequence(1, cast(ceil(log2(size(los) + 1)) as int)), struct(0 as lo, size(los) as hi), (s, x) -> if(s.hi - s.lo <= 1, s, if(los[cast((s.lo + s.hi) div 2 as int)] <= rank, struct(cast((s.lo + s.hi) div 2 as int) as lo, s.hi as hi), struct(s.lo as lo, cast((s.lo + s.hi) div 2 as int) as hi))), s -> s.lo)"
_SEARCH = f"spans[{_HALVE}]"


def _place_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """One row a length with its intervals in order of rank."""
    by: dict[int, list[tuple]] = {}
    for length, *rest in rows:
        by.setdefault(length, []).append(tuple(rest))
    span = T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("place", T.LongType()), T.StructField("per", T.IntegerType()), T.StructField("start_in", T.IntegerType()), T.StructField("capacity", T.IntegerType())])
    schema = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("los", T.ArrayType(T.LongType())), T.StructField("spans", T.ArrayType(span))])
    return spark.createDataFrame([(k, [x[0] for x in v], v) for k, v in sorted(by.items())], schema)


def fill_report(placed: DataFrame) -> DataFrame:
    """(capacity, sequences, tokens, unused, cost): how full the sequences of each permitted length are, and what they cost."""
    each = placed.where(F.col("container").isNotNull()).groupBy("container", "sequence_start", "capacity").agg(F.sum("n").alias("tokens"))
    out = each.groupBy("capacity").agg(F.count(F.lit(1)).alias("sequences"), F.sum("tokens").alias("tokens"), F.sum(F.col("capacity") - F.col("tokens")).alias("unused"))
    c = F.col("capacity")
    return out.withColumn("cost", F.col("sequences") * (c + c * c / QUADRATIC + OVERHEAD))


def choices(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """(lengths, sequences, room, tokens, cost): what the permitted lengths together cost, and the largest of them alone."""
    capacities = _checked(capacities)
    histogram = _histogram(_items(sizes, key, size, capacities[-1]))
    tokens = sum(k * n for k, n in histogram.items())
    rows = []
    for some in (capacities, capacities[-1:]):
        patterns = plan(histogram, some, overhead)
        rows.append((", ".join(map(str, some)), sum(n for _, _, n in patterns), sum(c * n for c, _, n in patterns), tokens, float(planned_cost(patterns, overhead))))
    return sizes.sparkSession.createDataFrame(rows, "lengths string, sequences long, room long, tokens long, cost double")


