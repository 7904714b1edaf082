"""Sharding by histogram sort, with DataFrame expressions only.

Rows are ordered by the key (hash of the text, doc_id, row number), so equal texts lie together and a group
of any size can be cut. Texts are read once; keys and sizes go to the shared folder, where all else reads them.
The driver holds, for each wanted splitter, an interval of keys. Each round counts the exact bytes below
PROBES candidate boundaries of every interval, in one aggregation with map-side partials that only looks
at rows in open intervals; with the counts come the least and largest key of each part and of the next
key column within it, so an interval shrinks to the keys that occur. Rounds end when every splitter is
within TOLERANCE of its share of the bytes or its interval is one row. Then rows are exchanged once, by
ranges of (shard, key), and numbered: a row's slot is its place in its partition plus the rows of its shard
in earlier ones, of which there is one count a partition and shard. What reaches the driver is bounded by
splitters times PROBES.

Law ``bytes``: shard sizes differ from the mean by at most twice TOLERANCE of it plus one document.
Null text: 16 bytes, and the hash of an empty text. Null doc_id: sorts with the least ids. Repeated rows, with
equal keys but for their number, are cut between shards like any others. An empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, spare, table

SHARDS, OVERHEAD = 40, 16
PROBES = 256
TOLERANCE = 0.001
LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Interval:
    """Keys low..high (both within) of one splitter; the splitter is the first key of the next shard.

    ``fixed`` holds the values of the key columns before the searched one, in whose ties it is searched.
    ``below`` counts the bytes under ``low``.
    """

    target: float
    low: int = LEAST
    high: int = MOST
    below: int = 0
    fixed: tuple[int, ...] = ()
    cut: tuple[int, ...] | None = None

    def place(self) -> tuple:
        return self.fixed, self.low, self.high


def splitters(rows: DataFrame, keys: list[str], size: str, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """Sorted keys that begin shards 1, 2, ...; fewer than shards - 1 only for an empty table. ``keys`` together are unique."""
    total = rows.agg(F.sum(size)).first()[0]
    if not total:
        return []
    slack = tolerance * total / shards
    wanted = [Interval(total * k / shards) for k in range(1, shards)]
    while open_ := [w for w in wanted if w.cut is None]:
        counts = _histogram(rows, keys, size, sorted({w.place() for w in open_}))
        for w in open_:
            _narrow(w, counts[w.place()], slack, len(keys))
    return sorted(w.cut for w in wanted)


def _step(low: int, high: int) -> int:
    return max(1, -(-(high - low + 1) // PROBES))


def _histogram(rows: DataFrame, keys: list[str], size: str, intervals: list[tuple]) -> dict[tuple, dict[int, tuple]]:
    """(bytes, least and largest key, least and largest value of the next key column) of each of up to PROBES equal parts of each interval."""
    place, key, following = F.lit(None).cast("struct<i:int,part:int>"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for i, (fixed, low, high) in reversed(list(enumerate(intervals))):
        at = len(fixed)
        value = F.col(keys[at])
        inside = (value >= F.lit(low)) & (value <= F.lit(high))
        for name, tied in zip(keys, fixed, strict=False):
            inside &= F.col(name) == F.lit(tied)
        # decimals, as the distance of two longs may not fit a long
        part = F.floor((value.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(_step(low, high)).cast("decimal(20,0)"))
        place = F.when(inside, F.struct(F.lit(i).alias("i"), part.cast("int").alias("part"))).otherwise(place)
        key = F.when(inside, value).otherwise(key)
        following = F.when(inside, F.col(keys[min(at + 1, len(keys) - 1)])).otherwise(following)
    found = rows.select(place.alias("place"), size, key.alias("key"), following.alias("next")).where("place is not null")
    got = found.groupBy("place").agg(F.sum(size).alias("bytes"), *[f(c).alias(f"{n}_{c}") for c in ("key", "next") for n, f in (("low", F.min), ("high", F.max))]).collect()
    out: dict[tuple, dict[int, tuple]] = {i: {} for i in intervals}
    for r in got:
        out[intervals[r["place"]["i"]]][r["place"]["part"]] = (r["bytes"], (r["low_key"], r["high_key"]), (r["low_next"], r["high_next"]))
    return out


def _narrow(w: Interval, parts: dict[int, tuple], slack: float, columns: int) -> None:
    """Take the boundary nearest to the target if it is near enough, else go into the keys of the part that holds it."""
    below, rest = w.below, (LEAST,) * (columns - len(w.fixed) - 1)
    for part in sorted(parts):
        size, (begin, end), following = parts[part]
        above = below + size
        if above < w.target and part != max(parts):
            below = above
            continue
        near = min((below, begin), (above, end + 1), key=lambda c: abs(c[0] - w.target))
        if abs(near[0] - w.target) <= slack and near[1] <= MOST:
            w.cut = (*w.fixed, near[1], *rest)
        elif begin < end:
            w.low, w.high, w.below = begin, end, below
        elif rest:
            w.fixed, (w.low, w.high), w.below = (*w.fixed, begin), following, below
        else:
            w.cut = (*w.fixed, min(near[1], MOST))
        return


def shard_of(keys: list[Column], cuts: list[tuple[int, ...]]) -> Column:
    """How many of the sorted ``cuts`` are at or below the key, by a tree of comparisons."""

    def before(cut: tuple[int, ...]) -> Column:
        *front, (key, value) = zip(keys, cut, strict=True)
        out = key < F.lit(value)
        for key, value in reversed(front):
            out = (key < F.lit(value)) | ((key == F.lit(value)) & out)
        return out

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(before(cuts[middle]), pick(low, middle)).otherwise(pick(middle + 1, high))

    return pick(0, len(cuts))


def sharded(rows: DataFrame, first: str, second: str, size: str, shards: int = SHARDS) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, by equal sums of ``size`` along the keys (longs without nulls).

    ``rows`` is written to the shared folder first, so keep it narrow.
    """
    nth, part, at = spare(rows, "nth", "part", "at")
    rows = checkpoint(rows.withColumn(nth, F.monotonically_increasing_id()))
    unique = [first, second, nth]
    cuts = splitters(rows, unique, size, shards)
    placed = rows.withColumn("shard", shard_of([F.col(c) for c in unique], cuts).cast("int"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("shard", *unique)
    # the number within a partition is the low 33 bits of an increasing id
    sorted_ = placed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    sorted_ = checkpoint(sorted_.withColumn(part, F.shiftright(at, 33)))
    counts = sorted_.groupBy("shard", part).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition, and one more where a shard begins within one
    starts = F.broadcast(counts.select("shard", part, (before - F.col("first")).alias("shift")))
    met = sorted_.join(starts, ["shard", part])
    return met.select(*[c for c in rows.columns if c != nth], "shard", (F.col(at) + F.col("shift")).cast("long").alias("slot"))


def op4_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_first"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("_second"),
    )
    got = sharded(rows, "_first", "_second", "size")
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
