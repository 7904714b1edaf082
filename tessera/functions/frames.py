"""Helpers on DataFrames that operators share."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names, set for checkpoints.

    Only a session on one machine may leave it unset and gets a temporary folder; on a cluster that would
    be a folder executors do not share, so it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, key: str, seed: int | None = None, name: str = "idx") -> tuple[DataFrame, int]:
    """``df`` with rows numbered from 0 in the order of ``key``, or of a hash of (seed, key), and their count.

    Ranges of the order go to partitions of about equal size and are numbered there; only one count a
    partition meets in one place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.withColumn("_h", F.lit(0).cast("long") if seed is None else F.xxhash64(F.lit(seed), key))
    ordered = hashed.repartitionByRange(parts, "_h", key).sortWithinPartitions("_h", key)
    # the number within a partition is the low 33 bits of an increasing id
    placed = cut(ordered.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    starts = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n") - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_h", "_part", "_at", "_shift"), n


#: Partial vectors that are added up in one task, or on the driver.
FAN_IN = 32
#: Numbers of partial vectors that the driver adds up; more are added up in tasks to one vector.
DRIVER_NUMBERS = 1 << 16


def matrix(column) -> np.ndarray:
    """Rows of an Arrow column of equally long lists of numbers."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def tree_sum(rows: DataFrame, partial: Callable[[Iterator], np.ndarray | None], numbers: int = 0) -> np.ndarray | None:
    """The sum of the vectors that ``partial`` makes of the Arrow batches of each partition; None if it makes none.

    FAN_IN vectors at most meet in a task or on the driver, in the order of their partitions, so sums repeat
    to the last bit. Say of how many ``numbers`` a vector is if they may be many: the driver then gets one.
    """
    import pyarrow as pa

    schema, names = "part long, data binary", ["part", "data"]

    def first(batches):
        from pyspark import TaskContext

        if (vector := partial(batches)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([vector.astype(np.float64).tobytes()], pa.binary())], names=names)

    def total(found: list[tuple[int, bytes]]) -> np.ndarray:
        return sum((np.frombuffer(data) for _, data in sorted(found)[1:]), np.frombuffer(min(found)[1]).copy())

    def added(table):
        found = list(zip(table.column("part").to_pylist(), table.column("data").to_pylist(), strict=True))
        return pa.table([pa.array([min(found)[0] // FAN_IN], pa.int64()), pa.array([total(found).tobytes()], pa.binary())], names=names)

    parts, width = rows.mapInArrow(first, schema), rows.rdd.getNumPartitions()
    while width > FAN_IN or (width > 1 and width * numbers > DRIVER_NUMBERS):
        parts, width = parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("lot")).applyInArrow(added, schema), -(-width // FAN_IN)
    found = [(r["part"], bytes(r["data"])) for r in parts.collect()]
    return total(found) if found else None


#: Parts that an interval of values is counted in at a time.
PROBES = 256


def order_statistics(values: DataFrame, places: list[int]) -> list[float]:
    """The values at ``places`` (from 0) of the one column of ``values`` (doubles; nulls are left out, NaN comes last), in order.

    Counts below PROBES boundaries of the interval that holds a place are exact, and the interval shrinks to
    the least and largest value of the part that holds it, until it is one value. Every round is one
    aggregation with map-side partials, and places share it; only counts reach the driver. Keep ``values``
    where it is cheap to read again.
    """
    v = F.col(values.columns[0])
    low, high, n = values.where(~F.isnan(v)).agg(F.min(v), F.max(v), F.count(v)).first()
    # (low, high, values below low) of each place
    open_ = {p: (low, high, 0) for p in places if p < n}
    while wide := sorted({o for o in open_.values() if o[0] < o[1]}):
        place = F.lit(None).cast("struct<i:int,part:int>")
        for i, (a, b, _) in enumerate(wide):
            # halves where the distance of two doubles is none; the largest value has a part of its own
            by = 1.0 if math.isfinite(b - a) else 2.0
            share = (v / by - F.lit(a / by)) / F.lit(b / by - a / by)
            part = F.when(v == b, PROBES).otherwise(F.least(F.floor(share * PROBES), F.lit(PROBES - 1)))
            place = F.when((v >= a) & (v <= b), F.struct(F.lit(i).alias("i"), part.cast("int").alias("part"))).otherwise(place)
        counted = values.select(v.alias("v"), place.alias("place")).where("place is not null").groupBy("place").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        parts: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: tuple(r["place"])):
            parts.setdefault(r["place"]["i"], []).append(r)
        for p, (a, b, below) in open_.items():
            if a < b:
                for r in parts[wide.index((a, b, below))]:
                    if p < below + r["n"]:
                        open_[p] = (r["low"], r["high"], below)
                        break
                    below += r["n"]
    return [open_[p][0] if p in open_ else float("nan") for p in places]


def exact_median(values: DataFrame) -> float | None:
    """The median of the one column of ``values``: the mean of the middle two for even counts, None for none."""
    n = values.where(F.col(values.columns[0]).isNotNull()).count()
    if not n:
        return None
    a, b = order_statistics(values, [(n - 1) // 2, n // 2])
    return a if a == b else a / 2 + b / 2


#: A prime whose squares fit a long; shuffles are worked out in numbers below it, which any SQL can follow.
PRIME = (1 << 31) - 1
HALF_ROUNDS = 6


def _below_prime(h: np.ndarray) -> np.ndarray:
    """``h % PRIME`` of unsigned 64-bit numbers; 2^31 is 1 there, so the upper bits are added to the lower ones."""
    prime, bits = np.uint64(PRIME), np.uint64(31)
    for _ in range(2):
        h = (h & prime) + (h >> bits)
    h = (h & prime) + (h >> bits)
    return np.where(h == prime, np.uint64(0), h)


def scrambled(ids: np.ndarray, step: int, seed: int) -> np.ndarray:
    """Numbers below PRIME that look random, from ids; any SQL can follow them."""
    h = _below_prime((ids % PRIME).astype(np.uint64) * np.uint64(48271) + np.uint64((step + 1) * 7919 + seed * 15485863 + 12345))
    for _ in range(3):
        h = _below_prime(_below_prime(h * h) * np.uint64(48271) + h + np.uint64(11))
    return h


def scrambled_column(ids: Column, step: int, seed: int) -> Column:
    """``scrambled`` as an expression, for ids of 0 and more."""
    h = (ids % PRIME * 48271 + ((step + 1) * 7919 + seed * 15485863 + 12345)) % PRIME
    for _ in range(3):
        h = (h * h % PRIME * 48271 + h + 11) % PRIME
    return h


def shuffle_key(perm: int, half: int, which: int, seed: int) -> int:
    """The keys of one shuffle are numbers below PRIME, scrambled from its own number."""
    k = ((perm + 1) * 1000003 + (half + 1) * 7919 + (which + 1) * 104729 + seed * 15485863 + 12345) % PRIME
    for _ in range(3):
        k = (k * k % PRIME * 48271 + k + 11) % PRIME
    return k


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n - 1) + 1) if n > 1 else 1
    return a, -(-n // a) if n else 1


def shuffle_rounds(n: int, keys: list[int]) -> list[np.ndarray]:
    """What each half round of a keyed permutation of 0..n-1 adds, for every value that it may draw on: about sqrt(n) of them."""
    prime, (a, b), out = np.uint64(PRIME), _sides(n), []
    for half in range(HALF_ROUNDS):
        own, other = (a, b) if half % 2 == 0 else (b, a)
        v = (np.arange(other, dtype=np.uint64) + np.uint64(keys[2 * half])) % prime
        out.append(((v * v % prime * np.uint64(keys[2 * half + 1]) + v) % prime % np.uint64(own)).astype(np.int32 if own < 1 << 31 else np.int64))
    return out


def shuffled(index: np.ndarray, n: int, keys: list[int], rounds: list[np.ndarray] | None = None) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 puts each of ``index``.

    A number is cut into a quotient and a rest of about sqrt(n) each; in turn, each has a keyed number of
    the other added to it (a Feistel network), which permutes the least rectangle that holds n; numbers
    outside 0..n-1 go through again. No sort and no exchange, and shuffles with different keys have
    nothing in common. Give ``rounds`` (see ``shuffle_rounds``) to use them for several arrays.
    """
    (a, b), rounds = _sides(n), shuffle_rounds(n, keys) if rounds is None else rounds
    out = np.asarray(index, np.int64)
    waiting = None
    while waiting is None or len(waiting):
        now = out if waiting is None else out[waiting]
        left = now // b
        right = now - left * b
        for half, add in enumerate(rounds):
            own, other, room = (left, right, a) if half % 2 == 0 else (right, left, b)
            own += add[other]
            own -= room * (own >= room)
        now = left * b + right
        if waiting is None:
            out, waiting = now, np.flatnonzero(now >= n)
        else:
            out[waiting] = now
            waiting = waiting[now >= n]
    return out


def shuffled_labels(labels: DataFrame, label: str, n_perm: int, seed: int) -> tuple[DataFrame, list]:
    """((cell_id, codes), names): for each cell an array with its label's place in ``names`` in each of ``n_perm`` shuffles.

    Cells are numbered once. Label counts cut 0..n-1 into one range for each label, and a cell has the label
    whose range its number is shuffled into; so every shuffle keeps the counts, and cells never move.
    """
    rows, names, shuffles = label_shuffles(labels, label, n_perm, seed)

    def deal(batches):
        import pyarrow as pa

        codes = shuffles()
        for batch in batches:
            idx = np.asarray(batch.column(1), np.int64)
            flat = pa.array(np.stack(list(codes(idx)), axis=1).ravel().astype(np.int32) if n_perm else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(idx) + 1, dtype=np.int32) * n_perm), flat)], names=["cell_id", "codes"])

    kind = labels.schema["cell_id"].dataType.simpleString()
    return rows.mapInArrow(deal, f"cell_id {kind}, codes array<int>"), names


def label_shuffles(labels: DataFrame, label: str, n_perm: int, seed: int) -> tuple[DataFrame, list, Callable]:
    """((cell_id, idx), names, shuffles): cells with their numbers, and what makes, in a task, a function from numbers to the
    codes they have in each shuffle, one array after the other."""
    counts = labels.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()  # the catalog of labels
    rows, n = numbered(labels.select("cell_id"), "cell_id")
    ends = np.cumsum([r["n"] for r in counts])
    keys = [[shuffle_key(p, half, which, seed) for half in range(HALF_ROUNDS) for which in (0, 1)] for p in range(n_perm)]

    def shuffles() -> Callable[[np.ndarray], Iterator[np.ndarray]]:
        rounds = [shuffle_rounds(n, k) for k in keys]
        return lambda idx: (np.searchsorted(ends, shuffled(idx, n, k, r), "right") for k, r in zip(keys, rounds, strict=True))

    return rows.select("cell_id", "idx"), [r["label"] for r in counts], shuffles
