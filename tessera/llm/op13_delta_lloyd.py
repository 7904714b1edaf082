"""Centroid clustering by delta Lloyd, exact in integers.

Vectors are dealt once into a bucketed table of the shared warehouse by a row number of their own. What
changes, each vector's owner and squared distance, is a narrow bucketed table written anew each round, so
vectors and assignments meet bucket by bucket without an exchange and a lost executor costs a re-read.
A round compares a vector whose owner stayed put only with the centroids that moved (its own distance is
known, and the others were no nearer before); only where the owner moved are all centroids compared. Each
task adds up what changes hands as signed integers, components and counts by centroid, and puts them into
the last row that it writes. The driver keeps the global sums (centroids x components) and adds the
transfers to them. Rounds after the first without a moved centroid would change nothing and are skipped.

Kept are vectors of WIDTH components, none null, none non-finite, each below MOST in size (so that every
squared distance fits a long); the others get no row, nor does a null vector. Components become
floor(SCALE * x). Starts: the kept vectors of least sha256 of ``3:<vec_id>``, a null id standing for the
empty string, rows of equal ids in order of their components. Repeated rows are clustered one by one. Ties
go to the smaller centroid, empty centroids stay where they are, and there are fewer centroids than asked
for if fewer vectors are kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, table

WIDTH, CENTROIDS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, 3
MOST = float(1 << 17)
#: Products of integers below this are summed exactly by floating-point matrix products.
EXACT = 1 << 22
#: Rows of a bucket; a row is some 300 bytes.
BUCKET_ROWS = 400_000
STATE = "id long, vec_id long, owner int, distance long, transfers array<struct<c:int,v:array<long>>>"
TRANSFERS = pa.list_(pa.struct([("c", pa.int32()), ("v", pa.list_(pa.int64()))]))


def kept(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id long, x array<int>) of the rows that take part."""
    x = F.col(embedding).cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= MOST)
    rows = vectors.where((F.size(x) == width) & ~F.exists(x, bad))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("x"))


def start_key(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{SALT}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer rows."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1).reshape(len(x), len(centroids))


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances; ``owner`` is -1 where there is none yet, ``moved`` says which centroids changed."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | moved[owner]
    if lost.any():
        d = squared(x[lost], centroids)
        owner[lost] = d.argmin(axis=1)
        distance[lost] = d.min(axis=1)
    stays, changed = np.flatnonzero(~lost), np.flatnonzero(moved)
    if len(stays) and len(changed):
        d = squared(x[stays], centroids[changed])
        best = d.argmin(axis=1)
        near, name = d[np.arange(len(stays)), best], changed[best]
        goes = (near < distance[stays]) | ((near == distance[stays]) & (name < owner[stays]))
        owner[stays[goes]], distance[stays[goes]] = name[goes], near[goes]
    return owner, distance


def _round(centroids: np.ndarray, moved: np.ndarray):
    """Batches of (id, vec_id, x, owner, distance) -> STATE; the last row of a task has its transfers."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # integers of 2^27 at most, so a task's totals fit a long
        totals, last = np.zeros((k, width + 1), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(2).flatten(), np.int64).reshape(batch.num_rows, width)
            before = np.asarray(batch.column(3), np.int64)
            owner, distance = reassigned(x, before, np.asarray(batch.column(4), np.int64), centroids, moved)
            went = np.flatnonzero(owner != before)
            joined = np.concatenate([x[went], np.ones((len(went), 1), np.int64)], axis=1)
            np.add.at(totals, owner[went], joined)
            left = before[went] >= 0
            np.subtract.at(totals, before[went][left], joined[left])
            if last is not None:
                yield from _written(*last, None)
            last = batch, owner, distance
        if last is not None:
            yield from _written(*last, totals)

    return run


def _written(batch: pa.RecordBatch, owner: np.ndarray, distance: np.ndarray, totals: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    transfers = pa.array([None] * (n - 1) + [None if totals is None else [{"c": c, "v": t.tolist()} for c, t in enumerate(totals) if t.any()]], TRANSFERS)
    arrays = [batch.column(0), batch.column(1), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), transfers]
    yield pa.RecordBatch.from_arrays(arrays, names=["id", "vec_id", "owner", "distance", "transfers"])


class Tables:
    """Bucketed tables of one run in the warehouse that driver and executors share; dropped when no longer needed."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.stem = spark, buckets, f"delta_lloyd_{uuid.uuid4().hex}"
        self.names: list[str] = []
        atexit.register(self.drop)

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        full = f"{self.stem}_{name}"
        rows.write.bucketBy(self.buckets, "id").sortBy("id").format("parquet").saveAsTable(full)
        self.names.append(full)
        return self.spark.table(full)

    def drop(self, keep: int = 0) -> None:
        """All but the ``keep`` latest tables; best effort, as the session may be gone when the driver ends."""
        try:
            while len(self.names) > keep:
                self.spark.sql(f"drop table if exists {self.names.pop(0)}")
        except Exception:  # noqa: BLE001
            return


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, *, vec_id: str = "vec_id", embedding: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """((vec_id, owner, distance) of every kept vector, final centroids, number of centroids that moved in each round)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = kept(vectors, vec_id, embedding, width, scale)
    first = rows.select("x", start_key(F.col("vec_id")).alias("key")).orderBy("key", "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), width)
    if not len(first):
        return rows.select("vec_id", F.lit(0).alias("owner"), F.lit(0).cast("long").alias("distance")), centroids, []
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-rows.count() // BUCKET_ROWS))
    stored, states = Tables(spark, buckets), Tables(spark, buckets)
    points = stored.write("points", rows.withColumn("id", F.monotonically_increasing_id()).repartition(buckets, "id"))
    sums, moved, history, state = np.zeros((len(centroids), width + 1), object), np.ones(len(centroids), bool), [], None
    for step in range(rounds + 1):
        if not moved.any():
            break
        if state is None:
            met = points.select("id", "vec_id", "x", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
        else:
            met = points.select("id", "vec_id", "x").join(state.select("id", "owner", "distance"), "id")
        state = states.write(f"state_{step}", met.mapInArrow(_round(centroids, moved), STATE))
        states.drop(keep=1)
        if step == rounds:
            break
        # a row for each task and centroid that took part
        gone = state.where("transfers is not null").select(F.explode("transfers").alias("t")).groupBy("t.c").agg(*[F.sum(F.col("t.v")[i].cast("decimal(38,0)")) for i in range(width + 1)])
        for c, *more in gone.collect():  # centroids x components
            sums[c] += np.array([int(v) for v in more], object)
        after = centroids.copy()
        for c, total in enumerate(sums):
            if total[-1]:
                after[c] = [v // total[-1] for v in total[:-1]]
        moved = (after != centroids).any(axis=1)
        history.append(int(moved.sum()))
        centroids = after
    return state.select("vec_id", "owner", "distance"), centroids, history


def centroid_hashes(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256); an inertia that no long holds is null."""
    hashes = F.array(*map(F.lit, centroid_hashes(centroids) or [""]))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    parts = assigned.groupBy("owner").agg(wide("distance").alias("own")).crossJoin(F.broadcast(assigned.agg(wide("distance").alias("all"))))
    totals = parts.select("owner", *[F.col(c).try_cast("long").alias(n) for c, n in (("own", "cluster_inertia"), ("all", "inertia"))])
    met = assigned.join(F.broadcast(totals), "owner")  # a row a centroid
    return met.select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", F.element_at(hashes, F.col("owner") + 1).alias("centroid_sha256"))


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(*clustered(table(spark, sf_dir, "embeddings"))[:2])


def _oracle() -> str:
    """The same rounds in full, every centroid compared with every vector."""
    apart = "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    size = f"len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v) OR abs(v) >= {MOST})) = 0"
    out = f"WITH x AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS id, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * {SCALE}) AS BIGINT)) AS x FROM embeddings WHERE {size})"
    out += f", c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x AS h FROM x QUALIFY c < {CENTROIDS})"
    nearest = "SELECT id, vec_id, x.x, arg_min(c, [" + apart.format("x.x", "h") + ", c]) AS c, min(" + apart.format("x.x", "h") + ") AS d FROM x CROSS JOIN c{} GROUP BY 1, 2, 3"
    for step in range(ROUNDS):
        out += f", a{step} AS (SELECT c, unnest(x) AS v, unnest(range({WIDTH})) AS i FROM ({nearest.format(step)}))"
        out += f", m{step} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS h FROM (SELECT c, i, sum(v) AS s, count(*) AS n FROM a{step} GROUP BY 1, 2) GROUP BY 1)"
        out += f", c{step + 1} AS MATERIALIZED (SELECT c, coalesce(m{step}.h, c{step}.h) AS h FROM c{step} LEFT JOIN m{step} USING (c))"
    out += f", last AS MATERIALIZED ({nearest.format(ROUNDS)})"
    return out + (
        " SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(h, ',')) AS centroid_sha256 FROM last JOIN c{ROUNDS} USING (c)"
    )


ORACLE_SQL = _oracle()
