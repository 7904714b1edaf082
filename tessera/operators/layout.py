"""Neighbours in embedding space, and a layout in the plane that keeps them.

Both work on the distinct vectors of a table, each of which stands under the least cell_id that has it, so
piles of equal rows make no hubs. Vectors that are null, or hold a null or non-finite component, take no
part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.frames import cut, matrix
from tessera.operators.cluster import _moments, projection
from tessera.operators.graph import build_graph, cell_tiles

#: Vectors that are laid out in a task, and of a tile of neighbour descent.
TILE = 2048
#: Bytes of the doubles of the vectors whose neighbours a task finds, and the least number of them; each task is sent all vectors once.
LOT_BYTES, LEAST_LOT = 16 << 20, 2048
#: Bytes of vectors that travel in a row; vectors of a task, and others, whose products are worked out at a time.
PIECE, ROWS, OTHERS = 4096, 256, 4096
#: Distances that are worked out at a time, and that wait to be sorted into lists.
EXACT, WAITING = 1 << 15, 1 << 20
#: Stands for a neighbour that is not known yet.
NOBODY = np.iinfo(np.int64).max
#: The curve 1 / (1 + A d^2B) by which near points attract: its fit to a least distance of 0.1 and a spread of 1.
A, B = 1.5769, 0.8951
#: Vectors of the whole table that push a tile's vectors away in a round, and pushes for each pull.
FAR, PUSHES = 4096, 5
#: The most that one pull or push moves a point, and parts of an epoch that see each other's moves.
MOVE, PARTS = 4.0, 4


def _vector(rows: DataFrame, column: str) -> Column:
    return F.col(column) if rows.schema[column].dataType.simpleString() == "array<float>" else F.col(column).cast("array<double>")


def distinct_vectors(rows: DataFrame, column: str = "features") -> DataFrame:
    """(cell_id, x): the distinct vectors, each with the least cell_id that has it; floats stay floats, as half as many bytes move."""
    x = _vector(rows, column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(x.isNotNull() & (F.size(x) > 0)).where(finite).groupBy(x.alias("x")).agg(F.min(F.col("cell_id").cast("long")).alias("cell_id")).select("cell_id", "x")


def _dealt(vectors: DataFrame, n: int, size: int, trees: int, seed: int) -> DataFrame:
    """(cell_id, tile, tree): vectors dealt to tiles of about ``size`` that are near in a plane, once for each of ``trees`` planes.

    Planes are drawn with the spread of the data: a direction is as likely as the vectors differ along it.
    """
    scatter = _moments(vectors, "x")[2]
    values, axes = np.linalg.eigh(scatter)
    draws = np.random.default_rng(seed).standard_normal((len(values), 2 * trees))
    planes = axes @ (np.sqrt(np.maximum(values, 0.0) / max(values.max(), 1e-300))[:, None] * draws)

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            at = (matrix(batch.column(1)) @ planes).reshape(-1, trees, 2)
            ids = np.repeat(np.asarray(batch.column(0)), trees)
            flat = (ids, np.tile(np.arange(trees), len(at)), at[:, :, 0].ravel(), at[:, :, 1].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in flat], names=["cell_id", "section_id", "x", "y"])

    return cell_tiles(vectors.mapInArrow(project, "cell_id long, section_id long, x double, y double"), size)


class _Lists:
    """The ``k`` nearest others that some vectors have met, by distance, ties by id.

    Products of single precision only rule vectors out, with a margin above their rounding; where they leave
    many, products of double precision do. What is left is worked out as a sum of squares in the order of the
    components, as SQL does it, so not even rounding orders it otherwise.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.centre = x.mean(axis=0)
        self.c = x - self.centre
        self.length = np.sqrt((self.c * self.c).sum(axis=1))
        with np.errstate(over="ignore"):
            self.low = np.concatenate([-self.c, np.ones((len(x), 1))], axis=1).astype(np.float32)
        self.dist, self.dst = np.full((len(x), k), np.inf), np.full((len(x), k), NOBODY)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(ids), OTHERS):
            self._meet(ids[at : at + OTHERS], x[at : at + OTHERS])

    def _meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        y = x - self.centre
        half = (y * y).sum(axis=1) / 2
        far = np.sqrt(2 * half.max())
        single = max(far, self.length.max()) < 1e17
        low = np.concatenate([y, half[:, None]], axis=1).astype(np.float32).T if single else None
        room, waiting = x.shape[1] + 8, 0
        found: list[tuple] = []
        for at in range(0, len(self.ids), ROWS):
            own = slice(at, at + ROWS)
            bound, most = self.dist[own, -1], (self.length[own] + far) ** 2
            limit = (bound * bound - self.length[own] ** 2) / 2
            flat = None
            if single and np.isfinite(bound).all():
                s = self.low[own] @ low
                flat = np.flatnonzero(s <= (limit + room * 2.0**-23 * most + 1e-37).astype(np.float32)[:, None])
            if flat is None or len(flat) > 16 * len(bound):
                s = half - self.c[own] @ y.T
                margin = room * 2.0**-52 * most
                if len(ids) > self.k:  # one more than k, as a vector may meet itself
                    limit = np.fmin(limit, np.partition(s, self.k, axis=1)[:, self.k] + margin)
                flat = np.flatnonzero(~(s > (limit + margin)[:, None]))
            for part in range(0, len(flat), EXACT):
                r, j = np.divmod(flat[part : part + EXACT], len(ids))
                apart = self.x[at + r] - x[j]
                dist = np.sqrt((apart * apart).cumsum(axis=1)[:, -1])
                near = (dist <= bound[r]) & (self.ids[at + r] != ids[j])
                found.append((at + r[near], dist[near], ids[j[near]]))
                waiting += len(found[-1][0])
                if waiting > WAITING:
                    self._sort_in(found)
                    found, waiting = [], 0
        if waiting:
            self._sort_in(found)

    def _sort_in(self, found: list[tuple]) -> None:
        row, dist, dst = (np.concatenate(c) for c in zip(*found, strict=True))
        some = np.unique(row)
        row, dist, dst = np.r_[np.repeat(some, self.k), row], np.r_[self.dist[some].ravel(), dist], np.r_[self.dst[some].ravel(), dst]
        order = np.lexsort((dst, dist, row))
        row = row[order]
        kept = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.dist[some], self.dst[some] = dist[kept].reshape(-1, self.k), dst[kept].reshape(-1, self.k)

    def batches(self):
        """(src, dst, rank, dist) as Arrow batches."""
        import pyarrow as pa

        for at in range(0, len(self.ids), OTHERS):
            own = slice(at, at + OTHERS)
            src = np.repeat(self.ids[own], self.k)
            rank = np.tile(np.arange(1, self.k + 1, dtype=np.int32), len(self.ids[own]))
            dst, dist = self.dst[own].ravel(), self.dist[own].ravel()
            known = dst != NOBODY
            yield pa.RecordBatch.from_arrays([pa.array(c[known]) for c in (src, dst, rank, dist)], names=["src", "dst", "rank", "dist"])


def _packed(lots: int, piece: int, kind: type):
    """(cell_id, x) -> pieces of up to ``piece`` vectors as bytes, dealt to ``lots`` lots."""

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        for batch in batches:
            ids, x = np.asarray(batch.column(0), np.int64), matrix(batch.column(1)).astype(kind)
            starts = range(0, len(ids), piece)
            home = pa.array([(turn + i) % lots for i in range(len(starts))], pa.int32())
            turn += len(starts)
            packed = [pa.array([c[at : at + piece].tobytes() for at in starts], pa.binary()) for c in (ids, x)]
            yield pa.RecordBatch.from_arrays([home, *packed], names=["home", "ids", "x"])

    return pack


def _all_met(k: int, width: int, kind: type):
    """Pieces of all vectors, a lot's own ones first -> the ``k`` nearest of each of its own; others pass by."""

    def search(batches):
        held, lists = [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                mine, ids, x = (c.to_pylist() for c in batch.slice(at, 512).columns)
                own = sum(len(i) for i, m in zip(ids, mine, strict=True) if m) // 8
                ids, x = np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(x), kind).reshape(-1, width).astype(np.float64)
                if own:
                    held.append((ids[:own], x[:own]))
                if own < len(ids) and held:
                    if lists is None:
                        lists = _Lists(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
                        lists.meet(lists.ids, lists.x)
                    lists.meet(ids[own:], x[own:])
        if lists is None and held:
            lists = _Lists(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
            lists.meet(lists.ids, lists.x)
        if lists is not None:
            yield from lists.batches()

    return search


def _all_compared(vectors: DataFrame, n: int, width: int, k: int) -> DataFrame:
    """(src, dst, rank, dist) from all pairs: each task has a lot of vectors and their lists, and all vectors pass it by."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    lots = min(cores * -(-n * width * 8 // (cores * LOT_BYTES)), -(-n // LEAST_LOT))
    kind = np.float32 if vectors.schema["x"].dataType.simpleString() == "array<float>" else np.float64
    pieces = vectors.mapInArrow(_packed(lots, max(1, PIECE // (width * np.dtype(kind).itemsize)), kind), "home int, ids binary, x binary")
    sent = pieces.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).select("lot", (F.col("lot") == F.col("home")).alias("own"), "ids", "x")
    dealt = sent.repartitionById(lots, "lot").sortWithinPartitions(F.desc("own")).select("own", "ids", "x")
    return dealt.mapInArrow(_all_met(k, width, kind), "src long, dst long, rank int, dist double")


def _pairs(a: np.ndarray, b: np.ndarray, d2: np.ndarray):
    import pyarrow as pa

    return pa.table([pa.array(np.asarray(c, t)) for c, t in ((a, np.int64), (b, np.int64), (d2, np.float64))], names=["src", "dst", "d2"])


def _within(k: int):
    """The k nearest others of each vector of a tile."""

    def search(table):
        ids, first = np.unique(np.asarray(table.column("cell_id")), return_index=True)
        x = matrix(table.column("x").combine_chunks())[first]
        half, out = (x * x).sum(axis=1) / 2, []
        take = min(k, len(ids) - 1)
        for at in range(0, len(ids) if take > 0 else 0, 256):
            mine = np.arange(at, min(at + 256, len(ids)))
            near = half - x[mine] @ x.T
            near[np.arange(len(mine)), mine] = np.inf
            limit = np.partition(near, take - 1, axis=1)[:, take - 1 : take]
            # products choose with a margin for their rounding, differences decide
            r, j = np.nonzero(near <= limit + 1e-12 * (half[mine, None] + half[None, :]))
            d2 = ((x[mine[r]] - x[j]) ** 2).sum(axis=1)
            order = np.lexsort((j, d2, r))
            r, j, d2 = r[order], j[order], d2[order]
            kept = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((ids[mine[r[kept]]], ids[j[kept]], d2[kept]))
        return _pairs(*(np.concatenate([np.zeros(0), *c]) for c in zip(*out, strict=True))) if out else _pairs([], [], [])

    return search


def _local_join(k: int):
    """(src, dst, d2) of members of one neighbourhood that are nearer to each other than the farthest neighbour either has, the k nearest of each src."""
    return lambda pairs, table: _joined(pairs, table, k)


def _joined(pairs, table, k: int):
    ids = np.asarray(table.column("cell_id"))
    order = np.argsort(ids)
    x, bound, ids = matrix(table.column("x").combine_chunks())[order], np.asarray(table.column("bound"))[order], ids[order]
    of, member = np.asarray(pairs.column("of")), np.searchsorted(ids, np.asarray(pairs.column("cell_id")))
    order = np.lexsort((member, of))
    of, member = of[order], member[order]
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    found = [np.zeros(0, np.int64)]
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True):
        some = member[lo:hi]
        one, two = np.triu_indices(len(some), 1)
        found.append(some[one] * len(ids) + some[two])
    codes = np.unique(np.concatenate(found))
    out = []
    for at in range(0, len(codes), 1 << 16):
        one, two = np.divmod(codes[at : at + (1 << 16)], max(len(ids), 1))
        d2 = ((x[one] - x[two]) ** 2).sum(axis=1)
        for a, b in ((one, two), (two, one)):
            nearer = d2 < bound[a]
            out.append((a[nearer], b[nearer], d2[nearer]))
    if not out:
        return _pairs([], [], [])
    # no list of the k nearest has more of this tile's than these
    a, b, d2 = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((b, d2, a))
    a, b, d2 = a[order], b[order], d2[order]
    kept = np.arange(len(a)) - np.searchsorted(a, a) < k
    return _pairs(ids[a[kept]], ids[b[kept]], d2[kept])


def _nearest_lists(pairs: DataFrame, k: int) -> DataFrame:
    """(src, near): for each vector its ``k`` nearest of (src, dst, d2, old) as (d2, dst, old), each dst once."""
    each = pairs.repartition("src").groupBy("src", "dst").agg(F.min("d2").alias("d2"), F.max("old").alias("old"))
    return cut(each.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "dst", "old"))), 1, k).alias("near")))


def embedding_neighbours(rows: DataFrame, k: int = 15, *, trees: int = 4, tile: int = TILE, least: float = 0.001, rounds: int | None = None, seed: int = 0, column: str = "features") -> DataFrame:
    """(src, dst, rank, dist): the ``k`` nearest other vectors of each distinct vector by Euclidean distance; ties go to the smaller id.

    Exact at every size: all pairs are compared. A task has a lot of vectors, and all vectors are sent past
    it, so its memory does not grow with the table; time and what is sent grow with its square.

    With ``rounds`` the result is approximate beyond ``tile`` vectors: they are dealt to tiles once for each of ``trees`` random
    planes and compared within them; then neighbours of a vector are compared with each other (neighbour
    descent), until a round changes less than ``least`` of all neighbours, or after ``rounds`` rounds.
    A vector takes part in a round with its own neighbours and at most ``k`` of those that it is a neighbour
    of, drawn anew each round. A tile gets each vector that its neighbourhoods name once, so vectors move
    a few times a round, not once for each pair, and a task holds a tile's neighbourhoods.
    """
    if k < 1 or trees < 2:
        raise ValueError(f"k must be 1 or more and trees 2 or more (in one plane no neighbour is outside a tile), not {k} and {trees}")
    vectors = cut(distinct_vectors(rows, column))
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    spark = vectors.sparkSession
    if n < 2:
        return spark.createDataFrame([], "src long, dst long, rank int, dist double")
    if rounds is None:
        return _all_compared(vectors, n, width, k)
    planes = 1 if n <= tile else trees
    dealt = cut(_dealt(vectors, n, tile, planes, seed) if n > tile else vectors.select("cell_id", F.lit(0).cast("long").alias("tile")))
    first = dealt.join(vectors, "cell_id").groupBy("tile").applyInArrow(_within(k), "src long, dst long, d2 double")
    lists = _nearest_lists(first.withColumn("old", F.lit(0)), k)
    # neighbourhoods are worked on where their vectors are near: the tile of one plane
    home = cut(dealt.groupBy("cell_id").agg(F.min("tile").alias("tile"))) if n > tile else None
    for turn in range(rounds if n > tile else 0):
        flat = lists.select("src", F.explode("near").alias("e")).select("src", F.col("e.dst").alias("dst"), F.col("e.d2").alias("d2"))
        drawn = Window.partitionBy("dst").orderBy(F.xxhash64("src", F.lit(seed * 1009 + turn)), "src")
        back = flat.withColumn("nth", F.row_number().over(drawn)).where(F.col("nth") <= k).select(F.col("dst").alias("of"), F.col("src").alias("cell_id"))
        members = flat.select(F.col("src").alias("of"), F.col("dst").alias("cell_id")).unionByName(back).unionByName(home.select(F.col("cell_id").alias("of"), "cell_id")).distinct()
        pairs = cut(members.join(home.select(F.col("cell_id").alias("of"), "tile"), "of"))
        bound = F.when(F.size("near") < k, float("inf")).otherwise(F.element_at("near", -1)["d2"])
        known = vectors.join(lists.select(F.col("src").alias("cell_id"), bound.alias("bound")), "cell_id", "left").na.fill(float("inf"), ["bound"])
        held = pairs.select(F.col("tile").alias("lot"), F.col("cell_id").alias("id")).distinct().join(known, F.col("id") == F.col("cell_id")).select("lot", "cell_id", "x", "bound")
        met = pairs.groupBy("tile").cogroup(held.groupBy("lot")).applyInArrow(_local_join(k), "src long, dst long, d2 double")
        lists = _nearest_lists(flat.withColumn("old", F.lit(1)).unionByName(met.withColumn("old", F.lit(0))), k)
        changed = lists.agg(F.sum(F.size(F.filter("near", lambda e: e["old"] == 0)))).first()[0]
        if changed <= least * n * k:
            break
    ranked = lists.select("src", F.posexplode("near").alias("rank", "e"))
    return ranked.select("src", F.col("e.dst").alias("dst"), (F.col("rank") + 1).alias("rank"), F.sqrt("e.d2").alias("dist"))


def fuzzy_edges(neighbours: DataFrame) -> DataFrame:
    """(src, dst, weight) in both directions, from (src, dst, rank, dist).

    A neighbour weighs exp(-(dist - nearest) / scale), with the scale at which a vector's weights add up to the
    base-2 logarithm of their number (at least a thousandth of their mean distance); the weights a and b of
    both ends meet as a + b - ab.
    """
    lists = neighbours.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "dist"))).alias("near"))
    lists = lists.select("src", F.transform("near", lambda e: e["dst"]).alias("dst"), F.transform("near", lambda e: e["dist"]).alias("dist"))

    def weigh(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            row = np.repeat(np.arange(len(sizes)), sizes)
            near = np.asarray(batch.column(2).flatten())
            wanted, mean = np.log2(np.maximum(sizes, 1)), np.bincount(row, near, len(sizes)) / np.maximum(sizes, 1)
            lowest = np.full(len(sizes), np.inf)
            np.minimum.at(lowest, row, near)
            over = near - lowest[row]
            low, high, scale = np.zeros(len(sizes)), np.full(len(sizes), np.inf), np.maximum(mean, 1e-300)
            for _ in range(64):
                got = np.bincount(row, np.exp(-over / scale[row]), len(sizes))
                low, high = np.where(got < wanted, scale, low), np.where(got < wanted, high, scale)
                scale = np.maximum(np.where(np.isinf(high), 2 * scale, (low + high) / 2), 1e-300)
            weights = np.exp(-over / np.maximum(scale, np.maximum(1e-3 * mean, 1e-300))[row])
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(0))[row]), batch.column(1).flatten(), pa.array(weights)], names=["src", "dst", "weight"])

    one = lists.mapInArrow(weigh, "src long, dst long, weight double")
    both = one.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    low, high = F.min("weight"), F.max("weight")
    joined = both.agg(F.when(F.count("weight") > 1, low + high - low * high).otherwise(high).alias("weight"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return joined.select(ends.alias("e"), "weight").select("e.src", "e.dst", "weight")


def _moved(epochs: int, start: float, end: float, far: list[tuple[int, float, float]], seed: int, turn: int):
    """Some epochs of pulls along edges and pushes from vectors drawn out of the whole table; only a tile's own points move."""
    far_ids, far_at = np.array([f[0] for f in far], np.int64), np.array([f[1:] for f in far], np.float64).reshape(-1, 2)

    def step(key, edges, points):
        import pyarrow as pa

        ids = np.asarray(points.column("cell_id"))
        order = np.argsort(ids)
        ids, own = ids[order], np.asarray(points.column("own"))[order]
        p = np.stack([np.asarray(points.column(c)) for c in ("px", "py")], axis=1)[order].astype(np.float64)
        src, dst, w = (np.asarray(edges.column(c)) for c in ("src", "dst", "weight"))
        order = np.lexsort((dst, src))
        i, j, w = np.searchsorted(ids, src[order]), np.searchsorted(ids, dst[order]), w[order]
        rng = np.random.default_rng([seed, turn, key[0].as_py()])
        # drawn vectors that are here push from where they are now
        spot = np.minimum(np.searchsorted(ids, far_ids), len(ids) - 1)
        here, others = ids[spot] == far_ids, far_at.copy()
        for epoch in range(epochs):
            rate = start + (end - start) * epoch / epochs
            chosen = rng.permutation(np.flatnonzero(rng.random(len(w)) < w))
            for part in np.array_split(chosen, PARTS):
                others[here] = p[spot[here]]
                a, b = i[part], j[part]
                apart = p[a] - p[b]
                d2 = (apart * apart).sum(axis=1, keepdims=True)
                pull = np.where(d2 > 0, -2 * A * B * np.maximum(d2, 1e-12) ** (B - 1) / (1 + A * d2**B), 0.0)
                move = np.clip(pull * apart, -MOVE, MOVE)
                pushed = np.repeat(a, PUSHES)
                drawn = rng.integers(0, len(far_ids), len(pushed))
                apart = p[pushed] - others[drawn]
                d2 = (apart * apart).sum(axis=1, keepdims=True)
                push = np.clip(2 * B / ((0.001 + d2) * (1 + A * d2**B)) * apart, -MOVE, MOVE)
                push[here[drawn] & (spot[drawn] == pushed)] = 0.0
                np.add.at(p, a, rate * move)
                np.add.at(p, pushed, rate * push)
        return pa.table([pa.array(ids[own]), pa.array(np.full(own.sum(), key[0].as_py(), np.int64)), pa.array(p[own, 0]), pa.array(p[own, 1])], names=["cell_id", "tile", "px", "py"])

    return step


def planar_layout(rows: DataFrame, k: int = 15, *, rounds: int = 10, epochs: int = 20, tile: int = TILE, seed: int = 0, column: str = "features", neighbours: DataFrame | None = None) -> DataFrame:
    """(cell_id, px, py): points in the plane where neighbours in embedding space stay near; equal vectors share a point, and rows without a vector have nulls.

    Starts at the two leading components, then pulls along weighted edges (``fuzzy_edges``) and pushes from
    vectors drawn out of the whole table. A round moves positions (never vectors) to the tiles that have an
    edge to them; each tile works out ``epochs`` epochs for its own vectors while the others' stay, and hands
    on its positions. A task holds a tile with its edges, of which a vector that
    very many others name may have many. Reruns agree.
    """
    vectors = cut(distinct_vectors(rows, column))
    n = vectors.count()
    if neighbours is None:
        neighbours = embedding_neighbours(rows, k, column=column)
    scores = projection(vectors, "x")
    largest = scores.agg(F.max(F.abs("px"))).first()[0] or 1.0
    # a hair of noise by id, so that no two start at one point
    noise = lambda salt: (F.pmod(F.xxhash64("cell_id", F.lit(salt + 2 * seed)), F.lit(2_000_001)) - 1_000_000) / 1e10
    start = scores.select("cell_id", (F.col("px") * (10 / largest) + noise(0)).alias("px"), (F.col("py") * (10 / largest) + noise(1)).alias("py"))
    placed = cell_tiles(start.select("cell_id", F.lit(0).alias("section_id"), F.col("px").alias("x"), F.col("py").alias("y")), tile) if n else start.select("cell_id", F.lit(0).cast("long").alias("tile"))
    points = cut(start.join(placed, "cell_id").select("cell_id", "tile", "px", "py"))
    home = points.select(F.col("cell_id").alias("src"), "tile")
    edges = cut(fuzzy_edges(neighbours).join(home, "src").select("tile", "src", "dst", "weight"))
    wanted = edges.select("tile", F.col("dst").alias("cell_id")).distinct()
    beyond = cut(wanted.join(points.select("cell_id", "tile"), ["cell_id", "tile"], "left_anti"))
    for turn in range(rounds if n > 1 else 0):
        far = [tuple(r) for r in points.orderBy(F.xxhash64("cell_id", F.lit(seed * 1009 + turn)), "cell_id").limit(FAR).select("cell_id", "px", "py").collect()]  # at most FAR rows
        around = beyond.join(points.drop("tile"), "cell_id").withColumn("own", F.lit(False))
        dealt = points.withColumn("own", F.lit(True)).unionByName(around).withColumnRenamed("tile", "lot")
        step = _moved(epochs, 1 - turn / rounds, 1 - (turn + 1) / rounds, far, seed, turn)
        points = cut(edges.groupBy("tile").cogroup(dealt.groupBy("lot")).applyInArrow(step, "cell_id long, tile long, px double, py double"))
    shared = vectors.join(points, "cell_id").select("x", "px", "py")
    given = rows.select("cell_id", _vector(rows, column).alias("x"))
    return given.join(shared, "x", "left").select("cell_id", "px", "py")


def preservation(neighbours: DataFrame, placed: DataFrame) -> DataFrame:
    """One row (preserved, n): the share of (src, dst) in ``neighbours`` that are among as many nearest points of (cell_id, px, py)."""
    most = neighbours.agg(F.max("rank")).first()[0] or 1
    ends = neighbours.select(F.col("src").alias("cell_id")).union(neighbours.select("dst")).distinct()
    plane = placed.join(ends, "cell_id", "left_semi").select("cell_id", F.lit(0).alias("section_id"), F.col("px").alias("x"), F.col("py").alias("y"))
    near = build_graph(plane, most, check=False).select("src", "dst", F.lit(1).alias("hit"))
    return neighbours.select("src", "dst").join(near, ["src", "dst"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("preserved"), F.count(F.lit(1)).alias("n"))
