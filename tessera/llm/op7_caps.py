"""Embedding near-dedup by spherical-cap filters.

A structured random product code: the unit vector, turned by a fixed random rotation, is cut into parts,
each with random code words; a filter direction is one word of each part. A vector belongs to every filter
whose inner product reaches the cap, which list decoding finds from the sorted products of the parts
without trying all. Vectors meet on shared filters and are verified in double precision. The number of
filters grows with that of vectors, so that a filter holds about FILTER_ROWS of them at every size; caps
and margins are set so that a vector has LISTED filters for each doubling of their number, found by trying
random vectors.

Equal vectors are one node with a count. Where a group (a filter, or a component while links are counted) has
more than BLOCK nodes, those within half the linking angle of the group's mean are all linked to each
other, which needs no comparison; only pairs with one of the others are compared, in blocks, each pair of
blocks a group of its own. Filters hand on links that connect what they found, never all pairs; links of a
component are then counted exactly on the nodes' own vectors.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and stay.
Only vectors of equal lengths are compared. Null vec_id: takes part; a component's id is its least id
that is not null, and such a row is not kept. Repeated rows: each has its own result row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, map_batches, table
from tessera.llm.components import connected_components

COSINE = 0.95
#: Half the angle of a link; rows this near to one point are all linked. A hair less, as cosines are rounded.
HALF = float(np.cos(np.arccos(COSINE) / 2)) + 1e-9
#: Rows a filter is to hold, fewest filters and most words a part; filters a row for each doubling of filters.
FILTER_ROWS, FILTERS, MOST_WORDS, LISTED = 512, 48 * 48, 128, 1.4
#: Filters a row that pass the cap itself; the rest come within a margin of the row's best.
OVER_CAP = 3.1
#: Caps narrower than this cosine tell apart what should be linked; it bounds the filters of short vectors.
NARROWEST = 0.75
BLOCK = 2048
MOST_BROADCAST, MOST_CENTRES, SALTS = 100_000, 1000, 64
SEED = 20


class Code:
    """The product code for vectors of one length, for about ``rows`` of them.

    Products are in standard deviations of a random direction's. A row takes the filters over ``cap``, and,
    if its best is low, all that come within ``margin`` of it, so none is left with few.
    """

    def __init__(self, length: int, rows: int = 0):
        random = np.random.default_rng(SEED + length)
        tail = lambda cap: 1 - NormalDist().cdf(cap)
        wanted = max(rows, 1) * LISTED * np.log2(FILTERS) / FILTER_ROWS
        wanted = max(FILTERS, min(wanted, OVER_CAP / max(tail(NARROWEST * np.sqrt(length)), 1e-12)))
        self.parts = min(length, next(n for n in range(2, 64) if wanted <= MOST_WORDS**n))
        words = int(np.ceil(wanted ** (1 / self.parts)))
        self.turn = np.linalg.qr(random.standard_normal((length, length)))[0]
        self.cut = np.array_split(np.arange(length), self.parts)
        self.words = []
        for part in self.cut:
            w = random.standard_normal((words, len(part)))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(self.parts))
        self.cap = NormalDist().inv_cdf(1 - OVER_CAP / float(words) ** self.parts) / np.sqrt(length)
        tried, fill = _unit(random.standard_normal((128, length))), LISTED * self.parts * np.log2(words)
        low, high = 0.0, 1.0 / np.sqrt(length)
        for _ in range(8):
            self.margin = (low + high) / 2
            low, high = (self.margin, high) if len(self.filters(tried)[0]) < fill * len(tried) else (low, self.margin)
        self.margin = high

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters whose product reaches the cap, or comes within the margin of the row's best.

        Partial sums over the first parts are kept only while the best of the remaining parts could
        still lift them over the cap.
        """
        turned = unit @ self.turn
        products = [turned[:, c] @ w.T for c, w in zip(self.cut, self.words, strict=True)]
        best = np.stack([p.max(axis=1) for p in products], axis=1)
        limit = np.minimum(self.cap, best.sum(axis=1) - self.margin)
        row, code, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, p in enumerate(products):
            need = limit[row] - best[row, k + 1 :].sum(axis=1) - total
            grown = p[row]
            at, word = np.nonzero(grown >= need[:, None])
            row, code, total = row[at], code[at] * p.shape[1] + word, total[at] + grown[at, word]
        return row, code


def packed(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) with the components as bytes, null where a vector cannot be linked."""
    kind = np.float32 if rows.schema[vector].dataType.simpleString() == "array<float>" else np.float64

    def form(values: list | None) -> bytes | None:
        if not values or None in values:
            return None
        row = np.array(values, kind) + kind(0)  # no negative zeros
        return row.tobytes() if np.isfinite(row).all() and row.any() else None

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"vec_id": batch["vec_id"], "vector": [form(v) for v in batch["vector"]], "width": [np.dtype(kind).itemsize] * len(batch["vec_id"])}

    cast = F.col(vector).cast("array<double>") if kind is np.float64 else F.col(vector)
    return map_batches(rows.select(F.col("vec_id").cast("long").alias("vec_id"), cast.alias("vector")), "vec_id long, vector binary, width int", run)


def _vectors(packed: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float32 if width == 4 else np.float64).reshape(len(packed), -1).astype(np.float64)


@lru_cache(maxsize=4)
def code(length: int, rows: int) -> Code:
    return Code(length, rows)


def _filtered(nodes: DataFrame, many: int) -> DataFrame:
    """Each node once for each of its filters; vectors of other lengths or widths have filters of their own."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            sizes = np.fromiter(map(len, batch["vector"]), np.int64, len(batch["vector"]))
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                width = batch["width"][rows[0]]
                unit = _unit(_vectors([batch["vector"][r] for r in rows], width))
                for at in range(0, len(rows), 512):
                    row, name = code(unit.shape[1], many).filters(unit[at : at + 512])
                    own = rows[at : at + 512][row].tolist()
                    yield {"length": [unit.shape[1]] * len(own), "filter": name, "width": [width] * len(own), "node": [batch["node"][r] for r in own], "vector": [batch["vector"][r] for r in own]}

    return map_batches(nodes.select("node", "vector", "width"), "length int, filter long, width int, node long, vector binary", run)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay finite
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _centres(members: DataFrame, group: list[str]) -> DataFrame:
    """(group, centre): the sum of the unit vectors of each group, as an array; partial sums are taken where the rows are."""
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            at: dict[tuple, list[int]] = {}
            for k, name in enumerate(zip(*(batch[g] for g in group), batch["width"], map(len, batch["vector"]), strict=True)):
                at.setdefault(name, []).append(k)
            for name, rows in at.items():
                total = _unit(_vectors([batch["vector"][k] for k in rows], name[-2])).sum(axis=0)
                yield {g: [v] * len(total) for g, v in zip(group, name, strict=False)} | {"j": np.arange(len(total)), "v": total}

    sums = map_batches(members.select(*group, "vector", "width"), ", ".join(f"{g} {kinds[g]}" for g in group) + ", j int, v double", run)
    sums = sums.groupBy(*group, "j").agg(F.sum("v").alias("v"))
    return sums.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("s")).select(*group, F.col("s.v").alias("centre"))


def _met(rows: DataFrame, few: DataFrame, group: list[str], most: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group in ``few``, which is broadcast behind a check of its rows, else met by salted keys."""
    if few.count() <= most:
        return rows.join(F.broadcast(few), group, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, [*group, "_salt"], how).drop("_salt")


def _with_core(members: DataFrame, group: list[str], block: int) -> DataFrame:
    """``members`` with ``core``: true for rows of a group of more than ``block`` that are within HALF of its mean."""
    large = checkpoint(members.groupBy(*group).count().where(F.col("count") > block).select(*group, F.lit(True).alias("large")))
    if not large.limit(1).count():
        return members.withColumn("core", F.lit(False))
    marked = _met(members, large, group, MOST_BROADCAST, "left")
    hot = checkpoint(marked.where("large").drop("large"))
    centred = _met(hot, checkpoint(_centres(hot, group)), group, MOST_CENTRES)
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    names = list(kinds)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            core = []
            for vector, width, centre in zip(batch["vector"], batch["width"], batch.pop("centre"), strict=True):
                near = np.array(centre)
                core.append(bool(np.linalg.norm(near)) and bool(_unit(_vectors([vector], width))[0] @ near >= HALF * np.linalg.norm(near)))
            yield {k: batch[k] for k in names} | {"core": core}

    judged = map_batches(centred.select(*members.columns, "centre"), ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", core boolean", run)
    return checkpoint(judged.unionByName(marked.where("large is null").drop("large").withColumn("core", F.lit(False))))


def _dealt(members: DataFrame, group: list[str], block: int) -> DataFrame:
    """``members`` (with ``core``) once for each pair of blocks of their group: ``part`` names the pair, ``side`` the larger or smaller block of it.

    Blocks of core rows come first and are paired with the others only.
    """
    sizes = members.groupBy(*group).agg(F.count_if("core").alias("cores"), F.count_if(~F.col("core")).alias("others")).where(F.col("cores") + F.col("others") > block)
    sizes = checkpoint(sizes.select(*group, F.ceil(F.col("cores") / block).cast("long").alias("cores"), F.ceil(F.col("others") / block).cast("long").alias("others")))
    sized = _met(members, sizes, group, MOST_BROADCAST, "left").withColumn("cores", F.coalesce("cores", F.lit(0).cast("long"))).withColumn("others", F.coalesce("others", F.lit(1).cast("long")))
    hashed, blocks = F.xxhash64("node", F.lit("block")), F.col("cores") + F.col("others")
    own = F.when(F.col("core"), F.pmod(hashed, F.greatest("cores", F.lit(1)))).otherwise(F.col("cores") + F.pmod(hashed, F.greatest("others", F.lit(1))))
    first = F.when(F.col("core"), F.col("cores")).otherwise(F.lit(0).cast("long"))
    paired = F.when(first < blocks, F.sequence(first, F.greatest(first, blocks - 1))).otherwise(F.array().cast("array<bigint>"))
    sized = sized.withColumn("own", own).withColumn("blocks", blocks).withColumn("paired", paired)
    pairs = F.transform("paired", lambda j: F.struct((F.greatest(F.col("own"), j) * F.col("blocks") + F.least(F.col("own"), j)).alias("part"), F.when(F.col("own") == j, 2).when(F.col("own") > j, 1).otherwise(0).alias("side")))
    dealt = sized.select(*members.columns, F.inline(pairs))
    return dealt.repartition(*group, "part").sortWithinPartitions(*group, "part")


def _groups(batches: Iterator[dict], keys: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Whole groups of rows that come sorted by ``keys``."""
    held: dict[str, list] = {}
    for batch in batches:
        names = list(zip(*(batch[k] for k in keys), strict=True))
        edges = [k for k in range(1, len(names)) if names[k] != names[k - 1]]
        for s, e in zip([0, *edges], [*edges, len(names)], strict=True):
            if s == e:
                continue
            if held and tuple(held[k][0] for k in keys) != names[s]:
                yield held
                held = {}
            for k, v in batch.items():
                held.setdefault(k, []).extend(v[s:e])
    if held:
        yield held


def _forest(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all rows with a cosine of COSINE or more, each found row once."""
    waiting, left, right = np.arange(len(unit)), [], []
    while len(waiting) > 1:
        stack, waiting = waiting[:1], waiting[1:]
        while len(stack) and len(waiting):
            near = unit[waiting] @ unit[stack[:256]].T >= COSINE
            hit = near.any(axis=1)
            left.append(stack[:256][near[hit].argmax(axis=1)])
            right.append(waiting[hit])
            stack, waiting = np.concatenate([stack[256:], waiting[hit]]), waiting[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) links that connect all pairs of ``nodes`` (node, vector, width) that share a filter and pass verification."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for group in _groups(batches, ("length", "filter", "part")):
            if len(group["node"]) > 1:
                ids = np.array(group["node"], np.int64)
                a, b = _forest(_unit(_vectors(group["vector"], group["width"][0])))
                if len(a):
                    yield {"a": ids[a], "b": ids[b]}

    keys = ["length", "filter"]
    listed = _with_core(_filtered(nodes, nodes.count()), keys, block)
    compared = map_batches(_dealt(listed, keys, block).drop("side"), "a long, b long", run)
    core = listed.where("core")
    least = checkpoint(core.groupBy(*keys).agg(F.min("node").alias("b")))
    return compared.unionByName(_met(core.select(*keys, F.col("node").alias("a"), "node"), least, keys, MOST_BROADCAST).select("a", "b"))


def link_counts(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, n): rows of other nodes of the same ``component`` within COSINE; exact, counted in blocks."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for group in _groups(batches, ("component", "part")):
            ids, times, side = np.array(group["node"], np.int64), np.array(group["times"], np.int64), np.array(group["side"])
            unit = _unit(_vectors(group["vector"], group["width"][0]))
            if side[0] == 2:
                near = unit @ unit.T >= COSINE
                np.fill_diagonal(near, False)
                yield {"node": ids, "n": near @ times}
            elif len(one := np.flatnonzero(side == 1)) and len(two := np.flatnonzero(side == 0)):
                near = unit[one] @ unit[two].T >= COSINE
                yield {"node": np.concatenate([ids[one], ids[two]]), "n": np.concatenate([near @ times[two], times[one] @ near])}

    marked = _with_core(members, ["component"], block)
    compared = map_batches(_dealt(marked, ["component"], block), "node long, n long", run)
    core = marked.where("core").select("component", "node", "times")
    totals = checkpoint(core.groupBy("component").agg(F.sum("times").alias("all")))
    within = _met(core, totals, ["component"], MOST_BROADCAST).select("node", (F.col("all") - F.col("times")).alias("n"))
    return compared.unionByName(within).groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    every = packed(rows, vector)
    good = every.where("vector is not null")
    nodes = good.groupBy("vector", "width").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    parts = checkpoint(connected_components(links(nodes)))
    members = checkpoint(nodes.join(parts, "node"))
    counts = link_counts(members.select("component", "node", "vector", "width", "times"))
    smallest = members.groupBy("component").agg(F.min("least").alias("component_id"))
    found = members.select("node", "component").join(counts, "node").join(smallest, "component").select("node", "n", "component_id")
    named = nodes.join(found, "node", "left").select("vector", "width", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = good.join(named, ["vector", "width"]).select("vec_id", "n_links", "component_id")
    alone = every.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
