"""SimHash near-duplicates: fingerprints of 3-word shingles, linked at few differing bits.

Links are found by pigeonring filtering. A fingerprint is a ring of SEGMENTS segments; if two differ in
at most BITS bits, some segment starts a chain whose first l segments differ in at most l * BITS /
SEGMENTS bits together, for every l. For short l that bound is zero, so rows meet on the (position,
value) of a chain of equal segments; longer chains prune before the full count. No link is missed.

Memory and skew: equal fingerprints are one node, whatever the number of copies. A bucket of more than
BLOCK nodes is cut into blocks, and each pair of blocks is a task's group of its own. Buckets hand on
links that connect what they found (a spanning forest for large ones), never all pairs of a group.

Null or empty text: fingerprint zero, linked like any other. Null doc_id: the row takes part and gets
the component's smallest id that is not null. Repeated rows and ids: each row has its own result row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, map_batches, table
from tessera.llm.components import connected_components

SEED, SHINGLE, BITS = 42, 3, 3
SEGMENTS = 16
WIDTH = 64 // SEGMENTS
#: Longest chain with no difference allowed; its bits are the join key.
CHAIN = next(n for n in range(SEGMENTS, 0, -1) if n * BITS // SEGMENTS == 0)
KEY_BITS = CHAIN * WIDTH
BLOCK = 4096
#: Groups up to this size are compared at all offsets at once, larger ones by breadth-first search.
SMALL = 48


def fingerprint(text: bytes | None) -> int:
    """Unsigned SimHash of the ASCII-lower-cased text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(s, SEED) for s in map(b" ".join, zip(words, words[1:], words[2:], strict=False))]
    bits = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    totals = np.zeros(64, np.int64)
    for at in range(0, len(bits), 1 << 16):
        totals += np.unpackbits(bits[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * totals > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", tie: Column | None = None) -> DataFrame:
    """(doc_id, fp long, and tie long if given) of each row; fp holds the 64 bits as a signed number."""
    also = {} if tie is None else {"tie": tie}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "fp": np.array([fingerprint(t) for t in batch["text"]], np.uint64).view(np.int64)} | {k: batch[k] for k in names}

    names, columns = list(also), [c.cast("long").alias(k) for k, c in also.items()]
    schema = ", ".join(["doc_id long", "fp long", *[f"{k} long" for k in names]])
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), *columns), schema, run)


def _rotated(fp: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64)
    return np.where(by == 0, fp, (fp << by) | (fp >> ((np.uint64(64) - by) & np.uint64(63))))


def _viable(x: np.ndarray) -> np.ndarray:
    """Rotated differences that keep every chain's budget; the last chain is the whole ring (BITS bits)."""
    ok = np.ones(len(x), bool)
    for n in range(CHAIN + 1, SEGMENTS + 1):
        budget = n * BITS // SEGMENTS
        if n == SEGMENTS or (n + 1) * BITS // SEGMENTS > budget:  # the longest chain of each budget implies the shorter ones
            ok &= np.bitwise_count(x >> np.uint64(64 - n * WIDTH)) <= budget
    return ok


def _links_small(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, right, at = [], [], np.arange(len(values))
    for offset in range(1, SMALL):
        at = at[at + offset < len(values)]
        at = at[group[at] == group[at + offset]]
        if not len(at):
            break
        hit = at[_viable(values[at] ^ values[at + offset])]
        left.append(hit)
        right.append(hit + offset)
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def _links_large(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one group's links."""
    waiting, left, right = np.arange(len(values)), [], []
    while len(waiting):
        stack, waiting = [waiting[0]], waiting[1:]
        while stack and len(waiting):
            near = _viable(values[waiting] ^ values[(at := stack.pop())])
            new = waiting[near]
            waiting = waiting[~near]
            left.append(np.full(len(new), at))
            right.append(new)
            stack.extend(new)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _bucket_links(batches: Iterator[dict]) -> Iterator[dict]:
    """Rows come sorted by (turn, part, rotated): groups are equal (turn, part, key); the last may go on in the next batch."""
    kept = {"turn": np.zeros(0, np.int64), "part": np.zeros(0, np.int64), "rotated": np.zeros(0, np.uint64)}

    def links(rows: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[dict]:
        sizes = ends - starts
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        at = np.flatnonzero(small)
        found = [(at[a], at[b]) for a, b in [_links_small(rows["rotated"][at], group[at])]]
        for s, e in zip(starts[sizes > SMALL], ends[sizes > SMALL], strict=True):
            found += [(a + s, b + s) for a, b in [_links_large(rows["rotated"][s:e])]]
        for a, b in found:
            if len(a):
                back = (np.uint64(64) - WIDTH * rows["turn"][a].astype(np.uint64)) & np.uint64(63)
                yield {"a": _rotated(rows["rotated"][a], back).view(np.int64), "b": _rotated(rows["rotated"][b], back).view(np.int64)}

    for batch in batches:
        new = {"turn": np.array(batch["turn"], np.int64), "part": np.array(batch["part"], np.int64), "rotated": np.array(batch["rotated"], np.int64).view(np.uint64)}
        rows = {k: np.concatenate([kept[k], new[k]]) for k in kept}
        if not (n := len(rows["turn"])):
            continue
        key = rows["rotated"] >> np.uint64(64 - KEY_BITS)
        starts = np.flatnonzero(np.concatenate([[True], (rows["turn"][1:] != rows["turn"][:-1]) | (rows["part"][1:] != rows["part"][:-1]) | (key[1:] != key[:-1])]))
        yield from links(rows, starts[:-1], starts[1:])
        kept = {k: v[starts[-1] : n] for k, v in rows.items()}
    n = len(kept["turn"])
    yield from links(kept, np.array([0] if n else [], np.int64), np.array([n] if n else [], np.int64))


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) links that connect all ``nodes`` (distinct fp) within BITS bits of each other."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("turn")
    spun = nodes.select("fp", turns).select(
        "turn",
        F.when(F.col("turn") == 0, F.col("fp"))
        .otherwise(F.expr(f"shiftleft(fp, {WIDTH} * turn) | shiftrightunsigned(fp, 64 - {WIDTH} * turn)"))
        .alias("rotated"),
    )
    key = F.shiftrightunsigned("rotated", 64 - KEY_BITS).alias("key")
    large = spun.groupBy("turn", key).count().where(F.col("count") > block)
    blocks = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / block).cast("long")
    own = F.pmod(F.xxhash64("rotated", F.lit("block")), F.col("blocks"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.greatest(own, j) * F.col("blocks") + F.least(own, j))
    dealt = (
        spun.withColumn("key", key)
        .join(large, ["turn", "key"], "left")
        .withColumn("blocks", blocks)
        .select("turn", "key", "rotated", F.explode(pair).alias("part"))
        .repartition("turn", "key", "part")
        .select("turn", "part", "rotated")
        .sortWithinPartitions("turn", F.shiftrightunsigned("rotated", 64 - KEY_BITS), "part", "rotated")
    )
    return map_batches(dealt, "a long, b long", _bucket_links)


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id long) of each row of ``docs``."""
    marked = checkpoint(fingerprints(docs, text))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = checkpoint(connected_components(links(nodes.select("fp"))))
    members = parts.join(nodes, parts["node"] == nodes["fp"]).select("fp", "component", "least")
    smallest = members.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = members.join(smallest, "component").select("fp", "component_id")
    named = nodes.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def kept_rows(docs: DataFrame, tie: Column, text: str = "text") -> DataFrame:
    """(doc_id, tie, rows, kept): equal rows counted; kept is true for one (doc_id, tie) of each component.

    ``tie`` is a hash of the text. The least doc_id is kept, a null one only where no row has another,
    and of texts with that id the one with the least tie.
    """
    marked = checkpoint(fingerprints(docs, text, tie).groupBy("doc_id", "tie", "fp").agg(F.count(F.lit(1)).alias("rows")))
    first = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "tie")
    nodes = marked.groupBy("fp").agg(F.min(first).alias("least"))
    parts = checkpoint(connected_components(links(nodes.select("fp"))))
    members = parts.join(nodes, parts["node"] == nodes["fp"]).select("fp", "component", "least")
    smallest = members.groupBy("component").agg(F.min("least").alias("first"))
    joined = members.join(smallest, "component").select("fp", "first")
    named = nodes.join(joined, "fp", "left").select("fp", F.coalesce("first", "least").alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    return marked.join(named, "fp").select("doc_id", "tie", "rows", kept.alias("kept"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
