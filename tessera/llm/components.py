"""Connected components of a link table by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint


def connected_components(links: DataFrame) -> DataFrame:
    """(a long, b long) links -> (node, component): the smallest node that each linked node reaches.

    Every round joins each node with the least of its neighbours, first among all (large star), then
    among smaller ones (small star); stars remain after O(log^2 n) rounds. Only the minimum per node is
    grouped, with map-side partials, so hubs do not gather in one task; joins on hubs are plain
    sort-merge joins that adaptive execution can split. Each round is cut through the checkpoint folder.
    Self links and nulls are ignored; an empty table gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    edges = (
        links.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    edges = checkpoint(edges)
    before = _digest(edges)
    while before[0]:
        edges = checkpoint(_small_star(_large_star(edges)))
        after = _digest(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
    )
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
