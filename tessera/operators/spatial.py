"""Spatial coherence over edge tables: Moran's I, neighbour agreement, co-location, spatial interaction scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.frames import label_shuffles
from tessera.operators.graph import with_ends
from tessera.schema import SchemaError, edges_out_of_range

#: Counts by shuffle and pair of types that a task keeps; beyond, it hands on those of each batch.
MOST_COUNTS = 1 << 22


def check_range(edges: DataFrame, cells: DataFrame) -> None:
    if edges_out_of_range(edges.select("src", "dst"), cells).limit(1).count():
        raise SchemaError("edges with an end that is no cell")


def morans_i(values: DataFrame, edges: DataFrame, column: str = "value") -> DataFrame:
    """One row (morans_i) of (cell_id, column) over directed unit edges; 0 without edges or variance."""
    stats = values.agg(F.avg(column).alias("mean"), F.count(column).alias("n"), F.var_pop(column).alias("var"))
    mean = F.broadcast(stats.select("mean"))  # one row
    centred = values.join(mean).select("cell_id", (F.col(column).cast("double") - F.col("mean")).alias("c"))
    products = with_ends(edges.select("src", "dst"), centred, "c").agg(F.sum(F.col("a") * F.col("b")).alias("s"), F.count(F.lit(1)).alias("w"))
    value = F.try_divide(F.col("s") / F.nullif(F.col("w"), F.lit(0)), F.nullif(F.col("var"), F.lit(0.0)))
    return F.broadcast(stats).join(products).select(F.coalesce(value, F.lit(0.0)).alias("morans_i"))


def per_prototype_morans_i(assignments: DataFrame, edges: DataFrame) -> DataFrame:
    """(prototype_id, morans_i): Moran's I of each prototype's 0/1 indicator, from counts of cells and edges alone."""
    sizes = assignments.groupBy("prototype_id").agg(F.count(F.lit(1)).alias("cells"))
    ends = with_ends(edges.select("src", "dst"), assignments, "prototype_id")
    # each edge counts once for its own prototype on either side, and once for both
    sides = ends.select(F.explode(F.array(F.struct(F.col("a").alias("p"), F.lit(1).alias("side")), F.struct(F.col("b").alias("p"), F.lit(1).alias("side")))).alias("s"), (F.col("a") == F.col("b")).cast("int").alias("same"))
    counts = sides.groupBy(F.col("s.p").alias("prototype_id")).agg(F.count(F.lit(1)).alias("touch"), (F.sum("same") / 2).alias("inside"))
    totals = F.broadcast(assignments.agg(F.count(F.lit(1)).alias("n")).join(ends.agg(F.count(F.lit(1)).alias("w"))))
    f = F.col("cells") / F.col("n")
    cross = F.coalesce("inside", F.lit(0)) - f * F.coalesce("touch", F.lit(0)) + f * f * F.col("w")
    spread = F.col("cells") * (1 - f)
    value = F.when((F.col("w") == 0) | (spread == 0), 0.0).otherwise(F.try_divide(F.col("n") * cross, F.col("w") * spread))
    return sizes.join(counts, "prototype_id", "left").join(totals).select("prototype_id", value.alias("morans_i"))


def neighbour_agreement(labels: DataFrame, edges: DataFrame, column: str = "prototype_id") -> DataFrame:
    """One row (agreement, n_edges): the share of edges between equal labels; nan without edges."""
    ends = with_ends(edges.select("src", "dst"), labels, column)
    return ends.agg(F.coalesce(F.avg((F.col("a") == F.col("b")).cast("double")), F.lit(float("nan"))).alias("agreement"), F.count(F.lit(1)).alias("n_edges"))


def neighbour_agreement_by_section(labels: DataFrame, edges: DataFrame, column: str = "prototype_id") -> DataFrame:
    ends = with_ends(edges.select("section_id", "src", "dst"), labels, column)
    return ends.groupBy("section_id").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n_edges"))


def colocation_counts(labels: DataFrame, edges: DataFrame, column: str = "cell_type") -> DataFrame:
    """(a, b, n): edges between types, each counted in both directions (within a type: twice)."""
    one = with_ends(edges.select("src", "dst"), labels, column).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.groupBy("a", "b").agg(F.sum("n").alias("n"))


def colocation_enrichment(labels: DataFrame, edges: DataFrame, n_perm: int = 200, seed: int = 0, column: str = "cell_type") -> DataFrame:
    """(a, b, observed, null_mean, null_sd, z) against ``n_perm`` shuffles of the labels over cells.

    See ``shuffled_labels`` for the shuffles. Edges meet the numbers of their cells, from which a cell's labels
    in all shuffles follow; a task works them out and hands on counts by shuffle and pair of types, so neither
    labels of shuffles nor edges by shuffle are rows. z is 0 where the null does not vary.
    """
    rows, names, shuffles = label_shuffles(labels, column, n_perm, seed)
    many = len(names)

    def count(batches):
        import pyarrow as pa

        codes, total = shuffles(), None
        if small := n_perm * many * many <= MOST_COUNTS:
            total = np.zeros((n_perm, many * many), np.int64)

        def out(perm, pair, n):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, t)) for c, t in ((perm, np.int32), (pair, np.int64), (n, np.int64))], names=["perm", "pair", "n"])

        for batch in batches:
            cells, at = np.unique(np.concatenate([np.asarray(batch.column(c), np.int64) for c in (0, 1)]), return_inverse=True)
            a, b = np.split(at, 2)
            for perm, code in enumerate(codes(cells)):
                pair = code[a] * many + code[b]
                if small:
                    total[perm] += np.bincount(pair, minlength=many * many)
                else:
                    each, n = np.unique(pair, return_counts=True)
                    yield out(np.full(len(each), perm), each, n)
        if small:
            perm, pair = np.nonzero(total)
            yield out(perm, pair, total[perm, pair])

    each = with_ends(edges.select("src", "dst"), rows, "idx").select("a", "b").mapInArrow(count, "perm int, pair long, n long").groupBy("perm", "pair").agg(F.sum("n").alias("n"))
    kind = labels.schema[column].dataType.simpleString()
    types = F.broadcast(labels.sparkSession.createDataFrame(list(enumerate(names)), f"code int, label {kind}"))  # the catalog of types
    pairs = types.select(F.col("code").alias("ca"), F.col("label").alias("a")).join(F.broadcast(types.select(F.col("code").alias("cb"), F.col("label").alias("b"))))
    one, two = F.floor(F.col("pair") / max(len(names), 1)).cast("int"), (F.col("pair") % max(len(names), 1)).cast("int")
    # an edge counts in both directions
    sides = each.select("perm", one.alias("ca"), two.alias("cb"), "n").unionByName(each.select("perm", two.alias("ca"), one.alias("cb"), "n"))
    drawn = sides.groupBy("perm", "ca", "cb").agg(F.sum("n").alias("n"))
    mean, square = F.sum("n") / n_perm, F.sum(F.col("n") * F.col("n")) / n_perm
    null = drawn.groupBy("ca", "cb").agg(mean.alias("null_mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("null_sd"))
    joined = pairs.join(null, ["ca", "cb"], "left").join(colocation_counts(labels, edges, column), ["a", "b"], "left").na.fill(0)
    z = F.when(F.col("null_sd") > 0, (F.col("n") - F.col("null_mean")) / F.col("null_sd")).otherwise(0.0)
    return joined.select("a", "b", F.col("n").alias("observed"), "null_mean", "null_sd", z.alias("z"))


def colocation_summary(enrichment: DataFrame) -> DataFrame:
    """One row: mean z within types, mean z across types, largest absolute z."""
    same = F.col("a") == F.col("b")
    return enrichment.agg(F.avg(F.when(same, F.col("z"))).alias("same_mean_z"), F.avg(F.when(~same, F.col("z"))).alias("cross_mean_z"), F.max(F.abs("z")).alias("max_abs_z"))


def spatial_interaction(expr: DataFrame, edges: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ligand, receptor, source, target, score): mean of ligand at src times receptor at dst over edges from source to target.

    ``expr`` is sparse, so the sum runs over edges where both are present and the mean over all edges
    between the groups; pairs of groups without an edge score 0. ``groups`` has (cell_id, prototype_id).
    """
    ends = with_ends(edges.select("src", "dst"), groups, "prototype_id")
    counts = ends.groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.count(F.lit(1)).alias("edges"))
    sent = expr.select(F.col("cell_id").alias("src"), F.col("gene").alias("ligand"), F.col("value").alias("sent"))
    got = expr.select(F.col("cell_id").alias("dst"), F.col("gene").alias("receptor"), F.col("value").alias("got"))
    genes = pairs.select("ligand", "receptor").distinct()
    met = ends.join(sent.join(genes, "ligand"), "src").join(got, ["dst", "receptor"])
    sums = met.groupBy("ligand", "receptor", F.col("a").alias("source"), F.col("b").alias("target")).agg(F.sum(F.col("sent") * F.col("got")).alias("total"))
    wanted = pairs.select("ligand", "receptor", "source", "target").distinct() if "source" in pairs.columns else genes.join(counts.select("source", "target"))
    score = F.coalesce(F.col("total") / F.col("edges"), F.lit(0.0))
    return wanted.join(counts, ["source", "target"], "left").join(sums, ["ligand", "receptor", "source", "target"], "left").select("ligand", "receptor", "source", "target", score.alias("score"))
