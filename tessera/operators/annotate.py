"""Marker-based annotation of cells and differential expression of prototypes."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.features import gene_moments, normalise_log1p
from tessera.operators.outcome import benjamini_hochberg


@dataclass
class Annotation:
    """(cell_id, cell_type, code, score) rows; ``types`` in code order; markers used, missing and types left out."""

    rows: DataFrame
    types: list[str]
    used: dict[str, list[str]]
    missing: dict[str, list[str]]
    excluded: list[str] = field(default_factory=list)


def marker_scores(expr: DataFrame, cells: DataFrame, panel: DataFrame, method: str = "zscore", gene: str = "gene") -> DataFrame:
    """(cell_id, type_pos, cell_type, score): means of a type's marker values, or z-scores, in each cell.

    ``panel`` has (type_pos, cell_type, gene), a gene as often as it is listed. A zero's z-score is a
    constant of the gene, so a cell's score is the sum over its present markers plus the type's constant.
    """
    if method not in ("zscore", "mean"):
        raise ValueError(f"no such method: {method!r}")
    listed = panel.groupBy("type_pos", "cell_type", gene).agg(F.count(F.lit(1)).alias("times"))
    genes = listed.join(gene_moments(expr, cells, gene), gene, "left").na.fill(0.0, ["mean", "sd"])
    scale = F.when(F.col("sd") > 0, 1 / F.col("sd")).otherwise(0.0) if method == "zscore" else F.lit(1.0)
    shift = F.col("mean") if method == "zscore" else F.lit(0.0)
    weighed = genes.select("type_pos", "cell_type", gene, (F.col("times") * scale).alias("w"), (F.col("times") * scale * shift).alias("c"), "times")
    types = weighed.groupBy("type_pos", "cell_type").agg(F.sum("times").alias("markers"), F.sum("c").alias("constant"))
    sums = expr.join(weighed, gene).groupBy("cell_id", "type_pos").agg(F.sum(F.col("value") * F.col("w")).alias("total"))
    grid = cells.select("cell_id").join(F.broadcast(types))  # cells times panel types: the scores' own size
    score = (F.coalesce("total", F.lit(0.0)) - F.col("constant")) / F.col("markers")
    return grid.join(sums, ["cell_id", "type_pos"], "left").select("cell_id", "type_pos", "cell_type", score.alias("score"))


def best_type(scores: DataFrame) -> DataFrame:
    """(cell_id, type_pos, cell_type, score): the highest score, the earliest type of ties."""
    top = F.max(F.struct("score", (-F.col("type_pos")).alias("before"), "cell_type")).alias("t")
    return scores.groupBy("cell_id").agg(top).select("cell_id", (-F.col("t.before")).alias("type_pos"), F.col("t.cell_type").alias("cell_type"), F.col("t.score").alias("score"))


def marker_annotation(expr: DataFrame, cells: DataFrame, markers: dict[str, list[str]], genes: list[str] | None = None, *, method: str = "zscore", min_markers: int = 1, unassigned: str = "unassigned", threshold: float | None = None, gene: str = "gene") -> Annotation:
    """Each cell's best type among those with at least ``min_markers`` known markers.

    ``genes`` is the catalog of known genes (those with values by default). Scores under ``threshold`` are
    ``unassigned``, the last type, listed only if it is used.
    """
    if not markers:
        raise ValueError("no markers")
    if min_markers < 1:
        raise ValueError("min_markers must be 1 or more")
    if unassigned in markers:
        raise ValueError(f"{unassigned!r} is also a type")
    if genes is None:
        listed = sorted({g for panel in markers.values() for g in panel})
        genes = [r[0] for r in expr.where(F.col(gene).isin(listed)).select(gene).distinct().collect()]  # at most the panel's
    known = set(genes)
    used = {t: [g for g in panel if g in known] for t, panel in markers.items()}
    missing = {t: [g for g in panel if g not in known] for t, panel in markers.items()}
    excluded = [t for t, panel in used.items() if len(panel) < min_markers]
    if excluded:
        warnings.warn(f"types with fewer than {min_markers} known markers are left out: {excluded}", stacklevel=2)
    types = [t for t in markers if t not in excluded]
    if not types:
        raise ValueError("no type has enough known markers")
    spark = expr.sparkSession
    panel = spark.createDataFrame([(i, t, g) for i, t in enumerate(types) for g in used[t]], f"type_pos int, cell_type string, {gene} string")
    best = best_type(marker_scores(expr, cells, panel, method, gene))
    if threshold is not None:
        low = F.col("score") < threshold
        best = best.withColumn("type_pos", F.when(low, len(types)).otherwise(F.col("type_pos"))).withColumn("cell_type", F.when(low, unassigned).otherwise(F.col("cell_type")))
        if best.where(F.col("cell_type") == unassigned).limit(1).count():
            types = [*types, unassigned]
    return Annotation(best.select("cell_id", "cell_type", F.col("type_pos").cast("long").alias("code"), "score"), types, {t: used[t] for t in used if t not in excluded}, missing, excluded)


def rank_sum_scores(expr: DataFrame, assignments: DataFrame, gene: str = "gene") -> DataFrame:
    """(prototype_id, gene, rank_sum, z, mean_in, mean_out): Wilcoxon rank sums of each prototype against the rest.

    Ranks run over all cells, zeros included: zeros tie at their common mean rank, negative values come
    before them. Cells are counted by (gene, value, prototype) where they are read; ranks follow from sums of
    counts over a gene's distinct values, so no task sorts a gene's cells.
    """
    n = F.broadcast(assignments.agg(F.count(F.lit(1)).alias("n")))
    sizes = F.broadcast(assignments.groupBy("prototype_id").agg(F.count(F.lit(1)).alias("m")))
    counted = expr.where("value <> 0").join(assignments, "cell_id").groupBy(gene, "value", "prototype_id").agg(F.count(F.lit(1)).alias("c"))
    values = counted.groupBy(gene, "value").agg(F.sum("c").alias("t"))
    g = Window.partitionBy(gene)
    up = F.coalesce(F.sum("t").over(g.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below, nonzero = F.coalesce(F.sum(F.when(F.col("value") < 0, F.col("t"))).over(g), F.lit(0)), F.sum("t").over(g)
    placed = values.select(gene, "value", (up + (F.col("t") + 1) / 2).alias("position"), below.alias("below"), nonzero.alias("nonzero")).join(n)
    zeros = F.col("n") - F.col("nonzero")
    placed = placed.select(gene, "value", "n", (F.col("below") + (zeros + 1) / 2).alias("zero_rank"), (F.col("position") + F.when(F.col("value") > 0, zeros).otherwise(0)).alias("r"))
    ranked = counted.join(placed, [gene, "value"])
    sums = ranked.groupBy("prototype_id", gene).agg(F.sum(F.col("r") * F.col("c")).alias("r"), F.sum("c").alias("k"), F.sum(F.col("value") * F.col("c")).alias("total"))
    genes = ranked.groupBy(gene).agg(F.first("n").alias("n"), F.first("zero_rank").alias("zero_rank"), F.sum(F.col("value") * F.col("c")).alias("all_total"))
    grid = genes.join(sizes)  # genes times prototypes: the result's own size
    met = grid.join(sums, ["prototype_id", gene], "left").na.fill(0, ["r", "k", "total"])
    rank_sum = F.col("r") + (F.col("m") - F.col("k")) * F.col("zero_rank")
    # the product of three counts is past a long from some four million cells on
    spread = F.sqrt(F.col("m") * (F.col("n") - F.col("m")) * (F.col("n") + 1).cast("double") / 12)
    z = F.coalesce(F.try_divide(rank_sum - F.col("m") * (F.col("n") + 1) / 2, F.nullif(spread, F.lit(0.0))), F.lit(0.0))
    return met.select("prototype_id", gene, rank_sum.alias("rank_sum"), z.alias("z"), (F.col("total") / F.col("m")).alias("mean_in"), F.coalesce(F.try_divide(F.col("all_total") - F.col("total"), F.col("n") - F.col("m")), F.lit(0.0)).alias("mean_out"))


def de_markers(expr: DataFrame, assignments: DataFrame, top_k: int = 10, gene: str = "gene", target: float = 1e4) -> DataFrame:
    """(prototype_id, rank, gene, score, logfc, p, q) of the top genes of each prototype, on values normalised to ``target`` and logged.

    p is the two-sided normal one; q is adjusted within the prototype. logfc compares means back on the count scale.
    """
    scored = rank_sum_scores(normalise_log1p(expr, target), assignments, gene)

    # no erfc in SQL: the normal tail by an Arrow function over genes x prototypes rows
    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))

    tested = benjamini_hochberg(scored.withColumn("p", two_sided("z")), "p", gene, ("prototype_id",))
    fold = F.log2((F.expm1("mean_in") + 1e-9) / (F.expm1("mean_out") + 1e-9))
    order = Window.partitionBy("prototype_id").orderBy(F.desc("z"), gene)
    return tested.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("prototype_id", "rank", gene, F.col("z").alias("score"), fold.alias("logfc"), "p", "q")
