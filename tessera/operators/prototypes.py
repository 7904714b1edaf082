"""Prototype catalogs: abundance, composition, sizes, markers, conserved and sample-specific kinds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def catalog(assignments: DataFrame, n_prototypes: int | None = None) -> DataFrame:
    """(prototype_id) from 0 to the largest assigned id, or to n_prototypes - 1."""
    low, high = assignments.agg(F.min("prototype_id"), F.max("prototype_id")).first()
    if low is not None and low < 0:
        raise ValueError("prototype ids must be 0 or more")
    if n_prototypes is None:
        n_prototypes = 0 if high is None else int(high) + 1
    elif high is not None and high >= n_prototypes:
        raise ValueError(f"prototype {high} is not in a catalog of {n_prototypes}")
    return assignments.sparkSession.range(n_prototypes).select(F.col("id").alias("prototype_id"))


def abundance(cells: DataFrame, n_prototypes: int | None = None) -> DataFrame:
    """(sample_id, prototype_id, fraction), a row for every sample and catalog prototype."""
    known = catalog(cells, n_prototypes)
    counts = cells.groupBy("sample_id", "prototype_id").agg(F.count(F.lit(1)).alias("n"))
    # samples times the catalog: the result's own size
    grid = counts.select("sample_id").distinct().join(F.broadcast(known))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("sample_id"))
    return grid.join(counts, ["sample_id", "prototype_id"], "left").na.fill(0, ["n"]).withColumn("fraction", share).select("sample_id", "prototype_id", "fraction")


def clr(table: DataFrame, pseudocount: float = 0.5) -> DataFrame:
    """(sample_id, prototype_id, clr): centred log ratios of a dense fraction table."""
    if pseudocount < 0:
        raise ValueError("the pseudocount must be 0 or more")
    sample = Window.partitionBy("sample_id")
    moved = table.withColumn("x", F.col("fraction") + pseudocount)
    logged = moved.withColumn("l", F.ln(F.col("x") / F.sum("x").over(sample)))
    return logged.select("sample_id", "prototype_id", (F.col("l") - F.avg("l").over(sample)).alias("clr"))


def composition(cells: DataFrame, column: str = "cell_type") -> DataFrame:
    """(prototype_id, cell_type, n, fraction) of the types that occur."""
    counts = cells.groupBy("prototype_id", column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("prototype_id")))


def composition_summary(table: DataFrame, column: str = "cell_type") -> DataFrame:
    """One row: mean, least and largest share of the main type, and the same of entropy over ln(types)."""
    types = F.broadcast(table.agg(F.count_distinct(column).alias("types")))
    rows = table.groupBy("prototype_id").agg(F.max("fraction").alias("top"), F.sum(F.when(F.col("fraction") > 0, -F.col("fraction") * F.ln("fraction")).otherwise(0.0)).alias("h")).join(types)
    h = F.when(F.col("types") > 1, F.col("h") / F.ln("types")).otherwise(0.0)
    names = {"mean": F.avg, "min": F.min, "max": F.max}
    return rows.select("top", h.alias("entropy")).agg(*[f(c).alias(f"{n}_{c}") for c in ("top", "entropy") for n, f in names.items()])


def size_structure(assignments: DataFrame) -> DataFrame:
    """One row: n_prototypes (largest id + 1), least, median and largest size, and entropy of those that occur."""
    sizes = assignments.groupBy("prototype_id").agg(F.count(F.lit(1)).alias("n"))
    share = sizes.select("prototype_id", "n").join(F.broadcast(assignments.agg(F.count(F.lit(1)).alias("total"))))
    p = F.col("n") / F.col("total")
    return share.agg((F.max("prototype_id") + 1).alias("n_prototypes"), F.min("n").alias("min_size"), F.median("n").alias("median_size"), F.max("n").alias("max_size"), F.sum(-p * F.ln(p)).alias("size_entropy"))


def marker_table(expr: DataFrame, assignments: DataFrame, top_k: int, gene: str = "gene", genes: DataFrame | None = None) -> DataFrame:
    """(prototype_id, rank, gene, mean_value): top genes by mean over a prototype's cells, zeros included; ties to the smaller gene.

    ``genes`` is the catalog of genes; without it, that of genes with any value.
    """
    if top_k < 1:
        raise ValueError(f"top_k must be 1 or more, not {top_k}")
    sizes = assignments.groupBy("prototype_id").agg(F.count(F.lit(1)).alias("cells"))
    sums = expr.join(assignments, "cell_id").groupBy("prototype_id", gene).agg(F.sum("value").alias("total"))
    known = (genes if genes is not None else expr).select(gene).distinct()
    grid = sizes.join(known)  # prototypes times genes: both catalogs
    means = grid.join(sums, ["prototype_id", gene], "left").withColumn("mean_value", F.coalesce("total", F.lit(0.0)) / F.col("cells"))
    order = Window.partitionBy("prototype_id").orderBy(F.desc("mean_value"), gene)
    return means.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("prototype_id", "rank", gene, "mean_value")


def presence(assignments: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(prototype_id, n_present, n_sections) of the catalog."""
    known = catalog(assignments) if known is None else known.select("prototype_id")
    seen = assignments.select("prototype_id", "section_id").distinct().groupBy("prototype_id").agg(F.count(F.lit(1)).alias("n_present"))
    total = F.broadcast(assignments.agg(F.count_distinct("section_id").alias("n_sections")))
    return known.join(seen, "prototype_id", "left").na.fill(0, ["n_present"]).join(total)


def _kind(coverage):
    required = F.greatest(F.lit(1), F.ceil(coverage * F.col("n_sections")))
    return F.when(F.col("n_sections") < 2, "unknown").when((F.col("n_present") > 0) & (F.col("n_present") >= required), "conserved").otherwise("sample_specific")


def check_coverage(coverage: float) -> float:
    if not 0 < coverage <= 1:
        raise ValueError(f"coverage must be in (0, 1], not {coverage}")
    return float(coverage)


def separation(assignments: DataFrame, coverage: float = 1.0, known: DataFrame | None = None) -> DataFrame:
    """(prototype_id, proto_kind): conserved if in at least ceil(coverage x sections) sections; unknown with fewer than two."""
    return presence(assignments, known).select("prototype_id", _kind(F.lit(check_coverage(coverage))).alias("proto_kind"))


def conserved_fraction(kinds: DataFrame) -> DataFrame:
    """One row: share of conserved among the kinds that are not unknown; null if there are none."""
    return kinds.where("proto_kind <> 'unknown'").agg(F.avg((F.col("proto_kind") == "conserved").cast("double")).alias("conserved_fraction"))


def overlap_rate(assignments: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row: share of tagged prototypes that are where their kind says: conserved in every section, sample-specific in fewer."""
    joined = presence(assignments, kinds).join(kinds, "prototype_id")
    if bad := kinds.where("proto_kind not in ('conserved', 'sample_specific', 'unknown')").limit(1).collect():
        raise ValueError(f"unknown kind {bad[0]['proto_kind']!r}")
    everywhere = F.col("n_present") == F.col("n_sections")
    right = F.when(F.col("proto_kind") == "conserved", everywhere).otherwise(~everywhere)
    return joined.where("proto_kind <> 'unknown'").agg(F.coalesce(F.avg(right.cast("double")), F.lit(float("nan"))).alias("section_overlap_rate"))


def coverage_sweep(assignments: DataFrame, thresholds: Sequence[float] = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)) -> DataFrame:
    """(coverage, conserved_fraction, section_overlap_rate, n_conserved, n_prototypes), a row a threshold; sections are counted once."""
    steps = assignments.sparkSession.createDataFrame([(check_coverage(t),) for t in thresholds], "coverage double")
    each = presence(assignments).join(F.broadcast(steps)).withColumn("kind", _kind(F.col("coverage")))
    everywhere = F.col("n_present") == F.col("n_sections")
    tagged = F.col("kind") != "unknown"
    right = F.when(F.col("kind") == "conserved", everywhere).when(F.col("kind") == "sample_specific", ~everywhere)
    conserved = F.col("kind") == "conserved"
    return each.groupBy("coverage").agg(
        F.avg(F.when(tagged, conserved.cast("double"))).alias("conserved_fraction"), F.coalesce(F.avg(right.cast("double")), F.lit(float("nan"))).alias("section_overlap_rate"),
        F.count_if(conserved).alias("n_conserved"), F.count(F.lit(1)).alias("n_prototypes"),
    )


def marker_recall(pred: DataFrame, true: DataFrame, k: int = 5) -> float:
    """Mean over prototypes with truth of the share of its first k genes that are among the first k predicted.

    Both have (prototype_id, rank, gene). An error if truth is shorter than k; nan without truth.
    """
    lengths = true.groupBy("prototype_id").agg(F.count(F.lit(1)).alias("n"))
    if short := lengths.where(F.col("n") < k).limit(1).collect():
        raise ValueError(f"prototype {short[0]['prototype_id']} has {short[0]['n']} true markers, fewer than {k}")
    want = true.where(F.col("rank") <= k).select("prototype_id", "gene").distinct()
    hits = want.join(pred.where(F.col("rank") <= k).select("prototype_id", "gene"), ["prototype_id", "gene"], "left_semi").groupBy("prototype_id").agg(F.count(F.lit(1)).alias("hits"))
    got = want.groupBy("prototype_id").agg(F.count(F.lit(1)).alias("n")).join(hits, "prototype_id", "left").agg(F.avg(F.coalesce("hits", F.lit(0)) / F.col("n"))).first()[0]
    return math.nan if got is None else got
