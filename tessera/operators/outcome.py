"""Associations of prototype abundance with sample outcomes, and false discovery rates."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.frames import cut
from tessera.functions.special import mann_whitney_two_sided, student_two_sided
from tessera.operators.prototypes import abundance, clr


def average_rank(value: str, *groups: str) -> Column:
    """Ranks from 1 with ties at their mean, within groups."""
    order = Window.partitionBy(*groups).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, value))
    return F.rank().over(order) + (ties - 1) / 2


def benjamini_hochberg(df: DataFrame, p: str = "p", key: str = "id", group: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``q``: adjusted p-values in [0, 1], ties by ``key``; within ``group`` if given.

    Rows are sorted by ranges of (group, p, key); ranks and least values go on from partition to partition
    through one row for each of them and group, so a table without groups is no single task either.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) for c in (*group, p, key)]
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(ordered).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_before", before - F.col("_first")).withColumn("_m", F.sum("_n").over(whole)).drop("_n", "_first")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*group, "_part")]
    # a row a partition and group: bounded only without groups
    small = (lambda rows: rows) if group else F.broadcast
    met = placed.alias("r").join(small(starts).alias("s"), reduce(and_, same)).select("r.*", "_before", "_m")
    raw = met.withColumn("_raw", F.col(p) * F.col("_m") / (F.col("_at") + F.col("_before") + 1)).drop("_before", "_m")
    least = raw.groupBy(*group, "_part").agg(F.min("_raw").alias("_least"))
    later = least.withColumn("_later", F.min("_least").over(whole.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))).drop("_least")
    down = Window.partitionBy(*group, "_part").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = raw.withColumn("_down", F.min("_raw").over(down)).alias("r").join(small(later).alias("s"), reduce(and_, same)).select("r.*", "_later")
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least("_down", "_later")))
    return within.withColumn("q", q).drop("_at", "_part", "_raw", "_down", "_later")


def rank_sums(table: DataFrame, value: str = "value", group: str = "group") -> DataFrame:
    """(prototype_id, u, n1, n0, tie_sum, effect): U of the higher of two sorted groups; ``table`` has prototype_id, group, value."""
    high = F.max(group).over(Window.partitionBy("prototype_id"))
    ranked = table.select("prototype_id", value, (F.col(group) == high).alias("high"), average_rank(value, "prototype_id").alias("r"), F.count(F.lit(1)).over(Window.partitionBy("prototype_id", value)).alias("t"))
    sums = ranked.groupBy("prototype_id").agg(
        F.sum(F.when(F.col("high"), F.col("r"))).alias("r1"), F.count_if("high").alias("n1"), F.count_if(~F.col("high")).alias("n0"),
        # each of t tied rows adds (t^2 - 1), which makes t^3 - t a tied group
        F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("tie_sum"),
    )
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    effect = F.coalesce(F.try_divide(2 * u, F.col("n1") * F.col("n0")) - 1, F.lit(0.0))
    return sums.select("prototype_id", u.alias("u"), "n1", "n0", "tie_sum", effect.alias("effect"))


def spearman(table: DataFrame, value: str = "value", outcome: str = "outcome") -> DataFrame:
    """(prototype_id, rho, n): rank correlations; 0 where one side is constant."""
    ranked = table.select("prototype_id", average_rank(value, "prototype_id").alias("a"), average_rank(outcome, "prototype_id").alias("b"))
    got = ranked.groupBy("prototype_id").agg(F.corr("a", "b").alias("rho"), F.count(F.lit(1)).alias("n"))
    return got.select("prototype_id", F.when(F.col("rho").isNull() | F.isnan("rho"), 0.0).otherwise(F.col("rho")).alias("rho"), "n")


@dataclass
class Association:
    """Records (prototype_id, statistic, effect, p, q) and what they were made with."""

    records: DataFrame
    kind: str
    transform: str
    n_samples: int


def outcome_association(table: DataFrame, labels: DataFrame, *, label_kind: str, transform: str = "clr", pseudocount: float = 0.5) -> Association:
    """Tests every prototype of a dense abundance table against (sample_id, outcome).

    The table of samples x prototypes is summed by Spark; only one row a prototype comes to the driver,
    for its p-value.
    """
    if label_kind not in ("binary", "continuous") or transform not in ("clr", "none"):
        raise ValueError(f"no such kind or transform: {label_kind!r}, {transform!r}")
    values = clr(table, pseudocount).withColumnRenamed("clr", "value") if transform == "clr" else table.select("sample_id", "prototype_id", F.col("fraction").alias("value"))
    n, groups = labels.agg(F.count(F.lit(1)), F.count_distinct("outcome")).first()
    if n < 2:
        raise ValueError("at least two samples are needed")
    if label_kind == "binary" and groups != 2:
        raise ValueError(f"a binary outcome has two groups, not {groups}")
    met = values.join(labels.select("sample_id", "outcome"), "sample_id")
    rows = []
    if label_kind == "binary":
        for r in rank_sums(met, "value", "outcome").collect():
            same = r["tie_sum"] >= (r["n1"] + r["n0"]) ** 3 - (r["n1"] + r["n0"])
            p = 1.0 if same else mann_whitney_two_sided(r["u"], r["n1"], r["n0"], r["tie_sum"])
            rows.append((r["prototype_id"], r["u"], 0.0 if same else r["effect"], p))
    else:
        for r in spearman(met, "value", "outcome").collect():
            rho, df = max(-1.0, min(1.0, r["rho"])), r["n"] - 2
            p = 1.0 if rho == 0 or df < 1 else student_two_sided(math.inf if abs(rho) == 1 else rho * math.sqrt(df / (1 - rho * rho)), df)
            rows.append((r["prototype_id"], rho, rho, p))
    records = table.sparkSession.createDataFrame(rows, "prototype_id long, statistic double, effect double, p double")
    return Association(benjamini_hochberg(records, "p", "prototype_id"), label_kind, transform, n)


def infer_label_kind(labels: DataFrame) -> str | None:
    """binary for two distinct values, continuous for more that are numbers, else None."""
    value = F.col("outcome")
    n, numbers, present = labels.agg(F.count_distinct(value), F.count(value.cast("string").try_cast("double")), F.count(value)).first()
    if n < 2:
        return None
    return "binary" if n == 2 else ("continuous" if numbers == present else None)


def sample_outcomes(cells: DataFrame) -> DataFrame:
    """(sample_id, outcome), an error where a sample has not exactly one."""
    got = cells.groupBy("sample_id").agg(F.count_distinct("outcome").alias("n"), F.min("outcome").alias("outcome"))
    if bad := got.where("n <> 1").limit(1).collect():
        raise ValueError(f"sample {bad[0]['sample_id']} has {bad[0]['n']} outcomes")
    return got.select("sample_id", "outcome")


def outcome_table(cells: DataFrame, n_prototypes: int | None = None, label_kind: str | None = None) -> Association | None:
    """From (sample_id, prototype_id, outcome) cells; None with fewer than two samples or no usable outcome."""
    labels = sample_outcomes(cells)
    kind = label_kind or infer_label_kind(labels)
    n, groups = labels.agg(F.count(F.lit(1)), F.count_distinct("outcome")).first()
    if kind is None or n < 2 or (kind == "binary" and groups != 2):
        return None
    if kind == "continuous":
        labels = labels.withColumn("outcome", F.col("outcome").cast("double"))
    return outcome_association(abundance(cells, n_prototypes), labels, label_kind=kind)
