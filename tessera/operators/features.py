"""Quality control, normalisation, sections, composition and neighbourhood features of cells.

Expression is sparse, long (cell_id, gene, value): a row that is absent is a zero, and every mean, spread
and rank here counts it.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.frames import cut, exact_median, numbered
from tessera.operators.graph import build_graph
from tessera.schema import require

#: Section columns, in the order they are tried (fixed values).
SECTION_COLUMNS = ("fov", "slice_id", "section_id", "sample", "batch")
#: Labels that mean "no label", lower-cased and trimmed (fixed values).
UNLABELLED = ("nan", "none", "na", "null", "")
PROBE_ROWS = 2000
MANY_SECTIONS, SMALL_SECTION, SHARED_FRAME = 50, 200, 4.0


# --- quality control and normalisation -------------------------------------------------------------


def qc_mask(cells: DataFrame, expr: DataFrame, min_counts: float = 10, min_genes: int = 5) -> DataFrame:
    """(cell_id, total, n_genes, keep) of every cell, cells without any row included."""
    sums = expr.groupBy("cell_id").agg(F.sum("value").alias("total"), F.count_if(F.col("value") != 0).alias("n_genes"))
    joined = cells.select("cell_id").join(sums, "cell_id", "left").na.fill(0)
    return joined.withColumn("keep", (F.col("total") >= min_counts) & (F.col("n_genes") >= min_genes))


@dataclass
class QcReport:
    n_cells: int
    n_kept: int

    @property
    def dropped(self) -> int:
        return self.n_cells - self.n_kept

    def note(self, min_counts: float, min_genes: int) -> str:
        return f"qc: kept {self.n_kept} of {self.n_cells} cells (min_counts={min_counts:g}, min_genes={min_genes})"


def apply_qc(cells: DataFrame, expr: DataFrame, min_counts: float = 10, min_genes: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame, QcReport]:
    """Kept cells and their values. Warns if more than half go; an error if any go and fewer than ``least`` stay."""
    mask = qc_mask(cells, expr, min_counts, min_genes)
    n, kept = mask.agg(F.count(F.lit(1)), F.count_if("keep")).first()
    report = QcReport(n, kept)
    if report.dropped > n / 2:
        warnings.warn(f"quality control drops {report.dropped} of {n} cells", stacklevel=2)
    if report.dropped and kept < least:
        raise RuntimeError(f"quality control leaves {kept} cells; at least {least} are needed")
    stay = mask.where("keep").select("cell_id")
    return cells.join(stay, "cell_id", "left_semi"), expr.join(stay, "cell_id", "left_semi"), report


def raw_count_probe(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """One row of what tells counts from normalised values, over the PROBE_ROWS cells of least id."""
    first = cells.select("cell_id").orderBy("cell_id").limit(PROBE_ROWS)
    rounded = F.rint("value")
    close = F.abs(F.col("value") - rounded) <= 1e-8 + 1e-5 * F.abs(rounded)
    got = expr.join(F.broadcast(first), "cell_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.coalesce(F.bool_and(close), F.lit(True)).alias("whole"), F.count(F.lit(1)).alias("n"))
    raw = (F.col("n") > 0) & (F.col("low") >= 0) & ((F.col("high") > 30) | (F.col("whole") & (F.col("high") >= 2)))
    return got.select("low", "high", "whole", "n", F.coalesce(raw, F.lit(False)).alias("raw"))


def looks_like_raw_counts(expr: DataFrame, cells: DataFrame) -> bool:
    return raw_count_probe(expr, cells).first()["raw"]


def count_qc_applicable(expr: DataFrame, cells: DataFrame, already_normalized: bool = False) -> bool:
    return not already_normalized and looks_like_raw_counts(expr, cells)


def normalise_log1p(expr: DataFrame, target: float | None = None) -> DataFrame:
    """Values scaled to ``target`` a cell (the median positive total if none is given), then log(1 + v)."""
    totals = expr.groupBy("cell_id").agg(F.sum("value").alias("total"))
    if target is None:
        totals = cut(totals)
        target = exact_median(totals.where("total > 0").select(F.col("total").cast("double")))
    scaled = expr.join(totals, "cell_id").withColumn("goal", F.lit(target).cast("double"))
    value = F.when(F.col("total") > 0, F.col("value") * F.col("goal") / F.col("total")).otherwise(F.col("value"))
    return scaled.withColumn("value", F.log1p(value)).drop("total", "goal")


def gene_moments(expr: DataFrame, cells: DataFrame, gene: str = "gene") -> DataFrame:
    """(gene, mean, sd) over all cells, zeros included; population spread."""
    n = F.broadcast(cells.agg(F.count(F.lit(1)).alias("n")))
    # centred on the present values' mean first, so that large offsets do not cancel
    sums = expr.groupBy(gene).agg(F.sum("value").alias("s"), F.var_pop("value").alias("v"), F.count(F.lit(1)).alias("k"), F.avg("value").alias("m")).join(n)
    mean = F.col("s") / F.col("n")
    var = F.col("k") / F.col("n") * (F.col("v") + F.col("m") * F.col("m") * (1 - F.col("k") / F.col("n")))
    return sums.select(gene, mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))


def zscores(expr: DataFrame, cells: DataFrame, gene: str = "gene") -> DataFrame:
    """(cell_id, gene, value, z) for present values; an absent one has z = -mean / sd, see ``gene_moments``."""
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return expr.join(gene_moments(expr, cells, gene), gene).select("cell_id", gene, "value", z.alias("z"))


def wide(expr: DataFrame, n_genes: int) -> DataFrame:
    """(cell_id, features array of n_genes doubles): absent values are zeros."""
    filled = F.map_from_entries(F.collect_list(F.struct("gene_id", "value")))
    genes = F.sequence(F.lit(0), F.lit(n_genes - 1))
    return expr.groupBy("cell_id").agg(filled.alias("m")).select("cell_id", F.transform(genes, lambda g: F.coalesce(F.try_element_at("m", g), F.lit(0.0))).alias("features"))


def long(features: DataFrame, column: str = "features") -> DataFrame:
    """(cell_id, gene_id, value) of the non-zero components."""
    return features.select("cell_id", F.posexplode(column).alias("gene_id", "value")).where("value <> 0").withColumn("value", F.col("value").cast("double"))


def unit_rows(features: DataFrame, column: str = "features", floor: float = 1e-12) -> DataFrame:
    """Rows over their length, or over ``floor`` where that is larger."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    with_norm = features.withColumn("_norm", F.greatest(norm, F.lit(floor)))
    return with_norm.withColumn(column, F.transform(column, lambda x: x.cast("double") / F.col("_norm"))).drop("_norm")


# --- labels and sections ---------------------------------------------------------------------------


def unlabelled(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*UNLABELLED), F.lit(True))


def category_codes(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """``df`` with codes of the sorted distinct values, -1 for null (and NaN)."""
    value = F.col(column).cast("string")
    known = df.select(F.col(column).alias("_v")).where(F.col("_v").isNotNull() & (F.col("_v").cast("string") != "NaN")).distinct()
    # ranges of the distinct values are numbered, wherever they lie
    codes = numbered(known, "_v", name="_code")[0].withColumn("_code", F.col("_code").cast("long"))
    joined = df.join(codes, F.col(column) == F.col("_v"), "left")
    return joined.withColumn(out, F.when(value.isNull() | (value == "NaN"), -1).otherwise(F.coalesce("_code", F.lit(-1))).cast("long")).drop("_v", "_code")


def section_frames(cells: DataFrame) -> DataFrame:
    """One row: bounding area over all, median area of sections, their ratio, whether sections share a frame."""
    area = lambda: (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    one = cells.groupBy("section_id").agg(area().alias("area"), *[f(a).alias(n + a) for a in ("x", "y") for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    total = (F.max("hi_x") - F.min("lo_x")) * (F.max("hi_y") - F.min("lo_y"))
    one = cut(one)
    median = F.lit(exact_median(one.select(F.col("area").cast("double")))).cast("double")
    got = one.agg(total.alias("global_area"), median.alias("section_area"), F.count(F.lit(1)).alias("n_sections"))
    ratio = F.try_divide(F.col("global_area"), F.nullif(F.col("section_area"), F.lit(0.0)))
    shared = F.coalesce((F.col("global_area") > 0) & (ratio < SHARED_FRAME), F.lit(False))
    return got.select("n_sections", "global_area", "section_area", F.coalesce(ratio, F.lit(float("nan"))).alias("ratio"), shared.alias("shared"))


def resolve_sections(cells: DataFrame, section_col: str = "auto") -> tuple[DataFrame, str | None, str]:
    """Cells with ``section_id``, the column it came from, and a note.

    ``auto`` takes the first of SECTION_COLUMNS that is there; ``none`` or ``single`` makes one section; any
    other name must be a column. Many or small sections without a shared coordinate frame give a warning.
    """
    name = next((c for c in SECTION_COLUMNS if c in cells.columns), None) if section_col == "auto" else section_col
    if name in (None, "none", "single"):
        return cells.withColumn("section_id", F.lit(0).cast("long")), None, "one section"
    if name not in cells.columns:
        raise KeyError(f"no column {name!r}; there are {cells.columns}")
    coded = category_codes(cells.withColumn("_section", F.col(name)), "_section", "section_id").drop("_section")
    n, sections = coded.agg(F.count(F.lit(1)), F.count_distinct("section_id")).first()
    note = f"{sections} sections from {name}"
    if section_col == "auto" and sections and (sections > MANY_SECTIONS or n / sections < SMALL_SECTION):
        if section_frames(coded).first()["shared"]:
            note += "; small sections that share one coordinate frame, so they may be fields of one section"
        else:
            warnings.warn(f"{name} gives {sections} sections of {n / sections:.0f} cells on average", stacklevel=2)
    return coded, name, note


# --- neighbourhood features ------------------------------------------------------------------------


def neighbour_mean(expr: DataFrame, edges: DataFrame, cells: DataFrame, gene: str = "gene_id") -> DataFrame:
    """(cell_id, gene, value): means of the out-neighbours' values; a cell without neighbours keeps its own row."""
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    met = edges.select("src", "dst").join(expr, F.col("dst") == F.col("cell_id")).groupBy("src", gene).agg(F.sum("value").alias("total"))
    means = met.join(degree, "src").select(F.col("src").alias("cell_id"), gene, (F.col("total") / F.col("degree")).alias("value"))
    alone = cells.select("cell_id").join(degree, F.col("cell_id") == F.col("src"), "left_anti")
    return means.unionByName(expr.join(alone, "cell_id", "left_semi").select("cell_id", gene, "value"))


def symmetric_mean(expr: DataFrame, edges: DataFrame, cells: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Means over both directions of the edges, mutual neighbours twice; zeros for a cell without any."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    met = both.join(expr, F.col("dst") == F.col("cell_id")).groupBy("src", gene).agg(F.sum("value").alias("total"))
    return met.join(degree, "src").select(F.col("src").alias("cell_id"), gene, (F.col("total") / F.col("degree")).alias("value"))


def blend(expr: DataFrame, edges: DataFrame, cells: DataFrame, alpha: float = 0.5, gene: str = "gene_id") -> DataFrame:
    """(1 - alpha) own value + alpha neighbour mean; alpha 0 gives the values as they are."""
    if not 0 <= alpha <= 1:
        raise ValueError(f"alpha must be in [0, 1], not {alpha}")
    own = expr.select("cell_id", gene, "value")
    if alpha == 0:
        return own
    mixed = own.withColumn("value", F.col("value") * (1 - alpha)).unionByName(neighbour_mean(expr, edges, cells, gene).withColumn("value", F.col("value") * alpha))
    return mixed.groupBy("cell_id", gene).agg(F.sum("value").alias("value"))


def neighbourhood_embedding(expr: DataFrame, cells: DataFrame, *, k: int = 8, alpha: float = 0.5, gene: str = "gene_id") -> DataFrame:
    if alpha == 0 or k == 0:
        return blend(expr, cells.sparkSession.createDataFrame([], "src long, dst long"), cells, alpha, gene)
    return blend(expr, build_graph(cells, k), cells, alpha, gene)


def diffusion_embedding(expr: DataFrame, edges: DataFrame, cells: DataFrame, *, alpha: float = 0.5, n_steps: int = 3, gene: str = "gene_id") -> DataFrame:
    """``n_steps`` blends over one edge table; each step is cut to the shared folder."""
    if n_steps < 0:
        raise ValueError(f"n_steps must be 0 or more, not {n_steps}")
    state = blend(expr, edges, cells, 0, gene)
    if not 0 <= alpha <= 1:
        raise ValueError(f"alpha must be in [0, 1], not {alpha}")
    if alpha == 0:
        return state
    for step in range(n_steps):
        state = blend(state, edges, cells, alpha, gene)
        if step + 1 < n_steps:
            state = cut(state)
    return state


def composition_embedding(cells: DataFrame, edges: DataFrame, column: str = "cell_type") -> DataFrame:
    """(cell_id, cell_type, share) over each cell and its out-neighbours."""
    every = edges.select("src", "dst").unionByName(cells.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst")))
    counts = every.join(cells.select(F.col("cell_id").alias("dst"), column), "dst").groupBy(F.col("src").alias("cell_id"), column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cell_id"))).select("cell_id", column, "share")


def dataset_card_id(paths: Sequence[str]) -> str:
    """Names of the paths' parent folders, distinct, sorted, joined by +."""
    parents = {p.replace("\\", "/").rstrip("/").split("/")[-2] for p in paths if p.replace("\\", "/").rstrip("/").count("/")}
    return "+".join(sorted(parents))


def effective_batch_size(requested: int, n_cells: int, threshold: int = 50_000, batch: int = 4096) -> int:
    """What is asked for if positive; else blocks of ``batch`` for more than ``threshold`` cells, 0 (all at once) below."""
    if requested > 0:
        return requested
    return batch if n_cells > threshold else 0


def check_composition(cells: DataFrame, column: str, n_types: int) -> None:
    require(cells, column)
    if (found := cells.select(column).distinct().count()) > n_types:
        raise ValueError(f"{found} types, but n_types is {n_types}")
