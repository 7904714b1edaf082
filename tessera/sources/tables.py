"""Reading cells and expression, and writing fitted tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.frames import cut
from tessera.operators.features import QcReport, apply_qc, category_codes, count_qc_applicable, normalise_log1p, resolve_sections
from tessera.operators.graph import build_graph
from tessera.operators.model import NicheModelResult
from tessera.schema import validate_inputs
from tessera.sources import chunked


@dataclass
class Loaded:
    cells: DataFrame
    expr: DataFrame
    n_genes: int
    notes: list[str] = field(default_factory=list)
    qc: QcReport | None = None


#: Kinds of the columns that the contracts name; any other column of a CSV file is text.
CSV_KINDS = {"cell_id": "long", "section_id": "long", "x": "double", "y": "double", "z": "double", "gene_id": "int", "value": "double", "prototype_id": "long"}


def read_table(spark: SparkSession, path: str, *, expression: bool = False) -> DataFrame:
    """Parquet, ORC, CSV (with a header), JSON lines, zarr or Matrix Market, by the path's ending; HDF5 needs converting first.

    A zarr store holds cells (obs, places) and expression (X): ``expression`` says which is wanted.
    """
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "csv":
        # text columns take the kinds of the table contracts; no pass over the file to guess them
        rows = spark.read.option("header", True).csv(path)
        return rows.withColumns({c: F.col(f"`{c}`").cast(kind) for c, kind in CSV_KINDS.items() if c in rows.columns})
    if ending in ("json", "jsonl"):
        return spark.read.json(path)
    if ending == "orc":
        return spark.read.orc(path)
    if ending == "zarr":
        return chunked.expression(spark, path) if expression else chunked.cells(spark, path)
    if ending == "mtx":
        return chunked.matrix_market(spark, path)
    if ending in ("h5", "h5ad"):
        raise ValueError(f"{path}: convert to Parquet tables of cells and expression first")
    return spark.read.parquet(path)


def load_dataset(spark: SparkSession, cells_path: str, expr_path: str, *, already_normalized: bool = False, section_col: str = "auto", min_counts: float = 10, min_genes: int = 5, qc: bool = True) -> Loaded:
    """Cells and expression with quality control on raw counts, normalisation, sections and gene ids.

    Control comes before normalisation, whose target is the median of what is kept.
    """
    cells, expr = read_table(spark, cells_path), read_table(spark, expr_path, expression=True)
    if not {"x", "y"} <= set(cells.columns):
        raise KeyError("cells have no coordinates x and y")
    notes, report = [], None
    raw = count_qc_applicable(expr, cells, already_normalized)
    if raw and qc:
        cells, expr, report = apply_qc(cells, expr, min_counts, min_genes)
        notes.append(report.note(min_counts, min_genes))
    elif qc:
        notes.append("qc: skipped, values are not counts")
    if raw:
        expr = normalise_log1p(expr)
        notes.append("normalised to the median total, log1p")
    cells, _, note = resolve_sections(cells, section_col)
    if "gene_id" not in expr.columns:
        expr = category_codes(expr, "gene", "gene_id").withColumn("gene_id", F.col("gene_id").cast("int"))
    n_genes = (expr.agg(F.max("gene_id")).first()[0] or 0) + 1
    return Loaded(cells, expr, n_genes, [*notes, note], report)


def build_contract(spark: SparkSession, cells_path: str, expr_path: str, section_col: str = "auto", k: int = 8) -> tuple[Loaded, DataFrame]:
    """The loaded tables and their neighbour graph, checked: no edge leaves its section."""
    loaded = load_dataset(spark, cells_path, expr_path, section_col=section_col, qc=False)
    edges = cut(build_graph(loaded.cells, k))
    validate_inputs(loaded.cells, edges, loaded.expr)
    return loaded, edges


def niche_map(cells: DataFrame, assignments: DataFrame) -> DataFrame:
    """What a map of niches shows: (section_id, x, y, prototype_id) of every cell."""
    return cells.join(assignments, "cell_id").select("section_id", "cell_id", "x", "y", "prototype_id")


def write_fit(result: NicheModelResult, folder: str) -> None:
    """embeddings, assignments, markers and interactions as Parquet; kinds also as a JSON list by prototype."""
    result.embeddings.join(result.assignments, "cell_id").write.mode("overwrite").parquet(f"{folder}/niche")
    result.markers.write.mode("overwrite").parquet(f"{folder}/markers")
    result.prototypes.write.mode("overwrite").parquet(f"{folder}/prototypes")
    if result.interactions is not None:
        result.interactions.write.mode("overwrite").parquet(f"{folder}/interaction_summary")


def read_fit(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(embeddings, assignments, prototypes) of a written fit."""
    niche = spark.read.parquet(f"{folder}/niche")
    return niche.select("cell_id", "h"), niche.select("cell_id", "prototype_id"), spark.read.parquet(f"{folder}/prototypes")


def write_kinds(prototypes: DataFrame, path: str) -> None:
    kinds = [r["proto_kind"] for r in prototypes.orderBy("prototype_id").select("proto_kind").collect()]  # one a prototype
    Path(path).write_text(json.dumps(kinds) + "\n", encoding="utf-8")
