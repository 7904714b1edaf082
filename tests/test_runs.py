import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import communication, features
from tessera.plans import runs
from tessera.sources import synthetic, tables
from tessera.streaming.abundance import windowed_abundance


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cohort")
    made = synthetic.generate(spark, n_sections=2, cells_per_section=60, n_genes=12, n_conserved=3, n_specific=0, noise=0.05, n_markers=3)
    cells = made.cells.withColumnRenamed("section_id", "fov").withColumn("cell_type", F.concat(F.lit("t"), (F.col("cell_id") % 3).cast("string"))).withColumn("arm", F.when(F.col("fov") == 0, "x").otherwise("y"))
    counts = made.expr.select("cell_id", F.concat(F.lit("g"), F.lpad(F.col("gene_id").cast("string"), 2, "0")).alias("gene"), F.greatest(F.rint(F.col("value") * 20), F.lit(0.0)).alias("value"))
    cells.write.parquet(str(folder / "cells.parquet"))
    counts.where("value > 0").write.parquet(str(folder / "expr.parquet"))
    return folder


def test_loader_controls_and_normalises(spark, saved):
    loaded = tables.load_dataset(spark, str(saved / "cells.parquet"), str(saved / "expr.parquet"), section_col="fov", min_genes=1)
    assert loaded.n_genes == 12 and loaded.qc.n_kept == 120 and loaded.expr.agg(F.max("value")).first()[0] < 10
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.h5ad")


def test_fit_and_stability_commands(spark, saved, tmp_path):
    common = [str(saved / "cells.parquet"), str(saved / "expr.parquet"), "--results-dir", str(tmp_path), "--section-col", "fov", "--min-genes", "1", "--n-prototypes", "3"]
    assert runs.main(["fit", *common, "--epochs", "2", "--sample-col", "fov", "--outcome-col", "arm"]) == 0
    metrics = json.loads((tmp_path / "model" / "metrics.json").read_text())
    assert metrics["n_obs"] == 120 and metrics["metrics"]["n_prototypes"] >= 2
    h, assigned, kinds = tables.read_fit(spark, str(tmp_path / "model" / "outputs"))
    assert h.count() == assigned.count() == 120 and kinds.count() >= 2
    assert runs.main(["leaderboard", str(tmp_path / "model" / "metrics.json"), "--out", str(tmp_path / "out"), "--stub", str(tmp_path / "stub.json")]) == 0
    stub = json.loads((tmp_path / "stub.json").read_text())
    assert stub["data_ready"] and not stub["paper_claim_ready"] and set(stub["artifacts"]) == {"leaderboard_csv", "leaderboard_md", "leaderboard_json"}
    assert runs.main(["scalability", str(tmp_path / "model" / "run_metadata.json"), "--out", str(tmp_path / "out")]) == 0
    cells = spark.read.parquet(str(saved / "cells.parquet")).withColumnRenamed("fov", "section_id")
    expr = features.category_codes(spark.read.parquet(str(saved / "expr.parquet")), "gene", "gene_id").withColumn("gene_id", F.col("gene_id").cast("int"))
    tables_ = runs.further_metrics(h, assigned, cells, expr, runs.build_graph(cells, 4), n_perm=5)
    assert all(t.count() for t in tables_.values())


@pytest.mark.parametrize("name", ["pca", "composition", "diffusion"])
def test_baselines(spark, saved, name):
    cells = spark.read.parquet(str(saved / "cells.parquet")).withColumnRenamed("fov", "section_id")
    expr = features.category_codes(spark.read.parquet(str(saved / "expr.parquet")), "gene", "gene_id").withColumn("gene_id", F.col("gene_id").cast("int"))
    h = runs.baseline_embedding(name, cells, expr, 12, n_components=3, n_steps=2, k=4)
    assert h.count() == 120 and h.columns == ["cell_id", "h"]
    if name == "composition":
        with pytest.raises(ValueError):
            runs.baseline_embedding(name, cells, expr, 12, k=4, n_types=2)


def test_stability_refits_the_model_for_each_seed(spark, saved, tmp_path, monkeypatch):
    fits, fit = [], runs.model.fit
    monkeypatch.setattr(runs.model, "fit", lambda *a, **b: fits.append((a[2].encoder, got := fit(*a, **b))) or got)
    common = [str(saved / "cells.parquet"), str(saved / "expr.parquet"), "--results-dir", str(tmp_path), "--section-col", "fov", "--min-genes", "1", "--n-prototypes", "3"]
    assert runs.main(["stability", *common, "--n-seeds", "2"]) == 0
    assert [(e.seed, e.epochs, e.d) for e, _ in fits] == [(0, 30, 32), (1, 30, 32)]
    a, b = ({r["cell_id"]: r["prototype_id"] for r in got.assignments.collect()} for _, got in fits)
    first, second = (sorted((r["cell_id"], *r["h"]) for r in got.embeddings.collect()) for _, got in fits)
    written = json.loads((tmp_path / "niche_stability.json").read_text())
    assert first != second and written["seed_stability"]["n_pairs"] == 1
    matrix = written["ari_matrix"]
    assert len(matrix) == 2 and matrix[0][0] == matrix[1][1] == pytest.approx(1.0) and matrix[0][1] == matrix[1][0] == pytest.approx(written["seed_stability"]["mean_ari"])
    pairs = written["prototype_matching_seed0_seed1"]
    assert len(pairs) == 3 and all(r["overlap"] == sum(a[c] == r["proto_a"] and b[c] == r["proto_b"] for c in a) for r in pairs)
    assert written["seed_stability"]["mean_ari"] == pytest.approx(1.0) or sum(r["overlap"] for r in pairs) < len(a)


def test_further_sweep_and_ligrec_commands(spark, saved, tmp_path):
    common = [str(saved / "cells.parquet"), str(saved / "expr.parquet"), "--section-col", "fov", "--min-genes", "1"]
    pairs = tmp_path / "pairs.csv"
    pairs.write_text("ligand,receptor\ng00,g01\ng02,g03\n")
    assert runs.main(["fit", *common, "--results-dir", str(tmp_path), "--n-prototypes", "3", "--epochs", "2", "--sample-col", "fov", "--outcome-col", "arm", "--outcome-kind", "binary", "--supervised-metrics", "cell_type", "--interaction-summary", str(pairs)]) == 0
    outputs = tmp_path / "model" / "outputs"
    told = json.loads((outputs / "supervised_metrics.json").read_text())
    assert told["secondary"] and {r["source"] for r in told["rows"]} == {"model", "kmeans"} and spark.read.parquet(str(outputs / "interactions")).columns[-1] == "pvalue"
    assert runs.main(["further", *common, "--results-dir", str(tmp_path / "more"), "--fit", str(outputs), "--max-k", "6", "--starts", "1", "--permutations", "5"]) == 0
    more = tmp_path / "more"
    assert all(spark.read.parquet(str(more / n)).count() for n in ("composition", "colocation", "markers"))
    assert [r["k"] for r in json.loads((more / "k_sweep.json").read_text())] == [5, 6] and len(json.loads((more / "per_niche_morans_i.json").read_text())) >= 2
    assert json.loads((more / "further_metrics.json").read_text())["pca_silhouette"] is not None
    assert runs.main(["layout", "--fit", str(outputs), "--neighbours", "5", "--out", str(more)]) == 0
    assert spark.read.parquet(str(more / "layout")).where("px is not null and prototype_id is not null").count() == 120
    kept = json.loads((more / "layout.json").read_text())
    assert kept["preserved_by_layout"] > 0 and kept["preserved_by_components"] > 0
    assert runs.main(["sweep", *common, "--results-dir", str(tmp_path / "sweep"), "--epochs", "1", "--d", "2", "3", "--tau", "0.2", "--n-prototypes", "2"]) == 0
    summary = json.loads((tmp_path / "sweep" / "sweep_summary.json").read_text())
    assert [r["knobs"]["d"] for r in summary] == [2, 3] and all(r["status"] == "ok" and json.loads((tmp_path / "sweep" / r["run_id"] / "run.json").read_text()) == r for r in summary)
    assert runs.main(["ligrec", *common, "--results-dir", str(tmp_path), "--pair", "g00,g01", "--permutations", "3"]) == 0
    assert spark.read.parquet(str(tmp_path / "ligrec")).count() > 0


def test_interaction_keys(spark):
    assert communication.key_table(spark, [("a", "b"), ("a", "b"), ["c", "d"]]).count() == 2
    for bad in (["ab"], [("a",)], [("a", "b"), ("a", "b", "c")]):
        with pytest.raises(ValueError):
            communication.key_table(spark, bad)
    with pytest.raises(ValueError):
        communication.check_keys(spark.createDataFrame([("a", None)], "ligand string, receptor string"))


def test_csv_tables_take_their_kinds_from_the_contract(spark, tmp_path):
    (tmp_path / "cells.csv").write_text("cell_id,x,y,section\n1,0.5,2,007\n")
    rows = tables.read_table(spark, str(tmp_path / "cells.csv"))
    assert [f.dataType.simpleString() for f in rows.schema] == ["bigint", "double", "double", "string"] and rows.first()["section"] == "007"


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1), (0, 1), (1, 2)], "sample_id long, prototype_id long").withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_abundance(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("update").format("memory").queryName("abundance").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["sample_id"], r["prototype_id"], r["n"]) for r in spark.table("abundance").collect()} == {(0, 1, 2), (1, 2, 1)}
