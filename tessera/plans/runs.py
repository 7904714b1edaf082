"""Whole runs, and their command line: fit, baselines, further metrics, stability, sweep, synthetic, reports.

``python -m tessera.plans.runs COMMAND --help``
"""

from __future__ import annotations

import argparse
import itertools
import time
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.frames import cut
from tessera.operators import agreement, annotate, cluster, communication, features, layout, model, outcome, prototypes, spatial
from tessera.operators.encoder import EncoderConfig
from tessera.operators.graph import build_graph
from tessera.plans import report
from tessera.sources import registry, synthetic, tables

GRAPH_K = 6
BASELINES = ("neighborhood", "pca", "diffusion", "composition")


def baseline_embedding(name: str, cells: DataFrame, expr: DataFrame, n_genes: int, *, k: int = 8, alpha: float = 0.5, n_steps: int = 3, n_components: int = 32, n_types: int | None = None) -> DataFrame:
    """(cell_id, h): one of BASELINES; ``composition`` needs a cell_type column, of at most ``n_types`` types if given."""
    if name == "pca":
        return cluster.pca(features.wide(expr, n_genes), n_components).withColumnRenamed("features", "h")
    if name == "composition":
        if n_types is not None:
            features.check_composition(cells, "cell_type", n_types)
        shares = features.composition_embedding(cells, cut(build_graph(cells, k)))
        coded = features.category_codes(shares, "cell_type", "gene_id").select("cell_id", F.col("gene_id").cast("int").alias("gene_id"), F.col("share").alias("value"))
        return features.wide(coded, coded.agg(F.max("gene_id")).first()[0] + 1).withColumnRenamed("features", "h")
    if name == "neighborhood":
        mixed = features.neighbourhood_embedding(expr, cells, k=k, alpha=alpha)
    elif name == "diffusion":
        mixed = features.diffusion_embedding(expr, cut(build_graph(cells, k)), cells, alpha=alpha, n_steps=n_steps)
    else:
        raise ValueError(f"no baseline {name!r}; there are {BASELINES}")
    return features.wide(mixed, n_genes).withColumnRenamed("features", "h")


def run_baseline(name: str, cells: DataFrame, expr: DataFrame, n_genes: int, *, n_prototypes: int = 10, seed: int = 0, **options) -> tuple[DataFrame, DataFrame, dict]:
    """(embeddings, assignments, metrics); the metrics' graph has GRAPH_K neighbours whatever the baseline's."""
    h = cut(baseline_embedding(name, cells, expr, n_genes, **options))
    labels = cut(cluster.spherical_kmeans(h, n_prototypes, seed=seed, column="h"))
    edges = cut(build_graph(cells, GRAPH_K))
    return h, labels, model.intrinsic_metrics(h, labels, edges, seed=seed)


def fit_run(loaded: tables.Loaded, *, n_prototypes: int = 10, d: int = 32, num_layers: int = 2, tau: float = 0.2, seed: int = 0, batch_size: int = 0, epochs: int = 30, max_seconds: float = 1800) -> tuple[model.NicheModelResult, DataFrame, dict]:
    """(result, edges, metrics) of a fit on a GRAPH_K graph; an error after the fact if it took too long."""
    edges = cut(build_graph(loaded.cells, GRAPH_K))
    size = features.effective_batch_size(batch_size, loaded.cells.count())
    config = model.NicheModelConfig(k=GRAPH_K, n_prototypes=n_prototypes, encoder=EncoderConfig(d=d, num_layers=num_layers, tau=tau, seed=seed, batch_size=size, epochs=epochs))
    began = time.time()
    result = model.fit(loaded.cells, loaded.expr, config, n_genes=loaded.n_genes, edges=edges)
    took = time.time() - began
    if took > max_seconds:
        raise TimeoutError(f"the fit took {took:.0f} s; {max_seconds:.0f} were allowed")
    metrics = model.intrinsic_metrics(result.embeddings, result.assignments, edges, result.prototypes, seed)
    return result, edges, metrics | {"runtime_s": took, "batch_size": size}


def further_metrics(h: DataFrame, assigned: DataFrame, cells: DataFrame, expr: DataFrame, edges: DataFrame, *, column: str = "cell_type", n_perm: int = 100, seed: int = 0) -> dict[str, DataFrame]:
    """Tables of composition, its summary, Moran's I by prototype, co-location and markers of a written fit."""
    typed = assigned.join(cells.select("cell_id", column), "cell_id")
    mix = prototypes.composition(typed, column)
    near = spatial.colocation_enrichment(cells, edges, n_perm, seed, column)
    return {
        "composition": mix, "composition_summary": prototypes.composition_summary(mix, column), "morans_i": spatial.per_prototype_morans_i(assigned, edges),
        "colocation": near, "colocation_summary": spatial.colocation_summary(near), "markers": annotate.de_markers(expr, assigned, gene="gene_id"),
    }


def pca_baseline_silhouette(expr: DataFrame, n_genes: int, assigned: DataFrame, n_components: int = 32) -> float | None:
    return cluster.silhouette(cluster.pca(features.wide(expr, n_genes), n_components), assigned).first()[0]


def stability(cells: DataFrame, expr: DataFrame, edges: DataFrame, *, n_genes: int, config: model.NicheModelConfig | None = None, n_seeds: int = 5, thresholds: tuple[float, ...] = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """(seed stability, coverage sweep, matching, pairs): the whole model, encoder included, is fitted anew for each seed.

    Seeds count up from the config's; their encoders train in the same jobs. The sweep is of the first fit, the matching (proto_a, proto_b,
    overlap) of the first two; None with one. Pairs (a, b, ari) are all ordered pairs of fits, each with itself too.
    """
    config = config or model.NicheModelConfig(k=GRAPH_K)
    encoders = [replace(config.encoder, seed=config.encoder.seed + s) for s in range(n_seeds)]
    trained = model.embeddings(cells, expr, edges, config.encoder, n_genes, [e.seed for e in encoders])
    h = [trained.where(F.col("seed") == e.seed).select("cell_id", "h") for e in encoders]
    runs = [model.fit(cells, expr, replace(config, encoder=e), n_genes=n_genes, edges=edges, embedded=x).assignments for e, x in zip(encoders, h, strict=True)]
    every = None
    for s, run in enumerate(runs):
        rows = run.select("cell_id", F.lit(s).alias("labeling"), F.col("prototype_id").alias("label"))
        every = rows if every is None else every.unionByName(rows)
    matched = None
    if n_seeds > 1:
        a, b = (run.select("cell_id", F.col("prototype_id").alias(name)) for run, name in zip(runs[:2], "ab", strict=True))
        matched = agreement.matching(a.join(b, "cell_id"), "a", "b")
    pairs = cut(agreement.pairwise_ari(every))
    return agreement.seed_stability(pairs), prototypes.coverage_sweep(runs[0].join(cells.select("cell_id", "section_id"), "cell_id"), thresholds), matched, pairs


def stability_run(loaded: tables.Loaded, *, n_seeds: int = 5, n_prototypes: int = 10, seed: int = 0, epochs: int = 30) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """``stability`` of fits like those of ``fit_run``."""
    edges = cut(build_graph(loaded.cells, GRAPH_K))
    encoder = EncoderConfig(seed=seed, batch_size=features.effective_batch_size(0, loaded.cells.count()), epochs=epochs)
    return stability(loaded.cells, loaded.expr, edges, n_genes=loaded.n_genes, config=model.NicheModelConfig(k=GRAPH_K, n_prototypes=n_prototypes, encoder=encoder), n_seeds=n_seeds)


#: The knobs of a sweep.
SWEPT = {"d": int, "num_layers": int, "tau": float, "epochs": int, "batch_size": int, "n_prototypes": int}


def expand_grid(**axes) -> list[dict]:
    """All combinations, the last axis fastest; axes without values are left out."""
    axes = {k: v for k, v in axes.items() if v}
    return [dict(zip(axes, values, strict=True)) for values in itertools.product(*axes.values())]


def run_id(knobs: dict, number: int = 0) -> str:
    return f"{number:03d}_" + ("_".join(f"{k}-{v}" for k, v in sorted(knobs.items())) or "default")


def sweep(loaded: tables.Loaded, grid: list[dict], folder: str, seed: int = 0) -> list[dict]:
    """A fit, its files and run.json for each setting of SWEPT, and sweep_summary.json; a setting that fails is noted and the sweep goes on."""
    rows = []
    for number, knobs in enumerate(grid):
        name, began = run_id(knobs, number), time.time()
        row: dict = {"run_id": name, "knobs": knobs, "seed": seed}
        try:
            result, _, metrics = fit_run(loaded, seed=seed, **knobs)
            tables.write_fit(result, f"{folder}/{name}")
            row |= {"status": "ok", "metrics": report.coerce_metrics(metrics)}
        except (ValueError, TimeoutError) as error:
            row |= {"status": "failed", "error": str(error)}
        row |= {"seconds": round(time.time() - began, 3), "git_sha": report.git_sha()}
        report.write_json(Path(folder, name, "run.json"), row)
        rows.append(row)
    report.write_json(Path(folder, "sweep_summary.json"), rows)
    return rows


def further_run(spark: SparkSession, fit: str, loaded: tables.Loaded, folder: str, *, column: str = "cell_type", ks=range(5, 21), starts: int = 10, n_perm: int = 200, seed: int = 0) -> dict[str, float | None]:
    """Metrics of a written fit, and the five artifacts beside them: composition, co-location, markers, Moran's I and the sweep over k."""
    h, assigned, _ = tables.read_fit(spark, fit)
    edges = cut(build_graph(loaded.cells, GRAPH_K))
    found = further_metrics(h, assigned, loaded.cells, loaded.expr, edges, column=column, n_perm=n_perm, seed=seed)
    for name in ("composition", "colocation", "markers"):
        found[name].write.mode("overwrite").parquet(f"{folder}/{name}")
    moran = {str(r["prototype_id"]): r["morans_i"] for r in found["morans_i"].orderBy("prototype_id").collect()}
    report.write_json(Path(folder, "per_niche_morans_i.json"), report.coerce_metrics(moran))
    steps = [r.asDict() for r in cluster.k_stability(h, ks, seed, starts, "h").orderBy("k").collect()]
    report.write_json(Path(folder, "k_sweep.json"), [{"k": r["k"], "best": r["best"], **report.coerce_metrics({c: r[c] for c in ("silhouette", "calinski_harabasz")})} for r in steps])
    values = {**found["composition_summary"].first().asDict(), **found["colocation_summary"].first().asDict()}
    values |= {"morans_i_mean": sum(moran.values()) / len(moran) if moran else None, "morans_i_min": min(moran.values(), default=None), "morans_i_max": max(moran.values(), default=None)}
    values |= {"pca_silhouette": pca_baseline_silhouette(loaded.expr, loaded.n_genes, assigned), "best_k": next((r["k"] for r in steps if r["best"]), None)}
    report.write_json(Path(folder, "further_metrics.json"), report.coerce_metrics(values))
    return values


def layout_run(spark: SparkSession, fit: str, folder: str, k: int = 15, seed: int = 0) -> dict[str, float]:
    """What a plot of a written fit shows: (cell_id, px, py, prototype_id) as Parquet, and how many neighbours it and the two leading components keep."""
    h, assigned, _ = tables.read_fit(spark, fit)
    near = cut(layout.embedding_neighbours(h, k, seed=seed, column="h"))
    layout.planar_layout(h, k, seed=seed, column="h", neighbours=near).join(assigned, "cell_id").write.mode("overwrite").parquet(f"{folder}/layout")
    placed = {"layout": spark.read.parquet(f"{folder}/layout"), "components": cluster.projection(h, "h")}
    found = {f"preserved_by_{name}": layout.preservation(near, points).first()["preserved"] for name, points in placed.items()}
    report.write_json(Path(folder, "layout.json"), report.coerce_metrics(found))
    return found


def supervised_run(result: model.NicheModelResult, cells: DataFrame, columns: list[str], folder: str, seeds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Scores against reference columns of the cells, beside k-means at the same number of classes; a secondary result."""
    table = cut(model.supervised_table(result.embeddings, result.assignments, cells, columns, list(seeds), column="h"))
    rows = [{k: v for k, v in r.asDict().items()} for r in table.orderBy("reference", "source", "seed").collect()]
    report.write_json(Path(folder, "supervised_metrics.json"), {"secondary": True, "note": "labels took no part in the fit", "rows": rows})
    return table


def ligrec_run(spark: SparkSession, expr: DataFrame, cells: DataFrame, column: str, pairs: DataFrame, out: str, n_perms: int = 100) -> DataFrame:
    """Interaction scores and p-values of the groups of a cell column, written as Parquet."""
    communication.check_keys(pairs)
    expr = expr if "gene" in expr.columns else expr.withColumn("gene", F.col("gene_id").cast("string"))
    clusters = cells.where(F.col(column).isNotNull()).select("cell_id", F.col(column).cast("string").alias("cluster"))
    communication.interaction_summary(expr, cut(clusters), pairs, n_perms).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def synthetic_metrics(spark: SparkSession, seed: int = 0, epochs: int = 10, **options) -> dict[str, float]:
    """Fit a generated instance and score it against what was planted."""
    made = synthetic.generate(spark, seed=seed, **options)
    niches = made.kinds.count()
    config = model.NicheModelConfig(n_prototypes=niches, encoder=EncoderConfig(seed=seed, epochs=epochs))
    result = model.fit(made.cells, made.expr, config, n_genes=made.n_genes, edges=cut(made.edges))
    return model.score_against_truth(result, made.truth, made.kinds, made.markers, made.cells, made.edges)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("fit", "baseline", "stability", "sweep", "further", "ligrec"):
        c = commands.add_parser(name)
        c.add_argument("cells")
        c.add_argument("expr")
        c.add_argument("--results-dir", default="results")
        c.add_argument("--already-normalized", action="store_true")
        c.add_argument("--section-col", default="auto")
        c.add_argument("--min-counts", type=float, default=10)
        c.add_argument("--min-genes", type=int, default=5)
        c.add_argument("--seed", type=int, default=0)
        if name == "sweep":
            for knob, kind in SWEPT.items():
                c.add_argument(f"--{knob.replace('_', '-')}", type=kind, nargs="+")
        elif name not in ("further", "ligrec"):
            c.add_argument("--n-prototypes", type=int, default=10)
        if name == "fit":
            c.add_argument("--batch-size", type=int, default=0)
            c.add_argument("--epochs", type=int, default=30)
            c.add_argument("--max-seconds", type=float, default=1800)
            c.add_argument("--outcome-col")
            c.add_argument("--sample-col")
            c.add_argument("--outcome-kind", choices=("auto", "binary", "continuous"), default="auto")
            c.add_argument("--supervised-metrics", nargs="+", metavar="COLUMN")
            c.add_argument("--interaction-summary", metavar="PAIRS", help="table of ligand and receptor genes")
        if name == "further":
            c.add_argument("--fit", required=True, help="folder of a written fit")
            c.add_argument("--cell-type-col", default="cell_type")
            c.add_argument("--max-k", type=int, default=20)
            c.add_argument("--starts", type=int, default=10)
            c.add_argument("--permutations", type=int, default=200)
        if name == "ligrec":
            c.add_argument("--cluster-col", default="cell_type")
            c.add_argument("--pairs", help="table of ligand and receptor genes")
            c.add_argument("--pair", action="append", default=[], metavar="LIGAND,RECEPTOR")
            c.add_argument("--permutations", type=int, default=100)
        if name == "baseline":
            c.add_argument("--baseline", choices=BASELINES, default="neighborhood")
            c.add_argument("--k", type=int, default=8)
            c.add_argument("--alpha", type=float, default=0.5)
            c.add_argument("--n-steps", type=int, default=3)
            c.add_argument("--n-components", type=int, default=32)
        if name == "stability":
            c.add_argument("--n-seeds", type=int, default=5)
    c = commands.add_parser("layout")
    c.add_argument("--fit", required=True)
    c.add_argument("--neighbours", type=int, default=15)
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--out", default="results")
    s = commands.add_parser("synthetic")
    s.add_argument("--seed", type=int, default=0)
    for name in ("leaderboard", "scalability"):
        c = commands.add_parser(name)
        c.add_argument("paths", nargs="*")
        c.add_argument("--out", default="results")
        if name == "leaderboard":
            c.add_argument("--stub", help="JSON file in which to note what was written")
    d = commands.add_parser("datasets")
    d.add_argument("--list", action="store_true")
    d.add_argument("--card")
    d.add_argument("--dataset")
    d.add_argument("--emit-cards")
    d.add_argument("--download", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "datasets":
        if args.card:
            print(registry.card_text(args.card), end="")
        elif args.dataset:
            print(registry.fetch(args.dataset, args.download))
        elif args.emit_cards:
            print("\n".join(registry.emit_cards(args.emit_cards)))
        else:
            print("\n".join(f"{x.id}\t{x.platform}\t{x.url_status}\t{x.size}" for x in registry.DATASETS.values()))
        return 0
    if args.command == "leaderboard":
        written = report.emit_leaderboard(args.paths, args.out)
        if args.stub:
            report.update_stub(args.stub, {f"leaderboard_{kind}": path for kind, path in written.items()})
        return 0
    if args.command == "scalability":
        report.emit_scalability(report.scalability_rows(args.paths), args.out)
        return 0
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if args.command == "synthetic":
        for k, v in synthetic_metrics(spark, args.seed).items():
            print(f"{k}: {v:.4f}")
        return 0
    if args.command == "layout":
        for k, v in layout_run(spark, args.fit, args.out, args.neighbours, args.seed).items():
            print(f"{k}: {v:.4f}")
        return 0
    loaded = tables.load_dataset(spark, args.cells, args.expr, already_normalized=args.already_normalized, section_col=args.section_col, min_counts=args.min_counts, min_genes=args.min_genes, qc=args.command != "baseline")
    card = features.dataset_card_id([args.cells])
    meta = {"n_obs": loaded.cells.count(), "n_vars": loaded.n_genes, "seed": args.seed, "dataset_paths": [args.cells, args.expr], "notes": "; ".join(loaded.notes)}
    if args.command == "baseline":
        h, labels, metrics = run_baseline(args.baseline, loaded.cells, loaded.expr, loaded.n_genes, n_prototypes=args.n_prototypes, seed=args.seed, k=args.k, alpha=args.alpha, n_steps=args.n_steps, n_components=args.n_components)
        h.join(labels, "cell_id").write.mode("overwrite").parquet(f"{args.results_dir}/{args.baseline}/outputs/niche")
        report.write_results(args.baseline, card, metrics, run_metadata=meta, results_dir=args.results_dir)
    elif args.command == "sweep":
        sweep(loaded, expand_grid(**{k: getattr(args, k) for k in SWEPT}), args.results_dir, args.seed)
    elif args.command == "further":
        further_run(spark, args.fit, loaded, args.results_dir, column=args.cell_type_col, ks=range(5, args.max_k + 1), starts=args.starts, n_perm=args.permutations, seed=args.seed)
    elif args.command == "ligrec":
        pairs = tables.read_table(spark, args.pairs) if args.pairs else communication.key_table(spark, [p.split(",") for p in args.pair])
        ligrec_run(spark, loaded.expr, loaded.cells, args.cluster_col, pairs, f"{args.results_dir}/ligrec", args.permutations)
    elif args.command == "stability":
        found, sweep_, matched, pairs = stability_run(loaded, n_seeds=args.n_seeds, n_prototypes=args.n_prototypes, seed=args.seed)
        matching = [] if matched is None else [r.asDict() for r in matched.orderBy("proto_a").collect()]
        report.emit_stability(found.first().asDict(), [r.asDict() for r in sweep_.orderBy(F.desc("coverage")).collect()], args.results_dir, matching, report.square(pairs.collect()))
    else:
        result, _, metrics = fit_run(loaded, n_prototypes=args.n_prototypes, seed=args.seed, epochs=args.epochs, batch_size=args.batch_size, max_seconds=args.max_seconds)
        took, batch = metrics.pop("runtime_s"), metrics.pop("batch_size")
        tables.write_fit(result, f"{args.results_dir}/model/outputs")
        report.write_results("model", card, metrics, run_metadata=meta | {"runtime_s": took, "batch_size": batch, "peak_rss_bytes": report.peak_rss_bytes()}, results_dir=args.results_dir)
        if args.outcome_col and args.sample_col:
            tagged = result.assignments.join(loaded.cells.select("cell_id", F.col(args.sample_col).alias("sample_id"), F.col(args.outcome_col).alias("outcome")), "cell_id")
            if (found := outcome.outcome_table(tagged, label_kind=None if args.outcome_kind == "auto" else args.outcome_kind)) is not None:
                found.records.write.mode("overwrite").json(f"{args.results_dir}/model/outputs/outcome")
        if args.supervised_metrics:
            supervised_run(result, loaded.cells, args.supervised_metrics, f"{args.results_dir}/model/outputs")
        if args.interaction_summary:
            groups = result.assignments.withColumn("niche", F.col("prototype_id").cast("string"))
            ligrec_run(spark, loaded.expr, groups, "niche", tables.read_table(spark, args.interaction_summary), f"{args.results_dir}/model/outputs/interactions")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
