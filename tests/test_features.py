import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import frames
from tessera.operators import annotate, communication, features, outcome, prototypes
from tessera.schema import SchemaError, validate_inputs, validate_outputs


def test_qc_mask(spark):
    cells = spark.createDataFrame([(i,) for i in range(4)], "cell_id long")
    expr = spark.createDataFrame([(1, g, 5.0) for g in range(3)] + [(3, g, 2.0) for g in range(5)], "cell_id long, gene int, value double")
    assert [r["keep"] for r in features.qc_mask(cells, expr, 10, 5).orderBy("cell_id").collect()] == [False, False, False, True]
    with pytest.raises(RuntimeError), pytest.warns(UserWarning):
        features.apply_qc(cells, expr, 10, 5)


def test_unlabelled(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(["6.0", "nan", "29.0", "", "NaN", "96.0", None])], "i int, v string")
    assert [r[0] for r in rows.orderBy("i").select(features.unlabelled(F.col("v"))).collect()] == [False, True, False, True, True, False, True]


def test_abundance_and_clr(spark):
    cells = spark.createDataFrame(list(zip([0, 0, 0, 1, 1], [0, 1, 1, 0, 0], strict=True)), "sample_id long, prototype_id long")
    got = {(r[0], r[1]): r[2] for r in prototypes.abundance(cells).collect()}
    assert got == pytest.approx({(0, 0): 1 / 3, (0, 1): 2 / 3, (1, 0): 1.0, (1, 1): 0.0})
    with pytest.raises(ValueError):
        prototypes.abundance(cells, 1)
    even = spark.createDataFrame([(0, p, 0.25) for p in range(4)], "sample_id long, prototype_id long, fraction double")
    assert all(abs(r["clr"]) < 1e-12 for r in prototypes.clr(even).collect())


@pytest.mark.parametrize(("p", "q"), [([0.001, 0.5], [0.002, 0.5]), ([0.01, 0.02, 0.03, 0.04, 0.05], [0.05] * 5)])
def test_benjamini_hochberg(spark, p, q):
    rows = spark.createDataFrame(list(enumerate(p)), "id long, p double")
    assert [r["q"] for r in outcome.benjamini_hochberg(rows).orderBy("id").collect()] == pytest.approx(q)


def test_planted_cohort(spark):
    random = np.random.default_rng(0)
    rows, labels = [], []
    for s in range(12):
        base = np.array([0.45, 0.05, 0.2, 0.15, 0.15]) if s < 6 else np.array([0.05, 0.45, 0.2, 0.15, 0.15])
        noisy = base * random.uniform(0.9, 1.1, 5)
        rows += [(s, p, float(v)) for p, v in enumerate(noisy / noisy.sum())]
        labels.append((s, "a" if s < 6 else "b"))
    got = outcome.outcome_association(spark.createDataFrame(rows, "sample_id long, prototype_id long, fraction double"), spark.createDataFrame(labels, "sample_id long, outcome string"), label_kind="binary")
    q = {r["prototype_id"]: r["q"] for r in got.records.collect()}
    assert q[0] < 0.05 and q[1] < 0.05
    from tessera.functions.special import mann_whitney_two_sided, student_two_sided

    assert mann_whitney_two_sided(9, 3, 3, 0) == pytest.approx(0.1) and mann_whitney_two_sided(4.5, 3, 3, 0) == 1.0
    assert student_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)


def test_markers(spark):
    x = [[0, 3, 1, 0], [0, 2, 1, 0], [0, 0, 5, 1]]
    expr = spark.createDataFrame([(i, g, float(v)) for i, row in enumerate(x) for g, v in enumerate(row) if v], "cell_id long, gene int, value double")
    protos = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "cell_id long, prototype_id long")
    first = {r["prototype_id"]: r["gene"] for r in prototypes.marker_table(expr, protos, 2).where("rank = 1").collect()}
    assert first == {0: 1, 1: 2}


def test_interactions(spark):
    wide = spark.createDataFrame([("TGFB1", "TGFBR1", 0.5, float("nan"), 0.2), ("A", "B", 0.9, 0.1, float("nan"))], ["ligand", "receptor", "A|B", "B|A", "A|A"])
    means = communication.melt(wide, "score")
    p = means.select(*communication.KEYS, F.lit(0.01).alias("pvalue"))
    got = {tuple(r)[:4]: r["score"] for r in communication.tidy(means, p).collect()}
    assert len(got) == 4 and got["TGFB1", "TGFBR1", "A", "B"] == 0.5
    key = "ligand int, receptor int, source int, target int"
    truth = spark.createDataFrame([(0, 1, 2, 3), (4, 5, 6, 7)], key)
    pred = spark.createDataFrame([(1, 0, 1, 2, 3), (2, 9, 9, 9, 9), (3, 4, 5, 6, 7)], "rank int, " + key)
    row = communication.top_k_score(pred, truth, 2).first()
    assert (row["precision"], row["recall"], row["n_recovered"]) == (0.5, 0.5, 1)
    assert math.isnan(communication.top_k_score(pred, truth.limit(0), 2).first()["precision"])
    with pytest.raises(ValueError):
        communication.top_k_score(pred, truth, True)


def test_annotation_recovers_planted_types(spark):
    random = np.random.default_rng(4)
    label = np.repeat(np.arange(3), 40)
    x = random.random((120, 6))
    for t in range(3):
        x[label == t, 2 * t : 2 * t + 2] += 5
    expr = spark.createDataFrame([(i, f"g{g}", float(x[i, g])) for i in range(120) for g in range(6)], "cell_id long, gene string, value double")
    cells = expr.select("cell_id").distinct()
    panel = {f"t{t}": [f"g{2 * t}", f"g{2 * t + 1}", "missing"] for t in range(3)}
    got = annotate.marker_annotation(expr, cells, panel)
    assert all(r["code"] == label[r["cell_id"]] for r in got.rows.collect()) and got.missing["t0"] == ["missing"]
    with pytest.raises(ValueError):
        annotate.marker_annotation(expr, cells, {})


def test_validators(spark):
    cells = spark.createDataFrame([(i, 0, float(i), 0.0) for i in range(6)], "cell_id long, section_id long, x double, y double")
    edges = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    validate_inputs(cells, edges([(0, 3), (1, 4), (2, 5)]))
    with pytest.raises(SchemaError):
        validate_inputs(cells, edges([(0, 9)]))
    with pytest.raises(SchemaError):
        validate_inputs(cells.withColumn("section_id", F.col("cell_id")), edges([(0, 3)]))
    with pytest.raises(SchemaError):
        validate_inputs(cells.unionByName(cells))
    protos = spark.createDataFrame([(0, 0)], "cell_id long, prototype_id long")
    with pytest.raises(SchemaError):
        validate_outputs(protos, spark.createDataFrame([(0, "odd")], "prototype_id long, proto_kind string"))


def test_sections(spark):
    cells = spark.createDataFrame([(i, f"s{i % 3}", float(i % 10), float(i)) for i in range(30)], "cell_id long, fov string, x double, y double")
    got, name, _ = features.resolve_sections(cells, "fov")
    assert name == "fov" and {r[0] for r in got.select("section_id").distinct().collect()} == {0, 1, 2}
    with pytest.raises(KeyError):
        features.resolve_sections(cells, "slice")
    assert features.resolve_sections(cells, "none")[1] is None


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, None, 5.0, 5.0, 1.0], [float("nan"), 1.0, -1e308, 1e308, 5e-324, 0.0], [], [None], [2.0] * 50 + [1.0] * 49, list(range(1000)), [10.0**k for k in range(-300, 300, 7)]])
def test_exact_median_and_places(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(3)
    known = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    want = spark.createDataFrame(df.collect(), "v double").agg({"v": "median"}).first()[0]
    got = frames.exact_median(df)
    assert (got is None) == (want is None) and (got is None or got == pytest.approx(want, rel=1e-15))
    places = list(range(0, len(known), max(1, len(known) // 5)))
    assert all(a == b or (a != a and b != b) for a, b in zip(frames.order_statistics(df, places), [float(known[p]) for p in places], strict=True))


def test_plans_without_single_tasks(spark):
    """No percentile, and no window over all rows, behind normalisation and category codes."""
    expr = spark.createDataFrame([(i, f"g{j}", float(i % 7 + j)) for i in range(50) for j in range(3)], "cell_id long, gene string, value double")
    plan = lambda df: df._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan(features.normalise_log1p(expr)) and "median(" not in plan(features.normalise_log1p(expr))
    assert "row_number" not in plan(features.category_codes(expr, "gene"))


def test_rank_sums_of_millions_of_cells(spark):
    """The spread multiplies three counts, which is past a long here."""
    n = 4_200_000
    cells = spark.range(n).select(F.col("id").alias("cell_id"), (F.col("id") % 2).alias("prototype_id"))
    expr = spark.createDataFrame([(i, "g", 1.0) for i in range(0, 20, 2)], "cell_id long, gene string, value double")
    got = {r["prototype_id"]: r for r in annotate.rank_sum_scores(expr, cells).collect()}
    spread = math.sqrt(n * n / 4 * (n + 1.0) / 12)
    assert got[0]["rank_sum"] + got[1]["rank_sum"] == n * (n + 1) / 2
    assert got[0]["z"] == pytest.approx(10 * n / 4 / spread) and got[1]["z"] == pytest.approx(-10 * n / 4 / spread)
