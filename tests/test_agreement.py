import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.assignment import assign
from tessera.functions.special import log_gamma
from tessera.operators import agreement, prototypes, spatial


def frame(spark, pred, true):
    return spark.createDataFrame(list(zip(pred, true, strict=True)), "pred long, true_label long")


def counts(pred, true):
    table = np.zeros((max(pred) + 1, max(true) + 1), np.int64)
    np.add.at(table, (pred, true), 1)
    return table


def test_ami_golden():
    got = agreement.adjusted_mutual_information_value(counts([0, 0, 0, 1, 1, 1, 2, 2], [0, 0, 1, 1, 1, 2, 2, 2]))
    assert got == pytest.approx(0.31967265056964705, abs=1e-9)


def test_macro_f1_goldens():
    assert agreement.macro_f1_value(counts([0, 0, 0, 1], [0, 0, 1, 1])) == pytest.approx(11 / 15)
    assert agreement.macro_f1_value(counts([0, 0, 0, 0], [0, 0, 1, 1])) == pytest.approx(1 / 3)


def test_perfect_and_degenerate_partitions(spark):
    row = agreement.agreement(frame(spark, [2, 2, 0, 0, 1, 1], [0, 0, 1, 1, 2, 2])).first()
    assert [row[c] for c in ("ari", "nmi", "homogeneity", "completeness", "v_measure")] == pytest.approx([1.0] * 5)
    row = agreement.agreement(frame(spark, [0] * 4, [0, 1, 2, 3])).first()
    assert row["nmi"] == 0.0 and row["completeness"] == 1.0 and row["homogeneity"] == 0.0
    row = agreement.agreement(frame(spark, [0, 0], [1, 1])).first()
    assert row["v_measure"] == 1.0 and row["nmi"] == 0.0 and math.isnan(row["ari"])
    row = agreement.agreement(frame(spark, [], [])).first()
    assert math.isnan(row["ari"]) and row["homogeneity"] == 1.0 and row["n"] == 0


def test_log_gamma():
    x = np.array([1, 2, 3.5, 11.9, 12, 100, 1e6])
    assert log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-13)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.data())
def test_assignment_is_optimal(rows, columns, data):
    m = np.array([[data.draw(st.integers(0, 9)) for _ in range(columns)] for _ in range(rows)])
    got = assign(m)
    assert len(got) == min(rows, columns) and len({c for _, c in got}) == len(got) and len({r for r, _ in got}) == len(got)
    wide = m if rows <= columns else m.T
    best = max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
    assert sum(m[r, c] for r, c in got) == best


def test_matching_and_kinds(spark):
    both = frame(spark, [1, 1, 0, 0], [0, 0, 1, 1])
    assert {tuple(r) for r in agreement.matching(both, "pred", "true_label").collect()} == {(1, 0, 2), (0, 1, 2)}
    both = frame(spark, [2, 2, 0, 0, 1, 1], [0, 0, 1, 1, 2, 2])
    kinds = lambda names: spark.createDataFrame(list(enumerate(names)), "prototype_id long, proto_kind string")
    assert agreement.proto_kind_accuracy(both, kinds("SCC"), kinds("CSC")) == 1.0
    assert agreement.proto_kind_accuracy(both, kinds("SCS"), kinds("CSC")) == pytest.approx(2 / 3)


def test_seed_stability(spark):
    pairs = spark.createDataFrame([(0, 1, 0.8), (0, 2, 0.6), (1, 2, 0.4), (1, 0, 0.8)], "a int, b int, ari double")
    row = agreement.seed_stability(pairs).first()
    assert row["mean_ari"] == pytest.approx(0.6) and row["min_ari"] == 0.4 and row["sd_ari"] == pytest.approx(np.std([0.8, 0.6, 0.4]))


def test_neighbour_agreement_and_moran(spark):
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "cell_id long, prototype_id long")
    edges = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    assert spatial.neighbour_agreement(labels, edges([(0, 1), (2, 3)])).first()[0] == 1.0
    assert spatial.neighbour_agreement(labels, edges([(0, 2), (1, 3)])).first()[0] == 0.0
    assert math.isnan(spatial.neighbour_agreement(labels, edges([])).first()[0])
    assert spatial.morans_i(labels, edges([(0, 1), (1, 0), (2, 3), (3, 2)]), "prototype_id").first()[0] > 0
    assert spatial.morans_i(labels, edges([]), "prototype_id").first()[0] == 0.0
    assert {r["prototype_id"]: r["morans_i"] for r in spatial.per_prototype_morans_i(labels, edges([(0, 1), (2, 3)])).collect()} == {0: 1.0, 1: 1.0}


def test_separation_and_sweep(spark):
    rows = lambda p, s: spark.createDataFrame(list(zip(p, s, strict=True)), "prototype_id long, section_id long")
    kinds = lambda df: [r["proto_kind"] for r in df.orderBy("prototype_id").collect()]
    assert kinds(prototypes.separation(rows([0, 0, 0, 1, 1], [0, 1, 2, 0, 1]))) == ["conserved", "sample_specific"]
    assert kinds(prototypes.separation(rows([0, 0, 0, 1, 1], [0, 1, 2, 0, 1]), 0.6))[1] == "conserved"
    assert kinds(prototypes.separation(rows([0, 2], [0, 0]))) == ["unknown"] * 3
    with pytest.raises(ValueError):
        prototypes.separation(rows([0], [0]), 0)
    sweep = {r["coverage"]: r["conserved_fraction"] for r in prototypes.coverage_sweep(rows([0] * 4 + [1] * 5, [*range(4), *range(5)]), (1.0, 0.8)).collect()}
    assert sweep == {1.0: 0.5, 0.8: 1.0}
