from collections import Counter

import numpy as np
import pytest

from tessera.functions.frames import HALF_ROUNDS, numbered, shuffle_key, shuffled, shuffled_labels
from tessera.operators import communication, spatial


def keys(perm, seed=0):
    return [shuffle_key(perm, half, which, seed) for half in range(HALF_ROUNDS) for which in (0, 1)]


@pytest.mark.parametrize("seed", [None, 3])
def test_numbers_are_dense(spark, seed):
    rows, n = numbered(spark.range(57).withColumnRenamed("id", "cell_id"), "cell_id", seed)
    got = sorted((r["idx"], r["cell_id"]) for r in rows.collect())
    assert n == 57 and [i for i, _ in got] == list(range(57)) and (seed is not None or all(i == c for i, c in got))


def test_shuffles_are_permutations():
    for n in (1, 2, 3, 5, 57, 100, 101, 4096):
        assert all(sorted(shuffled(np.arange(n), n, keys(p))) == list(range(n)) for p in range(5))


def test_shuffles_are_uniform_and_independent():
    """Places, pairs of places, fixed points, cycles and agreement of two shuffles, as of random permutations."""
    n, many = 60, 4000
    drawn = np.array([shuffled(np.arange(n), n, keys(p)) for p in range(many)])
    for cell in (0, 17, 59):
        counts = np.bincount(drawn[:, cell], minlength=n)
        assert ((counts - many / n) ** 2 / (many / n)).sum() < n - 1 + 5 * np.sqrt(2 * n)
    # pairs of cells land side by side as often as any pair does
    close = np.array([(np.abs(drawn[:, a] - drawn[:, b]) == 1).mean() for a, b in ((0, 1), (3, 40), (10, 11))])
    assert np.abs(close - 2 / n).max() < 5 * np.sqrt(2 / n / many)
    fixed = (drawn == np.arange(n)).sum(axis=1)
    assert abs(fixed.mean() - 1) < 5 / np.sqrt(many) and abs(fixed.var() - 1) < 0.2
    cycles = []
    for p in drawn[:600]:
        seen, k = set(), 0
        for i in range(n):
            if i not in seen:
                k += 1
                while i not in seen:
                    seen.add(i)
                    i = int(p[i])
        cycles.append(k)
    assert abs(np.mean(cycles) - (1 / np.arange(1, n + 1)).sum()) < 5 * np.std(cycles) / np.sqrt(len(cycles)) and np.std(cycles) > 1
    agree = (drawn[:-1] == drawn[1:]).sum(axis=1)
    assert abs(agree.mean() - 1) < 5 / np.sqrt(many)


def test_shuffles_keep_label_counts(spark):
    labels = spark.createDataFrame([(i, "abc"[i % 3 if i < 40 else 0]) for i in range(50)], "cell_id long, kind string")
    want = Counter(r["kind"] for r in labels.collect())
    coded, names = shuffled_labels(labels, "kind", 5, 1)
    got = coded.collect()
    assert len(got) == 50 and all(Counter(names[r["codes"][p]] for r in got) == want for p in range(5)) and len({tuple(r["codes"][p] for r in got) for p in range(5)}) == 5


def test_null_counts_against_brute_force(spark):
    """Mean and spread of co-location under shuffles, against many shuffles drawn by numpy."""
    random = np.random.default_rng(0)
    kinds = random.choice(3, 90, p=[0.5, 0.3, 0.2])
    edges = [(int(a), int(b)) for a, b in random.integers(0, 90, (300, 2)) if a != b]
    got = {(r["a"], r["b"]): r for r in spatial.colocation_enrichment(spark.createDataFrame([(i, f"k{k}") for i, k in enumerate(kinds)], "cell_id long, cell_type string"), spark.createDataFrame(edges, "src long, dst long"), 400).collect()}
    s, t = np.array(edges).T
    null = []
    for _ in range(2000):
        k = random.permutation(kinds)
        null.append(np.bincount(k[s] * 3 + k[t], minlength=9).reshape(3, 3))
    null = np.array(null) + np.array(null).transpose(0, 2, 1)
    for (a, b), r in got.items():
        m, sd = null[:, int(a[1]), int(b[1])].mean(), null[:, int(a[1]), int(b[1])].std()
        assert abs(r["null_mean"] - m) < 5 * sd / np.sqrt(400) and abs(r["null_sd"] / sd - 1) < 0.2 and r["z"] == pytest.approx((r["observed"] - m) / sd, abs=0.7)


def test_neighbours_of_one_kind_stand_out(spark):
    labels = spark.createDataFrame([(i, "a" if i < 50 else "b") for i in range(100)], "cell_id long, cell_type string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(99)], "src long, dst long")
    z = {(r["a"], r["b"]): r["z"] for r in spatial.colocation_enrichment(labels, edges, 30).collect()}
    assert z["a", "a"] > 2 and z["b", "b"] > 2 and z["a", "b"] < -2
    assert spatial.colocation_counts(labels, edges).where("a = b and a = 'a'").first()["n"] == 98


def test_planted_pair_is_significant(spark):
    expr = spark.createDataFrame([(i, "L" if i < 20 else "R", 5.0) for i in range(40)] + [(i, "N", 1.0) for i in range(40)], "cell_id long, gene string, value double")
    clusters = spark.createDataFrame([(i, "s" if i < 20 else "t") for i in range(40)], "cell_id long, cluster string")
    pairs = spark.createDataFrame([("L", "R"), ("N", "N")], "ligand string, receptor string")
    got = {(r["ligand"], r["source"], r["target"]): r for r in communication.interaction_summary(expr, clusters, pairs, 30).collect()}
    assert got["L", "s", "t"]["score"] == 5.0 and got["L", "s", "t"]["pvalue"] == 0.0 and got["N", "s", "t"]["pvalue"] == 1.0


def test_labels_of_all_shuffles_are_never_rows(spark):
    """Arrays of them are wider than Spark reckons, and were broadcast."""
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "cell_id long, cell_type string")
    got = spatial.colocation_enrichment(labels, spark.createDataFrame([(i, i + 1) for i in range(39)], "src long, dst long"), 30)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "codes" not in plan and "posexplode" not in plan


def test_counts_by_batch_equal_counts_by_task(spark, monkeypatch):
    labels = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "cell_id long, cell_type string")
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 60) for i in range(60)], "src long, dst long")
    kept = sorted(map(tuple, spatial.colocation_enrichment(labels, edges, 20).collect()))
    monkeypatch.setattr(spatial, "MOST_COUNTS", 0)
    assert sorted(map(tuple, spatial.colocation_enrichment(labels, edges, 20).collect())) == kept
