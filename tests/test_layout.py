import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.frames import cut
from tessera.operators import cluster, layout


def frame(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "cell_id long, features array<double>")


def brute(x, k):
    """{(src, dst)}: the k nearest other rows, ties to the smaller id."""
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[:k]}


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    centres = 3 * rng.standard_normal((8, 12))
    return centres[rng.integers(0, 8, 1500)] + rng.standard_normal((1500, 4)) @ rng.standard_normal((4, 12))


def test_one_tile_is_exact(spark, groups):
    x = groups[:300]
    got = layout.embedding_neighbours(frame(spark, x), 7).toPandas()
    assert set(zip(got.src, got.dst, strict=True)) == brute(x, 7) and sorted(set(got["rank"])) == list(range(1, 8))
    assert got.dist.to_numpy() == pytest.approx(np.sqrt(((x[got.src] - x[got.dst]) ** 2).sum(axis=1)))


def test_descent_finds_what_tiles_cut(spark, groups):
    want = brute(groups, 8)
    near = lambda **options: {(r["src"], r["dst"]) for r in layout.embedding_neighbours(frame(spark, groups), 8, tile=128, trees=2, **options).collect()}
    tiles, all_rounds = near(rounds=0), near()
    assert len(tiles & want) < 0.9 * len(want)
    assert len(all_rounds) == len(want) and len(all_rounds & want) >= 0.95 * len(want)


def test_ties_copies_and_rows_without_vectors(spark):
    x = [[0, 0], [1, 0], [0, 1], [0, 0], None, [float("nan"), 0], [0, -1]]
    got = {(r["src"], r["dst"], r["rank"]) for r in layout.embedding_neighbours(frame(spark, x), 2).collect()}
    assert {e for e in got if e[0] == 0} == {(0, 1, 1), (0, 2, 2)}
    assert {e[0] for e in got} == {0, 1, 2, 6}
    placed = {r["cell_id"]: (r["px"], r["py"]) for r in layout.planar_layout(frame(spark, x), 2, rounds=1, epochs=2).collect()}
    assert set(placed) == set(range(7)) and placed[0] == placed[3] and placed[4] == placed[5] == (None, None)
    assert np.isfinite([placed[i] for i in (0, 1, 2, 6)]).all()


@pytest.mark.parametrize("x", [[], [[1, 2]], [[1, 2], [1, 2]], [[0], [5]]])
def test_few_rows(spark, x):
    rows = frame(spark, x)
    pairs = layout.embedding_neighbours(rows, 3).count()
    assert pairs == (2 if x == [[0], [5]] else 0) and layout.planar_layout(rows, 3, rounds=1, epochs=1).where("px is not null").count() == len(x)
    for bad in ({"k": 0}, {"trees": 1}):
        with pytest.raises(ValueError):
            layout.embedding_neighbours(rows, **bad)


def test_fuzzy_edges(spark):
    near = spark.createDataFrame([(0, 1, 1, 1.0), (0, 2, 2, 2.0), (0, 3, 3, 4.0), (1, 0, 1, 1.0), (1, 2, 2, 1.5), (1, 3, 3, 3.0)], "src long, dst long, rank int, dist double")
    got = {(r["src"], r["dst"]): r["weight"] for r in layout.fuzzy_edges(near).collect()}
    assert got[0, 1] == got[1, 0] == pytest.approx(1.0) and len(got) == 10
    assert sum(got[0, j] for j in (1, 2, 3)) == pytest.approx(np.log2(3), abs=1e-6) and got[2, 0] == got[0, 2]


def test_layout_keeps_more_than_two_components(spark, groups):
    rows = frame(spark, groups).repartition(4)
    near = cut(layout.embedding_neighbours(rows, 10, tile=512))
    placed = [cut(layout.planar_layout(rows, 10, tile=512, neighbours=near, rounds=5)) for _ in range(2)]
    kept, plain = (layout.preservation(near, p).first()["preserved"] for p in (placed[0], cluster.projection(rows)))
    assert kept > 0.3 and kept > 1.5 * plain
    # reruns agree
    assert placed[0].join(placed[1].select("cell_id", F.col("px").alias("qx"), F.col("py").alias("qy")), "cell_id").where("px <> qx or py <> qy").count() == 0


def test_a_tile_hands_on_k_pairs_of_a_vector():
    import pyarrow as pa

    x = np.random.default_rng(6).normal(size=(30, 3))
    pairs = pa.table({"of": np.zeros(30, np.int64), "cell_id": np.arange(30)})
    table = pa.table({"cell_id": np.arange(30), "x": pa.array(x.tolist()), "bound": np.full(30, np.inf)})
    got = layout._local_join(4)(pairs, table)
    assert set(zip(got["src"].to_pylist(), got["dst"].to_pylist(), strict=True)) == brute(x, 4) and got.num_rows == 120


def test_floats_stay_floats(spark):
    rows = frame(spark, [[0, 1], [2, 3], [0, 1]]).selectExpr("cell_id", "cast(features as array<float>) as features")
    assert layout.distinct_vectors(rows).schema["x"].dataType.simpleString() == "array<float>"
    assert layout.planar_layout(rows, 1, rounds=1, epochs=1).where("px is not null").count() == 3


def test_all_pairs_are_compared_beyond_a_tile(spark, groups, monkeypatch):
    monkeypatch.setattr(layout, "LEAST_LOT", 400)
    for kind in ("double", "float"):
        rows = frame(spark, groups.astype(np.float32)).selectExpr("cell_id", f"cast(features as array<{kind}>) as features").repartition(3)
        got = layout.embedding_neighbours(rows, 8, tile=128, trees=2).toPandas()
        assert set(zip(got.src, got.dst, strict=True)) == brute(groups.astype(np.float32).astype(float), 8) and len(got) == 12000
        assert (got.sort_values(["src", "rank"])["rank"].to_numpy().reshape(-1, 8) == np.arange(1, 9)).all()


def odd_vectors():
    rng = np.random.default_rng(5)
    apart = rng.normal(size=(200, 7))
    yield "lattice", rng.integers(0, 3, (300, 5)).astype(float)
    yield "near copies", np.concatenate([apart, apart[:3].repeat(40, axis=0) + 1e-9 * rng.normal(size=(120, 7))])
    yield "far from the origin", 1e7 + apart
    yield "one far vector", np.concatenate([1e-12 * apart, [[1e30] * 7]])
    yield "last bits", np.array([rng.permutation([0.1, 0.2, 0.3, 0.7, 1.1, 1.3, 1e-8]) for _ in range(200)] + [[0.0] * 7])
    yield "fewer than k", apart[:4]


@pytest.mark.parametrize("name,x", list(odd_vectors()))
def test_lists_order_as_sums_in_order_do(name, x, monkeypatch):
    monkeypatch.setattr(layout, "ROWS", 32)
    monkeypatch.setattr(layout, "OTHERS", 50)
    monkeypatch.setattr(layout, "WAITING", 500)
    x = np.unique(x, axis=0)
    x = x[np.random.default_rng(1).permutation(len(x))]
    sums = np.zeros((len(x), len(x)))
    for c in range(x.shape[1]):
        sums += (x[:, None, c] - x[None, :, c]) ** 2
    dist, k, half = np.sqrt(sums), min(6, len(x) - 1), len(x) // 2
    np.fill_diagonal(dist, np.inf)
    ids = 10 * np.arange(len(x))
    lists = layout._Lists(ids[:half], x[:half], 6)
    lists.meet(ids[:half], x[:half])
    lists.meet(ids[half:], x[half:])
    for i in range(half):
        want = np.lexsort((ids, dist[i]))[:k]
        assert lists.dst[i, :k].tolist() == ids[want].tolist() and lists.dist[i, :k].tolist() == dist[i][want].tolist()


def test_descent_is_for_those_who_ask(spark, groups):
    got = {(r["src"], r["dst"]) for r in layout.embedding_neighbours(frame(spark, groups), 8, tile=128, trees=2, rounds=12).collect()}
    assert 0.95 * 12000 <= len(got & brute(groups, 8)) < 12000


def test_layout_draws_on_exact_neighbours_beyond_a_tile(spark, groups, monkeypatch):
    seen, edges = [], layout.fuzzy_edges
    monkeypatch.setattr(layout, "fuzzy_edges", lambda near: seen.append(near) or edges(near))
    placed = layout.planar_layout(frame(spark, groups), 8, tile=128, rounds=1, epochs=1)
    assert {(r["src"], r["dst"]) for r in seen[0].collect()} == brute(groups, 8) and placed.where("px is not null").count() == len(groups)
