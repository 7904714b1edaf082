import json
import zlib

import numpy as np
import pytest
import zstandard

from tessera.sources import chunked, tables


def write(folder, values, chunks, compressor=None, text=False, skip=()):
    """A version-2 array; chunks in ``skip`` are left out."""
    folder.mkdir(parents=True)
    values = np.asarray(values)
    described = {"zarr_format": 2, "shape": list(values.shape), "chunks": list(chunks), "dtype": "|O" if text else values.dtype.str, "compressor": {"id": compressor} if compressor else None, "filters": [{"id": "vlen-utf8"}] if text else None, "fill_value": None if text else 0, "order": "C"}
    (folder / ".zarray").write_text(json.dumps(described))
    counts = [-(-n // c) for n, c in zip(values.shape, chunks, strict=True)]
    for at in np.ndindex(*counts):
        name = ".".join(map(str, at))
        if name in skip:
            continue
        part = values[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, chunks, strict=True))]
        if text:
            content = len(part).to_bytes(4, "little") + b"".join(len(t.encode()).to_bytes(4, "little") + t.encode() for t in part)
        else:
            whole = np.zeros(chunks, values.dtype)
            whole[tuple(slice(0, n) for n in part.shape)] = part
            content = whole.tobytes()
        (folder / name).write_bytes({"zlib": zlib.compress, "zstd": zstandard.compress}.get(compressor, lambda c: c)(content))


@pytest.fixture(scope="module")
def matrix():
    random = np.random.default_rng(0)
    x = random.integers(1, 9, (53, 17)) * (random.random((53, 17)) < 0.3)
    x[7] = x[20:23] = 0
    return x


def triples(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("compressor", [None, "zlib", "zstd"])
def test_matrices_of_stores(spark, tmp_path, matrix, compressor):
    want = sorted((int(i), int(j), float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix), strict=True))
    write(tmp_path / "a/X", matrix.astype("<f4"), (10, 6), compressor)
    assert triples(chunked.expression(spark, str(tmp_path / "a"))) == want
    rows, cols = np.nonzero(matrix)
    group = tmp_path / "b/X"
    write(group / "data", matrix[rows, cols].astype("<f8"), (13,), compressor)
    write(group / "indices", cols.astype("<i4"), (13,), compressor)
    write(group / "indptr", np.concatenate([[0], np.cumsum((matrix != 0).sum(axis=1))]).astype("<i8"), (9,), compressor)
    (group / ".zattrs").write_text(json.dumps({"encoding-type": "csr_matrix", "shape": [53, 17]}))
    got = chunked.expression(spark, str(tmp_path / "b"))
    assert triples(got) == want and got.columns == ["cell_id", "gene_id", "value"]


def test_columns_of_stores(spark, tmp_path):
    n = 25
    place = np.random.default_rng(1).random((n, 2))
    place[3] = [0, 0.5]
    write(tmp_path / "obsm/spatial", place, (10, 2))
    write(tmp_path / "obs/count", np.arange(n), (7,), skip=("1",))
    write(tmp_path / "obs/kind/codes", (np.arange(n) % 4 - 1).astype("i1"), (6,))
    write(tmp_path / "obs/kind/categories", ["é", "", "long name"], (2,), text=True)
    got = {r["cell_id"]: r for r in chunked.cells(spark, str(tmp_path), "count", "kind").collect()}
    assert sorted(got) == list(range(n))
    for i, r in got.items():
        assert (r["x"], r["y"]) == tuple(place[i]) and r["count"] == (0 if 7 <= i < 14 else i)
        assert r["kind"] == [None, "é", "", "long name"][i % 4]
    with pytest.raises(chunked.StoreError):
        chunked.cells(spark, str(tmp_path), "nothing")
    write(tmp_path / "bad", np.arange(3), (3,), "blosc")
    with pytest.raises(chunked.StoreError, match="blosc"):
        chunked.column(spark, str(tmp_path / "bad"))


def test_matrix_market(spark, tmp_path, matrix):
    path = tmp_path / "m.mtx"
    entries = [(j + 1, i + 1, matrix[i, j]) for i, j in zip(*np.nonzero(matrix), strict=True) if (i, j) != (52, 16)] + [(17, 53, 500)]
    path.write_text("%%MatrixMarket matrix coordinate integer general\n% note\n17 53 500\n" + "".join(f"{a} {b} {v}\n" for a, b, v in entries))
    assert triples(chunked.matrix_market(spark, str(path))) == sorted((b - 1, a - 1, float(v)) for a, b, v in entries)
    path.write_text("%%MatrixMarket\n")
    with pytest.raises(chunked.StoreError):
        chunked.matrix_market(spark, str(path))


def test_stores_load_as_their_tables(spark, tmp_path, matrix):
    """The same cells and expression from a zarr store, a Matrix Market file and Parquet."""
    matrix = np.concatenate([matrix] * 3)
    n, store = len(matrix), tmp_path / "s.zarr"
    rows, cols = np.nonzero(matrix)
    write(store / "X" / "data", matrix[rows, cols].astype("<f4"), (20,), "zlib")
    write(store / "X" / "indices", cols.astype("<i4"), (20,), "zlib")
    write(store / "X" / "indptr", np.concatenate([[0], np.cumsum((matrix != 0).sum(axis=1))]).astype("<i4"), (54,))
    (store / "X" / ".zattrs").write_text(json.dumps({"encoding-type": "csr_matrix"}))
    place = np.random.default_rng(2).random((n, 2))
    write(store / "obsm" / "spatial", place, (30, 2))
    write(store / "obs" / "fov", np.arange(n) % 3, (16,))
    (store / "obs" / ".zattrs").write_text(json.dumps({"column-order": ["fov"]}))
    (tmp_path / "m.mtx").write_text(f"%%MatrixMarket matrix coordinate integer general\n17 {n} {len(rows)}\n" + "".join(f"{j + 1} {i + 1} {matrix[i, j]}\n" for i, j in zip(rows, cols, strict=True)))
    spark.createDataFrame([(i, i % 3, float(x), float(y)) for i, (x, y) in enumerate(place)], "cell_id long, fov long, x double, y double").write.parquet(str(tmp_path / "cells"))
    spark.createDataFrame([(int(i), int(j), float(matrix[i, j])) for i, j in zip(rows, cols, strict=True)], "cell_id long, gene_id int, value double").write.parquet(str(tmp_path / "expr"))

    def loaded(cells, expr):
        got = tables.load_dataset(spark, str(tmp_path / cells), str(tmp_path / expr), section_col="fov", min_counts=1, min_genes=1)
        return triples(got.cells.select("cell_id", "section_id", "x", "y")), sorted((c, g, round(v, 9)) for c, g, v in got.expr.select("cell_id", "gene_id", "value").collect()), got.n_genes, got.notes

    want = loaded("cells", "expr")
    assert len(want[0]) == (matrix.sum(axis=1) >= 1).sum() and loaded("s.zarr", "s.zarr") == want and loaded("cells", "m.mtx") == want
