"""Chunked array stores and Matrix Market files as tables: a row a chunk, read by Spark and decoded where it lies.

Stores are version-2 zarr folders as written by AnnData: X dense or a CSR group, obs columns, obsm arrays.
Spark's binary reader brings one chunk a row, from whatever file system Spark reads; only the small JSON
descriptions are read on the driver. A task holds the chunks of one place, never a matrix. Compressors: none,
zlib, gzip, zstd; others are an error. A chunk that is not there stands for the fill value, as the format has it.
"""

from __future__ import annotations

import gzip
import json
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StoreError(ValueError):
    """A store that cannot be read here, and why."""


def _described(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file, or None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


@dataclass(frozen=True)
class Array:
    """What a .zarray file says of an array; travels to the tasks."""

    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    compressor: str | None
    fill: float | None
    order: str
    text: bool

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Array:
        got = _described(spark, f"{path}/.zarray")
        if got is None:
            raise StoreError(f"no array at {path}")
        if got["zarr_format"] != 2:
            raise StoreError(f"{path} has format {got['zarr_format']}, not 2")
        compressor = (got["compressor"] or {}).get("id")
        filters = [f["id"] for f in got["filters"] or ()]
        text = filters == ["vlen-utf8"]
        if compressor not in (None, "zlib", "gzip", "zstd") or (filters and not text):
            raise StoreError(f"{path} is packed with {compressor or filters}")
        fill = got["fill_value"] if isinstance(got["fill_value"], (int, float)) else None
        return cls(path, tuple(got["shape"]), tuple(got["chunks"]), "|O" if text else got["dtype"], compressor, fill, got["order"], text)

    def decode(self, content: bytes) -> np.ndarray:
        """One chunk, as large as all chunks are."""
        if self.compressor == "zlib":
            content = zlib.decompress(content)
        elif self.compressor == "gzip":
            content = gzip.decompress(content)
        elif self.compressor == "zstd":
            import zstandard

            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        if not self.text:
            return np.frombuffer(content, self.dtype).reshape(self.chunks, order=self.order)
        out, at = [], 4
        for _ in range(int.from_bytes(content[:4], "little")):
            size = int.from_bytes(content[at : at + 4], "little")
            out.append(content[at + 4 : at + 4 + size].decode())
            at += 4 + size
        return np.array(out, object)


def _chunks(spark: SparkSession, array: Array) -> DataFrame:
    """(number, content) of the stored chunks; the number counts chunks row by row."""
    files = spark.read.format("binaryFile").load(f"{array.path}/*")
    parts = F.split(F.element_at(F.split("path", "/"), -1), "\\.")
    number = F.lit(0).cast("long")
    for k, (n, size) in enumerate(zip(array.shape, array.chunks, strict=True)):
        number = number * -(-n // size) + F.get(parts, F.lit(k)).cast("long")
    return files.select(number.alias("number"), "content")


def column(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """(row long, ``name``) of a one-dimensional array, or of a categorical group (codes, categories); -1 is null.

    Rows of chunks that are not there have the fill value.
    """
    import pyarrow as pa

    if _described(spark, f"{path}/codes/.zarray") is not None:
        codes, names = column(spark, f"{path}/codes", "code"), column(spark, f"{path}/categories", name).withColumnRenamed("row", "code")
        return codes.join(names, "code", "left").select("row", name)
    array = Array.at(spark, path)
    if len(array.shape) != 1:
        raise StoreError(f"{path} has {len(array.shape)} dimensions, not 1")
    kind = "string" if array.text else "long" if np.dtype(array.dtype).kind in "iub" else "double"
    (n,), (size,) = array.shape, array.chunks
    whole = pa.string() if kind == "string" else pa.int64() if kind == "long" else pa.float64()

    def run(batches):
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = array.decode(content)[: max(0, n - number * size)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)) + number * size), pa.array(values.tolist(), whole)], names=["row", name])

    there = _chunks(spark, array)
    found = there.mapInArrow(run, f"row long, `{name}` {kind}")
    if array.text or array.fill is None:
        return found
    lost = spark.range(-(-n // size)).select(F.col("id").alias("number")).join(there.select("number"), "number", "left_anti")
    rows = lost.select(F.explode(F.sequence(F.col("number") * size, F.least((F.col("number") + 1) * size, F.lit(n)) - 1)).alias("row"))
    return found.unionByName(rows.select("row", F.lit(array.fill).cast(kind).alias(name)))


def dense(spark: SparkSession, path: str) -> DataFrame:
    """(row long, col int, value double) of the non-zero values of a two-dimensional array."""
    import pyarrow as pa

    array = Array.at(spark, path)
    if len(array.shape) != 2:
        raise StoreError(f"{path} has {len(array.shape)} dimensions, not 2")
    if array.fill:
        raise StoreError(f"{path} has a fill value that is not 0")
    (n, m), (rows, cols) = array.shape, array.chunks
    across = -(-m // cols)

    def run(batches):
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                top, left = number // across * rows, number % across * cols
                block = array.decode(content)[: n - top, : m - left]
                i, j = np.nonzero(block)
                yield pa.RecordBatch.from_arrays([pa.array(i + top), pa.array((j + left).astype(np.int32)), pa.array(block[i, j].astype(np.float64))], names=["row", "col", "value"])

    return _chunks(spark, array).mapInArrow(run, "row long, col int, value double")


def compressed_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row long, col int, value double) of a CSR group (data, indices, indptr).

    The places where rows begin and end say which stretches of which chunks are whose; a task meets one chunk of
    values, its columns and the stretches in it.
    """
    import pyarrow as pa

    data, indices = (Array.at(spark, f"{path}/{name}") for name in ("data", "indices"))
    if data.chunks != indices.chunks:
        raise StoreError(f"{path}: data and indices have chunks of different sizes")
    size = data.chunks[0]
    starts = column(spark, f"{path}/indptr", "at")
    bounds = starts.select("row", F.col("at").alias("start"), F.lit(None).cast("long").alias("end")).unionByName(starts.select((F.col("row") - 1).alias("row"), F.lit(None).cast("long").alias("start"), F.col("at").alias("end")))
    rows = bounds.groupBy("row").agg(F.max("start").alias("start"), F.max("end").alias("end")).where("end > start")
    chunk = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("number")
    stretches = rows.select("row", "start", "end", chunk)
    blocks = _chunks(spark, data).join(_chunks(spark, indices).withColumnRenamed("content", "columns"), "number")
    kinds = pa.schema([("row", pa.int64()), ("col", pa.int32()), ("value", pa.float64())])

    def meet(here, block):
        if not here.num_rows or not block.num_rows:
            return kinds.empty_table()
        number = here.column("number")[0].as_py()
        values, columns = data.decode(block.column("content")[0].as_py()), indices.decode(block.column("columns")[0].as_py())
        start = np.maximum(np.asarray(here.column("start")) - number * size, 0)
        end = np.minimum(np.asarray(here.column("end")) - number * size, size)
        row = np.repeat(np.asarray(here.column("row")), end - start)
        at = np.arange(len(row)) - np.repeat(np.cumsum(end - start) - (end - start), end - start) + np.repeat(start, end - start)
        return pa.table([pa.array(row), pa.array(columns[at].astype(np.int32)), pa.array(values[at].astype(np.float64))], schema=kinds)

    return stretches.groupBy("number").cogroup(blocks.groupBy("number")).applyInArrow(meet, "row long, col int, value double").where("value <> 0")


def expression(spark: SparkSession, path: str, matrix: str = "X") -> DataFrame:
    """(cell_id, gene_id, value) of a store's matrix, dense or CSR; cells and genes are numbered as they lie."""
    kind = (_described(spark, f"{path}/{matrix}/.zattrs") or {}).get("encoding-type")
    if kind not in (None, "array", "csr_matrix"):
        raise StoreError(f"{path}/{matrix} is a {kind}")
    got = compressed_rows(spark, f"{path}/{matrix}") if kind == "csr_matrix" else dense(spark, f"{path}/{matrix}")
    return got.select(F.col("row").alias("cell_id"), F.col("col").alias("gene_id"), "value")


def cells(spark: SparkSession, path: str, *columns: str, spatial: str | None = "obsm/spatial") -> DataFrame:
    """(cell_id, columns of obs, x, y): only the named columns' chunks are read; without names all that obs lists."""
    columns = columns or tuple((_described(spark, f"{path}/obs/.zattrs") or {}).get("column-order", ()))
    parts = [column(spark, f"{path}/obs/{name}", name) for name in columns]
    if spatial:
        n = Array.at(spark, f"{path}/{spatial}").shape[0]
        at = lambda k: F.max(F.when(F.col("col") == k, F.col("value")))
        places = dense(spark, f"{path}/{spatial}").groupBy("row").agg(at(0).alias("x"), at(1).alias("y"))
        parts.append(spark.range(n).select(F.col("id").alias("row")).join(places, "row", "left").na.fill(0.0, ["x", "y"]))  # zeros are no rows
    if not parts:
        raise StoreError("no columns are asked for")
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "row", "full")
    return out.withColumnRenamed("row", "cell_id")


def matrix_market(spark: SparkSession, path: str, *, genes_by_cells: bool = True) -> DataFrame:
    """(cell_id, gene_id, value) of a Matrix Market coordinate file, numbered from 0; its lines are split like those of any text."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    head = lines.first()  # of the file's first lines
    if head is None:
        raise StoreError(f"{path} has no size line")
    size = [int(v) for v in head["value"].split()]
    if len(size) != 3:
        raise StoreError(f"{path} is no coordinate file")
    fields = F.split(F.trim("value"), r"\s+")
    entry = [fields[k].cast(kind) for k, kind in enumerate(("long", "long", "double"))]
    one, two = entry[0] - 1, entry[1] - 1
    cell, gene = (two, one) if genes_by_cells else (one, two)
    rows = lines.where(F.col("value") != head["value"])
    # an entry that reads like the size line: the line is there twice
    same = lines.where(F.col("value") == head["value"]).count() - 1
    if same > 0:
        rows = rows.unionByName(lines.where(F.col("value") == head["value"]).limit(same))
    return rows.select(cell.alias("cell_id"), gene.cast("int").alias("gene_id"), entry[2].alias("value"))
