"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.frames import checkpoint_folder

#: Words are maximal runs of anything but ASCII white space (what ``bytes.split()`` yields).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of training data are those whose crc32(doc_id as text) mod 3 is not this.
HELD_OUT_REMAINDER = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for documents that no classifier may learn from (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == HELD_OUT_REMAINDER, F.lit(True))


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so that a lost executor costs a re-read, not a recompute."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder, removed when the driver ends."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort: the session may be gone when the driver ends."""
    try:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(there, True)
    except Exception:  # noqa: BLE001
        return


def map_batches(df: DataFrame, schema: str, fn: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, object]]]) -> DataFrame:
    """``mapInArrow`` for functions over {column: list of Python values}; strings come as UTF-8 bytes.

    Each output dict maps every column of ``schema`` to a list, a numpy array or an Arrow array. Batches are cut to about
    ``SLICE_BYTES`` of input, so that very long documents do not add up in one worker.
    """
    bounded_batches(df.sparkSession)
    out = {f.name: pa_type(f.dataType.simpleString()) for f in schema_of(schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[dict[str, list]]:
            for batch in batches:
                for part in _slices(batch):
                    yield {
                        name: (col.cast(pa.binary()) if pa.types.is_string(col.type) else col).to_pylist()
                        for name, col in zip(part.schema.names, part.columns, strict=True)
                    }

        for got in fn(columns()):
            yield pa.RecordBatch.from_arrays([got[k] if isinstance(got[k], pa.Array) else pa.array(got[k], t) for k, t in out.items()], names=list(out))

    return df.mapInArrow(run, schema)


#: A worker's working arrays are some twenty times a slice, and an executor has as many workers as cores.
SLICE_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at SLICE_BYTES, so that neither side of a Python worker holds thousands of long documents at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    parts = max(1, min(batch.num_rows, -(-batch.nbytes // SLICE_BYTES)))
    step = -(-batch.num_rows // parts) if batch.num_rows else 1
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def schema_of(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


_PA = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
    "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()),
    "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
}


def pa_type(simple: str) -> pa.DataType:
    return _PA[simple]
