"""Incremental prototype abundance over a stream of assigned cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_abundance(cells: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, sample_id, prototype_id, n) of a stream with ts, sample_id and prototype_id; counts close once the watermark passes."""
    return cells.withWatermark("ts", late).groupBy(F.window("ts", every), "sample_id", "prototype_id").agg(F.count(F.lit(1)).alias("n"))
