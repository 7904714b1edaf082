"""Bounded labelled samples for the classifiers, and counts over all learnable rows.

A sample is chosen among distinct (doc_id, hash of the text, label): by a hash of all three, so that rows that
share an id or a text are told apart and repeated rows count once. It is bounded in rows and in bytes of
text a label, at every size of the input and whatever repeats in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, held_out, map_batches

SCALE = 1 << 30
#: Bytes of text that a label's sample may have; at least one row is taken.
SAMPLE_BYTES = 16 << 20


def _under(rows: DataFrame, label: str, wanted: int, order) -> DataFrame:
    """About ``wanted`` of the distinct ``rows`` for each value of ``label``: those whose hash is under a threshold set from the label's exact count."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    below = F.lit(0)
    for value, n in counts.items():
        below = F.when(F.col(label) == F.lit(value), F.lit(min(SCALE, int(SCALE * wanted / n)))).otherwise(below)
    return rows.where(F.pmod(order, F.lit(SCALE)) < below)


def _chosen(keys: DataFrame, per_class: int, max_bytes: int) -> DataFrame:
    """(doc_id, tie, label) of at most ``per_class`` keys a label, with ``max_bytes`` bytes of text at most.

    The threshold leaves about a quarter more than wanted, for each label a bounded list that a window then
    cuts to the exact number of rows and bytes.
    """
    order = F.xxhash64("doc_id", "tie", F.lit("sample"))
    few = _under(keys, "label", per_class + per_class // 4 + 64, order)
    by_hash = Window.partitionBy("label").orderBy(order, "doc_id", "tie")
    numbered = few.withColumn("nth", F.row_number().over(by_hash)).withColumn("sum", F.sum("bytes").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where((F.col("nth") <= per_class) & ((F.col("nth") == 1) | (F.col("sum") <= max_bytes))).select("doc_id", "tie", "label")


def _sample(rows: DataFrame, per_class: int, max_bytes: int) -> DataFrame:
    """(doc_id, text, label) of a bounded choice among ``rows`` of those columns; only hashes of the others are shuffled."""
    tied = rows.withColumn("tie", F.xxhash64("text"))
    keys = tied.groupBy("doc_id", "tie", "label").agg(F.first(F.octet_length("text")).cast("long").alias("bytes"))
    chosen = checkpoint(_chosen(checkpoint(keys), per_class, max_bytes))
    # at most per_class keys a label: bounded, so they travel to where the texts are read
    return tied.join(F.broadcast(chosen), ["doc_id", "tie", "label"]).dropDuplicates(["doc_id", "tie", "label"]).select("doc_id", "text", "label")


def labelled_sample(docs: DataFrame, label: str, per_class: int, text: str = "text", max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` learnable rows for each value of a column of ``docs``.

    Held-out rows, null labels and null texts are never chosen.
    """
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col("doc_id")))
    return _sample(known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(label).alias("label")), per_class, max_bytes)


def sample_by_labels(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text: str = "text", max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` learnable documents with each 0/1 label in ``labels``.

    Ids are chosen among the distinct labels first, so that a bounded number of them is broadcast to where
    documents are read; then among the documents that have them, as ids can repeat. A document labelled
    both ways may be chosen for either.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    ids = checkpoint(_under(known, "label", 2 * per_class + 64, F.xxhash64("doc_id", F.lit("ids"))))
    rows = docs.where(F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _sample(rows.join(F.broadcast(ids), "doc_id"), per_class, max_bytes)


def sparse_rows(sample: DataFrame, features: Callable[[bytes], tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list]:
    """Features of a bounded sample, made on the executors; rows come back in the order of (doc_id, label, features)."""
    kind = sample.schema["label"].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            made = [features(t) for t in batch["text"]]
            label = [x.decode() if isinstance(x, bytes) else x for x in batch["label"]]
            yield {"doc_id": batch["doc_id"], "label": label, "at": [m[0].astype(np.int32).tobytes() for m in made], "value": [m[1].astype(np.float32).tobytes() for m in made]}

    # packed as bytes: lists of Python numbers would take ten times the driver's memory
    got = map_batches(sample, f"doc_id long, label {kind}, at binary, value binary", run).collect()
    got.sort(key=lambda r: (r["doc_id"], str(r["label"]), r["at"], r["value"]))
    return [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in got], [r["label"] for r in got]


def document_counts(docs: DataFrame, occurrences: Callable[[bytes], np.ndarray], dimension: int, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of learnable rows with any occurrence, and of those with each coordinate: whole texts, all rows.

    A task sends one count a coordinate at most; what reaches the driver is one row a coordinate.
    """
    known = docs.where(F.col(text).isNotNull() & ~held_out(F.col("doc_id"))).select(F.col(text).alias("text"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counts, seen = np.zeros(dimension + 1, np.int64), np.zeros(dimension, bool)
        for batch in batches:
            for t in batch["text"]:
                at = occurrences(t)
                if len(at):
                    seen[at] = True
                    counts[:-1] += seen
                    counts[-1] += 1
                    seen[at] = False
        at = np.flatnonzero(counts)
        yield {"at": at, "n": counts[at]}

    got = map_batches(known, "at int, n long", run).groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(dimension + 1)
    for r in got:
        counts[r["at"]] = r["n"]
    return int(counts[-1]), counts[:-1]
