"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct single words, neighbouring pairs and pairs with one word between, of words
lower-cased in ASCII and cut at white space and ASCII punctuation; presence counts, so length does not.
Single words also count by their stem, the first STEM bytes, so that an ending does not hide a word.
Fitted on a bounded sample (at most ``per_class`` learnable rows a label, see ``samples``); L1 leaves a few
hundred weights, which travel with the scoring function. Whole texts are scored in Arrow batches; nothing is
shuffled but the labels of the sample.

Null or empty text: no features, so the score is the bias's. Null ids are held out. Repeated ids in
``labels``: a document counts once for each distinct label, so a contradictory one teaches both.
Repeated rows are scored alike. Empty labels: a model without weights, score 0.5. Very long texts are
handled one at a time, in memory linear in the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ftrl
from tessera.llm.common import bounded_batches, held_out, map_batches, table
from tessera.llm.samples import sample_by_labels, sparse_rows

DIMENSION = 1 << 20
PER_CLASS = 2500
THRESHOLD = 0.7
STEM = 5
ALPHA, L1, L2, EPOCHS = 1.0, 10.0, 0.01, 10

_BREAK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_STEMMED = np.uint64(1 << 40)
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def occurrences(text: bytes | None) -> np.ndarray:
    """Coordinates of all n-gram and skip-gram occurrences."""
    words = (text or b"").lower().translate(_BREAK).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    mixed = (h * _PAIR) ^ (h >> np.uint64(7))
    stems = np.fromiter((zlib.crc32(w[:STEM]) for w in words if len(w) > STEM), np.uint64)
    parts = [mixed, (stems + _STEMMED) * _PAIR, mixed[:-1] * _PAIR + mixed[1:], mixed[:-2] * _SKIP + mixed[2:]]
    return (np.concatenate(parts) >> np.uint64(44)).astype(np.int64)


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    at = np.unique(occurrences(text))
    return at, np.ones(len(at))


@dataclass
class Model:
    sparse: ftrl.Sparse

    def scorer(self):
        weight = self.sparse.dense()[:, 0]
        bias = float(self.sparse.bias[0])

        def score(text: bytes | None) -> float:
            at = occurrences(text)
            at = np.unique(at[weight[at] != 0])
            return float(ftrl.sigmoid(np.float64(bias + weight[at].sum(dtype=np.float64))))

        return score


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample = sample_by_labels(docs, labels, "toxic", per_class)
    rows, target = sparse_rows(sample, features)
    return Model(ftrl.fit(rows, np.array(target, np.int64), 2, DIMENSION, alpha=ALPHA, l1=L1, l2=L2, epochs=EPOCHS))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        score = model.scorer()
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "score": [score(t) for t in batch["text"]]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id long, score double", run)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Whole rows of ``docs`` that score under the threshold, filtered as Arrow batches pass, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            values = batch.column(text).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([score(t) < threshold for t in values], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
