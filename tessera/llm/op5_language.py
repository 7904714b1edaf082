"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Character GRAMS-grams of the lower-cased text (runs of anything but letters and their marks become one
space) are hashed to DIMENSION coordinates; a row's values are their shares of its n-grams times the inverse
document frequency, which is counted over all learnable rows. FTRL with elastic-net penalties fits
``PER_CLASS`` rows a language at most (see ``samples`` for the bounds); every fifth row of the sample is set
aside to fit the temperature on. Inverse document frequencies, weights and temperature fold into one
table, so scoring is a table sum over each whole text, in Arrow batches. Letters are Unicode's category L.

Null texts and texts without letters: ``und``, score 0. Null ids are held out; null langs never teach.
A single learnt language is always predicted with score 1; none at all gives ``und``. Repeated rows are
scored alike. Texts are handled one at a time in pieces, so memory is bounded by the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ftrl
from tessera.llm.common import held_out, map_batches, table
from tessera.llm.samples import document_counts, labelled_sample, sparse_rows

GRAMS = (1, 2, 3)
DIMENSION = 1 << 16
PER_CLASS = 800
ALPHA, L1, L2, EPOCHS = 0.5, 0.02, 0.001, 4
#: Shares are small numbers; this brings rows to about unit size.
GAIN = 30.0

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_SHIFT = np.uint32(32 - 16)


def occurrences(text: str) -> np.ndarray:
    """Coordinates of all n-gram occurrences, all sizes of GRAMS; empty without letters."""
    clean = _OTHER.sub(" ", text.lower()).strip()
    if not _LETTER.search(clean):
        return np.zeros(0, np.int64)
    points = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for n in GRAMS:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, np.uint32) * _MULTIPLIERS[2]
            for k in range(n):
                h = (h ^ points[k : len(points) - n + 1 + k]) * _MULTIPLIERS[0]
                h ^= h >> np.uint32(15)
            found.append(((h * _MULTIPLIERS[1]) >> _SHIFT).astype(np.int64))
    return np.concatenate(found)


def _shares(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(occurrences((text or b"").decode()), return_counts=True)
    return at, GAIN * n / max(1, n.sum())


@dataclass
class Model:
    langs: list[str]
    table: ftrl.Sparse
    heat: float

    def scorer(self):
        full = (self.table.dense() * np.float32(GAIN)).astype(np.float32)
        bias, heat, langs = self.table.bias, self.heat, self.langs

        def score(text: str | None) -> tuple[str, float]:
            at = occurrences(text or "")
            if not langs or not len(at):
                return "und", 0.0
            if len(langs) == 1:
                return langs[0], 1.0
            total = np.zeros(full.shape[1])
            for k in range(0, len(at), 1 << 16):
                total += full[at[k : k + (1 << 16)]].sum(axis=0, dtype=np.float64)
            p = ftrl.probabilities(((total / len(at) + bias) * heat)[None, :])[0]
            best = int(p.argmax())
            return langs[best], float(p[best])

        return score


def train(docs: DataFrame, per_class: int = PER_CLASS) -> Model:
    rows, names = sparse_rows(labelled_sample(docs.select("doc_id", "text", "lang"), "lang", per_class), _shares)
    pairs = [(r, n) for r, n in zip(rows, names, strict=True) if len(r[0])]
    langs = sorted({n for _, n in pairs})
    if len(langs) < 2:
        return Model(langs, ftrl.Sparse(DIMENSION, np.zeros(0, np.int64), np.zeros((0, 1), np.float32), np.zeros(1)), 1.0)
    n, seen = document_counts(docs, lambda t: occurrences(t.decode()), DIMENSION)
    rarity = np.log((1 + n) / (1 + seen)) + 1
    rows = [(at, share * rarity[at]) for (at, share), _ in pairs]
    target = np.array([langs.index(n) for _, n in pairs])
    # a third column keeps two languages multinomial, so that one table form serves all
    classes = max(3, len(langs))
    aside = np.arange(len(rows)) % 5 == 4
    options = {"classes": classes, "dimension": DIMENSION, "alpha": ALPHA, "l1": L1, "l2": L2, "epochs": EPOCHS}
    learnt = ftrl.fit([r for r, a in zip(rows, aside, strict=True) if not a], target[~aside], **options)
    full = learnt.dense()[:, : len(langs)]
    logits = np.array([(full[at] * x[:, None]).sum(axis=0) + learnt.bias[: len(langs)] for (at, x), a in zip(rows, aside, strict=True) if a])
    heat = ftrl.temperature(logits, target[aside]) if len(logits) else 1.0
    folded = learnt.weights[:, : len(langs)] * rarity[learnt.index, None]
    return Model(langs, ftrl.Sparse(DIMENSION, learnt.index, folded.astype(np.float32), learnt.bias[: len(langs)]), heat)


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        score = model.scorer()
        for batch in batches:
            got = [score(None if t is None else t.decode()) for t in batch["text"]]
            yield {"doc_id": batch["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id long, lang_pred string, score double", run)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
