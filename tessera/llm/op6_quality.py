"""Quality rules: base counts, then hashed word and character n-gram logistic regression.

Base counts are exact. The classifier's features are the shares of hashed WORD_GRAMS-grams of words and
CHARACTER_GRAMS-grams of code points in the raw text (case and signs matter here). It is fitted by FTRL on at
most ``PER_CLASS`` labelled rows a class (see ``samples`` for the bounds); every fifth row is set aside for
Platt calibration. Texts are scored whole, in Arrow batches, against the fixed threshold KEEP.

Null text: no words, so it fails the base rule. Null ids are held out of training; repeated labels count
once for each distinct value. Repeated rows are judged alike. Without labels of both classes the verdict is
the base rule's. Windows of one document are hashed and sorted in arrays linear in its words; hash equality is
confirmed on the words themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ftrl
from tessera.llm.common import map_batches, table
from tessera.llm.samples import sample_by_labels, sparse_rows

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WORD_GRAMS, CHARACTER_GRAMS = (1, 2, 3), (3, 5)
DIMENSION = 1 << 18
PER_CLASS = 1500
KEEP = 0.5
GAIN = 30.0
ALPHA, L1, L2, EPOCHS = 0.5, 0.05, 0.01, 3

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_DOWN = np.uint64(64 - 18)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by WINDOW-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64) * _A
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * _B + one[k : k + n]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    maybe = np.flatnonzero(np.isin(rolled, twice))
    seen: dict[tuple, list[int]] = {}
    for at in maybe.tolist():
        seen.setdefault(tuple(words[at : at + WINDOW]), []).append(at)
    steps = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            steps[places] += 1
            np.add.at(steps, np.array(places) + WINDOW, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or b""
    words = text.split()
    solid = text.translate(None, SPACES)
    chars = len(solid.decode())
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def occurrences(text: bytes | None) -> np.ndarray:
    """Coordinates of all word n-grams and all n-grams of code points; a gram's length is part of its hash."""
    text = text or b""
    words = text.split()
    word = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1 << 40)
    point = np.frombuffer(text.decode().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = [np.zeros(0, np.uint64)]
    for units, sizes in ((word, WORD_GRAMS), (point, CHARACTER_GRAMS)):
        for n in sizes:
            if (m := len(units) - n + 1) > 0:
                h = units[:m] + np.uint64(n)
                for k in range(1, n):
                    h = (h ^ (h >> np.uint64(29))) * _B + units[k : k + m]
                found.append((h ^ (h >> np.uint64(31))) * _A >> _DOWN)
    return np.concatenate(found).astype(np.int64)


def _shares(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(occurrences(text), return_counts=True)
    return at, GAIN * n / max(1, n.sum())


@dataclass
class Model:
    sparse: ftrl.Sparse
    scale: float
    shift: float

    def scorer(self):
        weight = self.sparse.dense()[:, 0]
        bias = float(self.sparse.bias[0])

        def score(text: bytes | None) -> float:
            at = occurrences(text)
            margin = bias + GAIN * float(weight[at].sum(dtype=np.float64)) / max(1, len(at))
            return float(ftrl.sigmoid(np.float64(self.scale * margin + self.shift)))

        return score


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """None where labels do not hold both classes."""
    sample = sample_by_labels(docs, labels, "quality", per_class)
    rows, target = sparse_rows(sample, _shares)
    target = np.array(target, np.int64)
    if len(set(target.tolist())) < 2:
        return None
    aside = np.arange(len(rows)) % 5 == 4
    learnt = ftrl.fit([r for r, a in zip(rows, aside, strict=True) if not a], target[~aside], 2, DIMENSION, alpha=ALPHA, l1=L1, l2=L2, epochs=EPOCHS)
    weight = learnt.dense()[:, 0].astype(np.float64)
    margins = np.array([learnt.bias[0] + (weight[at] * x).sum() for (at, x), a in zip(rows, aside, strict=True) if a])
    return Model(learnt, *ftrl.platt(margins, target[aside]))


def judged(docs: DataFrame, model: Model | None, text: str = "text", keep: float = KEEP) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, quality_score) of each row."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        score = model.scorer() if model else lambda _: 1.0
        for batch in batches:
            counts = [base_counts(t) for t in batch["text"]]
            failed = [fails(c[0], c[4]) for c in counts]
            scores = [score(t) for t in batch["text"]]
            columns = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), zip(*counts, strict=True), strict=True)) if counts else dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), ())
            yield {"doc_id": batch["doc_id"]} | {k: list(v) for k, v in columns.items()} | {"base_failed": failed, "kept": [not f and s >= keep for f, s in zip(failed, scores, strict=True)], "quality_score": scores}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_score double"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), schema, run)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, train(docs, table(spark, sf_dir, "labels")))
