"""Token counts: batches of equal bytes are encoded in Arrow functions, which return lengths only.

Texts are cut into pieces of about PIECE characters, and pieces are gathered into batches of about
BATCH_BYTES, whatever texts they come from; so neither a very long text nor a run of them makes a batch
larger. A cut is safe where no merge can cross it. For a sentencepiece BPE file that is between two
characters that stand side by side in no piece of the vocabulary: every symbol that a merge makes is such
a piece. A piece that is cut off also holds the character before the cut, whose own count is taken off
again; so the library's own first space goes to that character and not to the text behind the cut. For a
byte-level BPE file of the tokenizers library it is before a space that begins a unit (see ``units``).
Where no cut is safe, a stretch is encoded whole, however long it is: counts are those of whole texts.

Null or empty text: no tokens. Special strings inside texts count as the library counts them by default.
Repeated rows and null ids are counted one by one; empty tables give empty results; other columns are not
read. Memory is linear in one text and one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, spare, table
from tessera.llm.units import pieces as units_of

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters of a piece and bytes of a batch; both only shape the work.
PIECE, BATCH_BYTES = 8_192, 1 << 18
SPACE = "▁"  # what stands for a space in sentencepiece files


class SentencePieces:
    """Counts and safe cuts of one sentencepiece BPE file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        # byte, control and unknown pieces take no part in merges
        merged = [self.library.id_to_piece(i) for i in ids if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.joined = {p[k : k + 2] for p in merged for k in range(len(p) - 1)}
        self.joined |= {p.replace(SPACE, " ") for p in self.joined}
        self.alone: dict[str, int] = {}

    def cuts(self, text: str) -> Iterator[tuple[str, int]]:
        """(piece, tokens to take off): pieces whose counts, less what is to be taken off, add up to that of the text."""
        at, off, n = 0, 0, len(text)
        while n - at > PIECE + PIECE // 2:
            end = at + PIECE
            while end < n and text[end - 1 : end + 1] in self.joined:
                end += 1
            if end == n:
                break
            yield text[at:end], off
            before = text[end - 1]
            if before not in self.alone:
                self.alone[before] = len(self.library.encode(before))
            at, off = end - 1, self.alone[before]
        yield text[at:], off

    def counts(self, texts: list[str]) -> list[int]:
        return list(map(len, self.library.encode(texts, num_threads=1)))


class ByteUnits:
    """Counts and safe cuts of one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        if not isinstance(self.library.pre_tokenizer, pre_tokenizers.ByteLevel) or self.library.normalizer is not None:
            raise ValueError(f"only byte-level BPE files can be cut safely, not {path}")
        self.library.no_truncation()
        self.library.no_padding()

    def cuts(self, text: str) -> Iterator[tuple[str, int]]:
        if len(text) <= PIECE + PIECE // 2:
            yield text, 0
            return
        held, size = [], 0
        for k, unit in enumerate(units_of(text.encode())):
            held.append(unit.decode() if k == 0 else " " + unit.decode())
            size += len(unit) + 1
            if size > PIECE:
                yield "".join(held), 0
                held, size = [], 0
        yield "".join(held), 0

    def counts(self, texts: list[str]) -> list[int]:
        return list(map(len, self.library.encode_batch(texts, add_special_tokens=False)))


@lru_cache(maxsize=2)
def loaded(path: str) -> SentencePieces | ByteUnits:
    return SentencePieces(path) if path.endswith(".model") else ByteUnits(path)


def count_texts(texts: list[str], cuts: Callable[[str], Iterator[tuple[str, int]]], counts: Callable[[list[str]], list[int]]) -> np.ndarray:
    """Tokens of each text, encoded in batches of about BATCH_BYTES of pieces."""
    out = np.zeros(len(texts), np.int64)
    held: list[str] = []
    rows: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        np.add.at(out, rows, counts(held))
        held.clear()
        rows.clear()
        size = 0

    for row, text in enumerate(texts):
        if not text:
            continue
        for piece, off in cuts(text):
            held.append(piece)
            rows.append(row)
            out[row] -= off
            size += len(piece)
            if size >= BATCH_BYTES:
                flush()
    if held:
        flush()
    return out


def counted(docs: DataFrame, path: str, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` (longs), n_bytes of the UTF-8 text and n_tokens of it."""
    schema = ", ".join([*(f"`{c}` long" for c in keep), "n_bytes long", "n_tokens long"])
    (held,) = spare(docs.select(*keep), "text")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        model = loaded(path)
        for batch in batches:
            texts = batch[held]
            got = count_texts([t.decode("utf-8", "replace") if t else "" for t in texts], model.cuts, model.counts)
            yield {c: batch[c] for c in keep} | {"n_bytes": [len(t) if t else 0 for t in texts], "n_tokens": got}

    return map_batches(docs.select(*[F.col(c).cast("long").alias(c) for c in keep], F.col(text).alias(held)), schema, run)


def over_limit(n_tokens: Column, limit: int = LIMIT) -> Column:
    return n_tokens > limit


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = counted(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), "doc_id")
    return got.withColumn("over_limit", over_limit(F.col("n_tokens")))
