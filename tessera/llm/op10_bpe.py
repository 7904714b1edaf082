"""BPE encoding by backtracking over longest token matches; decoding by an offset table.

Aho-Corasick finds every token in a word and so the longest at each position. Two neighbouring tokens
are compatible if merging their bytes by rank would leave both whole; a sequence whose neighbours are all
compatible is exactly what the merges give. The encoder takes the longest match, falls back to its
longest shorter prefix token, and steps back where no token fits; positions found to be dead ends are
marked, so a word takes linear time. Texts are cut into independent units (see ``units``) whose encoded
forms each worker keeps in a bounded table. Ids of decoding index one byte string by offsets.

Null or empty text: no ids, the empty text. Special tokens' strings become their ids, as the tokenizers
library does by default. Repeated rows are encoded alike. A text is handled whole, in memory linear in it.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, table
from tessera.llm.units import KEEP_BYTES, byte_level_table, encode_texts, gather, pieces

VOCABULARY = "byte_bpe_50k.json"
#: Entries of a worker's tables: units with their ids, words with theirs, and compatible pairs; about 50 MB.
KEEP_UNITS, KEEP_WORDS, KEEP_PAIRS = 120_000, 50_000, 100_000
#: White space as the tokenizers library sees it (the Unicode property).
_W = r"\p{White_Space}"
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _W + r"\p{L}\p{N}]+|" + _W + r"+(?!" + f"[^{_W}])|" + _W + "+")


class Bpe:
    """Encoder and decoder of one tokenizer file with a byte-level BPE model whose ids are in merge order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = {c: b for b, c in byte_level_table().items()}
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for token, at in vocabulary.items():
            self.token[at] = raw(token)
        by_bytes = {t: at for at, t in enumerate(self.token) if t}
        for text, at in self.special.items():
            self.token[at] = text
        self.parts = [(at, at) for at in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            left, right = (vocabulary[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            at = by_bytes[self.token[left] + self.token[right]]
            self.merged[left, right], self.parts[at] = at, (left, right)
        self.shorter = [next((by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_bytes), -1) for t in self.token]
        self.length = [len(t) for t in self.token]
        self.matches = ahocorasick.Automaton()
        for t, at in by_bytes.items():
            self.matches.add_word(t.decode("latin-1"), at)
        self.matches.make_automaton()
        self.whole = by_bytes
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.token), np.uint8)
        self.between = regex.compile(b"(" + b"|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.words: dict[str, list[int]] = {}
        self.fits: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay whole side by side.

        Merges that would cross the border are looked for from the last made pair of border tokens
        backwards in rank; ``limit`` is the rank up to which both border tokens already exist.
        """
        pair = left << 16 | right
        known = self.fits.get(pair)
        if known is None:
            known = self._compatible(left, right)
            if len(self.fits) < KEEP_PAIRS:
                self.fits[pair] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        limit = len(self.token)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.parts[left][1]
                if left == limit:
                    limit, right = right + 1, self.parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.parts[right][0]
                if right + 1 == limit:
                    limit, left = left, self.parts[left][1]
                    if left == limit:
                        return True

    def word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        longest = [0] * len(word)
        for end, at in self.matches.iter(word.decode("latin-1")):
            longest[end + 1 - self.length[at]] = at
        open_ = bytearray(b"\1") * (len(word) + 1)
        ids: list[int] = []
        place, token = 0, longest[0]
        while place < len(word):
            while True:
                end = place + self.length[token]
                if open_[end] and (not ids or self.compatible(ids[-1], token)):
                    ids.append(token)
                    place, token = end, longest[end] if end < len(word) else -1
                    break
                if (shorter := self.shorter[token]) >= 0:
                    token = shorter
                    continue
                open_[place] = 0
                token = ids.pop()
                place -= self.length[token]
        return ids

    def unit(self, unit: bytes) -> list[int]:
        ids: list[int] = []
        for w in _WORDS.findall(unit.decode()):
            if (got := self.words.get(w)) is None:
                got = self.word(w.encode())
                if len(w) <= KEEP_BYTES and len(self.words) < KEEP_WORDS:
                    self.words[w] = got
            ids += got
        return ids

    def stretches(self, text: bytes) -> Iterator[tuple[bytes, int]]:
        """Ordinary stretches (text, -1) and special tokens (text, id)."""
        if self.between is None or not any(s in text for s in self.special):
            yield text, -1
            return
        for k, part in enumerate(self.between.split(text)):
            if k % 2:
                yield part, self.special[part]
            elif part:
                yield part, -1

    def encode(self, text: bytes) -> list[int]:
        ids: list[int] = []
        for part, special in self.stretches(text):
            if special >= 0:
                ids.append(special)
            else:
                first, *rest = pieces(part)
                ids += self.unit(first) if first else []
                for piece in rest:
                    ids += self.unit(b" " + piece)
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids' tokens; where they are not UTF-8 the caller replaces, as the library does."""
        starts = self.offsets[ids]
        return gather(self.blob, starts, self.offsets[ids.astype(np.int64) + 1] - starts).tobytes()


class Decimals:
    """Ids as decimal text with a comma after each, by an offset table."""

    def __init__(self, size: int):
        shown = [b"%d," % i for i in range(size)]
        self.sizes = np.array([len(x) for x in shown], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(shown), np.uint8)


@lru_cache(maxsize=2)
def loaded(path: str) -> tuple[Bpe, dict[bytes, bytes], Decimals]:
    bpe = Bpe(path)
    if len(bpe.token) > 1 << 16:
        raise ValueError("ids of more than 16 bits are not supported")
    return bpe, {}, Decimals(len(bpe.token))


def encoded(docs: DataFrame, path: str, text: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, decoded from the ids themselves; ``ids`` adds the array of them."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe, known, decimals = loaded(path)
        whole = lambda units: [array("H", bpe.unit(u)).tobytes() for u in units]
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            stretches = [list(bpe.stretches(t)) if t else [] for t in batch["text"]]
            plain = [s for doc in stretches for s, special in doc if special < 0]
            flat, at = encode_texts(plain, known, whole, KEEP_UNITS)
            if any(special >= 0 for doc in stretches for _, special in doc):
                spans = iter(zip(at[:-1], at[1:], strict=True))
                docs_ids = [[np.array([x], np.uint16) if x >= 0 else flat[slice(*next(spans))] for _, x in doc] for doc in stretches]
                joined = [np.concatenate([np.zeros(0, np.uint16), *parts]) for parts in docs_ids]
                flat, at = np.concatenate([np.zeros(0, np.uint16), *joined]), np.cumsum([0, *map(len, joined)])
            else:
                at = at[np.cumsum([0, *map(len, stretches)])]
            sizes, widths = bpe.offsets[flat.astype(np.int64) + 1] - bpe.offsets[flat], decimals.sizes[flat]
            shown = memoryview(gather(decimals.blob, decimals.starts[flat], widths))
            decoded = gather(bpe.blob, bpe.offsets[flat], sizes).tobytes()
            shown_at = np.concatenate([[0], np.cumsum(widths)])[at]
            decoded_at = np.concatenate([[0], np.cumsum(sizes)])[at]
            out = [decoded[s:e] for s, e in zip(decoded_at[:-1], decoded_at[1:], strict=True)]
            yield {
                "doc_id": batch["doc_id"],
                "n_tokens": np.diff(at),
                "ids_sha256": [digest(shown[s : max(s, e - 1)]) for s, e in zip(shown_at[:-1], shown_at[1:], strict=True)],
                "decoded_sha256": [digest(x.decode("utf-8", "replace").encode()) for x in out],
            } | ({"ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))} if ids else {})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), schema, run)


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
