"""Token-id output: Re-Pair grammar compressed shards, read back at random.

Documents go to partitions by ranges of doc_id (ties: by a hash of the text, equal rows dealt out), about
PART_BYTES of text each, and are sorted there. They are encoded with the tokenizers library, unit by unit
(see ``units``), every document ends with END, and each run of about SHARD_TOKENS ids is a shard with a
grammar of its own. Re-Pair: the exact counts of all pairs of neighbouring symbols are taken, the most
frequent pairs (those within a factor of STEP of the most frequent, so that a round replaces many) become
nonterminals, their occurrences are replaced from left to right, and counts are taken again, until no pair
occurs LEAST_COUNT times or all 16-bit symbols are used. Pairs do not cross documents.

File format, one Parquet row a shard, written by Spark's committer into a shared folder: part, shard,
doc_ids, token_starts (of documents, within the shard's ids; one more entry for the end), packed_starts
(the same within the sequence), rules (left and right symbol of nonterminal BASE + k, unsigned 16-bit
little-endian), lengths (ids each nonterminal stands for, 32-bit), sequence (symbols, 16-bit).
``decode`` expands any slice of a shard: symbols' lengths find a token's place without expanding what
is before it.

Null or empty text: END alone. Null doc_ids sort first. Repeated rows each keep their place. Very long
documents make a shard of their own size; a shard never holds more than one beyond SHARD_TOKENS.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, map_batches, shared_folder, table
from tessera.llm.units import byte_level_table, encode_texts, gather

VOCABULARY = "byte_bpe_50k.json"
END = 0
SHARD_TOKENS, PART_BYTES, ENCODE_BYTES = 1 << 21, 256 << 20, 4 << 20
LEAST_COUNT, STEP = 8, 8
MOST_BROADCAST = 200_000
#: The last 16-bit symbol is not used, so that NO_PAIR is no pair.
SYMBOLS = (1 << 16) - 1
#: Stands for a pair across documents; no rule ever makes these two symbols.
NO_PAIR = np.uint32(0xFFFFFFFF)

SHARDS = "part int, shard int, doc_ids array<bigint>, token_starts array<bigint>, packed_starts array<bigint>, rules binary, lengths binary, sequence binary"


class Encoder:
    """Whole texts to ids with the tokenizers library; each worker keeps a bounded table of units."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.merge = self.tokenizer.model.tokenize
        self.shown = byte_level_table()
        self.tails = {"": b"", **{c: array("H", self.tokenizer.encode(c, add_special_tokens=False).ids).tobytes() for c in ".,;:!?"}}

    def batch(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text."""
        special = [t is not None and any(s in t for s in self.special) for t in texts]
        flat, at = encode_texts([t or b"" for t, x in zip(texts, special, strict=True) if not x], self.known, self._ids)
        parts = (flat[s:e] for s, e in zip(at[:-1], at[1:], strict=True))
        return [np.frombuffer(self._ids([t])[0], np.uint16) if x else next(parts) for t, x in zip(texts, special, strict=True)]

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of units. The pre-tokenizer's pattern takes a space and letters whole, and one sign after them on its own; so such units go straight to the model, and share the ids of their word."""
        tails, known, merge, shown = self.tails, self.known.get, self.merge, self.shown
        out, rest, places = [], [], []
        for unit in texts:
            text = unit.decode()
            tail = text[-1:]
            if tail in tails:  # one byte long, like the space before the word
                word, head = text[:-1], unit[:-1]
            else:
                word, head, tail = text, unit, ""
            spaced = word[:1] == " "
            if not (word[1:] if spaced else word).isalpha():
                places.append(len(out))
                rest.append(text)
                out.append(b"")
                continue
            ids = known(head[1:]) if tail and spaced else None
            if ids is None:
                ids = array("H", [t.id for t in merge(head.decode("latin-1").translate(shown))]).tobytes()
            out.append(ids + tails[tail] if tail else ids)
        for place, e in zip(places, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[place] = array("H", e.ids).tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def compress(ids: np.ndarray, last: np.ndarray, base: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, its flags of document ends, rules (k x 2), lengths) of ids with ``last`` set at document ends.

    Of two chosen pairs that overlap the left one is replaced; one that is left with fewer than ``least``
    places by that is counted anew in the next round, as are pairs that share a hash bucket with a more
    frequent one.
    """
    ids, last, room = ids.astype(np.uint16), last.copy(), SYMBOLS - base
    rules, lengths, spread = [np.zeros((0, 2), np.int64)], np.ones(base, np.int64), np.uint32(0x9E3779B1)
    while room > 0 and len(ids) > 1:
        key = (ids[:-1].astype(np.uint32) << np.uint32(16)) | ids[1:]
        key[last[:-1]] = NO_PAIR
        ordered = np.sort(key)
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        pairs, counts = ordered[starts], np.diff(np.append(starts, len(ordered)))
        if pairs[-1] == NO_PAIR:
            pairs, counts = pairs[:-1], counts[:-1]
        if not len(counts) or (top := int(counts.max())) < least:
            break
        best = np.flatnonzero(counts >= max(least, -(-top // STEP)))
        pairs = pairs[best[np.argsort(-counts[best], kind="stable")][: min(room, 1 << 15)]]
        # a table of sixteen places a pair: small ones stay in the processor's cache
        down = np.uint32(32 - max(8, int(16 * len(pairs) - 1).bit_length()))
        symbol = np.full(1 << (32 - int(down)), -1, np.int16)
        symbol[(pairs[::-1] * spread) >> down] = np.arange(len(pairs), dtype=np.int16)[::-1]
        found = symbol[(key * spread) >> down]
        at = np.flatnonzero(found >= 0)
        at = at[key[at] == pairs[found[at]]]
        place = np.arange(len(at))
        run = place - np.maximum.accumulate(np.where(np.concatenate([[True], at[1:] != at[:-1] + 1]), place, 0))
        at = at[run % 2 == 0]
        found = found[at]
        uses = np.bincount(found, minlength=len(pairs))
        kept = uses >= least
        if not kept.any():  # runs of one symbol alone: progress all the same
            kept = uses > 0
        number = np.cumsum(kept) - 1 + SYMBOLS - room
        at, found = at[kept[found]], number[found[kept[found]]]
        chosen = np.stack([pairs[kept] >> 16, pairs[kept] & 0xFFFF], axis=1).astype(np.int64)
        rules.append(chosen)
        lengths = np.concatenate([lengths, lengths[chosen[:, 0]] + lengths[chosen[:, 1]]])
        room -= len(chosen)
        ids[at] = found
        last[at] = last[at + 1]
        stays = np.ones(len(ids), bool)
        stays[at + 1] = False
        ids, last = ids[stays], last[stays]
    return ids, last, np.concatenate(rules), lengths[base:]


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, sizes): symbol s stands for ids[starts[s] : starts[s] + sizes[s]]."""
    symbols, owner = np.arange(base, base + len(rules)), np.arange(len(rules))
    while len(nested := np.flatnonzero(symbols >= base)):
        repeats = np.ones(len(symbols), np.int64)
        repeats[nested] = 2
        ends = np.cumsum(repeats)
        wide = np.repeat(symbols, repeats)
        wide[ends[nested] - 2], wide[ends[nested] - 1] = rules[symbols[nested] - base].T
        symbols, owner = wide, np.repeat(owner, repeats)
    sizes = np.concatenate([np.ones(base, np.int64), np.bincount(owner, minlength=len(rules))])
    return np.concatenate([np.arange(base), symbols]).astype(np.uint16), np.cumsum(sizes) - sizes, sizes


def decode(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that a slice of a sequence stands for."""
    ids, starts, sizes = expansions(rules, base)
    return gather(ids, starts[symbols], sizes[symbols])


def tokens_at(shard: dict, start: int, stop: int, base: int) -> np.ndarray:
    """Ids start..stop of a shard, expanding only the symbols that hold them."""
    rules = np.frombuffer(shard["rules"], "<u2").astype(np.int64).reshape(-1, 2)
    lengths = np.concatenate([np.ones(base, np.int64), np.frombuffer(shard["lengths"], "<i4")])
    sequence = np.frombuffer(shard["sequence"], "<u2")
    ends = np.cumsum(lengths[sequence])
    first, past = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    before = ends[first - 1] if first else 0
    return decode(sequence[first:past], rules, base)[start - before : stop - before]


def _lots(batches: Iterator[dict]) -> Iterator[tuple[list, list]]:
    """Batches put together to about ENCODE_BYTES of text, as equal units are encoded once a lot."""
    docs, texts, held = [], [], 0
    for batch in batches:
        docs, texts = docs + batch["doc_id"], texts + batch["text"]
        held += sum(len(t or b"") for t in batch["text"])
        if held >= ENCODE_BYTES:
            yield docs, texts
            docs, texts, held = [], [], 0
    if docs:
        yield docs, texts


def packed(docs: DataFrame, path: str, parts: int, shard_tokens: int = SHARD_TOKENS, text: str = "text") -> DataFrame:
    """Shards (see the file format) of ``docs`` in ascending doc_id order; ``path`` names the tokenizer."""
    size = encoder(path).size

    def shard(part: int, number: int, rows: list[tuple[int | None, np.ndarray]]) -> dict:
        starts = np.concatenate([[0], np.cumsum([len(x) for _, x in rows])]).astype(np.int64)
        last = np.zeros(starts[-1], bool)
        last[starts[1:] - 1] = True
        sequence, last, rules, lengths = compress(np.concatenate([x for _, x in rows]), last, size)
        ends = np.concatenate([[0], np.flatnonzero(last) + 1])
        return {
            "part": [part], "shard": [number], "doc_ids": [[d for d, _ in rows]], "token_starts": [starts], "packed_starts": [ends],
            "rules": [rules.astype("<u2").tobytes()], "lengths": [lengths.astype("<i4").tobytes()], "sequence": [sequence.astype("<u2").tobytes()],
        }

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        part, number, waiting, held = TaskContext.get().partitionId(), 0, [], 0
        tokens = encoder(path)
        for docs, texts in _lots(batches):
            for doc, ids in zip(docs, tokens.batch(texts), strict=True):
                waiting.append((doc, np.append(ids, np.uint16(END))))
                held += len(ids) + 1
                if held >= shard_tokens:
                    yield shard(part, number, waiting)
                    number, waiting, held = number + 1, [], 0
        if waiting:
            yield shard(part, number, waiting)

    # equal rows have a number too, so that a large group of them is cut into ranges like any other
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"), F.monotonically_increasing_id().alias("nth"))
    dealt = rows.repartitionByRange(parts, "doc_id", "tie", "nth").sortWithinPartitions("doc_id", "tie", "nth")
    return map_batches(dealt.select("doc_id", "text"), SHARDS, run)


def read_back(shards: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, shard) of each document in shards written by ``packed``."""
    base = encoder(path).size

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for k in range(len(batch["shard"])):
                rules = np.frombuffer(batch["rules"][k], "<u2").astype(np.int64).reshape(-1, 2)
                ids = decode(np.frombuffer(batch["sequence"][k], "<u2"), rules, base).astype("<u4")
                starts = batch["token_starts"][k]
                spans = list(zip(starts[:-1], starts[1:], strict=True))
                n = len(spans)
                yield {
                    "doc_id": batch["doc_ids"][k], "start": [s + batch["before"][k] for s, _ in spans], "n_tokens": [e - s for s, e in spans],
                    "ids_crc32": [zlib.crc32(ids[s:e].tobytes()) for s, e in spans], "part": [batch["part"][k]] * n, "shard": [batch["shard"][k]] * n,
                }

    # one row a partition is all that meets in one task; shards are summed within their partition
    sizes = shards.select("part", "shard", F.element_at("token_starts", -1).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    within = Window.partitionBy("part").orderBy("shard")
    sizes = sizes.select("part", "shard", (F.sum("n").over(within) - F.col("n")).alias("inside")).join(parts, "part")
    sizes = checkpoint(sizes.select("part", "shard", (F.col("earlier") + F.col("inside")).alias("before")))
    # a row of three numbers a shard; their number is checked, beyond it shards are exchanged to meet them
    placed = shards.join(F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST else sizes, ["part", "shard"])
    return map_batches(placed, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int", run)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = public_tokenizers.path(VOCABULARY), table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "token-store")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed(docs, path, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))).write.parquet(folder)
    return read_back(spark.read.parquet(folder), path)
