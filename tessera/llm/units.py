"""Independent units of byte-level BPE texts.

The public pre-tokenizer's pattern starts a new word at every space before a character that is not white
space, whatever stands before it; so a text can be encoded unit by unit, and equal units encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WHITE = rb"[\x20\x09-\x0d]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\Z"
_JOINED = re.compile(rb" (?=" + _WHITE + rb")")
_START = re.compile(rb" (?!" + _WHITE + rb")")
#: Longer units are not kept, and tables take in no more than this many; common units come first.
KEEP_BYTES, KEEP_UNITS = 48, 700_000


def byte_level_table() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes count up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def pieces(text: bytes) -> list[bytes]:
    """The text cut at unit starts; all but the first piece lack the space they begin with."""
    return _START.split(text) if _JOINED.search(text) else text.split(b" ")


def encode_texts(texts: list[bytes], known: dict[bytes, bytes], encode: Callable[[list[bytes]], list[bytes]], keep: int = KEEP_UNITS) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, offsets of the texts) as unsigned 16-bit ids.

    ``encode`` gives the ids of units as 16-bit bytes; ``known`` keeps those of units that begin with a
    space, by the unit without it. Units of the whole batch are made distinct before they are looked up.
    """
    odd = [k for k, t in enumerate(texts) if _JOINED.search(t)]
    cut = pc.split_pattern(pa.array(texts, pa.large_binary()), b" ")
    if odd:
        mixed = cut.to_pylist()
        for k in odd:
            mixed[k] = pieces(texts[k])
        cut = pa.array(mixed, pa.large_list(pa.large_binary()))
    bounds = np.asarray(cut.offsets, np.int64) - cut.offsets[0].as_py() if len(texts) else np.zeros(1, np.int64)
    coded = cut.flatten().dictionary_encode()
    units, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices, np.int64).copy()
    firsts = np.asarray(units, object)[index[bounds[:-1]]].tolist() if len(texts) else []
    forms = list(map(known.get, units))
    gaps = [k for k, x in enumerate(forms) if x is None]
    for k, got in zip(gaps, encode([b" " + units[k] for k in gaps]), strict=True):
        forms[k] = got
        if len(known) < keep and len(units[k]) <= KEEP_BYTES:  # the common units come first
            known[units[k]] = got
    index[bounds[:-1]] = len(forms) + np.arange(len(firsts))
    forms += encode(firsts)
    flat = np.frombuffer(b"".join(forms), np.uint16)
    sizes = np.fromiter(map(len, forms), np.int64, len(forms)) // 2
    starts = np.cumsum(sizes) - sizes
    ends = np.concatenate([[0], np.cumsum(sizes[index])])
    return gather(flat, starts[index], sizes[index]), ends[bounds]


#: Places that ``gather`` works out at a time; each takes two 8-byte numbers while it does.
GATHER = 1 << 20


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each, one after the other."""
    some = np.flatnonzero(sizes)
    if not len(some):
        return flat[:0]
    starts, sizes = starts[some], sizes[some]
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]), flat.dtype)
    row = 0
    while row < len(ends):
        begin = int(ends[row] - sizes[row])
        past = max(row + 1, int(np.searchsorted(ends, begin + GATHER, "right")))
        first, size = starts[row:past], sizes[row:past]
        at = np.ones(int(ends[past - 1]) - begin, np.int64)
        at[0] = first[0]
        at[ends[row : past - 1] - begin] += first[1:] - first[:-1] - size[:-1]
        out[begin : begin + len(at)] = flat[np.cumsum(at)]
        row = past
    return out
