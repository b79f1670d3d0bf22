"""Words and word shingles of a batch of texts, as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit number spread over all of it (one to one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, `length` numbers of it."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - before, lengths)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and the len(texts) + 1 places where they begin and end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)), at - at[0]


@dataclass
class Words:
    """Words of a batch: how many each text has, and in order the hash and the byte span of each."""

    counts: np.ndarray
    hashes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    lowered: np.ndarray

    @cached_property
    def first(self) -> np.ndarray:
        """The place of each text's first word."""
        return np.cumsum(self.counts) - self.counts

    def of(self, k: int) -> list[bytes]:
        """The words of one text."""
        own = slice(self.first[k], self.first[k] + self.counts[k])
        begins, ends = self.begins[own], self.ends[own]
        if not len(begins):
            return []
        data = self.lowered[begins[0] : ends[-1]].tobytes()
        return [data[a:b] for a, b in zip((begins - begins[0]).tolist(), (ends - begins[0]).tolist(), strict=True)]


def words_of(texts: pa.Array, breaks: np.ndarray = _WHITE) -> Words:
    """Runs of other bytes than `breaks` (ASCII white space), A-Z lower-cased; null as empty."""
    data, at = text_bytes(pc.ascii_lower(texts))
    solid = ~breaks[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = at[1:-1][at[1:-1] < len(data)]
    first[inner] = solid[inner]  # a text begins a word of its own
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(begins, at))
    if not len(begins):
        return Words(counts, np.zeros(0, np.uint64), begins, ends, data)
    narrow = np.int32 if len(data) < 1 << 31 else np.int64
    place = np.cumsum(first, dtype=narrow)
    place = np.arange(len(data), dtype=narrow) - np.concatenate(([0], begins)).astype(narrow)[place]
    place[~solid] = 0
    factors = mixed(np.arange(1, int(place.max()) + 2, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    spread = _BYTE[data] * factors[place]
    spread[~solid] = 0
    return Words(counts, mixed(np.add.reduceat(spread, begins)), begins, ends, data)


def shingles(words: Words, width: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `width`-word shingles in order, and how many each text has.

    short: a text with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    n = words.counts
    starts = np.cumsum(n) - n
    lengths = np.maximum(n - width + 1, 0)
    sizes = np.full(len(n), width, np.int64)
    if short:
        few = (n > 0) & (n < width)
        lengths[few], sizes[few] = 1, n[few]
    at = ranges(starts, lengths)
    size = np.repeat(sizes, lengths)
    out = size.astype(np.uint64)
    full = bool((size == width).all())
    for j in range(width):
        if full:
            out = mixed(out * _STEP + words.hashes[at + j])
        else:
            has = j < size
            out[has] = mixed(out[has] * _STEP + words.hashes[at[has] + j])
    return out, lengths


def split_by(lengths: np.ndarray) -> list[tuple[int, int]]:
    ends = np.cumsum(lengths)
    return list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
