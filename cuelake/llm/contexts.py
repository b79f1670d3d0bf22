"""Byte context trees of variable order: counting contexts, and scoring texts with frozen statistics.

A text is its bytes and then END. The context of a byte is what stands before it in the text, back to
the text's beginning, `depth` bytes at most. NUL is written FE and END is FF; UTF-8 has neither.
Contexts are packed into 64-bit numbers, the latest byte lowest, so depth is 7 at most.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from cuelake.llm.words import text_bytes

END = 0xFF
#: Symbols that a text can hold: 254 byte values and END are told apart from what never occurs.
SYMBOLS = 257
LANES = 8192


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by END, and where each text starts."""
    data, at = text_bytes(texts)
    out = np.insert(data, at[1:], END) if len(texts) else data
    zero = data == 0
    if zero.any():
        out = out.copy()
        out[out == 0] = 0xFE
    return out, at[:-1] + np.arange(len(texts))


def grams(symbols: np.ndarray, depth: int) -> np.ndarray:
    """For each place of a stream: its byte and up to `depth` bytes before, back to END."""
    n = len(symbols)
    since = np.arange(n) - np.maximum.accumulate(np.concatenate(([-1], np.where(symbols == END, np.arange(n), -1)[:-1])))
    padded = np.concatenate((np.full(depth, END, np.uint8), symbols)).astype(np.uint64)
    code = padded[depth:].copy()
    for j in range(1, depth + 1):
        code |= np.where(j <= since, padded[depth - j : depth - j + n], np.uint64(0)) << np.uint64(8 * j)
    return code


def counted(codes: np.ndarray) -> pd.Series:
    return pd.Series(codes).value_counts(sort=False)


def tallied(codes: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each occurs (or the sum of its `times`)."""
    if times is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes)
        codes, times = codes[order], times[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
    return codes[first], np.diff(first, append=len(codes)).astype(np.int32) if times is None else np.add.reduceat(times, first, dtype=np.int64) if len(first) else times


class Automaton:
    """Contexts as a trie with suffix links, so that each byte costs two table look-ups.

    levels[d] = (contexts, symbols, counts): rows sorted by context, for depth d = 0, 1, ...
    blend(counts, below): next-symbol probabilities of contexts from their counts (rows x symbols)
    and the probabilities of their longest kept suffixes.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], blend: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.depth = len(levels) - 1
        self.column = np.full(256, -1, np.int32)
        seen = np.unique(levels[0][1])
        self.column[seen] = np.arange(len(seen))
        self.column[self.column < 0] = len(seen)  # one column for all others
        self.width = width = len(seen) + 1
        self.rest = SYMBOLS - len(seen)
        kept = [np.unique(c) for c, _, _ in levels]
        keys = [np.zeros(1, np.uint64)]
        for k in range(1, self.depth + 1):
            keys.append(np.unique(np.concatenate([kept[d] >> np.uint64(8 * (d - k)) for d in range(k, self.depth + 1)])))
        first = np.concatenate(([0], np.cumsum([len(x) for x in keys])))
        goto = np.zeros((first[-1], width), np.int32)
        p = np.zeros((first[-1], width), np.float32)
        for d, (contexts, symbols, counts) in enumerate(levels):
            if d:
                parent = first[d - 1] + np.searchsorted(keys[d - 1], keys[d] >> np.uint64(8))
                goto[parent, self.column[(keys[d] & np.uint64(255)).astype(np.int64)]] = first[d] + np.arange(len(keys[d]))
                below = np.zeros(len(keys[d]), np.int64)
                for j in range(1, d):
                    short = keys[d] & np.uint64((1 << 8 * j) - 1)
                    at = np.minimum(np.searchsorted(keys[j], short), len(keys[j]) - 1) if len(keys[j]) else np.zeros(len(short), np.int64)
                    hit = (keys[j][at] == short) if len(keys[j]) else np.zeros(len(short), bool)
                    below[hit] = first[j] + at[hit]
                rows = slice(first[d], first[d + 1])
                goto[rows], p[rows] = goto[below], p[below]
            else:
                p[0, :-1], p[0, -1] = 1 / SYMBOLS, self.rest / SYMBOLS
            for a in range(0, len(kept[d]), 4096):
                some = kept[d][a : a + 4096]
                lo, hi = np.searchsorted(contexts, some[[0, -1]], side="left")[0], np.searchsorted(contexts, some[-1], side="right")
                dense = np.zeros((len(some), width))
                np.add.at(dense, (np.searchsorted(some, contexts[lo:hi]), self.column[symbols[lo:hi]]), counts[lo:hi])
                at = first[d] + np.searchsorted(keys[d], some)
                p[at] = blend(dense, p[at].astype(np.float64))
        p[:, -1] /= self.rest
        np.log2(np.maximum(p, 1e-30, out=p), out=p)  # in place: the tables are what a worker has most of
        goto *= width
        self.log2, self.goto = p.reshape(-1), goto.reshape(-1)

    def scores(self, symbols: np.ndarray) -> np.ndarray:
        """log2 of the probability of each symbol of a stream. Pieces of it run beside each other,
        each from `depth` symbols before its first, after which the state is that of one long run."""
        n = len(symbols)
        if not n:
            return np.zeros(0, np.float32)
        length = max(4 * self.depth + 1, -(-n // LANES))
        lanes = -(-n // length)
        cols = np.full(self.depth + lanes * length, self.column[END], np.int32)
        cols[self.depth : self.depth + n] = self.column[symbols]
        step = cols.itemsize
        table = np.ascontiguousarray(np.lib.stride_tricks.as_strided(cols, (lanes, length + self.depth), (length * step, step)).T)
        state = np.zeros(lanes, np.int32)
        out = np.empty((length, lanes), np.float32)
        for t in range(length + self.depth):
            k = state + table[t]
            if t >= self.depth:
                np.take(self.log2, k, out=out[t - self.depth], mode="clip")
            state = np.take(self.goto, k, mode="clip")
        return out.T.reshape(-1)[:n]

    def text_scores(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.scores(symbols).astype(np.float64), starts) if len(starts) else np.zeros(0)


def levels_of(codes: np.ndarray, counts: np.ndarray, depth: int, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts of full-depth grams to those of contexts of each depth that occur `least` times."""
    out = []
    for d in range(depth + 1):
        code = codes & np.uint64((1 << 8 * (d + 1)) - 1)
        has = np.ones(len(code), bool) if not d else (code >> np.uint64(8 * d)) > 0
        gram, back = np.unique(code[has], return_inverse=True)
        n = np.bincount(back, counts[has], len(gram)).astype(np.int64)
        context = gram >> np.uint64(8)
        _, which = np.unique(context, return_inverse=True)
        often = np.bincount(which, n)[which] >= least if len(n) else np.zeros(0, bool)
        out.append((context[often], (gram[often] & np.uint64(255)).astype(np.int64), n[often]))
    return out


def trimmed() -> None:
    """Gives what this task and the worker's earlier ones have freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each has about `most` bytes of text, or one row."""
    trimmed()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_bytes(batch.column(text))[1][1:]
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
            yield batch.slice(a, b - a)
            a = b
    trimmed()
