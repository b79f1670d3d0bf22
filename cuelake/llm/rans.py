"""A static range asymmetric numeral system over token ids, many lanes at a time."""

from __future__ import annotations

import zlib

import numpy as np

#: Probabilities are out of 2 ** SCALE; states stay from LOW up, and give up 32 bits at a time.
SCALE = 20
LOW = np.uint64(1 << 31)
_K, _MASK, _WORD = np.uint64(SCALE), np.uint64((1 << SCALE) - 1), np.uint64(32)


class Table:
    """Shared frequencies: tokens that occur, and their shares of 2 ** SCALE, at least 1 each."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        if len(tokens) > 1 << SCALE:
            raise ValueError(f"more than {1 << SCALE} kinds of token")
        order = np.argsort(tokens)
        self.tokens, counts = tokens[order].astype(np.int64), counts[order].astype(np.float64)
        share = np.maximum(1, np.floor(counts / max(1.0, counts.sum()) * (1 << SCALE))).astype(np.int64)
        over = int(share.sum()) - (1 << SCALE)
        while over and len(share):  # what rounding left goes to or comes from the largest
            k = int(share.argmax())
            step = min(over, int(share[k]) // 2) if over > 0 else over
            share[k] -= step
            over -= step
        self.share = share.astype(np.uint64)
        self.below = np.cumsum(share).astype(np.uint64) - self.share
        self.symbol = np.zeros(int(self.tokens[-1]) + 1 if len(self.tokens) else 1, np.int32)
        self.symbol[self.tokens] = np.arange(len(self.tokens))
        self.slot = np.repeat(np.arange(len(share), dtype=np.int32), share)

    def encode(self, ids: np.ndarray, lanes: int, every: int) -> tuple[bytes, bytes, list[int], list[int]]:
        """Words, checkpoints (lane states), the word at which each checkpoint begins, and CRC-32s of
        the ids from one checkpoint to the next. There is a checkpoint before every `every` rounds of
        `lanes` ids, the first before round 0."""
        symbols = self.symbol[ids]
        rounds = -(-len(ids) // lanes)
        state = np.full(lanes, LOW, np.uint64)
        given, states, marks, n_words = [], [], [], 0
        for t in range(rounds - 1, -1, -1):
            s = symbols[t * lanes : (t + 1) * lanes]
            f, x = self.share[s], state[: len(s)]
            full = x >= ((LOW >> _K) << _WORD) * f
            words = (x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            x = np.where(full, x >> _WORD, x)
            state[: len(s)] = ((x // f) << _K) + x % f + self.below[s]
            given.append(words)
            n_words += len(words)
            if t % every == 0:
                states.append(state.copy()), marks.append(n_words)
        step = lanes * every
        crcs = [zlib.crc32(ids[a : a + step].astype("<u4").tobytes()) for a in range(0, len(ids), step)]
        words = np.concatenate([*given[::-1], np.zeros(0, np.uint32)])
        checkpoints = np.concatenate([*states[::-1], np.zeros(0, np.uint64)])
        return words.astype("<u4").tobytes(), checkpoints.astype("<u8").tobytes(), [n_words - m for m in marks[::-1]], crcs

    def decode(self, n: int, lanes: int, words: bytes, states: bytes, crc: int) -> np.ndarray:
        """The n ids after one checkpoint; words from where it begins."""
        stream, at = np.frombuffer(words, "<u4"), 0
        state = np.frombuffer(states, "<u8").copy()
        out = np.empty(n, np.int64)
        for a in range(0, n, lanes):
            x = state[: min(lanes, n - a)]
            low = x & _MASK
            s = self.slot[low.astype(np.int64)]
            x = self.share[s] * (x >> _K) + low - self.below[s]
            short = x < LOW
            k = int(short.sum())
            if k:
                x[short] = (x[short] << _WORD) | stream[at : at + k].astype(np.uint64)
                at += k
            state[: len(x)] = x
            out[a : a + len(x)] = s
        out = self.tokens[out]
        if zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError("a block of token ids doesn't match its checksum")
        return out
