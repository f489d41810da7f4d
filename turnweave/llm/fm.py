"""A compressed FM-index in numpy: Burrows-Wheeler transform in a wavelet matrix, sampled positions, backward search.

The wavelet matrix keeps one bit per symbol and level in 64-bit words with a running count per word; of
the suffix order every eighth text position is kept, the others are found by walking back. Searches and
walks run in lockstep: one step of all patterns at once is a handful of array operations a level.
"""

from __future__ import annotations

import numpy as np

#: Text positions whose place in the suffix order is kept: the multiples of this.
SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in lexicographic order, by prefix doubling. A shorter suffix sorts first."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        behind = np.zeros(n, dtype=np.int64)
        behind[: max(0, n - width)] = rank[width:]
        key = rank * (n + 2) + behind
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        if fresh.all():
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        width *= 2


def agreeing(text: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool, block: int = 16) -> np.ndarray:
    """How many symbols from ``x`` and ``y`` on (``back``: before them) agree, ``most`` at the highest; blocks of symbols at a time."""
    done = np.zeros(len(x), dtype=np.int64)
    alive = np.flatnonzero(most > 0)
    offsets = np.arange(block)
    sign = -1 if back else 1
    while len(alive):
        so_far = done[alive, None] + offsets
        inside = so_far < most[alive, None]
        shift = np.where(inside, so_far, 0) * sign - (1 if back else 0)
        same = inside & (text[x[alive, None] + shift] == text[y[alive, None] + shift])
        run = np.where(same.all(axis=1), block, np.argmin(same, axis=1))
        done[alive] += run
        alive = alive[run == block]
    return done


class Bits:
    """A bit vector with the number of ones before each place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.counts = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int32))))[:-1].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[word] + np.bitwise_count(self.words[word] & mask)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Rank of a symbol in a prefix, and the symbol at a place, over symbols 0..sigma-1."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        current = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = (current >> level) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(symbols) - bit.sum()))
            current = np.concatenate((current[bit == 0], current[bit == 1]))
        self.begin = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.depth):
            one = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            ones = self.levels[k].ones(at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.begin[symbol]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for k in range(self.depth):
            one = self.levels[k][at]
            ones = self.levels[k].ones(at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
            symbol = symbol * 2 + one
        return symbol, at - self.begin[symbol]


class FMIndex:
    """Index over a text of symbols 1..sigma-1; symbol 0 is kept for the end."""

    def __init__(self, text: np.ndarray, sigma: int):
        whole = np.concatenate((text, [0]))
        order = suffix_order(whole)
        self.size = len(order)
        self.bwt = WaveletMatrix(whole[order - 1], sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(whole, minlength=sigma))))[:-1]
        kept = order % SAMPLE == 0
        self.marked, self.samples = Bits(kept), order[kept].astype(np.int32)

    def search(self, symbols: np.ndarray, ends: np.ndarray, length: int, least: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of the patterns ``symbols[end - length : end]``, by backward search.

        A pattern with fewer than ``least`` places is given up on the way, its interval then has under ``least``.
        """
        least = np.broadcast_to(least, len(ends))
        low = np.zeros(len(ends), dtype=np.int64)
        high = np.full(len(ends), self.size, dtype=np.int64)
        alive = np.arange(len(ends))
        for step in range(1, length + 1):
            c = symbols[ends[alive] - step]
            both = self.bwt.rank(np.concatenate((c, c)), np.concatenate((low[alive], high[alive])))
            low[alive] = self.before[c] + both[: len(c)]
            high[alive] = self.before[c] + both[len(c) :]
            alive = alive[high[alive] - low[alive] >= least[alive]]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order: back in the text to the next sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        rows, alive = rows.copy(), np.arange(len(rows))
        steps = 0
        while len(alive):
            here = self.marked[rows[alive]]
            at = alive[here]
            out[at] = self.samples[self.marked.ones(rows[at])] + steps
            alive = alive[~here]
            if len(alive):
                symbol, rank = self.bwt.symbol_and_rank(rows[alive])
                rows[alive] = self.before[symbol] + rank
                steps += 1
        return out
