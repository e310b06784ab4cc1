"""FM-index of a token sequence: wavelet matrix, backward search, sampled positions.

All queries are answered together, one array pass per symbol and level.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64)
    h = 1
    order = np.argsort(rank, kind="stable")
    while True:
        top = int(rank.max(initial=0)) + 1
        if top == n:
            return np.argsort(rank)
        second = np.zeros(n, np.int64)
        if h < n:
            second[:-h] = rank[h:] + 1
        key = rank * (top + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        h *= 2


class WaveletMatrix:
    """Symbols of a sequence by bit planes, with ranks."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ranks, self.bits, self.zeros = [], [], []
        now = seq
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.bits.append(bit.astype(np.uint8))
            self.ranks.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for i in range(self.levels):
            bit = (symbol >> (self.levels - 1 - i)) & 1
            ones = self.ranks[i]
            lo = np.where(bit, self.zeros[i] + ones[lo], lo - ones[lo])
            hi = np.where(bit, self.zeros[i] + ones[hi], hi - ones[hi])
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for i in range(self.levels):
            bit = self.bits[i][at]
            out = out << 1 | bit
            ones = self.ranks[i][at]
            at = np.where(bit, self.zeros[i] + ones, at - ones)
        return out


class FMIndex:
    """Index of a sequence of numbers from 1 to sigma - 1; 0 may separate parts."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 8):
        text = np.r_[np.asarray(seq, np.int64) + 1, 0]  # the end is the only least symbol
        self.n, self.sample = len(text), sample
        order = suffix_array(text)
        last = text[order - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma + 1))]
        self.tree = WaveletMatrix(last, sigma + 1)
        held = order % sample == 0
        self.held = held
        self.held_rank = np.r_[0, np.cumsum(held)].astype(np.int64)
        self.positions = order[held]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern (a row of the matrix)."""
        m = patterns.shape[1]
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(m - 1, -1, -1):
            symbol = patterns[live, j].astype(np.int64) + 1
            lo[live] = self.first[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.tree.rank(symbol, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: steps back to the next sampled place."""
        at, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.held[at])
        while len(live):
            symbol = self.tree.access(at[live])
            at[live] = self.first[symbol] + self.tree.rank(symbol, at[live])
            steps[live] += 1
            live = live[~self.held[at[live]]]
        return self.positions[self.held_rank[at]] + steps
