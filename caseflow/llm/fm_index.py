"""An FM-index over words, with a wavelet matrix for ranks and sampled suffix positions.

Symbol 0 separates runs of words and never is part of a pattern, so every separator counts as a symbol of its own and suffixes
are compared up to the next one only.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; text ends with 0."""
    n = len(text)
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + int(zero.sum()))
    k = 1
    while True:
        after = np.full(n, 0, np.int64)
        after[: n - k] = rank[k:] + 1 if k < n else 0
        after[zero] = 0  # a separator already is alone
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class WaveletMatrix:
    """rank(symbol, i): occurrences of a symbol before i, for many (symbol, i) at once."""

    def __init__(self, values: np.ndarray, top: int):
        self.n, self.bits = len(values), max(1, int(top).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        v = values.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (v >> level) & 1
            pad = np.zeros((len(v) // 64 + 1) * 64, np.uint8)
            pad[: len(v)] = bit
            w = np.packbits(pad, bitorder="little").view(np.uint64)
            self.words.append(w)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(w).astype(np.int64))]))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        q, r = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << r) - np.uint64(1)
        return self.counts[level][q] + np.bitwise_count(self.words[level][q] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        a, b = np.zeros_like(i), i.copy()
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            ra, rb = self._ones(level, a), self._ones(level, b)
            a = np.where(one, self.zeros[level] + ra, a - ra)
            b = np.where(one, self.zeros[level] + rb, b - rb)
        return b - a

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level in range(self.bits):
            q, r = i >> 6, (i & 63).astype(np.uint64)
            one = ((self.words[level][q] >> r) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, i)
            i = np.where(one == 1, self.zeros[level] + ones, i - ones)
            out = (out << 1) | one
        return out


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """text: symbols 1..symbols in runs, each run ended by a 0."""
        self.sa = None
        order = suffix_array(text)
        before = text[order - 1]
        before[order == 0] = 0
        self.tree = WaveletMatrix(before, symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        keep = (order % SAMPLE == 0) | (before == 0)
        self.sampled = np.full(len(order), -1, np.int64)
        self.sampled[keep] = order[keep]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: (m, width) with each pattern at the right end of its row. Row ranges lo, hi; empty where there is none."""
        m, width = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.tree.n, np.int64)
        live = np.arange(m)
        for step in range(width):
            live = live[(lengths[live] > step) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, width - 1 - step]
            lo[live] = self.below[c] + self.tree.rank(c, lo[live])
            hi[live] = self.below[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one."""
        out, walked, at = np.full(len(rows), -1, np.int64), 0, rows.copy()
        left = np.arange(len(rows))
        while len(left):
            found = self.sampled[at]
            done = found >= 0
            out[left[done]] = found[done] + walked
            left, at = left[~done], at[~done]
            c = self.tree.access(at)
            at = self.below[c] + self.tree.rank(c, at)
            walked += 1
        return out
