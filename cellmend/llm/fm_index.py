"""FM-index over a sequence of small integers: suffix array, wavelet matrix, backward search, sampled locate."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; only suffixes that still share a rank are sorted again. The last symbol must be unique and least."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    key = text[order].astype(np.int64)
    pos = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    head = np.concatenate(([True], key[1:] != key[:-1])) if n else np.empty(0, dtype=bool)
    rank[order] = np.maximum.accumulate(np.where(head, pos, 0)) if n else pos
    open_ = ~(head & np.concatenate((head[1:], [True]))) if n else head
    at = np.flatnonzero(open_)  # places in order whose suffix shares its rank
    k = 1
    while len(at):
        s = order[at]
        nxt = s + k
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[s] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        s, key = s[by], key[by]
        order[at] = s
        head = np.concatenate(([True], key[1:] != key[:-1]))
        # a rank is the place of its group's first member
        rank[s] = np.maximum.accumulate(np.where(head, at, 0))
        at = at[~(head & np.concatenate((head[1:], [True])))]
        k *= 2
    return order


class Wavelet:
    """Wavelet matrix: rank of many (symbol, prefix) pairs, and symbol with its rank at many places, at once."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        cur = seq
        for level in range(self.bits - 1, -1, -1):
            bit = (cur >> level) & 1
            ranks = np.zeros(len(cur) + 1, dtype=np.int32)
            np.cumsum(bit, out=ranks[1:])
            self.ones.append(ranks)
            self.zeros.append(len(cur) - int(ranks[-1]))
            mask = bit.astype(bool)
            cur = np.concatenate((cur[~mask], cur[mask]))
        self.start = self._down(np.arange(1 << self.bits), np.zeros(1 << self.bits, dtype=np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = self.ones[k][i]
            i = np.where((symbol >> level) & 1, self.zeros[k] + one, i - one)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs before i."""
        return self._down(symbol, i) - self.start[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and how often it occurs before i."""
        symbol = np.zeros(len(i), dtype=np.int64)
        for k in range(self.bits):
            one = self.ones[k][i]
            bit = self.ones[k][i + 1] - one
            symbol = symbol * 2 + bit
            i = np.where(bit, self.zeros[k] + one, i - one)
        return symbol, i - self.start[symbol]


class FMIndex:
    """Over symbols 1..sigma-1; 0 is appended as the end mark."""

    SAMPLE = 8

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.concatenate((text, [0])).astype(np.int64)
        sa = suffix_array(text)
        self.bwt = Wavelet(text[sa - 1], sigma)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:-1]
        self.sampled = sa % self.SAMPLE == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of patterns, given as right-aligned rows; empty where a pattern does not occur."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for step in range(patterns.shape[1]):
            live = live[(lengths[live] > step) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, patterns.shape[1] - 1 - step]
            lo[live] = self.less[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.less[c] + self.bwt.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled suffix."""
        out = np.empty(len(rows), dtype=np.int64)
        at, open_, walked = rows.copy(), np.arange(len(rows)), 0
        while len(open_):
            here = self.sampled[at]
            out[open_[here]] = self.samples[self.sample_rank[at[here]]] + walked
            open_, at = open_[~here], at[~here]
            if len(open_):
                c, r = self.bwt.access(at)
                at = self.less[c] + r
            walked += 1
        return out
