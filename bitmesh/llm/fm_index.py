"""An FM-index over a sequence of word numbers, for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a sequence in which 0 separates runs; each 0 counts as a symbol of its own, by place.

    Prefix doubling: it ends once the sorted length exceeds the longest
    repeat, which no separator lies in.
    """
    n = len(sequence)
    breaks = sequence == 0
    number = np.cumsum(breaks)
    rank = np.where(breaks, number - 1, sequence + number[-1] if n else 0).astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (rank.max(initial=0) + after.max(initial=0) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        dense = np.cumsum(new) - 1
        rank = np.empty(n, np.int64)
        rank[order] = dense
        if n == 0 or dense[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit level at a time."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for shift in range(self.levels - 1, -1, -1):
            bit = (sequence >> shift) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        self.base = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones in enumerate(self.ones):
            before = ones[at]
            at = np.where((symbol >> (self.levels - 1 - level)) & 1, self.zeros[level] + before, at - before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place ``at``."""
        return self._walk(symbol, at) - self.base[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros(len(at), np.int64)
        for level, ones in enumerate(self.ones):
            before = ones[at]
            bit = ones[at + 1] - before
            out = out << 1 | bit
            at = np.where(bit, self.zeros[level] + before, at - before)
        return out


class FMIndex:
    """Counts and locates patterns of symbols from 1 on by backward search; patterns never reach over a 0."""

    def __init__(self, sequence: np.ndarray, symbols: int, sample: int = 16):
        # the index also has an end symbol, here a further 0
        sequence = np.r_[sequence, 0].astype(np.int64)
        suffixes = suffix_array(sequence)
        last = sequence[suffixes - 1]
        self.tree = WaveletMatrix(last, symbols)
        self.less = np.r_[0, np.cumsum(np.bincount(sequence, minlength=symbols))]
        # a walk to the left ends at a sampled place, and at the start of its run at the latest
        self.sampled = (suffixes % sample == 0) | (last == 0)
        self.slot = np.cumsum(self.sampled) - 1
        self.places = suffixes[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each row of ``patterns``."""
        lo, hi = self.less[patterns[:, -1]], self.less[patterns[:, -1] + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[:, j]
            lo = self.less[c] + self.tree.rank(c, lo)
            hi = self.less[c] + self.tree.rank(c, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of the suffixes in these rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        going = np.flatnonzero(~self.sampled[rows])
        while len(going):
            c = self.tree.access(rows[going])
            rows[going] = self.less[c] + self.tree.rank(c, rows[going])
            steps[going] += 1
            going = going[~self.sampled[rows[going]]]
        return self.places[self.slot[rows]] + steps
