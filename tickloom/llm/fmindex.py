"""A compressed full-text index over runs of symbols, with searches for many patterns at once.

The text is the runs, each followed by the symbol 0. Suffixes are sorted up to ``DEPTH`` symbols, which is
enough for backward search of patterns shorter than that. The Burrows-Wheeler transform lies in a wavelet
matrix: a bit vector per bit of a symbol with a count every 64 bits.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class Bits:
    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = i >> 6
        inside = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)


class Wavelet:
    def __init__(self, symbols: np.ndarray, most: int):
        self.levels: list[Bits] = []
        for bit in range(max(1, int(most).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append(Bits(ones))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

        # where each symbol's places begin after the last level
        self.begin = self._down(np.arange(most + 1), np.zeros(most + 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(self.levels):
            ones = level.rank(at)
            at = np.where((symbol >> (len(self.levels) - 1 - i) & 1).astype(bool), level.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``low`` and before ``high``."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return both[: len(low)] - self.begin[symbol], both[len(low) :] - self.begin[symbol]


def suffixes(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes by their first DEPTH symbols."""
    rank, width, order = text.astype(np.int64), 1, None
    while True:
        follow = np.zeros_like(rank)
        follow[:-width] = rank[width:] + 1
        key = rank * (len(text) + int(text.max(initial=0)) + 2) + follow
        order = np.argsort(key)
        key = key[order]
        fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty_like(rank)
        rank[order] = fresh
        width *= 2
        if width >= DEPTH or width >= len(text) or fresh[-1] == len(text) - 1:
            return order


class Index:
    """Runs of symbols (1 and up, shorter than DEPTH) with weights."""

    def __init__(self, runs: list[np.ndarray], weights: np.ndarray):
        lengths = np.array([len(r) for r in runs], np.int64)
        self.ends = np.cumsum(lengths + 1)
        self.starts = self.ends - lengths - 1
        self.text = np.zeros(int(self.ends[-1]), np.int64)
        self.text[np.repeat(self.starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())] = np.concatenate(runs)
        order = suffixes(self.text)
        most = int(self.text.max())
        self.wavelet = Wavelet(self.text[order - 1], most)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=most + 1))])
        self.weight = np.concatenate([[0], np.cumsum(np.repeat(weights, lengths + 1)[order])])

    def longest(self, low_end: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Backward search from places ``end`` of the text, no further than ``low_end``: the least start of a
        pattern that occurs twice or more by weight."""
        start = end.copy()
        lanes = np.flatnonzero(start > low_end)
        low, high = np.zeros(len(lanes), np.int64), np.full(len(lanes), len(self.text))
        while len(lanes):
            symbol = self.text[start[lanes] - 1]
            before, after = self.wavelet.rank(symbol, low, high)
            low, high = self.first[symbol] + before, self.first[symbol] + after
            again = self.weight[high] - self.weight[low] >= 2
            start[lanes[again]] -= 1
            on = again & (start[lanes] > low_end[lanes])
            lanes, low, high = lanes[on], low[on], high[on]
        return start

    def repeats(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, start, end) of the maximal intervals of at least ``least`` symbols that occur twice or more.

        Matching statistics of every run: a backward search stops at a place b; the longest repeat that
        begins at b, found by bisection, is where the search goes on.
        """
        run = np.flatnonzero(self.ends - 1 - self.starts >= least)
        end = self.ends[run] - 1
        out = []
        while len(run):
            begin = self.starts[run]
            start = self.longest(begin, end)
            long = end - start >= least
            out.append((run[long], (start - begin)[long], (end - begin)[long]))
            on = start > begin
            run, begin, stop, end = run[on], begin[on], start[on] - 1, end[on]
            # only matches of the least length matter, so none beyond stop + least
            reach, known = np.minimum(end - 1, stop + least), stop.copy()
            while len(lanes := np.flatnonzero(known < reach)):
                middle = (known[lanes] + reach[lanes] + 1) // 2
                holds = self.longest(stop[lanes], middle) == stop[lanes]
                known[lanes] = np.where(holds, middle, known[lanes])
                reach[lanes] = np.where(holds, reach[lanes], middle - 1)
            on = known - begin >= least
            run, end = run[on], known[on]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
