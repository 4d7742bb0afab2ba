"""A run-length index of a few texts: their Burrows-Wheeler transform as runs, with sampled run ends.

Suffixes are sorted by prefix doubling.  The transform is kept as runs of one symbol: for each its start,
the row that its first row maps to, and the text positions of its first and last row.  Repeats put equal
symbols next to each other, so repetitive texts have few runs.

matching() gives matching statistics: for every position of a pattern, the length of the longest match
of what begins there with any place in the texts.  It streams patterns from right to left, all of them
in step: where the next symbol isn't that of the current row, the nearest runs of that symbol above and
below are tried, and the sampled ends tell which of the two agrees longer.
"""

from __future__ import annotations

import numpy as np

LOOK = 32  # bytes compared at once


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions by the order of what begins there; symbols are below 512, and the last is 0."""
    n, width = len(symbols), 6
    padded = np.concatenate((symbols, np.zeros(width, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = key << 9 | padded[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        if rank[order[-1]] == n - 1:
            return order
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - width)] = rank[width:] + 1
        key, width = rank * (n + 1) + behind, width * 2


class RunIndex:
    """Index of texts given as bytes end to end and where each begins (and the last ends)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        sizes = np.diff(bounds)
        symbols = np.zeros(len(data) + len(sizes), np.int64)  # each text ends in a 0
        symbols[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data.astype(np.int64) + 1
        order = suffix_order(symbols)
        before = symbols[order - 1]
        new = np.concatenate(([True], before[1:] != before[:-1]))
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(order)))
        self.head = before[self.start]
        self.first, self.last = order[self.start], order[self.start + self.size - 1]
        self.by_head = np.argsort(self.head, kind="stable")
        self.key = self.head[self.by_head] * self.runs + self.by_head
        self.maps_to = np.empty(self.runs, np.int64)
        self.maps_to[self.by_head] = np.cumsum(self.size[self.by_head]) - self.size[self.by_head]
        self.symbols = np.concatenate((symbols, np.zeros(LOOK, np.int64)))

    @property
    def runs(self) -> int:
        return len(self.start)

    def agreeing(self, at: np.ndarray, pattern: np.ndarray, begin: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from text positions at agree with the pattern's from begin on, up to most."""
        out, going, done = np.zeros(len(at), np.int64), np.arange(len(at)), 0
        step = np.arange(LOOK)
        while len(going):
            theirs = self.symbols[np.minimum(at[going, None] + done + step, len(self.symbols) - 1)]
            ours = pattern[np.minimum(begin[going, None] + done + step, len(pattern) - 1)]
            differ = (theirs != ours) | (done + step >= most[going, None])
            out[going] += np.where(differ.any(1), differ.argmax(1), LOOK)
            going, done = going[~differ.any(1)], done + LOOK
        return out

    def matching(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Matching statistics of patterns, given like texts: a length for each byte."""
        out, sizes = np.zeros(len(data), np.int64), np.diff(bounds)
        pattern = data.astype(np.int64) + 1
        longest = np.argsort(-sizes, kind="stable")
        end, sizes = bounds[1:][longest], sizes[longest]
        row, length = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
        for back in range(1, int(sizes.max(initial=0)) + 1):
            live = int(np.searchsorted(-sizes, -back, "right"))
            at = end[:live] - back
            symbol = pattern[at]
            run = np.searchsorted(self.start, row[:live], "right") - 1
            other = np.flatnonzero(self.head[run] != symbol)
            moved, grown = self.maps_to[run] + row[:live] - self.start[run], length[:live] + 1
            if len(other):
                c, most, begin = symbol[other], length[:live][other], at[other] + 1
                nearest = np.searchsorted(self.key, c * self.runs + run[other])
                best, place = np.full(len(other), -1, np.int64), np.zeros(len(other), np.int64)
                for step, sample in ((0, self.first), (-1, self.last)):
                    k = nearest + step
                    there = self.by_head[np.clip(k, 0, self.runs - 1)]
                    has = (k >= 0) & (k < self.runs) & (self.head[there] == c)
                    there, has = there[has], np.flatnonzero(has)
                    agree = self.agreeing(sample[there], pattern, begin[has], most[has])
                    goes = self.maps_to[there] + (self.size[there] - 1 if step else 0)
                    better = agree > best[has]
                    best[has[better]], place[has[better]] = agree[better], goes[better]
                moved[other], grown[other] = place, best + 1
            row[:live], length[:live] = moved, grown
            out[at] = grown
        return out
