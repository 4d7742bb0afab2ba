"""Components of links within one cluster of sets, by index-level and answer-level skipping.

Index level: a list holds, for one n-gram, the sets whose prefix has it, in blocks of equal set size,
and within a block by how many n-grams of the set are left from there on.  A probe enters only blocks
of sizes that can link; a block is skipped whole where the probe itself has too few n-grams left, and
otherwise left at the first position where the listed sets have too few.

Answer level: a set that links to a pivot becomes its follower and is not indexed.  Later its answers
are derived from the pivot's: as Jaccard distance is a metric, a set farther from a pivot than the
threshold plus the distance of its farthest follower links to none of them, and of the others only
followers far enough from the pivot, in components not joined yet, are compared.

All steps work on whole arrays; what they expand is cut into pieces of about PIECE entries.  Overlaps
are counted by binary search, or with bit rows where all n-grams of the cluster fit in few words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 21
FEW = 16  # so few sets are compared at once, without lists


def need(n: np.ndarray, percent: float) -> np.ndarray:
    """The least overlap of a set of size n with any that it links to."""
    return np.ceil(n * percent / 100 - 1e-9).astype(np.int64)


def need_both(n: np.ndarray, k: np.ndarray, percent: float) -> np.ndarray:
    """The least overlap of linked sets of sizes n and k."""
    return np.ceil((n + k) * percent / (100 + percent) - 1e-9).astype(np.int64)


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of ranges, and which range each is of."""
    of = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts), of


def cut(weights: np.ndarray) -> Iterator[slice]:
    """Slices of about PIECE together."""
    upto, at = np.cumsum(weights), 0
    while at < len(weights):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE, "right")))
        yield slice(at, stop)
        at = stop


class Union:
    """Union-find over 0 .. n-1; the smallest number of a component is its root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        up = self.up
        while not np.array_equal(again := up[up], up):  # flatten all paths
            up = again
        self.up = up
        return up[i]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.find(a), self.find(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


class Sets:
    """Sets by ascending size; n-grams that stand in one set only are left out, the rarest come first."""

    def __init__(self, size: np.ndarray, rows: list[np.ndarray], percent: float):
        self.size, self.percent = size.astype(np.int64), percent
        held = np.array([len(r) for r in rows], np.int64)
        _, flat, often = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        of = np.repeat(np.arange(len(rows)), held)
        keep = often[flat] > 1
        of, flat = of[keep], rank[flat[keep]]
        self.width = len(often) + 1
        self.keys = np.sort(of * self.width + flat)  # by set, then by rank
        self.flat = self.keys % self.width
        self.bounds = np.searchsorted(of, np.arange(len(rows) + 1))
        self.held = np.diff(self.bounds)
        alone = int((often == 1).sum())
        words = (len(often) - alone + 63) // 64
        self.bits = None
        if len(rows) > FEW and words <= 4 * self.held.mean() and words * len(rows) <= PIECE:
            self.bits = np.zeros((len(rows), words), np.uint64)
            at = (self.flat - alone).astype(np.uint64)
            np.bitwise_or.at(self.bits, (of, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))

    def overlaps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many n-grams each pair has in common."""
        swap = self.held[a] > self.held[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = np.zeros(len(a), np.int64)
        if not len(self.keys):
            return out
        if self.bits is not None:
            for some in cut(np.full(len(a), self.bits.shape[1])):
                out[some] = np.bitwise_count(self.bits[a[some]] & self.bits[b[some]]).sum(1)
            return out
        for some in cut(self.held[a]):
            at, of = spread(self.bounds[a[some]], self.held[a[some]])
            wanted = b[some][of] * self.width + self.flat[at]
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[some] = np.bincount(of[self.keys[place] == wanted], minlength=len(a[some]))
        return out

    def distances(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Overlap, and Jaccard distance."""
        o = self.overlaps(a, b)
        return o, 1 - o / (self.size[a] + self.size[b] - o)

    def linked(self, a: np.ndarray, b: np.ndarray, o: np.ndarray) -> np.ndarray:
        return 100 * o >= self.percent * (self.size[a] + self.size[b] - o)

    def prefix(self, sets: np.ndarray, percent: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the n-grams that any set at that similarity must share one of: rank, which set, how many are left."""
        many = np.maximum(0, self.held[sets] - need(self.size[sets], percent) + 1)
        at, of = spread(self.bounds[sets], many)
        return self.flat[at], of, self.bounds[sets + 1][of] - at


class Lists:
    """Inverted lists of some sets' prefixes, in blocks."""

    def __init__(self, sets: Sets, members: np.ndarray, percent: float):
        self.sets, self.percent = sets, percent
        token, of, left = sets.prefix(members, percent)
        size = sets.size[members][of]
        order = np.lexsort((-left, size, token))
        token, size, left = token[order], size[order], left[order]
        self.owner = members[of[order]]
        self.wide = int(sets.size.max()) + 1
        key = token * self.wide + size
        self.first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        self.key, self.block_size = key[self.first], size[self.first]
        self.high = int(left.max(initial=0)) + 1
        block = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(key))))
        self.place = block * (self.high + 1) + self.high - left

    def pairs(self, probes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(probe, listed set) that may be as similar, piece by piece; a pair may come more than once."""
        sets, percent = self.sets, self.percent
        token, of, left = sets.prefix(probes, percent)
        size = sets.size[probes][of]
        low = np.searchsorted(self.key, token * self.wide + need(size, percent))
        high = np.searchsorted(self.key, token * self.wide + np.minimum((size * 100 / percent + 1e-9).astype(np.int64), self.wide - 1), "right")
        for some in cut(high - low):
            block, which = spread(low[some], (high - low)[some])
            least = need_both(size[some][which], self.block_size[block], percent)
            enter = left[some][which] >= least
            block, which, least = block[enter], which[enter], least[enter]
            begin = self.first[block]
            stop = np.searchsorted(self.place, block * (self.high + 1) + self.high - least, "right")
            many = np.maximum(0, stop - begin)
            for part in cut(many):
                at, k = spread(begin[part], many[part])
                yield probes[of[some][which[part][k]]], self.owner[at]


def similar(sets: Sets, lists: Lists, probes: np.ndarray, both: Union | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(probe, listed set, overlap, distance) of different pairs, of different components only if both is given."""
    m = np.int64(len(sets.size))
    for a, b in lists.pairs(probes):
        pair = np.unique((a * m + b)[a != b])
        a, b = pair // m, pair % m
        if both is not None:
            apart = both.find(a) != both.find(b)
            a, b = a[apart], b[apart]
        o, distance = sets.distances(a, b)
        yield a, b, o, distance


def solved(size: np.ndarray, rows: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set (by ascending size) the first set of its component of links."""
    m = len(rows)
    sets, both, everyone = Sets(size, rows, percent), Union(m), np.arange(m)
    if m <= FEW:
        a, b = np.triu_indices(m, 1)
        fit = sets.size[a] >= need(sets.size[b], percent)
        a, b = a[fit], b[fit]
        good = sets.linked(a, b, sets.overlaps(a, b))
        both.join(a[good], b[good])
        return both.find(everyone)
    pivot_of, apart = everyone.copy(), np.zeros(m)

    def place(todo: np.ndarray) -> np.ndarray:
        """The pivots among sets that link to no pivot so far; all others become followers."""
        pivots, at, step = todo[:1], 1, 1
        while at < len(todo):
            chunk = todo[at : at + step]
            at, step = at + step, 2 * step
            near = np.full(len(chunk), np.inf)
            for a, b, o, distance in similar(sets, Lists(sets, pivots, percent), chunk):
                good = sets.linked(a, b, o)
                a, b, distance = a[good], b[good], distance[good]
                both.join(a, b)
                order = np.lexsort((distance, a))
                own, first = np.unique(a[order], return_index=True)
                i, d, p = np.searchsorted(chunk, own), distance[order][first], b[order][first]
                nearer = d < near[i]
                near[i[nearer]], pivot_of[own[nearer]], apart[own[nearer]] = d[nearer], p[nearer], d[nearer]
            if len(free := chunk[np.isinf(near)]):
                pivots = np.sort(np.concatenate((pivots, place(free))))
        return pivots

    pivots = place(everyone)
    if len(np.unique(both.find(pivots))) > 1:
        followers = np.argsort(pivot_of, kind="stable")
        bounds = np.searchsorted(pivot_of[followers], np.arange(m + 1))
        radius = np.zeros(m)
        np.maximum.at(radius, pivot_of, apart)
        limit = 1 - percent / 100 + 1e-9
        reach = 100 * (1 - limit - float(radius.max()))
        for a, p, _, distance in similar(sets, Lists(sets, pivots, max(reach, 1.0)), everyone, both):
            close = distance <= limit + radius[p]
            a, p, distance = a[close], p[close], distance[close]
            for some in cut(np.diff(bounds)[p]):
                x, y, d = a[some], p[some], distance[some]
                open_ = both.find(x) != both.find(y)
                x, y, d = x[open_], y[open_], d[open_]
                at, k = spread(bounds[y], np.diff(bounds)[y])
                x, d, j = x[k], d[k], followers[at]
                small, large = np.minimum(sets.size[x], sets.size[j]), np.maximum(sets.size[x], sets.size[j])
                may = (apart[j] >= d - limit) & (100 * small >= percent * large)
                x, j = x[may], j[may]
                good = sets.linked(x, j, sets.overlaps(x, j))
                both.join(x[good], j[good])
    return both.find(everyone)
