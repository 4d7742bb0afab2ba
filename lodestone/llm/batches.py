"""Vectorised handling of words and characters in Arrow batches of whole texts.

A batch is worked through in pieces of about PIECE bytes, a long text being a piece of its own, so
memory follows the longest text and not the batch.  Word hashes are 64 bits wide: a polynomial over
random byte values, read off one running sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
BLOCK = 1 << 20

_random = np.random.default_rng(20240229)
BYTE_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = int(_random.integers(1, 2**62, dtype=np.uint64)) * 2 + 1
PLACE_VALUE = _random.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# byte classes: 0 white space, 1 letters and all beyond ASCII, 2 digits, 3 all else
KIND = np.full(256, 3, np.uint8)
KIND[SPACE] = 0
KIND[65:91] = KIND[97:123] = KIND[128:] = 1
KIND[48:58] = 2

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and its inverse modulo 2 ** 64, for i < n."""
    if len(_powers[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((STEP, pow(STEP, -1, 2**64))):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Texts:
    """Some texts in a row: their bytes, and where each begins; first is the row of the batch."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def counts(self, places: np.ndarray) -> np.ndarray:
        """Of sorted byte positions, where each text's begin (n + 1 values)."""
        return np.searchsorted(places, self.bounds)

    def raw(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def pieces(column: pa.Array) -> Iterator[Texts]:
    """The texts of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, pa.scalar("", column.type)).cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield Texts(at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop


def runs(texts: Texts, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of one kind other than 0, within texts."""
    k = kind[texts.data]
    if not len(k):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(len(k) + 1, bool)
    change[1:-1] = k[1:] != k[:-1]
    change[texts.bounds] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    full = k[starts] != 0
    return starts[full], ends[full]


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of ``[^\\x20\\x09-\\x0D]+``."""
    return runs(texts, (~SPACE).astype(np.uint8))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans in ascending order are taken BLOCK bytes at a time."""
    if len(data) <= 2 * BLOCK or (starts[1:] < starts[:-1]).any() or (ends[1:] < ends[:-1]).any():
        return block_hashes(data, starts, ends)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        first = starts[at]
        out[at:stop] = block_hashes(data[first : ends[stop - 1]], starts[at:stop] - first, ends[at:stop] - first)
        at = stop
    return out


def block_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbours of one text, and bounds of the texts among them; bounds are of h."""
    if n == 1:
        return h, bounds
    size = np.diff(bounds)
    many = np.maximum(size - n + 1, 0)
    out = np.concatenate(([0], np.cumsum(many)))
    # position of each gram among h: shifted by what the texts before it have lost
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], many)
    g = np.zeros(len(at), np.uint64)
    for k in range(n):
        g += h[at + k] * PLACE_VALUE[k]
    return mixed(g), out


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of each text's rows, 0 for texts without any."""
    total = np.zeros((len(bounds), *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = total[:-1]
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return out


def code_points(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and where each text's begin."""
    points = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))
    return points, lead[texts.bounds]
