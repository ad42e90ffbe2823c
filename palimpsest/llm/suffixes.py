"""Suffix sorting by prefix polynomial hashes, in numpy.

Hashes are polynomials over 64-bit words of random byte codes, modulo 2**64 with an odd base, so the hash of any
slice comes from two prefixes. Two suffixes compare by a binary search for their common extension; many pairs are
compared at once, and sorts merge all runs of all groups level by level. Extensions that decide a result are held
against the bytes themselves.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(400)
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 17)
        for i, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def prefixes(data: np.ndarray) -> np.ndarray:
    """Prefix hashes of bytes: entry i is for the first i of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * powers(len(data))[0], out=out[1:])
    return out


def slices(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Mixed hashes of slices; equal slices have equal hashes wherever they are."""
    return mix((prefix[stop] - prefix[start]) * powers(len(prefix))[1][start])


def windows(prefix: np.ndarray, length: int) -> np.ndarray:
    """Mixed hashes of all slices of one length."""
    n = len(prefix) - length
    return mix((prefix[length:] - prefix[:n]) * powers(len(prefix))[1][:n])


def least_in(value: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, from prefix and suffix minima of blocks."""
    n = len(value) - width + 1
    padded = np.full(-(-len(value) // width) * width, np.iinfo(value.dtype).max, value.dtype)
    padded[: len(value)] = value
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Suffixes:
    """Slices data[begin:end], compared from their beginnings on."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.data, self.begin, self.size = data, begin, end - begin
        self.prefix = prefixes(data)
        self.back = powers(len(self.prefix))[1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        a, b = self.begin[i], self.begin[j]
        while (going := np.flatnonzero(low < high)).size:
            half = (low[going] + high[going] + 1) >> 1
            x, y = a[going], b[going]
            same = (self.prefix[x + half] - self.prefix[x]) * self.back[x] == (self.prefix[y + half] - self.prefix[y]) * self.back[y]
            low[going[same]] = half[same]
            high[going[~same]] = half[~same] - 1
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before suffix j; ties by number."""
        n = self.common(i, j)
        short = (n == self.size[i]) | (n == self.size[j])
        a, b = (self.data[np.minimum(self.begin[k] + n, len(self.data) - 1)] for k in (i, j))
        tied = self.size[i] == self.size[j]
        return np.where(short, np.where(tied, i < j, self.size[i] < self.size[j]), a < b)

    def sort(self, bounds: np.ndarray) -> np.ndarray:
        """Numbers of the suffixes, sorted within each group of consecutive numbers: a mergesort from below."""
        order = np.arange(int(bounds[-1]))
        size = np.diff(bounds)
        group = np.repeat(np.arange(len(size)), size)
        within = order - bounds[:-1][group]
        run = 1
        while run < size.max(initial=0):
            some = np.flatnonzero(size[group] > run)
            block = within[some] // run
            other = bounds[:-1][group[some]] + (block ^ 1) * run  # where the run that this one merges with begins
            stop = np.minimum(other + run, bounds[1:][group[some]])
            low, high = np.minimum(other, stop), stop.copy()
            base = low.copy()
            me = order[some]
            while (going := np.flatnonzero(low < high)).size:
                half = (low[going] + high[going]) >> 1
                before = self.less(order[half], me[going])
                low[going[before]] = half[before] + 1
                high[going[~before]] = half[~before]
            ahead = low - base
            mine = within[some] - block * run
            new = order.copy()
            new[bounds[:-1][group[some]] + (block & ~1) * run + mine + ahead] = me
            order = new
            run *= 2
        return order

    def neighbours(self, order: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Common extension of each suffix in ``order`` with the one before it, -1 at the beginning of a group."""
        out = np.full(len(order), -1, np.int64)
        inner = np.ones(len(order), bool)
        inner[bounds[:-1]] = False
        at = np.flatnonzero(inner)
        i, j = order[at - 1], order[at]
        n = self.common(i, j)
        raw, a, b = self.data.tobytes(), self.begin[i].tolist(), self.begin[j].tolist()
        for k, size in enumerate(n.tolist()):
            if raw[a[k] : a[k] + size] != raw[b[k] : b[k] + size]:  # two hashes collided
                x, y = self.data[a[k] : a[k] + size], self.data[b[k] : b[k] + size]
                n[k] = int(np.flatnonzero(x != y)[0])
        out[at] = n
        return out
