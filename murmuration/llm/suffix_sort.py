"""Sorting suffixes by hashes of their prefixes.

Polynomial prefix hashes of every string tell whether two strings agree in their
first ``n`` bytes; a binary search over ``n`` finds where they part, so one
comparison takes a logarithmic number of steps however long the strings are.
With it, a bottom-up merge sort orders many groups of strings at once. Since
hashes can collide, the lengths common to neighbours are then measured on the
bytes, and if the order is not that of the bytes, they are sorted directly.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_229)
CODES = _RNG.integers(0, 2**64, (2, 257), dtype=np.uint64)
BASES = (_RNG.integers(0, 2**62, 2, dtype=np.uint64) << np.uint64(2)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of a base and of its inverse modulo 2^64, as many as asked for."""

    def __init__(self, which: int):
        self.base = int(BASES[which])
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_POWERS = [Powers(0), Powers(1)]


class PrefixHashes:
    """Hashes of all substrings of one long byte string."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _POWERS[which].get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(CODES[which][data] * up[: len(data)], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Of the substring of this size at every place."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (self.sums[last] - self.sums[first]) * self.down[first]


class Strings:
    """Rows of bytes, each of its own length, with the hashes of all prefixes."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray):
        self.rows, self.sizes = rows, sizes
        up, _ = _POWERS[0].get(rows.shape[1] + 1)
        self.prefix = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        np.cumsum(CODES[0][rows] * up[: rows.shape[1]], axis=1, out=self.prefix[:, 1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many first bytes two rows share, by binary search over the hashes."""
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.sizes[i], self.sizes[j])
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.prefix[i, middle] == self.prefix[j, middle]
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether row i sorts strictly before row j; a prefix comes first."""
        n = self.common(i, j)
        last = self.rows.shape[1] - 1
        a = np.where(n < self.sizes[i], self.rows[i, np.minimum(n, last)].astype(np.int64), -1)
        b = np.where(n < self.sizes[j], self.rows[j, np.minimum(n, last)].astype(np.int64), -1)
        return a < b

    def exact_common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        differ = self.rows[i] != self.rows[j]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), self.rows.shape[1])
        return np.minimum(n, np.minimum(self.sizes[i], self.sizes[j]))


def merge_sort(strings: Strings, group: np.ndarray) -> np.ndarray:
    """The order of the rows by (group, string). Groups come in ascending order."""
    n = len(group)
    order = np.arange(n)
    width, largest = 1, int(np.bincount(np.unique(group, return_inverse=True)[1]).max()) if n else 0
    # runs of a group, counted from its first row, are merged in pairs
    start = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), np.arange(n), 0)) if n else order
    stop = np.append(np.flatnonzero(np.diff(group)) + 1, n)
    end = stop[np.searchsorted(stop, np.arange(n), "right")] if n else order
    while width < largest:
        place = np.arange(n)
        run = (place - start) // width
        own = start + run * width
        left = run % 2 == 0
        first = np.where(left, own + width, own - width)  # of the run it is merged with
        active = (first < end) & (first >= start)
        low = np.where(active, first, 0)
        high = np.where(active, np.minimum(first + width, end), 0)
        bound = low.copy()
        # how many of the other run come before: rows of the left run win ties
        while True:
            open_ = np.flatnonzero(bound < high)
            if not len(open_):
                break
            middle = (bound[open_] + high[open_]) >> 1
            mine, other = order[open_], order[middle]
            is_left = left[open_]
            i, j = np.where(is_left, other, mine), np.where(is_left, mine, other)
            earlier = strings.before(i, j)  # other before mine, or mine before other
            goes_on = np.where(is_left, earlier, ~earlier)
            bound[open_] = np.where(goes_on, middle + 1, bound[open_])
            high[open_] = np.where(goes_on, high[open_], middle)
        ahead = np.where(active, bound - low, 0)
        base = np.where(left | ~active, own, first)
        target = base + (place - own) + ahead
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    return order


def sorted_common(strings: Strings, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (group, string), and how many bytes each row shares with the
    one before it, -1 for the first of a group: checked on the bytes."""
    order = merge_sort(strings, group)
    while True:
        i, j = order[:-1], order[1:]
        common = strings.exact_common(i, j)
        last = strings.rows.shape[1] - 1
        a = np.where(common < strings.sizes[i], strings.rows[i, np.minimum(common, last)].astype(np.int64), -1)
        b = np.where(common < strings.sizes[j], strings.rows[j, np.minimum(common, last)].astype(np.int64), -1)
        inside = group[i] == group[j]
        if not (inside & (a > b)).any():
            return order, np.concatenate(([-1] if len(order) else [], np.where(inside, common, -1))).astype(np.int64)
        # hashes collided
        keys = [strings.rows[k, : strings.sizes[k]].tobytes() for k in range(len(group))]
        order = np.array(sorted(range(len(group)), key=lambda k: (group[k], keys[k])), np.int64)
