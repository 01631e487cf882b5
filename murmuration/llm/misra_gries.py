"""Misra-Gries summaries of weighted keys, which merge by adding them up."""

from __future__ import annotations

import numpy as np


class Summary:
    """At most ``capacity`` keys with counts. Where there are more, the count of
    the first one too many is taken from all, so each such step takes it from
    ``capacity + 1`` keys at least, and all steps together take no more than the
    mass divided by that from any key: what occurs more often is always here.
    Additions wait until there are as many as the summary may hold."""

    def __init__(self, capacity: int):
        self.capacity = max(1, capacity)
        self.taken = 0
        self._keys = [np.zeros(0, np.uint32)]
        self._counts = [np.zeros(0, np.int64)]
        self._waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._keys.append(keys)
        self._counts.append(counts.astype(np.int64))
        self._waiting += len(keys)
        if self._waiting > self.capacity:
            self._settle()

    def merge(self, other: Summary) -> None:
        """Take in another summary of the same capacity; bounds add up."""
        self.add(*other.counts())
        self.taken += other.taken

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order, and how often each occurs at least."""
        self._settle()
        return self._keys[0], self._counts[0]

    def at_least(self, threshold: int) -> np.ndarray:
        """All keys that occur so often, and some that do a little less often."""
        keys, counts = self.counts()
        return keys[counts + self.taken >= threshold]

    def _settle(self) -> None:
        if self._waiting:
            keys = np.concatenate(self._keys)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], np.concatenate(self._counts)[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, counts = keys[first], np.add.reduceat(counts, first)
            if len(keys) > self.capacity:
                at = len(keys) - self.capacity - 1
                cut = np.partition(counts, at)[at]
                keys, counts = keys[counts > cut], counts[counts > cut] - cut
                self.taken += int(cut)
            self._keys, self._counts, self._waiting = [keys], [counts], 0
