"""Cuckoo filters over 64-bit keys, filled and searched many keys at a time.

Four 16-bit fingerprints to a bucket, each key in one of two buckets that can be
told from each other's number and the fingerprint alone. Keys are given once
each; a filter answers "surely absent" or "perhaps present", and forgets again.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
ROUNDS = 200


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    def __init__(self, buckets: int):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets is a power of two")
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @staticmethod
    def for_keys(n: int) -> CuckooFilter:
        """Room for ``n`` keys at a load of at most 0.8."""
        return CuckooFilter(1 << max(1, int(np.ceil(np.log2(max(1, n) / (0.8 * SLOTS))))))

    @staticmethod
    def from_bytes(raw: bytes) -> CuckooFilter:
        made = CuckooFilter(1)
        made.table = np.frombuffer(raw, "<u2").reshape(-1, SLOTS).copy()
        return made

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _print(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = _mix(keys.astype(np.uint64))
        mark = (mixed >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (mixed & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, at = self._print(keys)
        here = (self.table[at] == mark[:, None]).any(axis=1)
        return here | (self.table[self._other(at, mark)] == mark[:, None]).any(axis=1)

    def _settle(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; which of them found one."""
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        first = np.concatenate(([True], sorted_at[1:] != sorted_at[:-1]))
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        empty = self.table[sorted_at] == 0
        fits = rank < empty.sum(axis=1)
        slot = np.argsort(~empty, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
        self.table[sorted_at[fits], slot[fits]] = mark[order][fits]
        done = np.zeros(len(at), bool)
        done[order[fits]] = True
        return done

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys that it does not hold yet. False if it is too full: then it
        must be made anew, larger, from the exact table of keys."""
        mark, at = self._print(keys)
        left = ~self._settle(mark, at)
        mark, at = mark[left], self._other(at[left], mark[left])
        slot = 0
        for _ in range(ROUNDS):
            if not len(mark):
                return True
            left = ~self._settle(mark, at)
            mark, at = mark[left], at[left]
            if not len(mark):
                return True
            # one of those that wait for a bucket takes a slot; its owner moves on
            _, chosen = np.unique(at, return_index=True)
            slot = (slot + 1) % SLOTS
            owners = self.table[at[chosen], slot].copy()
            self.table[at[chosen], slot] = mark[chosen]
            moved = self._other(at[chosen], owners)
            mark[chosen], at[chosen] = owners, moved
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that it holds."""
        mark, at = self._print(keys)
        for _ in range(2):  # in the one bucket, then in the other
            while True:
                match = self.table[at] == mark[:, None]
                hit = np.flatnonzero(match.any(axis=1))
                if not len(hit):
                    break
                slot = match[hit].argmax(axis=1)
                _, one = np.unique(at[hit] * SLOTS + slot, return_index=True)
                self.table[at[hit[one]], slot[one]] = 0
                keep = np.ones(len(mark), bool)
                keep[hit[one]] = False
                mark, at = mark[keep], at[keep]
            at = self._other(at, mark)
        if len(mark):
            raise KeyError("a key to delete is not in the filter")
