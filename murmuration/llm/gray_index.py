"""A hierarchical index of 64-bit codes in Gray order, searched by Hamming distance.

Sorted by the rank of the code in the reflected Gray sequence, neighbours differ
in few bits. Each run of ``FAN`` codes hangs below a node that holds the bits
they share; nodes are grouped likewise. A bit stated by an upper node is masked
out below it, so along any path every bit is compared once, and a whole group
goes as soon as the differences added up so far exceed the radius.
"""

from __future__ import annotations

import numpy as np

FAN = 8
#: Pairs (query, node) looked at together; more queries are split in halves.
FRONTIER = 1 << 21
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    def __init__(self, codes: np.ndarray):
        codes = codes.astype(np.uint64)
        self.order = np.argsort(gray_rank(codes), kind="stable")
        bits, mask = codes[self.order], np.full(len(codes), ALL)
        self.bits, self.rest = [bits], []
        while True:
            firsts = np.arange(0, len(bits), FAN)
            lead = np.repeat(bits[firsts], FAN)[: len(bits)]
            shared = np.bitwise_and.reduceat(mask, firsts) & ~np.bitwise_or.reduceat(bits ^ lead, firsts)
            self.rest.append(mask & ~np.repeat(shared, FAN)[: len(bits)])
            bits, mask = bits[firsts] & shared, shared
            self.bits.append(bits)
            if len(bits) == 1:
                self.rest.append(mask)
                break

    def labelled(self, label: np.ndarray) -> list[np.ndarray]:
        """The label of each node below which all codes have the same, else -1."""
        levels = [label[self.order]]
        for bits in self.bits[1:]:
            firsts = np.arange(len(bits)) * FAN
            least, most = np.minimum.reduceat(levels[-1], firsts), np.maximum.reduceat(levels[-1], firsts)
            levels.append(np.where(least == most, least, -1))
        return levels

    def search(
        self,
        queries: np.ndarray,
        radius: int,
        own: np.ndarray | None = None,
        labels: list[np.ndarray] | None = None,
    ) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) positions of all pairs within the radius; given labels of
        queries and nodes, of all pairs of different labels."""
        found = list(self._search(queries.astype(np.uint64), np.arange(len(queries)), radius, own, labels))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, at = (np.concatenate(x) for x in zip(*found, strict=True))
        return q, self.order[at]

    def _search(self, queries: np.ndarray, which: np.ndarray, radius: int, own, labels):
        q, node = which, np.zeros(len(which), np.int64)
        used = np.zeros(len(which), np.uint8)
        for level in range(len(self.bits) - 1, -1, -1):
            used = used + np.bitwise_count((queries[q] ^ self.bits[level][node]) & self.rest[level][node])
            near = used <= radius
            if labels is not None:
                near &= labels[level][node] != own[q]
            q, node, used = q[near], node[near], used[near]
            if level == 0:
                break
            if len(q) * FAN > FRONTIER and len(which) > 1:
                for half in np.array_split(which, 2):
                    yield from self._search(queries, half, radius, own, labels)
                return
            width = len(self.bits[level - 1])
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            inside = child < width
            q, used, node = np.repeat(q, FAN)[inside], np.repeat(used, FAN)[inside], child[inside]
        yield q, node


def linked(codes: np.ndarray, radius: int, block: int = 512) -> np.ndarray:
    """For each code the position of the first code it is joined to by links of
    at most ``radius`` bits. Pairs are used block by block and not kept. What is
    already joined to a query is not looked for again, so a dense group costs
    little after its first few queries."""
    label = np.arange(len(codes))
    index = GrayIndex(codes)
    first, size = 0, min(16, block)
    while first < len(codes):
        now = np.arange(first, min(first + size, len(codes)))
        q, at = index.search(codes[now], radius, label[now], index.labelled(label))
        q = q + first
        while len(q):
            a, b = label[q], label[at]
            open_ = a != b
            if not open_.any():
                break
            q, at, a, b = q[open_], at[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = label[label]
                if (further == label).all():
                    break
                label = further
        first, size = first + size, min(2 * size, block)
    return label
