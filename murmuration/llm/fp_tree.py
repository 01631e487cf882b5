"""A frequent-pattern tree of documents, searched by branch and bound.

A document is a vector of (term, tf): only terms that queries ask for, the most
frequent first. Vectors that begin alike share the path from the root, so the
tree is the sorted list of vectors cut where neighbours part. A node keeps, of
the documents below it, the largest tf of every term, the smallest length factor
m and the smallest id; as a term's part of a score grows with tf and falls with
m, these bound every score below the node. A query goes depth first, best child
first, and leaves out what cannot reach its k-th best so far.
"""

from __future__ import annotations

import numpy as np

BILLION = 1_000_000_000
#: Documents of a leaf, if their vectors are not all the same.
LEAF = 16
#: Entries of the table of maxima (nodes by terms), about.
TABLE = 1 << 23
NO_ID = np.iinfo(np.int64).min


def parts(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of rows of tf with one m each; all in 64-bit integers."""
    tf = tf.astype(np.int64)
    return (weights * ((BILLION * tf) // (1000 * tf + 8 * m[:, None]))).sum(axis=1)


class Best:
    """The k best documents of a query: highest score, then smallest id, none first."""

    def __init__(self, k: int):
        self.k = k
        self.rows: list[tuple[int, int]] = []  # (-score, id)

    def beaten(self, bound: int, least_id: int) -> bool:
        """Whether nothing of this bound and id or a later one could enter."""
        return bound <= 0 or len(self.rows) == self.k and (-bound, least_id) > self.rows[-1]

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores > 0
        if len(self.rows) == self.k:
            good &= scores >= -self.rows[-1][0]
        if good.any():
            new = zip((-scores[good]).tolist(), ids[good].tolist(), strict=True)
            self.rows = sorted([*self.rows, *new])[: self.k]


class DocumentTree:
    """``first`` has where each document's entries begin, and their number at the
    end; ``terms`` are numbered by falling frequency and ascend in a document;
    ``ids`` of documents without one are ``NO_ID``."""

    def __init__(self, first, terms, tf, m, ids, n_terms: int, leaf: int = LEAF):
        order, common = self._sorted(first, terms)
        sizes = np.diff(first)[order]
        at = np.repeat(first[:-1][order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        self.m, self.ids, self.n_terms = m[order], ids[order], max(1, n_terms)
        self.tf = tf[at].astype(np.int64)
        doc = np.repeat(np.arange(len(order)), sizes)
        self.keys = doc * self.n_terms + terms[at]  # ascending: a document's tf is found by bisection
        self._grow(common, sizes, max(leaf, 4 * len(order) * self.n_terms // TABLE))
        self._summarize(doc, terms[at])

    @staticmethod
    def _sorted(first, terms):
        """The documents in the order of their vectors, and how many leading
        terms each shares with the one before."""
        raw, f = terms.astype(">u4").tobytes(), (4 * first).tolist()
        keys = [raw[a:b] for a, b in zip(f[:-1], f[1:], strict=True)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        common = np.zeros(len(order), np.int64)
        for k in range(1, len(order)):
            a, b = (terms[first[i] : first[i + 1]] for i in order[k - 1 : k + 1])
            n = min(len(a), len(b))
            part = np.flatnonzero(a[:n] != b[:n])
            common[k] = part[0] if len(part) else n
        return np.array(order, np.int64), common

    def _grow(self, common: np.ndarray, sizes: np.ndarray, leaf: int) -> None:
        """Nodes in breadth-first order: the documents [low, high) of each, and
        its children [kids, kids + n_kids). Small neighbouring children of a node
        are one leaf."""
        low, high, kids, n_kids = [0], [len(sizes)], [], []
        k = 0
        while k < len(low):
            a, b = low[k], high[k]
            inner = common[a + 1 : b]
            same = b - a > leaf and bool((inner == sizes[a + 1 : b]).all() and (sizes[a] == inner[0]))
            if b - a <= leaf or same:
                cuts = []
            else:
                ends = [a, *(a + 1 + np.flatnonzero(inner == inner.min())).tolist(), b]
                cuts = [a]
                for left, right in zip(ends[:-1], ends[1:], strict=True):
                    if left > cuts[-1] and right - cuts[-1] > leaf:
                        cuts.append(left)
                cuts.append(b)
            kids.append(len(low))
            n_kids.append(max(0, len(cuts) - 1))
            low.extend(cuts[:-1])
            high.extend(cuts[1:])
            k += 1
        self.low, self.high, self.kids, self.n_kids = (np.array(x, np.int64) for x in (low, high, kids, n_kids))

    def _summarize(self, doc: np.ndarray, terms: np.ndarray) -> None:
        n = len(self.low)
        self.most = np.zeros((n, self.n_terms), np.int32)
        leaves = np.flatnonzero(self.n_kids == 0)
        leaves = leaves[np.argsort(self.low[leaves])]
        leaf_of = np.repeat(leaves, self.high[leaves] - self.low[leaves])
        np.maximum.at(self.most, (leaf_of[doc], terms), self.tf.astype(np.int32))
        self.least_m, self.least_id = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if len(self.m):
            self.least_m[leaves] = np.minimum.reduceat(self.m, self.low[leaves])
            self.least_id[leaves] = np.minimum.reduceat(self.ids, self.low[leaves])
        for k in range(n - 1, -1, -1):
            if self.n_kids[k]:
                own = slice(self.kids[k], self.kids[k] + self.n_kids[k])
                self.most[k] = self.most[own].max(axis=0)
                self.least_m[k], self.least_id[k] = self.least_m[own].min(), self.least_id[own].min()

    def _scores(self, low: int, high: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        wanted = np.arange(low, high)[:, None] * self.n_terms + terms
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return parts(weights, np.where(self.keys[at] == wanted, self.tf[at], 0), self.m[low:high])

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Offer ``best`` all documents that may belong to it; the number scored.
        A term's weight counts its repeats in the query."""
        if not len(self.m) or not len(self.keys) or not len(terms):
            return 0
        scored = 0
        root = parts(weights, self.most[:1, terms], self.least_m[:1])
        stack = [(int(root[0]), 0)]
        while stack:
            bound, node = stack.pop()
            if best.beaten(bound, int(self.least_id[node])):
                continue
            if not self.n_kids[node]:
                low, high = int(self.low[node]), int(self.high[node])
                best.offer(self._scores(low, high, terms, weights), self.ids[low:high])
                scored += high - low
                continue
            a = int(self.kids[node])
            b = a + int(self.n_kids[node])
            bounds = parts(weights, self.most[a:b][:, terms], self.least_m[a:b])
            order = np.argsort(bounds, kind="stable")  # the best on top
            stack.extend(zip(bounds[order].tolist(), (a + order).tolist(), strict=True))
        return scored
