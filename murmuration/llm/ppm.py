"""Prediction by partial matching over bytes, with escapes and exclusion.

A symbol is coded in the longest known context of at most ``order`` bytes. Where
the symbol is new there, an escape is coded (method D: every different symbol
gives half a count to it), and the next shorter context codes the symbol among
those that the longer one does not have. The last resort is an even choice of the
bytes never seen. The longest contexts count how often a symbol comes; a shorter
one counts in how many of the contexts one byte longer it comes, as the shorter
one is asked only where the longer one does not know (update exclusion). Contexts
form a trie, root at the byte just before the symbol; as a symbol of a long
context is one of every shorter context too, what exclusion takes from a node is
one sum for each child.

A symbol with its context is one integer: the nearest byte first, the symbol last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ORDER = 5
#: Ends a text and stands before its start; no word holds it.
END = 10
#: Symbols looked at together.
SEGMENT = 1 << 22


def events(texts: list[bytes], order: int = ORDER, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all symbols of the texts, an end each included: the distinct ones in
    context, in the order they come; which of them each is; the number per text."""
    pad = bytes([END]) * order
    data = np.frombuffer(b"".join([b"%b%b\n" % (pad, t) for t in texts]), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    coded = np.ones(len(data), bool)
    starts = np.cumsum(lengths + order) - lengths - order
    for k in range(order):
        coded[starts + k] = False
    known, which = [], []
    for a in range(0, len(data), segment):
        first = max(a, order)
        part = data[first - order : a + segment].astype(np.uint64)
        n = len(part) - order
        if n <= 0:
            continue
        key = part[order:].copy()
        for back in range(1, order + 1):
            key |= part[order - back : order - back + n] << np.uint64(8 * (order - back + 1))
        found = pa.array(key[coded[first : first + n]]).dictionary_encode()
        known.append(found.dictionary.to_numpy())
        which.append(found.indices.to_numpy())
    if len(known) == 1:
        return known[0], which[0], lengths
    found = pa.array(np.concatenate([*known, np.zeros(0, np.uint64)])).dictionary_encode()
    place = np.split(found.indices.to_numpy(), np.cumsum([len(k) for k in known])[:-1])
    which = [p[w] for p, w in zip(place, which, strict=False)]
    return found.dictionary.to_numpy(), np.concatenate([*which, np.zeros(0, np.int32)]), lengths


def shorter(keys: np.ndarray, by: int) -> np.ndarray:
    """The same symbols in contexts without their ``by`` farthest bytes."""
    return (keys >> np.uint64(8 * (by + 1)) << np.uint64(8)) | (keys & np.uint64(0xFF))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is, and whether it is there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


class _Level:
    """All contexts of one length: their symbols' counts; the totals and numbers
    of symbols of each; and the counts its symbols have in the next shorter one."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts
        contexts = grams >> np.uint64(8)
        self.first = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1]))) if len(grams) else np.zeros(0, np.int64)
        self.contexts = contexts[self.first]
        self.total = self._by_context(counts)
        self.symbols = self._by_context(np.ones(len(counts), np.int64))
        self.below = self.total

    def _by_context(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first) if len(self.first) else np.zeros(0, np.int64)

    def count(self, grams: np.ndarray) -> np.ndarray:
        at, there = _find(self.grams, grams)
        return np.where(there, self.counts[at], 0) if len(self.counts) else np.zeros(len(grams), np.int64)

    def excluded(self, lower: _Level) -> None:
        self.below = self._by_context(lower.count(shorter(self.grams, 1)))


class Trie:
    """Contexts with the counts of what follows them. ``keys`` are symbols in
    contexts of ``order`` bytes; where they are only those whose two nearest bytes
    are of some set, as in a shard, ``pairs`` must be the sum of the pair counts of
    all shards."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER, pairs: np.ndarray | None = None):
        if order < 2:
            raise ValueError("order must be 2 or more")
        self.order = order
        grams, sums = summed(keys.astype(np.uint64), counts.astype(np.int64))
        grams, sums = grams[sums > 0], sums[sums > 0]
        if pairs is None:
            pairs = pair_counts(grams, order)
        self.levels = [_Level(grams, sums)]
        for _ in range(order - 2):
            self.levels.append(_Level(*_continued(self.levels[-1].grams)))
        for dense in (pairs.ravel(), (pairs > 0).sum(axis=0)):
            at = np.flatnonzero(dense)
            self.levels.append(_Level(at.astype(np.uint64), dense[at]))
        for upper, lower in zip(self.levels[:-1], self.levels[1:], strict=True):
            upper.excluded(lower)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """The logarithm of the probability of each symbol in its context."""
        keys = keys.astype(np.uint64)
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        gone, gone_symbols = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k, level in enumerate(self.levels):
            grams = shorter(keys[left], k)
            at, there = _find(level.contexts, grams >> np.uint64(8))
            if len(level.contexts):
                # a context that is not there takes and excludes nothing
                total = np.where(there, level.total[at], 0) - gone
                symbols = np.where(there, level.symbols[at], 0) - gone_symbols
                count = np.where(there, level.count(grams), 0)
                found = count > 0
                part = np.where(found, 2 * count - 1, symbols)
                used = part > 0
                out[left[used]] += np.log10(part[used] / (2 * total[used]))
                stay = ~found
                gone, gone_symbols = (np.where(there, x[at], 0)[stay] for x in (level.below, level.symbols))
                left = left[stay]
        seen = len(self.levels[-1].grams)
        out[left] -= np.log10(256 - seen) if seen < 256 else 0.0
        return out


def _continued(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in contexts one byte shorter: in how many of the given ones."""
    return summed(shorter(grams, 1), np.ones(len(grams), np.int64))


def pair_counts(keys: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte and symbol after it, with how many different bytes before both."""
    grams = np.unique(shorter(keys, order - 2))
    pair = ((grams >> np.uint64(16) << np.uint64(8)) | (grams & np.uint64(0xFF))).astype(np.int64)
    return np.bincount(pair, minlength=1 << 16).reshape(256, 256)
