"""Gradient-boosted trees on histograms, for two classes, in numpy.

Features are binned by quantiles of the training rows. Trees grow level by level
to a fixed depth from the sums of gradients per bin; all trees are then held in
flat arrays (feature, threshold, value by node number), so that scoring walks
all rows of a batch down all trees, one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``threshold`` of the inner nodes and ``value`` of the leaves,
    one row a tree, nodes numbered by level. A row goes right where its feature is
    greater than the threshold; an infinite threshold sends all to the left."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.feature))[None, :]
        inner = (1 << self.depth) - 1
        for first in range(0, len(x), 4096):
            part = x[first : first + 4096]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(self.depth):
                right = part[rows[: len(part)], self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + right
            total[first : first + 4096] += self.value[trees, node - inner].sum(axis=1)
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 80,
    depth: int = 5,
    rate: float = 0.15,
    ridge: float = 1.0,
    least: float = 1.0,
) -> Trees:
    """Minimise the log loss. Without rows of both classes the score is constant,
    the smoothed share of class 1."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1.0 - share)))
    leaves, inner = 1 << depth, (1 << depth) - 1
    feature = np.zeros((0, inner), np.int64)
    threshold = np.full((0, inner), np.inf)
    value = np.zeros((0, leaves))
    if not len(y) or y.min() == y.max():
        return Trees(feature, threshold, value, base, depth)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    offsets = binned + np.arange(width) * BINS
    raw = np.full(n, base)
    grown = []
    for _ in range(trees):
        p = sigmoid(raw)
        gradient, curvature = p - y, np.maximum(p * (1 - p), 1e-9)
        f, t, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        cut_bin = np.full(inner, BINS)
        for level in range(depth):
            nodes, start = 1 << level, (1 << level) - 1
            slot = (at[:, None] * (width * BINS) + offsets).ravel()
            size = nodes * width * BINS
            shape = (nodes, width, BINS)
            g = np.bincount(slot, np.repeat(gradient, width), size).reshape(shape).cumsum(axis=2)
            h = np.bincount(slot, np.repeat(curvature, width), size).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain = np.where((h >= least) & (all_h - h >= least), gain, 0.0).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            for node in np.flatnonzero(gain[np.arange(nodes), best] > 1e-6):
                k, b = divmod(int(best[node]), BINS)
                if b < len(cuts[k]):
                    f[start + node], t[start + node], cut_bin[start + node] = k, cuts[k][b], b
            here = start + at
            at = 2 * at + (binned[np.arange(n), f[here]] > cut_bin[here])
        g = np.bincount(at, gradient, leaves)
        h = np.bincount(at, curvature, leaves)
        v = -rate * g / (h + ridge)
        raw += v[at]
        grown.append((f, t, v))
    f, t, v = (np.stack(z) for z in zip(*grown, strict=True))
    return Trees(f, t, v, base, depth)
