"""A semi-Markov conditional random field over candidate segments.

A lattice has the places 0..n between its tokens. A step over one token means
"nothing here"; a segment is a longer step with a type. The score of a path is
the sum of the weights of its steps' features, and the probability of a path is
its share among all paths, which dynamic programming sums over.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import exp, log

import numpy as np


@dataclass(frozen=True)
class Lattice:
    """``plain``: features of stepping over each token. ``segments``: first and
    last place of each candidate and the features of the whole span."""

    plain: tuple[tuple[str, ...], ...]
    segments: tuple[tuple[int, int, tuple[str, ...]], ...]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + log(sum(exp(v - top) for v in values))


@dataclass
class SemiCRF:
    """Weights by feature, one for each type; ``plain`` features have one weight."""

    types: tuple[str, ...]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    plain: dict[str, float] = field(default_factory=dict)

    def _scores(self, lattice: Lattice) -> tuple[list[float], list[list[float]]]:
        steps = [sum(self.plain.get(f, 0.0) for f in fs) for fs in lattice.plain]
        zero = np.zeros(len(self.types))
        spans = [sum((self.weights.get(f, zero) for f in fs), zero).tolist() for _, _, fs in lattice.segments]
        return steps, spans

    def best(self, lattice: Lattice) -> list[tuple[int, int, str]]:
        """The segments of the best path; among equals, that with fewer segments."""
        steps, spans = self._scores(lattice)
        n = len(steps)
        score, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, last, _) in enumerate(lattice.segments):
            ending[last].append(k)
        for t in range(1, n + 1):
            score[t] = score[t - 1] + steps[t - 1]
            for k in ending[t]:
                first = lattice.segments[k][0]
                for kind, s in enumerate(spans[k]):
                    if score[first] + s > score[t]:
                        score[t], back[t] = score[first] + s, (k, kind)
        out, t = [], n
        while t:
            if back[t] is None:
                t -= 1
            else:
                first, last, _ = lattice.segments[back[t][0]]
                out.append((first, last, self.types[back[t][1]]))
                t = first
        return out[::-1]

    def marginals(self, lattice: Lattice) -> tuple[float, list[float], list[list[float]]]:
        """The log of the sum over paths, and the probability of every step."""
        steps, spans = self._scores(lattice)
        n = len(steps)
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (first, last, _) in enumerate(lattice.segments):
            starting[first].append(k)
            ending[last].append(k)
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for t in range(1, n + 1):
            ahead[t] = _log_sum(
                [ahead[t - 1] + steps[t - 1]]
                + [ahead[lattice.segments[k][0]] + s for k in ending[t] for s in spans[k]]
            )
        for t in range(n - 1, -1, -1):
            behind[t] = _log_sum(
                [behind[t + 1] + steps[t]] + [behind[lattice.segments[k][1]] + s for k in starting[t] for s in spans[k]]
            )
        total = ahead[n]
        p_steps = [exp(ahead[t] + steps[t] + behind[t + 1] - total) for t in range(n)]
        p_spans = [
            [exp(ahead[first] + s + behind[last] - total) for s in spans[k]]
            for k, (first, last, _) in enumerate(lattice.segments)
        ]
        return total, p_steps, p_spans

    def fit(
        self,
        examples: list[tuple[Lattice, list[tuple[int, int, str]]]],
        epochs: int = 6,
        rate: float = 0.5,
        decay: float = 1e-4,
        seed: int = 1,
    ) -> SemiCRF:
        """Raise the probability of the given segments by stochastic gradients."""
        rng = np.random.default_rng(seed)
        squares: dict[str, np.ndarray] = {}
        for _ in range(epochs):
            for at in rng.permutation(len(examples)):
                lattice, gold = examples[at]
                _, p_steps, p_spans = self.marginals(lattice)
                right = {(a, b): self.types.index(kind) for a, b, kind in gold}
                covered = {t for a, b, _ in gold for t in range(a, b)}
                gradient: dict[str, np.ndarray] = {}
                for t, fs in enumerate(lattice.plain):
                    g = (t not in covered) - p_steps[t]
                    for f in fs:
                        gradient["." + f] = gradient.get("." + f, 0.0) + g
                for k, (a, b, fs) in enumerate(lattice.segments):
                    g = -np.array(p_spans[k])
                    if (a, b) in right:
                        g[right[a, b]] += 1.0
                    for f in fs:
                        gradient[f] = gradient.get(f, 0.0) + g
                for f, g in gradient.items():
                    plain = f[0] == "."
                    old = self.plain.get(f[1:], 0.0) if plain else self.weights.get(f, np.zeros(len(self.types)))
                    g = g - decay * old
                    squares[f] = squares.get(f, 1e-3) + g * g
                    new = old + rate * g / np.sqrt(squares[f])
                    if plain:
                        self.plain[f[1:]] = float(new)
                    else:
                        self.weights[f] = new
        return self
