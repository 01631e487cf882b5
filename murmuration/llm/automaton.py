"""A generalised suffix automaton over sequences of integers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """Recognises every run of consecutive symbols of the sequences added."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, out: dict[int, int], link: int) -> int:
        self.next.append(out)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """A copy of ``q`` for the shorter runs that reach it from ``p``."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: Iterable[int]) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:  # an earlier sequence went this way
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
            last = new

    def matching(self, symbols: Sequence[int]) -> list[int]:
        """For every place, the length of the longest run ending there that is known."""
        state, size, out = 0, 0, []
        step, link, length = self.next, self.link, self.length
        for symbol in symbols:
            while state and symbol not in step[state]:
                state = link[state]
                size = length[state]
            if symbol in step[state]:
                state = step[state][symbol]
                size += 1
            else:
                size = 0
            out.append(size)
        return out
