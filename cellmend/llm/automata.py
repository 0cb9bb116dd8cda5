"""Probabilistic automata by state merging (ALERGIA) from labelled strings."""

from __future__ import annotations

import math
from collections import Counter


def symbols(text: str, literal: int) -> list[str]:
    """The first `literal` characters stand for themselves; further on letters and digits stand for their class."""
    return [c if k < literal else "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for k, c in enumerate(text)]


class Automaton:
    """States are numbers; a state has counts of ends and of moves by symbol."""

    def __init__(self, examples: list[str], literal: int = 5, alpha: float = 0.05):
        self.literal = literal
        self.end: list[int] = [0]
        self.count: list[Counter[str]] = [Counter()]
        self.to: list[dict[str, int]] = [{}]
        for x in examples:  # the prefix tree
            q = 0
            for s in symbols(x, literal):
                self.count[q][s] += 1
                if s not in self.to[q]:
                    self.to[q][s] = len(self.to)
                    self.end.append(0)
                    self.count.append(Counter())
                    self.to.append({})
                q = self.to[q][s]
            self.end[q] += 1
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self._finish()

    def _total(self, q: int) -> int:
        return self.end[q] + self.count[q].total()

    def _compatible(self, a: int, b: int) -> bool:
        """Hoeffding's bound on ends and moves, here and wherever both go on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            bound = self.width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.end[a] / n - self.end[b] / m) >= bound:
                return False
            for s in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a][s] / n - self.count[b][s] / m) >= bound:
                    return False
                if s in self.to[a] and s in self.to[b]:
                    todo.append((self.to[a][s], self.to[b][s]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of a subtree of the prefix tree to a state and those after it."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.end[a] += self.end[b]
            self.count[a].update(self.count[b])
            for s, q in self.to[b].items():
                if s in self.to[a]:
                    todo.append((self.to[a][s], q))
                else:
                    self.to[a][s] = q

    def _merge(self) -> None:
        """Red states are kept, blue ones stand behind them; the heaviest blue state is merged or becomes red."""
        red = [0]
        while True:
            blue = [(self._total(q), -q, p, s) for p in red for s, q in self.to[p].items() if q not in red]
            if not blue:
                break
            _, b, p, s = max(blue)
            b = -b
            for r in red:
                if self._compatible(r, b):
                    self.to[p][s] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
        self.states = red

    def _finish(self) -> None:
        """Log probabilities, with a little for what was never seen."""
        self.logs: dict[int, tuple[float, dict[str, float], float]] = {}
        for q in self.states:
            n = self._total(q) + 1
            self.logs[q] = (math.log((self.end[q] + 0.02) / n), {s: math.log((k + 0.01) / n) for s, k in self.count[q].items()}, math.log(0.002 / n))

    def log_likelihood(self, text: str) -> float:
        q, out = 0, 0.0
        for s in symbols(text, self.literal):
            _, moves, unseen = self.logs[q]
            out += moves.get(s, unseen - 2)
            q = self.to[q].get(s, q)
        return out + self.logs[q][0]
