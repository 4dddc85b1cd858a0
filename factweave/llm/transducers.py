"""Weighted finite-state transducers over symbols, and their composition.

A transducer has states, start states, final states and arcs (state, symbol read) -> (next state, symbol written, weight).
Arcs read and write one symbol each.  A path through a sequence multiplies its arc weights position by position; what it
writes at a position is worth that weight times the weight of the symbol read there.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator
from dataclasses import dataclass

State = Hashable


@dataclass(frozen=True)
class Transducer:
    starts: tuple[State, ...]
    finals: frozenset[State]
    arcs: dict[tuple[State, str], tuple[tuple[State, str, float], ...]]

    def compose(self, after: Transducer) -> Transducer:
        """The machine that feeds what self writes to `after`; only states that can be reached are kept."""
        starts = tuple((a, b) for a in self.starts for b in after.starts)
        by_state: dict[State, list[tuple[str, tuple[tuple[State, str, float], ...]]]] = {}
        for (state, read), out in self.arcs.items():
            by_state.setdefault(state, []).append((read, out))
        arcs: dict[tuple[State, str], tuple[tuple[State, str, float], ...]] = {}
        todo, seen = list(starts), set(starts)
        while todo:
            a, b = todo.pop()
            for read, out in by_state.get(a, ()):
                found = []
                for to, middle, w in out:
                    for to_b, written, v in after.arcs.get((b, middle), ()):
                        found.append(((to, to_b), written, w * v))
                        if (to, to_b) not in seen:
                            seen.add((to, to_b))
                            todo.append((to, to_b))
                if found:
                    arcs[(a, b), read] = tuple(found)
        return Transducer(starts, frozenset(s for s in seen if s[0] in self.finals and s[1] in after.finals), arcs)

    def numbered(self) -> Transducer:
        """The same machine with numbers for states."""
        number: dict[State, int] = {}
        for s in (*self.starts, *(s for s, _ in self.arcs), *(to for out in self.arcs.values() for to, _, _ in out)):
            number.setdefault(s, len(number))
        arcs = {(number[s], read): tuple((number[to], written, w) for to, written, w in out) for (s, read), out in self.arcs.items()}
        return Transducer(tuple(number[s] for s in self.starts), frozenset(number[s] for s in self.finals if s in number), arcs)

    def paths(self, symbols: list[str]) -> Iterator[list[tuple[str, float]]]:
        """Every accepting path: what it writes and the arc's weight, position by position."""
        todo: list[tuple[State, list[tuple[str, float]]]] = [(s, []) for s in self.starts]
        while todo:
            state, written = todo.pop()
            if len(written) == len(symbols):
                if state in self.finals:
                    yield written
                continue
            for to, out, w in self.arcs.get((state, symbols[len(written)]), ()):
                todo.append((to, [*written, (out, w)]))

    def run(self, read: Iterable[tuple[str, float]]) -> dict[str, float]:
        """Sums by written symbol of the best accepting path (the largest total); {} if no path accepts.

        read: symbols and their weights.  One total a state is kept, so a sequence takes time in proportion to its length.
        """
        live: dict[State, tuple[float, dict[str, float]]] = {s: (0.0, {}) for s in self.starts}
        for symbol, weight in read:
            now: dict[State, tuple[float, dict[str, float]]] = {}
            for state, (total, sums) in live.items():
                for to, out, w in self.arcs.get((state, symbol), ()):
                    value = total + w * weight
                    if to not in now or value > now[to][0]:
                        if weight:
                            now[to] = (value, {**sums, out: sums.get(out, 0.0) + w * weight})
                        else:
                            now[to] = (value, sums)
            live = now
        good = [x for s, x in live.items() if s in self.finals]
        return max(good, key=lambda x: x[0])[1] if good else {}


def machine(starts: Iterable[State], finals: Iterable[State], arcs: Iterable[tuple[State, str, State, str, float]]) -> Transducer:
    """Transducer from (from, read, to, written, weight) arcs."""
    found: dict[tuple[State, str], list[tuple[State, str, float]]] = {}
    for state, read, to, written, weight in arcs:
        found.setdefault((state, read), []).append((to, written, weight))
    return Transducer(tuple(starts), frozenset(finals), {k: tuple(v) for k, v in found.items()})
