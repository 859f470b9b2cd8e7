"""Compiles several regular expressions into one minimal deterministic automaton over bytes."""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser

import numpy as np


@dataclass(frozen=True)
class Automaton:
    """``step[state * classes + classes_of[byte]]`` is the next state; ``accepts[state]`` has a bit for each rule. State 0 starts; ``dead`` (or -1) can reach no accepting state."""

    step: np.ndarray
    classes_of: np.ndarray
    classes: int
    accepts: np.ndarray
    dead: int


class _Nfa:
    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.moves.append([])
        return len(self.eps) - 1

    def add(self, items, at: int, backwards: bool) -> int:
        """Appends what ``items`` (parsed expression) match after state ``at``; the state it ends in."""
        for op, arg in reversed(items) if backwards else items:
            name = str(op)
            if name in ("LITERAL", "IN"):
                to = self.state()
                self.moves[at].append((frozenset(_bytes_of(name, arg)), to))
                at = to
            elif name == "SUBPATTERN":
                at = self.add(list(arg[3]), at, backwards)
            elif name == "BRANCH":
                end = self.state()
                for way in arg[1]:
                    start = self.state()
                    self.eps[at].append(start)
                    self.eps[self.add(list(way), start, backwards)].append(end)
                at = end
            elif name == "MAX_REPEAT":
                low, high, body = arg
                for _ in range(low):
                    at = self.add(list(body), at, backwards)
                if high == _parser.MAXREPEAT:
                    loop = self.state()
                    self.eps[at].append(loop)
                    self.eps[self.add(list(body), loop, backwards)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.eps[at].append(end)
                        at = self.add(list(body), at, backwards)
                    self.eps[at].append(end)
                    at = end
            else:
                raise ValueError(f"not supported in a rule: {name}")
        return at

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes_of(name: str, arg) -> set[int]:
    if name == "LITERAL":
        return {arg}
    out: set[int] = set()
    for op, x in arg:
        out |= {x} if str(op) == "LITERAL" else set(range(x[0], x[1] + 1))
    return out


def compile_rules(rules: list[str], search: bool, backwards: bool = False, reset: int | None = None) -> Automaton:
    """Subset construction, then minimisation. ``search``: matches may start at any byte. ``reset``: a byte that leads back to the start from everywhere."""
    nfa = _Nfa()
    start = nfa.state()
    ends = []
    for rule in rules:
        own = nfa.state()
        nfa.eps[start].append(own)
        ends.append(nfa.add(list(_parser.parse(rule)), own, backwards))
    # bytes that no move tells apart share a class
    sets = sorted({m[0] for ms in nfa.moves for m in ms}, key=sorted)
    kinds: dict[tuple, int] = {}
    classes_of = np.zeros(256, dtype=np.intp)
    for b in range(256):
        classes_of[b] = kinds.setdefault((b == reset, *(b in s for s in sets)), len(kinds))
    one = {int(classes_of[b]): b for b in range(256)}
    first = nfa.closure(frozenset([start]))
    ids, todo, rows = {first: 0}, [first], []
    while todo:
        at = todo.pop(0)
        row = []
        for c in range(len(kinds)):
            b = one[c]
            to = frozenset(t for s in at for chars, t in nfa.moves[s] if b in chars) if b != reset else frozenset()
            to = nfa.closure(to | first) if search else nfa.closure(to)
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum(1 << i for i, e in enumerate(ends) if e in s) for s in ids], dtype=np.int64)
    # minimise: split groups of states until all in a group step into the same groups
    group = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack((group, group[table])), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    order = {g: i for i, g in enumerate(dict.fromkeys(group.tolist()))}  # the start's group comes first
    small = np.zeros((len(order), len(kinds)), dtype=np.intp)
    marks = np.zeros(len(order), dtype=np.int64)
    for s, g in enumerate(group.tolist()):
        small[order[g]] = [order[x] for x in group[table[s]].tolist()]
        marks[order[g]] = accepts[s]
    dead = next((i for i in range(len(order)) if not marks[i] and (small[i] == i).all()), -1)
    return Automaton(small.reshape(-1), classes_of, len(kinds), marks, dead)
