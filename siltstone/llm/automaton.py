"""Byte automata: a small regex parser, subset construction, minimisation, transition arrays."""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np

ANY_CASE = {c: bytes({c, c ^ 32}) if 65 <= c & ~32 <= 90 else bytes([c]) for c in range(256)}


class Machine(NamedTuple):
    """next[state * n_classes + classes[byte]]; state 0 starts; accepts[state] has the rules that end there."""

    classes: np.ndarray
    n_classes: int
    next: np.ndarray
    accepts: list[frozenset[int]]
    #: States from which no match is reached any more.
    dead: frozenset[int]


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[bytes, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1


class _Parser:
    """Literals, escapes, classes, groups, |, ?, *, +, {n}, {n,}, {n,m}; (?i:...) for letters in either case."""

    def __init__(self, pattern: str, nfa: _Nfa, backwards: bool = False) -> None:
        self.p, self.at, self.nfa, self.any_case, self.backwards = pattern.encode(), 0, nfa, False, backwards

    def peek(self) -> int:
        return self.p[self.at] if self.at < len(self.p) else -1

    def take(self) -> int:
        self.at += 1
        return self.p[self.at - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == ord("|"):
            self.take()
            parts.append(self.sequence())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def sequence(self):
        parts = []
        while self.peek() not in (-1, ord("|"), ord(")")):
            atom, c = self.atom(), self.peek()
            if c > 0 and c in b"?*+":
                self.take()
                atom = ("rep", atom, 0 if c in b"?*" else 1, 1 if c == ord("?") else None)
            elif c == ord("{"):
                close = self.p.index(b"}", self.at)
                low, comma, high = self.p[self.at + 1 : close].partition(b",")
                self.at = close + 1
                atom = ("rep", atom, int(low), int(high) if high else None if comma else int(low))
            parts.append(atom)
        return ("seq", parts)

    def byte(self) -> int:
        c = self.take()
        if c != ord("\\"):
            return c
        c = self.take()
        if c == ord("x"):
            self.at += 2
            return int(self.p[self.at - 2 : self.at], 16)
        return {ord("n"): 10, ord("t"): 9, ord("r"): 13}.get(c, c)

    def atom(self):
        c = self.peek()
        if c == ord("("):
            self.take()
            before = self.any_case
            if self.p[self.at : self.at + 3] == b"?i:":
                self.at += 3
                self.any_case = True
            inner = self.alternatives()
            if self.take() != ord(")"):
                raise ValueError("unclosed group")
            self.any_case = before
            return inner
        if c == ord("["):
            self.take()
            found = set()
            while self.peek() != ord("]"):
                low = self.byte()
                if self.peek() == ord("-") and self.p[self.at + 1] != ord("]"):
                    self.take()
                    found.update(range(low, self.byte() + 1))
                else:
                    found.add(low)
            self.take()
            return ("set", bytes(sorted(found)))
        c = self.byte()
        return ("set", ANY_CASE[c] if self.any_case else bytes([c]))

    def build(self, node, a: int) -> int:
        n = self.nfa
        if node[0] == "set":
            b = n.state()
            n.moves[a].append((node[1], b))
            return b
        if node[0] == "seq":
            for x in reversed(node[1]) if self.backwards else node[1]:
                a = self.build(x, a)
            return a
        if node[0] == "alt":
            end = n.state()
            for x in node[1]:
                s = n.state()
                n.empty[a].append(s)
                n.empty[self.build(x, s)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            a = self.build(inner, a)
        if high is None:
            loop, end = n.state(), n.state()
            n.empty[a].append(loop)
            n.empty[loop].append(end)
            n.empty[self.build(inner, loop)].append(loop)
            return end
        end = n.state()
        for _ in range(high - low):
            n.empty[a].append(end)
            a = self.build(inner, a)
        n.empty[a].append(end)
        return end


def compile_rules(patterns: list[str], search: bool, backwards: bool = False) -> Machine:
    """One minimal automaton of all patterns. search: a match may begin anywhere; backwards: it reads from the last byte on."""
    nfa = _Nfa()
    root, final = nfa.state(), {}
    if search:
        nfa.moves[root].append((bytes(range(256)), root))
    for rule, pattern in enumerate(patterns):
        start = nfa.state()
        nfa.empty[root].append(start)
        parser = _Parser(pattern, nfa, backwards)
        final[parser.build(parser.alternatives(), start)] = rule

    # bytes that no set tells apart share a class
    sets = {s for moves in nfa.moves for s, _ in moves}
    member = np.zeros((256, len(sets)), bool)
    for k, s in enumerate(sets):
        member[list(s), k] = True
    _, first, classes = np.unique(member, axis=0, return_index=True, return_inverse=True)
    classes = classes.reshape(-1)
    n_classes = len(first)
    per_class = [[[(b) for s, b in moves if int(c) in s] for c in first] for moves in [*nfa.moves]]

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.moves[x] or x in final)

    number, rows, accepts, todo = {closure([root]): 0}, [], [], [closure([root])]
    while todo:
        states = todo.pop(0)
        accept = frozenset(final[x] for x in states if x in final)
        accepts.append(accept)
        row = []
        for c in range(n_classes):
            to = closure({b for x in states for b in per_class[x][c]})
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    table = np.array(rows)

    # Moore's refinement
    group = np.unique([str(sorted(a)) for a in accepts], return_inverse=True)[1].reshape(-1)
    while True:
        key = np.concatenate([group[:, None], group[table]], axis=1)
        new = np.unique(key, axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == group.max():
            break
        group = new
    order = np.full(group.max() + 1, -1)
    order[group[0]] = 0
    order[order < 0] = np.arange(1, len(order))
    group = order[group]
    one = np.zeros(len(order), int)
    one[group] = np.arange(len(group))
    small, ends = group[table[one]].astype(np.int32), [accepts[x] for x in one]
    dead = frozenset(q for q in range(len(small)) if not ends[q] and (small[q] == q).all())
    return Machine(classes.astype(np.uint8), n_classes, small.reshape(-1), ends, dead)


def resetting(m: Machine) -> np.ndarray:
    """Which bytes lead every state to the start: no match spans them."""
    return (m.next.reshape(-1, m.n_classes) == 0).all(axis=0)[m.classes]


class Longest:
    """Finds the end of the longest match that begins at a byte. For a machine that doesn't search."""

    def __init__(self, m: Machine) -> None:
        self.next = m.next.reshape(-1, m.n_classes)[:, m.classes].tolist()
        self.accepts = [bool(a) for a in m.accepts]
        self.dead = [q in m.dead for q in range(len(self.accepts))]

    def end(self, data: bytes, at: int) -> int:
        """-1 where there is none."""
        row, end, rows, accepts, dead = self.next[0], at if self.accepts[0] else -1, self.next, self.accepts, self.dead
        for k in range(at, len(data)):
            q = row[data[k]]
            if accepts[q]:
                end = k + 1
            elif dead[q]:
                break
            row = rows[q]
        return end
