"""One automaton for many patterns: subset construction, minimisation, transition arrays."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np


@dataclass(frozen=True)
class Automaton:
    """``steps[state + classes[byte]]`` is the next state; states from ``accepting`` on report.

    States are numbered in steps of the number of byte classes, ``start`` is where a text
    begins, ``rules[state // width]`` holds the numbers of the patterns that end there.
    ``dead`` is the state that nothing can be reached from, or -1.
    """

    classes: bytes
    steps: list[int]
    start: int
    accepting: int
    width: int
    rules: list[tuple[int, ...]]
    dead: int = -1

    def matching(self, text: bytes) -> set[int]:
        """The patterns that occur in ``text``."""
        return set(self.ends(text))

    def ends(self, text: bytes) -> dict[int, int]:
        """The patterns that occur in ``text`` and where the last match of each ends, found in
        one pass over its bytes."""
        steps, state, accepting, last = self.steps, self.start, self.accepting, {}
        for i, c in enumerate(text.translate(self.classes), 1):
            state = steps[state + c]
            if state >= accepting:
                last[state] = i
        ends: dict[int, int] = {}
        for s, i in last.items():
            for k in self.rules[s // self.width]:
                ends[k] = max(ends.get(k, 0), i)
        return ends

    def places(self, text: bytes) -> list[int]:
        """How many bytes are read each time that a pattern has just been matched."""
        steps, state, accepting, found = self.steps, self.start, self.accepting, []
        for i, c in enumerate(text.translate(self.classes), 1):
            state = steps[state + c]
            if state >= accepting:
                found.append(i)
        return found

    def longest(self, coded: bytes, at: int) -> tuple[int, tuple[int, ...]]:
        """Where the longest match from ``at`` ends (-1: nowhere), and its patterns; for an anchored
        automaton. ``coded`` is the text translated by ``classes``; reads to the end of the match
        and on until none can follow."""
        steps, state, end, held = self.steps, self.start, -1, self.start
        for i in range(at, len(coded)):
            state = steps[state + coded[i]]
            if state >= self.accepting:
                end, held = i + 1, state
            elif state == self.dead:
                break
        return end, self.rules[held // self.width]


class _Net:
    """A nondeterministic automaton: edges on sets of bytes, and empty ones. With ``turned`` it
    reads what a pattern matches from its end."""

    def __init__(self, turned: bool):
        self.turned = turned
        self.free: list[list[int]] = []
        self.edges: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.edges.append(None)
        return len(self.free) - 1

    def link(self, a: int, b: int) -> None:
        self.free[a].append(b)

    def read(self, a: int, held) -> int:
        b = self.state()
        self.edges[a] = (frozenset(held), b)
        return b

    def build(self, tree, at: int, flags: int) -> int:
        for kind, arg in reversed(tree) if self.turned else tree:
            at = self.part(kind, arg, at, flags)
        return at

    def part(self, kind, arg, at: int, flags: int) -> int:
        if kind in (op.LITERAL, op.NOT_LITERAL, op.IN, op.ANY):
            return self.read(at, _bytes_of(kind, arg, flags))
        if kind is op.SUBPATTERN:
            _, add, drop, tree = arg
            return self.build(tree, at, (flags | add) & ~drop)
        if kind is op.BRANCH:
            end = self.state()
            for tree in arg[1]:
                begin = self.state()
                self.link(at, begin)
                self.link(self.build(tree, begin, flags), end)
            return end
        if kind is op.MAX_REPEAT:
            least, most, tree = arg
            for _ in range(least):
                at = self.build(tree, at, flags)
            if most is op.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.link(at, loop)
                self.link(loop, end)
                inner = self.state()
                self.link(loop, inner)
                self.link(self.build(tree, inner, flags), loop)
                return end
            end = self.state()
            self.link(at, end)
            for _ in range(most - least):
                begin = self.state()
                self.link(at, begin)
                at = self.build(tree, begin, flags)
                self.link(at, end)
            return end
        raise ValueError(f"patterns may not use {kind}")


def _bytes_of(kind, arg, flags: int) -> set[int]:
    if kind is op.ANY:
        return set(range(256)) - ({10} if not flags & re.DOTALL else set())
    items = arg if kind is op.IN else [(op.LITERAL, arg)]
    held = set()
    for what, value in items:
        if what is op.LITERAL:
            held.add(value)
        elif what is op.RANGE:
            held |= set(range(value[0], value[1] + 1))
        elif what is not op.NEGATE:
            raise ValueError(f"patterns may not use {what}")
    if flags & re.IGNORECASE:
        held |= {b ^ 32 for b in held if 65 <= b <= 90 or 97 <= b <= 122}
    turned = kind is op.NOT_LITERAL or items[0][0] is op.NEGATE
    return set(range(256)) - held if turned else held


def _classes(sets: set[frozenset[int]]) -> tuple[bytes, list[int]]:
    """A class for every byte, equal for bytes that no set tells apart, and one byte of each class."""
    kinds: dict[tuple[bool, ...], int] = {}
    classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    return classes, [classes.index(c) for c in range(len(kinds))]


def _minimal(net: _Net, root: int, end: int, anchored: bool, sample: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the minimal automaton, state 0 first, and which states accept. It is built
    by subset construction; states that no text tells apart are then merged."""
    reach: dict[int, frozenset[int]] = {}

    def closure(state: int) -> frozenset[int]:
        if state not in reach:
            seen, todo = set(), [state]
            while todo:
                s = todo.pop()
                if s not in seen:
                    seen.add(s)
                    todo += net.free[s]
            reach[state] = frozenset(s for s in seen if net.edges[s] or s == end)
        return reach[state]

    first = closure(root)
    names, todo, rows = {first: 0}, [first], []
    for now in todo:
        if len(names) > most:
            raise ValueError("a pattern needs too many states")
        row = []
        for byte in sample:
            after = set() if anchored else set(first)
            for s in now:
                if net.edges[s] and byte in net.edges[s][0]:
                    after |= closure(net.edges[s][1])
            after = frozenset(after)
            if after not in names:
                names[after] = len(names)
                todo.append(after)
            row.append(names[after])
        rows.append(row)
    table, told = np.array(rows), np.array([end in held for held in names])
    label = told.astype(np.int64)
    while True:
        _, member, finer = np.unique(np.column_stack([label, label[table]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.ravel()
        if len(member) == len(np.unique(label)):
            break
        label = finer
    order = np.argsort(finer[member] != finer[0], kind="stable")
    rank = np.argsort(order)
    return rank[finer[table[member[order]]]], told[member[order]]


def compile_patterns(
    patterns: list[bytes], anchored: bool = False, turned: bool = False, most_states: int = 50_000
) -> Automaton:
    """One minimal automaton that tells which of ``patterns`` end at each byte of a text.

    Matches may begin anywhere, or with ``anchored`` at the first byte only; with ``turned``
    the text is given from its end, and beginnings are told. Every pattern gets a minimal
    automaton; the reachable part of their product tells them all at once, and is minimal
    as well, for states that differ differ for some pattern.
    """
    nets = []
    for pattern in patterns:
        net = _Net(turned)
        root = net.state()
        nets.append((net, root, net.build(_parser.parse(pattern), root, 0)))
    classes, sample = _classes({edge[0] for net, _, _ in nets for edge in net.edges if edge})
    width = len(sample)
    parts = [_minimal(*net, anchored, sample, most_states) for net in nets]

    names = {(0,) * len(parts): 0}
    fresh, blocks = np.zeros((1, len(parts)), dtype=np.int64), []
    while len(fresh):
        after = np.stack([table[fresh[:, k]] for k, (table, _) in enumerate(parts)], axis=2).reshape(-1, len(parts))
        known, row = len(names), []
        for states in map(tuple, after.tolist()):
            row.append(names.setdefault(states, len(names)))
        if len(names) > most_states:
            raise ValueError("the patterns need too many states")
        blocks.append(np.array(row).reshape(-1, width))
        fresh = np.array(list(names)[known:], dtype=np.int64).reshape(-1, len(parts))
    table = np.concatenate(blocks)
    told = [tuple(k for k, (_, ends) in enumerate(parts) if ends[states[k]]) for states in names]
    order = np.argsort([bool(t) for t in told], kind="stable")
    rank = np.argsort(order)
    steps = rank[table[order]]
    rules = [told[s] for s in order]
    dead = [s for s in range(len(rules)) if not rules[s] and (steps[s] == s).all()]
    return Automaton(
        classes, (steps * width).ravel().tolist(), int(rank[0]) * width, sum(not t for t in told) * width, width, rules,
        dead[0] * width if dead else -1,
    )
