"""Regular expressions as one minimal deterministic automaton over bytes.

Expressions may have literals, escapes, sets, groups, alternatives and repetitions; bytes above 127 stand in negated sets
only. They become one non-deterministic automaton, subset construction makes it deterministic, and states that no
continuation tells apart become one. The outcome is a transition array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Never part of UTF-8; stands between texts.
BREAK = 255
_NAMED = {"n": 10, "r": 13, "t": 9}
_BLANK = frozenset([9, 10, 11, 12, 13, 32])
_OTHERS = frozenset(range(255))

#: A tree is a set of bytes, or a tuple ("row" | "choice", trees) or ("repeat", tree, least, most or None).


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def _next(self, what: str) -> bool:
        found = self.text.startswith(what, self.at)
        self.at += len(what) if found else 0
        return found

    def choice(self):
        rows = [self.row()]
        while self._next("|"):
            rows.append(self.row())
        return rows[0] if len(rows) == 1 else ("choice", rows)

    def row(self):
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            part = self.atom()
            while (bounds := self.bounds()) is not None:
                part = ("repeat", part, *bounds)
            parts.append(part)
        return ("row", parts)

    def bounds(self):
        for sign, low, high in (("*", 0, None), ("+", 1, None), ("?", 0, 1)):
            if self._next(sign):
                return low, high
        if not self._next("{"):
            return None
        end = self.text.index("}", self.at)
        low, _, high = self.text[self.at : end].partition(",")
        high = high if _ else low
        self.at = end + 1
        return int(low), int(high) if high else None

    def atom(self):
        if self._next("("):
            self._next("?:")
            inner = self.choice()
            if not self._next(")"):
                raise ValueError("a group isn't closed")
            return inner
        if self._next("["):
            return self.members()
        return self.sign()

    def sign(self) -> frozenset[int]:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            if c in ".^$*+?{}" or ord(c) > 127:
                raise ValueError(f"{c} isn't supported here")
            return frozenset([ord(c)])
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return frozenset([int(self.text[self.at - 2 : self.at], 16)])
        return _BLANK if c == "s" else frozenset([_NAMED.get(c, ord(c))])

    def members(self) -> frozenset[int]:
        negated, out = self._next("^"), set()
        while not self._next("]"):
            plain = self.text[self.at] not in "\\"
            one = frozenset([ord(self.text[self.at])]) if plain else self.sign()
            self.at += plain
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = ord(self.text[self.at])
                self.at += 1
                out.update(range(min(one), high + 1))
            else:
                out |= one
        return frozenset(_OTHERS - out if negated else out)


def parsed(pattern: str):
    reader = _Reader(pattern)
    out = reader.choice()
    if reader.at < len(pattern):
        raise ValueError(f"what follows {pattern[: reader.at]} has no place")
    return out


def backwards(tree):
    """The tree of the same texts, each read from its end."""
    if isinstance(tree, frozenset):
        return tree
    if tree[0] == "repeat":
        return ("repeat", backwards(tree[1]), *tree[2:])
    parts = [backwards(x) for x in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "row" else parts)


class _Nfa:
    """States with byte-set edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, at: int) -> int:
        """Adds a tree that begins in state `at`; its final state."""
        if isinstance(tree, frozenset):
            to = self.state()
            self.edges[at].append((tree, to))
            return to
        if tree[0] == "row":
            for part in tree[1]:
                at = self.add(part, at)
            return at
        if tree[0] == "choice":
            end = self.state()
            for part in tree[1]:
                begin = self.state()
                self.empty[at].append(begin)
                self.empty[self.add(part, begin)].append(end)
            return end
        _, body, low, high = tree
        for _ in range(low):
            at = self.add(body, at)
        end = self.state()
        if high is None:
            loop = self.state()
            self.empty[at] += [loop]
            self.empty[self.add(body, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        for _ in range(high - low):
            self.empty[at].append(end)
            at = self.add(body, at)
        self.empty[at].append(end)
        return end

    def closed(self, state: int) -> int:
        """All states that empty edges lead to, as bits."""
        seen, todo = {state}, [state]
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return sum(1 << s for s in seen)


@dataclass(frozen=True)
class Automaton:
    """next[state + kind[byte]] is the next state; states are multiples of `width`, the number of byte kinds.

    rules: by state number, the rules that end there, as bits; those from `reached` on end rules. alive: the rules that a
    continuation may still end.
    """

    kind: np.ndarray
    next: np.ndarray
    width: int
    reached: int
    rules: np.ndarray
    alive: np.ndarray


def compiled(trees: list, anywhere: bool) -> Automaton:
    """One automaton of all trees; anywhere: a match may begin at any byte, else only at the first one."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {}
    for i, tree in enumerate(trees):
        begin = nfa.state()
        nfa.empty[start].append(begin)
        ends[nfa.add(tree, begin)] = 1 << i
    # Bytes that every edge treats alike are one kind.
    sets = sorted({on for edges in nfa.edges for on, _ in edges}, key=sorted)
    signs: dict[tuple, int] = {}
    kind = np.array([signs.setdefault(tuple(b in s for s in sets), len(signs)) for b in range(256)], dtype=np.uint8)
    width = len(signs)
    sample = [int(np.flatnonzero(kind == k)[0]) for k in range(width)]
    closed = [nfa.closed(s) for s in range(len(nfa.edges))]
    steps = []
    for edges in nfa.edges:
        to = [0] * width
        for on, target in edges:
            for k in range(width):
                if sample[k] in on:
                    to[k] |= closed[target]
        steps.append([(k, x) for k, x in enumerate(to) if x])
    # Subset construction, with subsets as bits.
    begin = closed[start]
    place, todo, rows, masks = {begin: 0}, [begin], [], []
    for subset in todo:
        row, mask, left = [begin if anywhere else 0] * width, 0, subset
        while left:
            s = (left & -left).bit_length() - 1
            left &= left - 1
            mask |= ends.get(s, 0)
            for k, x in steps[s]:
                row[k] |= x
        for k, to in enumerate(row):
            if to not in place:
                place[to] = len(todo)
                todo.append(to)
            row[k] = place[to]
        rows.append(row)
        masks.append(mask)
    step, mask = np.array(rows, dtype=np.int64), np.array(masks, dtype=np.int64)
    # Minimisation: states fall into classes by the rules they end, and classes are split until their successors agree.
    classes, n = np.unique(mask, return_inverse=True)[1], 0
    while classes.max() + 1 != n:
        n = int(classes.max()) + 1
        classes = np.unique(np.c_[classes, classes[step]], axis=0, return_inverse=True)[1].ravel()
    first = np.unique(classes, return_index=True)[1]
    # Order: the start state first unless it ends a rule, states that end rules last.
    order = np.lexsort((np.arange(n) != classes[0], mask[first] > 0))
    number = np.empty(n, dtype=np.int64)
    number[order] = np.arange(n)
    to, rules = number[classes[step[first[order]]]], mask[first[order]]
    alive = rules.copy()
    while True:
        more = alive | np.bitwise_or.reduce(alive[to], axis=1)
        if (more == alive).all():
            break
        alive = more
    return Automaton(kind, (to * width).astype(np.int32).ravel(), width, int(np.count_nonzero(rules == 0)) * width, rules, alive)


def reached(a: Automaton, data: np.ndarray, length: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places in the bytes at which rules end, and which, as bits, as a scan from the first byte to the last finds them.

    The bytes are cut into segments that step side by side as one array, each from the start state; a segment whose true
    entry state is another one is stepped again until it meets the states it had before.
    """
    lanes = -(-len(data) // length)
    kinds = np.full(lanes * length, a.kind[BREAK], dtype=np.int32)
    kinds[: len(data)] = a.kind[data]
    kinds = np.ascontiguousarray(kinds.reshape(lanes, length).T)
    states = np.empty((length, lanes), dtype=np.int32)
    now = np.zeros(lanes, dtype=np.int32)
    for i in range(length):
        now = np.take(a.next, now + kinds[i], out=states[i], mode="clip")
    changed = np.flatnonzero(states[length - 1, : lanes - 1])
    while len(changed):
        # These segments ended in another state than the one after them was entered with; that one starts again until it meets the path it had.
        lane = changed + 1
        now = states[length - 1, changed]
        for i in range(length):
            if not len(lane):
                break
            now = a.next[now + kinds[i, lane]]
            new = now != states[i, lane]
            lane, now = lane[new], now[new]
            states[i, lane] = now
        changed = lane[lane < lanes - 1]
    step, lane = np.nonzero(states >= a.reached)
    at = lane * length + step
    keep = at < len(data)
    return at[keep], a.rules[states[step[keep], lane[keep]] // a.width]


class Walker:
    """Follows an automaton from single places on, to where a rule's longest match ends."""

    def __init__(self, a: Automaton):
        self.kind, self.next = a.kind.tolist(), a.next.tolist()
        # By state: bits of the rules that end there, and of those that may still end.
        self.rules = {i * a.width: x for i, x in enumerate(a.rules.tolist()) if x}
        self.alive = {i * a.width: x for i, x in enumerate(a.alive.tolist())}

    def end(self, data: bytes, at: int, rule: int) -> int:
        """The end of the longest match of the rule (a bit) that begins at `at`, -1 without one."""
        state, found = 0, -1
        kind, following, rules, alive = self.kind, self.next, self.rules, self.alive
        for i in range(at, len(data)):
            state = following[state + kind[data[i]]]
            if rules.get(state, 0) & rule:
                found = i + 1
            if not alive[state] & rule:
                break
        return found
