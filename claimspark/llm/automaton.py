"""Several regular expressions as one minimal deterministic automaton over bytes.

Each rule becomes an anchored deterministic automaton (subset construction over a
Thompson automaton). A search automaton is put around it whose states are lists of
rule states, one for each place where a match may have begun, earliest first: once
the earliest has matched, later ones are dropped, and when a match ends the search
goes on behind it. That is the leftmost, longest, non-overlapping search. The
product of all rules' search automata is minimised by partition refinement. One
table lookup for each byte then follows all rules at once; a tag of each state
says which rules have a match that reaches up to here.

Rules are written with literals, ``\\xHH`` and backslash escapes, classes, groups,
``|``, ``?``, ``*``, ``+`` and ``{m}``, ``{m,}``, ``{m,n}``. A rule must stay in an
accepting state from its first accepted byte until its match ends (it ends in a
repeated class, say); others are refused when they are compiled.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np

DEAD = -1


class _Parser:
    """Regular expression to Thompson automaton: ``moves`` has (bytes, target), ``free`` has targets."""

    def __init__(self, pattern: str, ignore_case: bool) -> None:
        self.text, self.at, self.ignore_case = pattern.encode(), 0, ignore_case
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        self.start, self.end = self.choice()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at:]!r} in {pattern!r}")

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def peek(self) -> int | None:
        return self.text[self.at] if self.at < len(self.text) else None

    def choice(self) -> tuple[int, int]:
        first, last = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.free[first].append(a)
            self.free[b].append(last)
            if self.peek() != ord("|"):
                return first, last
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        first = last = self.state()
        while self.peek() not in (None, ord("|"), ord(")")):
            begin = self.at
            a, b = self.atom()
            end = self.at
            least, most = self.times()
            after, parts = self.at, []
            for number in range(max(least, most or 0, 1)):
                if number:  # another copy of the atom
                    self.at = begin
                    a, b = self.atom()
                    assert self.at == end
                parts.append((a, b))
            self.at = after
            exits = [last] if least == 0 else []
            for number, (a, b) in enumerate(parts, 1):
                self.free[last].append(a)
                last = b
                if number >= least:
                    exits.append(b)
            if most is None:
                self.free[last].append(parts[-1][0])
            joined = self.state()
            for place in exits:
                self.free[place].append(joined)
            last = joined
        return first, last

    def times(self) -> tuple[int, int | None]:
        sign = self.peek()
        if sign in (ord("?"), ord("*"), ord("+")):
            self.at += 1
            return {ord("?"): (0, 1), ord("*"): (0, None), ord("+"): (1, None)}[sign]
        if sign == ord("{"):
            close = self.text.index(b"}", self.at)
            least, comma, most = self.text[self.at + 1 : close].partition(b",")
            self.at = close + 1
            return int(least), int(least) if not comma else int(most) if most else None
        return 1, 1

    def atom(self) -> tuple[int, int]:
        if self.peek() == ord("("):
            self.at += 1
            inner = self.choice()
            if self.peek() != ord(")"):
                raise ValueError("a group is not closed")
            self.at += 1
            return inner
        chars = self.byte_class() if self.peek() == ord("[") else {self.byte()}
        if self.ignore_case:
            chars |= {c ^ 32 for c in chars if chr(c).isascii() and chr(c).isalpha()}
        first, last = self.state(), self.state()
        self.moves[first].append((frozenset(chars), last))
        return first, last

    def byte(self) -> int:
        char = self.text[self.at]
        self.at += 1
        if char != ord("\\"):
            return char
        kind = self.text[self.at]
        self.at += 1
        if kind == ord("x"):
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {ord("n"): 10, ord("t"): 9, ord("r"): 13}.get(kind, kind)

    def byte_class(self) -> set[int]:
        self.at += 1
        inverse = self.peek() == ord("^")
        self.at += inverse
        chars: set[int] = set()
        while self.peek() != ord("]"):
            low = self.byte()
            if self.peek() == ord("-") and self.text[self.at + 1] != ord("]"):
                self.at += 1
                chars |= set(range(low, self.byte() + 1))
            else:
                chars.add(low)
        self.at += 1
        return set(range(256)) - chars if inverse else chars


def _closure(free, states) -> frozenset[int]:
    seen, todo = set(states), list(states)
    while todo:
        for target in free[todo.pop()]:
            if target not in seen:
                seen.add(target)
                todo.append(target)
    return frozenset(seen)


@dataclass
class _Rule:
    """Anchored automaton of one rule, over bytes, and of its reversal."""

    table: list[list[int]]
    accepts: set[int]
    covers: np.ndarray | None = None


def _covers(rule: _Rule) -> np.ndarray:
    """[a, b]: whatever b still accepts, a accepts as well and with the same bytes.

    A later beginning in such a state b cannot give a match that an earlier one in
    state a does not give first, and is forgotten.
    """
    table = np.array(rule.table)
    size = len(table)
    accepts = np.isin(np.arange(size), list(rule.accepts))
    holds = accepts[:, None] | ~accepts[None, :]
    columns = np.unique(table, axis=1).T
    while True:
        finer = holds.copy()
        for moved in columns:
            both = holds[np.ix_(np.maximum(moved, 0), np.maximum(moved, 0))]
            finer &= (moved == DEAD)[None, :] | ((moved != DEAD)[:, None] & both)
        if (finer == holds).all():
            return holds
        holds = finer


def _subsets(moves, free, start: set[int], end: int) -> _Rule:
    first = _closure(free, start)
    names, table, accepts, todo = {first: 0}, [], set(), [first]
    while todo:
        subset = todo.pop(0)
        if end in subset:
            accepts.add(names[subset])
        reach: list[set[int]] = [set() for _ in range(256)]
        for state in subset:
            for chars, target in moves[state]:
                for char in chars:
                    reach[char].add(target)
        row, known = [], {}
        for targets in map(frozenset, reach):
            if not targets:
                row.append(DEAD)
                continue
            if targets not in known:
                subset_to = _closure(free, targets)
                if subset_to not in names:
                    names[subset_to] = len(names)
                    todo.append(subset_to)
                known[targets] = names[subset_to]
            row.append(known[targets])
        table.append(row)
    return _Rule(table, accepts)


def _rule(pattern: str, ignore_case: bool) -> tuple[_Rule, _Rule]:
    parsed = _Parser(pattern, ignore_case)
    forward = _subsets(parsed.moves, parsed.free, {parsed.start}, parsed.end)
    moves = [[] for _ in parsed.moves]
    free = [[] for _ in parsed.free]
    for state, out in enumerate(parsed.moves):
        for chars, target in out:
            moves[target].append((chars, state))
    for state, out in enumerate(parsed.free):
        for target in out:
            free[target].append(state)
    backward = _subsets(moves, free, {parsed.end}, parsed.start)
    if 0 in forward.accepts:
        raise ValueError(f"{pattern!r} matches the empty string")
    for state in forward.accepts:
        if any(target not in forward.accepts for target in forward.table[state] if target != DEAD):
            raise ValueError(f"{pattern!r} can be left and accepted again")
    forward.covers = _covers(forward)
    return forward, backward


def _search_step(rule: _Rule, state: tuple[int, ...], char: int) -> tuple[tuple[int, ...], bool]:
    """The places after a byte, and whether a match ended before it."""
    matched = bool(state) and state[0] in rule.accepts
    moved = [target for place in state if (target := rule.table[place][char]) != DEAD]
    if matched:
        if moved:
            return (moved[0],), False
        begun = rule.table[0][char]  # the search goes on with this byte
        return ((begun,) if begun != DEAD else ()), True
    if (begun := rule.table[0][char]) != DEAD:
        moved.append(begun)
    for number, place in enumerate(moved):
        if place in rule.accepts:  # earlier places may still match and come first
            moved = moved[: number + 1]
            break
    kept: list[int] = []
    for place in moved:
        if not any(rule.covers[earlier, place] for earlier in kept):
            kept.append(place)
    return tuple(kept), False


class Automaton:
    """All rules in one table.

    ``table[state, class]`` is the next state, ``classes[byte]`` the byte's class,
    ``tags[state]`` a bit for each rule that has a match up to here, ``first`` the
    start. A match of a rule ends where its bit goes out.
    """

    def __init__(self, rules: Mapping[str, tuple[str, bool]]) -> None:
        self.names = list(rules)
        if len(self.names) > 8:
            raise ValueError("at most eight rules fit the tags of one automaton")
        pairs = [_rule(*rules[name]) for name in self.names]
        forward = [f for f, _ in pairs]
        self.backward = [(b.table, b.accepts) for _, b in pairs]
        columns = {}
        for char in range(256):
            columns.setdefault(tuple(row[char] for f in forward for row in f.table), []).append(char)
        self.classes = np.zeros(256, np.uint8)
        for number, chars in enumerate(columns.values()):
            self.classes[chars] = number
        samples = [chars[0] for chars in columns.values()]

        start = tuple(() for _ in forward)
        names, rows, todo = {start: 0}, [], [start]
        while todo:
            state, row = todo.pop(0), []
            for char in samples:
                steps = [_search_step(f, own, char) for f, own in zip(forward, state)]
                for f, (own, ended) in zip(forward, steps):
                    if ended and own and own[0] in f.accepts:
                        raise ValueError("a rule matches a single byte; two matches could not be told apart")
                    if any(place in f.accepts for place in own[1:]):
                        raise ValueError("a later beginning may match before an earlier one is given up")
                target = tuple(own for own, _ in steps)
                if target not in names:
                    names[target] = len(names)
                    todo.append(target)
                row.append(names[target])
            rows.append(row)
        tags = np.zeros(len(names), np.uint8)
        for state, number in names.items():
            for bit, (f, own) in enumerate(zip(forward, state)):
                if any(place in f.accepts for place in own[:1]):
                    tags[number] |= 1 << bit
        self._minimise(np.array(rows), tags)

    def _minimise(self, table: np.ndarray, tags: np.ndarray) -> None:
        """Merge states that have equal tags and move to equal blocks, until nothing splits."""
        block = np.unique(tags, return_inverse=True)[1]
        while True:
            signature = np.column_stack([block, block[table]])
            finer = np.unique(signature, axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        picked = np.unique(block, return_index=True)[1]
        self.table, self.tags, self.first = block[table[picked]], tags[picked], int(block[0])

    def start_of(self, rule: int, data: bytes, low: int, end: int) -> int:
        """Where the leftmost match of the rule that ends at ``end`` begins, not before ``low``."""
        table, accepts = self.backward[rule]
        state, found = 0, -1
        for at in range(end - 1, low - 1, -1):
            state = table[state][data[at]]
            if state == DEAD:
                break
            if state in accepts:
                found = at
        return found
