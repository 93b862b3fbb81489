"""Deterministic automata over bytes.

A pattern becomes a nondeterministic automaton over the bytes of UTF-8 whose threads are kept in order of preference, and that becomes a table by subset
construction. Matches are leftmost-first: in a set of threads nothing after a match goes on. A match is noted one byte late, so a state is an ordered set
of threads and a bit that says whether the set it came from had matched. ``semantics="all"`` keeps every thread going and describes the plain language.

A set of characters is one small deterministic automaton over bytes, made once however often the set is repeated; a copy of it is one thread. The table
is minimised: states that agree on whether the text may end there, on that bit, and on all that follows become one (``minimal=False`` keeps them apart).

States are numbered in the order in which they are found, breadth first by byte class: 0 is dead, 1 is the start.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from ..errors import DfaHasNoStartState, IndexDfaError
from .regex_syntax import Ranges, parse

DEAD, START = 0, 1
#: Sizes beyond which a pattern is refused.
MOST_THREADS, MOST_STATES = 4_000_000, 1_000_000

_LENGTHS = (0x7F, 0x7FF, 0xFFFF, 0x10FFFF)


def _spans(low: bytes, high: bytes) -> Iterator[tuple[tuple[int, int], ...]]:
    """Byte strings from low to high (of one length) as products of byte ranges."""
    if len(low) == 1:
        yield ((low[0], high[0]),)
        return
    bottom, top = b"\x80" * (len(low) - 1), b"\xbf" * (len(low) - 1)
    if low[0] == high[0]:
        for rest in _spans(low[1:], high[1:]):
            yield ((low[0], low[0]), *rest)
        return
    first, last = low[0], high[0]
    if low[1:] != bottom:
        for rest in _spans(low[1:], top):
            yield ((first, first), *rest)
        first += 1
    ragged = high[1:] != top
    if ragged:
        last -= 1
    if first <= last:
        yield ((first, last), *[(0x80, 0xBF)] * (len(low) - 1))
    if ragged:
        for rest in _spans(bottom, high[1:]):
            yield ((high[0], high[0]), *rest)


def utf8(ranges: Ranges) -> Iterator[tuple[tuple[int, int], ...]]:
    """Ranges of code points as sequences of byte ranges; surrogates have none."""
    for a, b in ranges:
        for low, high in ((a, min(b, 0xD7FF)), (max(a, 0xE000), b)):
            for floor, top in zip((0, *(n + 1 for n in _LENGTHS[:-1])), _LENGTHS, strict=True):
                x, y = max(low, floor), min(high, top)
                if x <= y:
                    yield from _spans(chr(x).encode(), chr(y).encode())


#: Where a byte of a character leads: nowhere, or out of the character.
NOWHERE, OUT = -1, -2


class _Character:
    """The bytes of a set of characters as a small minimal automaton: ``nodes`` of (low, high, node or OUT), the first one its entry."""

    def __init__(self, ranges: Ranges):
        self.nodes: list[list[tuple[int, int, int]]] = []
        self._known: dict[tuple, int] = {}
        sequences = tuple(utf8(ranges))
        if sequences:
            self._node(sequences)
        self.rows: list[list[int]] = []

    def _node(self, sequences: tuple[tuple[tuple[int, int], ...], ...]) -> int:
        if sequences in self._known:
            return self._known[sequences]
        number = self._known[sequences] = len(self.nodes)
        self.nodes.append([])
        cuts = sorted({x for s in sequences for x in (s[0][0], s[0][1] + 1)})
        arcs: list[tuple[int, int, int]] = []
        starting, active = defaultdict(list), []
        for s in sequences:
            starting[s[0][0]].append(s)
        for low, after in zip(cuts, cuts[1:], strict=False):
            active = [s for s in active if s[0][1] >= low] + starting[low]
            if active:
                tails = tuple(sorted({s[1:] for s in active}))
                to = OUT if tails == ((),) else self._node(tails)
                if arcs and arcs[-1][1] + 1 == low and arcs[-1][2] == to:
                    arcs[-1] = (arcs[-1][0], after - 1, to)
                else:
                    arcs.append((low, after - 1, to))
        self.nodes[number] = arcs
        return number

    def spread(self, classes: np.ndarray, n: int) -> None:
        """Rows by byte class."""
        for arcs in self.nodes:
            row = [NOWHERE] * n
            for low, high, to in arcs:
                for c in range(classes[low], classes[high] + 1):
                    row[c] = to
            self.rows.append(row)


@dataclass
class _Threads:
    """States: ("set", character, node, number of its first node, next), ("split", [next, ...]), ("end", next), ("start", next), ("match",)."""

    most: int = MOST_THREADS
    states: list = field(default_factory=list)
    sets: dict = field(default_factory=dict)

    def add(self, *state) -> int:
        if len(self.states) >= self.most:
            raise IndexDfaError("the pattern is too large")
        self.states.append(state)
        return len(self.states) - 1

    def build(self, node, after: int) -> int:
        """The entry of ``node`` that goes on to ``after``."""
        kind = node[0]
        if kind == "set":
            return self.characters(node[1], after)
        if kind == "cat":
            for part in reversed(node[1]):
                after = self.build(part, after)
            return after
        if kind == "alt":
            return self.add("split", [self.build(part, after) for part in node[1]])
        if kind in ("start", "end"):
            return self.add(kind, after)
        _, part, low, high, greedy = node
        order = (lambda inside, out: [inside, out]) if greedy else (lambda inside, out: [out, inside])
        if high is None:
            loop = self.add("split", [])
            self.states[loop] = ("split", order(self.build(part, loop), after))
            if low:
                # The last required copy is the one that loops.
                loop = self.build(part, loop)
                low -= 1
            after = loop
        else:
            out = after
            for _ in range(high - low):
                after = self.add("split", order(self.build(part, after), out))
        for _ in range(low):
            after = self.build(part, after)
        return after

    def characters(self, ranges: Ranges, after: int) -> int:
        character = self.sets.get(ranges) or self.sets.setdefault(ranges, _Character(ranges))
        if not character.nodes:
            return self.add("split", [])
        first = len(self.states)
        for i in range(len(character.nodes)):
            self.add("set", character, i, first, after)
        return first


@dataclass(frozen=True)
class Automaton:
    """``delta[state * n_classes + classes[byte]]`` is the next state; ``final`` says where the text may end, ``useful`` which states an index keeps."""

    pattern: str
    delta: np.ndarray
    classes: np.ndarray
    final: np.ndarray
    useful: np.ndarray

    @property
    def n_classes(self) -> int:
        return int(self.classes.max()) + 1

    @property
    def n_states(self) -> int:
        return len(self.final)

    def step(self, state: int, byte: int) -> int:
        return int(self.delta[state * self.n_classes + self.classes[byte]])

    def walk(self, data: bytes, state: int = START) -> int:
        n, delta, classes = self.n_classes, self.delta, self.classes
        for b in data:
            state = int(delta[state * n + classes[b]])
            if state == DEAD:
                break
        return state

    def accepts(self, data: bytes) -> bool:
        return bool(self.final[self.walk(data)])

    def live_bytes(self, state: int) -> list[int]:
        return [b for b in range(256) if self.step(state, b) != DEAD]


def _components(after: list[list[int]]) -> list[int]:
    """The strongly connected component of each state, numbered so that what a component leads to has lesser numbers (Tarjan's algorithm, without recursion)."""
    n = len(after)
    order, low, own, stack, number = [-1] * n, [0] * n, [-1] * n, [], 0
    found = 0
    for root in range(n):
        if order[root] >= 0:
            continue
        order[root] = low[root] = number
        number += 1
        stack.append(root)
        todo = [(root, iter(after[root]))]
        while todo:
            s, rest = todo[-1]
            for t in rest:
                if order[t] < 0:
                    order[t] = low[t] = number
                    number += 1
                    stack.append(t)
                    todo.append((t, iter(after[t])))
                    break
                if own[t] < 0:
                    low[s] = min(low[s], order[t])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[s])
                if low[s] == order[s]:
                    while True:
                        t = stack.pop()
                        own[t] = found
                        if t == s:
                            break
                    found += 1
    return own


def _ranks(after: list[list[int]]) -> list[int]:
    """How far a state is above its last cycle or end; equivalent states have equal ranks, and what follows a state never a greater one. -1 is for cycles that nothing leaves."""
    own = _components(after)
    members = defaultdict(list)
    for s, c in enumerate(own):
        members[c].append(s)
    rank, founded = [0] * len(after), [True] * len(after)
    for c in range(len(members)):
        below = [t for s in members[c] for t in after[s] if own[t] != c]
        cyclic = len(members[c]) > 1 or members[c][0] in after[members[c][0]]
        highest = max([rank[t] + founded[t] for t in below], default=-1 if cyclic else 0)
        for s in members[c]:
            rank[s], founded[s] = highest, not cyclic and all(founded[t] for t in below)
    return rank


def minimised(delta: np.ndarray, labels: list) -> np.ndarray:
    """The block of each state in the coarsest partition that tells labels apart and that ``delta`` (states x classes) respects.

    By rank: what a state leads to in lesser ranks is known when its turn comes, so states of one rank are told apart by one look at their rows, and only where they lead to each other are blocks split
    again: a block that splits keeps its number for its largest part, and only what leads to the other parts is looked at once more.
    """
    after = [sorted({*row} - {DEAD}) for row in delta.tolist()]
    rank = _ranks(after)
    levels = defaultdict(list)
    for s in range(1, len(delta)):
        levels[rank[s]].append(s)
    block = np.zeros(len(delta), np.int64)
    blocks = 1

    for level in sorted(levels):
        members = levels[level]
        inside = set(members)
        before = defaultdict(list)
        for s in members:
            for t in after[s]:
                if t in inside:
                    before[t].append(s)
        kinds: dict = {}
        for s in members:  # all of one label first
            block[s] = kinds.setdefault(labels[s], blocks + len(kinds))
        blocks += len(kinds)
        holds = defaultdict(set)
        for s in members:
            holds[int(block[s])].add(s)
        dirty = inside
        while dirty:
            by_block = defaultdict(list)
            for s in dirty:
                by_block[int(block[s])].append(s)
            rows = {s: block[delta[s]].tobytes() for s in dirty}
            moved: list[int] = []
            for b, some in by_block.items():
                parts = defaultdict(list)
                for s in sorted(some):
                    parts[rows[s]].append(s)
                clean = holds[b].difference(some)
                if clean:  # they agree with each other
                    same = block[delta[next(iter(clean))]].tobytes()
                    parts[same] += clean
                stays = max(parts, key=lambda k: len(parts[k]))
                for k, part in parts.items():
                    if k != stays:
                        holds[b].difference_update(part)
                        holds[blocks].update(part)
                        moved += [(s, blocks) for s in part]
                        blocks += 1
            for s, b in moved:
                block[s] = b
            dirty = {p for s, _ in moved for p in before[s]}
    return block


def _numbered(delta: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one state of each block in breadth-first order from the start, the blocks' own table); the dead state's comes first."""
    _, first = np.unique(block, return_index=True)
    of = dict(zip(block[first].tolist(), first.tolist(), strict=True))
    order, numbers = [DEAD, of[int(block[START])]], {int(block[DEAD]): DEAD, int(block[START]): START}
    at = START
    while at < len(order):
        for b in dict.fromkeys(block[delta[order[at]]].tolist()):
            if b not in numbers:
                numbers[b] = len(order)
                order.append(of[b])
        at += 1
    names = np.zeros(int(block.max()) + 1, np.int64)
    names[list(numbers)] = list(numbers.values())
    return np.array(order), names[block[delta[order]]]


def compile_pattern(pattern: str, semantics: str = "first", most_threads: int = MOST_THREADS, most_states: int = MOST_STATES, minimal: bool = True) -> Automaton:
    """The automaton of a pattern, anchored at both ends of the text. Larger ones than ``most_threads`` and ``most_states`` are refused: they are the driver's memory."""
    threads = _Threads(most_threads)
    try:
        entry = threads.build(parse(pattern), threads.add("match"))
    except RecursionError as e:
        raise IndexDfaError("the pattern nests too deep") from e
    states = threads.states

    def closure(roots: list[int], at_start: bool = False) -> tuple[int, ...]:
        """The threads reachable without a byte, in order of preference."""
        seen: set[int] = set()
        out, stack = [], list(reversed(roots))
        while stack:
            i = stack.pop()
            if i in seen:
                continue
            seen.add(i)
            kind = states[i][0]
            if kind == "split":
                stack.extend(reversed(states[i][1]))
            elif kind == "start":
                if at_start:
                    raise DfaHasNoStartState()
            else:
                out.append(i)
        return tuple(out)

    def ends(threads_: tuple[int, ...]) -> bool:
        seen, stack = set(), list(threads_)
        while stack:
            i = stack.pop()
            if i in seen:
                continue
            seen.add(i)
            kind = states[i][0]
            if kind == "match":
                return True
            if kind == "end":
                stack.append(states[i][1])
            elif kind == "split":
                stack.extend(states[i][1])
        return False

    cuts = np.zeros(257, bool)
    cuts[0] = True
    for character in threads.sets.values():
        for arcs in character.nodes:
            for low, high, _ in arcs:
                cuts[low] = cuts[high + 1] = True
    classes = np.cumsum(cuts[:256]) - 1
    n_classes = int(classes[-1]) + 1
    for character in threads.sets.values():
        character.spread(classes, n_classes)

    start = (closure([entry], at_start=True), False)
    numbers = {((), False): DEAD, start: START}
    order = [((), False), start]
    rows: list[list[int]] = [[DEAD] * n_classes]
    #: By what threads go on, and whether the set before had matched: the state.
    led: dict[tuple, int] = {}
    at = START
    while at < len(order):
        matched, moving = False, []
        for i in order[at][0]:
            kind = states[i][0]
            if kind == "match":
                matched = True
                if semantics == "first":
                    break
            elif kind == "set":
                _, character, node, first, after = states[i]
                moving.append([first + t if t >= 0 else after if t == OUT else NOWHERE for t in character.rows[node]])
        row = []
        for going in zip(*moving, strict=True) if moving else [()] * n_classes:
            key = (going, matched)
            if key not in led:
                state = (closure([t for t in going if t != NOWHERE]), matched)
                if state not in numbers:
                    if len(order) >= most_states:
                        raise IndexDfaError("the automaton is too large")
                    numbers[state] = len(order)
                    order.append(state)
                led[key] = numbers[state]
            row.append(led[key])
        rows.append(row)
        at += 1
    delta = np.array(rows, np.int64)
    final = np.array([ends(t) for t, _ in order])
    useful = final | (delta != DEAD).any(axis=1)
    useful[DEAD] = False
    if minimal:
        kept, delta = _numbered(delta, minimised(delta, list(zip(final.tolist(), useful.tolist(), [bit for _, bit in order], strict=True))))
        final, useful = final[kept], useful[kept]
        columns, kinds = np.unique(delta, axis=1, return_inverse=True)
        # Classes in the order of their first byte.
        firsts = np.full(columns.shape[1], n_classes)
        np.minimum.at(firsts, kinds.reshape(-1), np.arange(n_classes))
        place = np.argsort(np.argsort(firsts))
        delta, classes = columns[:, np.argsort(firsts)], place[kinds.reshape(-1)][classes]
    return Automaton(pattern, delta.reshape(-1).astype(np.int32), classes.astype(np.int32), final, useful)
