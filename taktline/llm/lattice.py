"""Cheapest edits of a run of conversation turns: bidirectional Dijkstra over the lattice of turns and role states.

A lattice node is (turns consumed, state of the roles kept so far). Edits are its edges: Keep, Rerole and Delete consume a
turn, Insert consumes none. Labels are (cost, audit), the audit being the initials of the edits in order; of two ways with
the same cost the one with the least audit counts. This is well defined node by node: an audit fixes its way, and every
Insert costs something, so that no audit at a node is the beginning of another one with the same cost.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

START, SYSTEM, USER, ASSISTANT = range(4)  # nothing kept yet; last role kept
STATES = range(4)
FINAL = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT = "KRDI"
INSERT_COST, REROLE_COST, DELETE_COST, TRUNCATED_COST = 3, 3, 4, 3
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # role that may follow, but for a first system turn
KEPT = {"s": SYSTEM, "u": USER, "a": ASSISTANT}

Label = tuple[int, str]


def _kept_state(state: int, initial: str) -> int | None:
    """State after a turn is kept as it is."""
    kept = KEPT.get(initial)
    if kept == SYSTEM:
        return SYSTEM if state == START else None
    return kept if kept == NEXT[state] else None


def edits(turn: tuple[str, bool, bool], state: int) -> Iterable[tuple[str, int, int]]:
    """(edit, cost, next state) that consume a turn (role initial, has to go, truncated)."""
    initial, has_to_go, truncated = turn
    yield DELETE, DELETE_COST, state
    if not has_to_go:
        more = TRUNCATED_COST * truncated
        kept = _kept_state(state, initial)
        if kept is not None:
            yield KEEP, more, kept
        yield REROLE, REROLE_COST + more, NEXT[state]


class _Side:
    """One direction: settled labels, open labels and a heap.

    Edits without cost move on by a turn, so that among equal costs nodes are settled in the order of their turns, when
    no better audit of the same cost can come any more.
    """

    def __init__(self, sources: Iterable[tuple[int, int]], forward: bool):
        self.forward = forward
        self.open: dict[tuple[int, int], Label] = {node: (0, "") for node in sources}
        self.done: dict[tuple[int, int], Label] = {}
        self.heap = [(0, self._rank(node), node) for node in self.open]
        heapq.heapify(self.heap)

    def _rank(self, node: tuple[int, int]) -> int:
        return node[0] if self.forward else -node[0]

    def least(self) -> float:
        """Least cost of a node that is not settled."""
        while self.heap and (self.heap[0][2] in self.done or self.open[self.heap[0][2]][0] < self.heap[0][0]):
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> tuple[int, int]:
        node = heapq.heappop(self.heap)[2]
        self.done[node] = self.open.pop(node)
        return node

    def reach(self, node: tuple[int, int], label: Label) -> None:
        if node not in self.done and (node not in self.open or label < self.open[node]):
            if node not in self.open or label[0] < self.open[node][0]:
                heapq.heappush(self.heap, (label[0], self._rank(node), node))
            self.open[node] = label


def cheapest(turns: list[tuple[str, bool, bool]], entry: int = START, exits: Iterable[int] = FINAL) -> Label | None:
    """Least cost and, at that cost, least audit from one state to any of ``exits`` over all turns; None without a way.

    Forward and reverse search take turns by their least open cost. They go on while their least costs together don't
    exceed the best crossing: then each of the cheapest ways has an edge, or an end, whose two sides are settled, and
    the least concatenated audit among these crossings is the answer.
    """
    n = len(turns)
    back: dict[int, list[list[tuple[str, int, int]]]] = {}

    def into(i: int) -> list[list[tuple[str, int, int]]]:
        """Edges into nodes after turn i: per state (edit, cost, state before)."""
        if i not in back:
            back[i] = [[] for _ in STATES]
            for state in STATES:
                for edit, cost, after in edits(turns[i], state):
                    back[i][after].append((edit, cost, state))
        return back[i]

    before_insert = [[s for s in STATES if NEXT[s] == state] for state in STATES]
    ahead, behind = _Side([(0, entry)], True), _Side([(n, x) for x in exits], False)
    best: Label | None = None

    def cross(first: Label, edit: str, cost: int, second: Label) -> None:
        nonlocal best
        label = first[0] + cost + second[0], first[1] + edit + second[1]
        if best is None or label < best:
            best = label

    while True:
        a, b = ahead.least(), behind.least()
        if min(a, b) == float("inf") or (best is not None and a + b > best[0]):
            return best
        if a <= b:
            node = ahead.settle()
            label = ahead.done[node]
            if node in behind.done:
                cross(label, "", 0, behind.done[node])
            i, state = node
            steps = [(INSERT, INSERT_COST, (i, NEXT[state]))]
            if i < n:
                steps += [(edit, cost, (i + 1, after)) for edit, cost, after in edits(turns[i], state)]
            for edit, cost, after in steps:
                if after in behind.done:
                    cross(label, edit, cost, behind.done[after])
                ahead.reach(after, (label[0] + cost, label[1] + edit))
        else:
            node = behind.settle()
            label = behind.done[node]
            if node in ahead.done:
                cross(ahead.done[node], "", 0, label)
            i, state = node
            steps = [(INSERT, INSERT_COST, (i, s)) for s in before_insert[state]]
            if i > 0:
                steps += [(edit, cost, (i - 1, s)) for edit, cost, s in into(i - 1)[state]]
            for edit, cost, before in steps:
                if before in ahead.done:
                    cross(ahead.done[before], edit, cost, label)
                behind.reach(before, (label[0] + cost, edit + label[1]))


def apply(turns: list[tuple[str, str]], audit: str, state: int = START) -> tuple[list[tuple[str, str]], int]:
    """The repaired (role, text) turns and the state behind them."""
    out, at = [], iter(turns)
    for edit in audit:
        if edit == INSERT:
            state = NEXT[state]
            out.append((_role(state), ""))
            continue
        role, text = next(at)
        if edit == REROLE:
            state = NEXT[state]
            out.append((_role(state), text))
        elif edit == KEEP:
            state = KEPT[role[:1]]
            out.append((role, text))
    return out, state


def _role(state: int) -> str:
    return "user" if state == USER else "assistant"
