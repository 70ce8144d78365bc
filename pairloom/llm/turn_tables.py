"""Cheapest repair of a sequence of turns by block tables (Four Russians).

A repaired conversation is ``(s?(ua)+)?`` in role initials.  An automaton with
four states (nothing yet, after s, after u, after a) reads it; the cost still
to pay from each state is a vector of four numbers.  Less their minimum, only
few such vectors exist, so the step over every block of BLOCK symbols from
every vector is computed once; a sequence is then taken block by block, from
its end, by lookup.  For the edits themselves each block is expanded backward
to its inner vectors and traced forward: the letters' order decides ties, so
the trace is the ASCII-least of the cheapest."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: fixed values: costs of the edits and of a truncated turn that stays
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: states, and where a new user or assistant turn leads from each
START, S, U, A = range(4)
NEXT = (U, U, A, U)
ROLE = {U: "user", A: "assistant"}

#: where a kept turn of each role class (s, u, a, other) leads; -1: not allowed
KEPT = {0: (S, -1, -1, -1), 1: (U, U, -1, U), 2: (-1, -1, A, -1), 3: (-1, -1, -1, -1)}

#: symbols: 0 must go; 1 + 2 * role class, plus 1 if truncated
SYMBOLS = 9
BLOCK = 4

#: cost still to pay after the last turn
END = (0, 10, 5, 0)


def _moves(symbol: int, state: int):
    """(letter, cost, state after) of the edits that take a turn, by letter."""
    yield "D", DELETE, state
    if symbol:
        role, extra = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
        if KEPT[role][state] >= 0:
            yield "K", KEEP + extra, KEPT[role][state]
        yield "R", REROLE + extra, NEXT[state]


def _before(symbol: int, after: tuple) -> tuple:
    """The costs before a turn, from those after it; turns may be inserted."""
    cost = [min(c + after[to] for _, c, to in _moves(symbol, q)) for q in range(4)]
    for _ in range(3):  # at most three in a row: a fourth would lead where one had
        cost = [min(c, INSERT + cost[NEXT[q]]) for q, c in enumerate(cost)]
    return tuple(cost)


class TurnTables:
    def __init__(self):
        self.vectors, ids, self.step, self.paid = [END], {END: 0}, [], []
        for v in self.vectors:  # grows until closed
            row, paid = [], []
            for symbol in range(SYMBOLS):
                cost = _before(symbol, v)
                least = min(cost)
                norm = tuple(c - least for c in cost)
                if norm not in ids:
                    ids[norm] = len(self.vectors)
                    self.vectors.append(norm)
                row.append(ids[norm])
                paid.append(least)
            self.step.append(row)
            self.paid.append(paid)
        step, paid = np.array(self.step), np.array(self.paid)
        to, cost = step, paid
        for _ in range(BLOCK - 1):  # one more symbol in front
            cost = np.moveaxis(cost[..., None] + paid[to], -1, 1)
            to = np.moveaxis(step[to], -1, 1)
        self.block_to, self.block_paid = to.reshape(len(step), -1), cost.reshape(len(step), -1)
        self.expanded = lru_cache(1 << 16)(self._expanded)

    @staticmethod
    def _blocks(symbols: bytes) -> np.ndarray:
        """Indices of the whole blocks; what is left over stands in front."""
        own = np.frombuffer(symbols, np.uint8)[len(symbols) % BLOCK:].reshape(-1, BLOCK).astype(np.int64)
        return own @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def function(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """From every vector behind a stretch to that before it, and the cost."""
        at = np.arange(len(self.vectors))
        paid = np.zeros(len(at), np.int64)
        for block in self._blocks(symbols)[::-1]:
            paid += self.block_paid[at, block]
            at = self.block_to[at, block]
        for symbol in reversed(symbols[:len(symbols) % BLOCK]):
            paid += np.array(self.paid)[at, symbol]
            at = np.array(self.step)[at, symbol]
        return at, paid

    def back(self, symbols: bytes, end: int = 0) -> tuple[list[int], int]:
        """The vector behind the front rest and behind each block, and the
        cost beyond the first vector's minimum, by one lookup a block."""
        behind, cost = [end], 0
        for block in self._blocks(symbols)[::-1].tolist():
            cost += int(self.block_paid[end, block])
            end = int(self.block_to[end, block])
            behind.append(end)
        for symbol in reversed(symbols[:len(symbols) % BLOCK]):
            cost += self.paid[end][symbol]
            end = self.step[end][symbol]
        return behind[::-1], cost + self.vectors[end][START]

    def _expanded(self, symbols: bytes, end: int, state: int) -> tuple[str, tuple, int]:
        """A block from one state: letters, the state after each, the last state."""
        inner = [end]
        for symbol in reversed(symbols):
            inner.append(self.step[inner[-1]][symbol])
        inner.reverse()
        letters, states = [], []
        for symbol, here, there in zip(symbols, inner, inner[1:]):
            v, w, paid = self.vectors[here], self.vectors[there], self.paid[there][symbol]
            taken = False
            while not taken:
                moves = {m: (to, c + w[to] == v[state] + paid) for m, c, to in _moves(symbol, state)}
                moves["I"] = NEXT[state], INSERT + v[NEXT[state]] == v[state]
                letter = min(m for m, (_, best) in moves.items() if best)
                state, taken = moves[letter][0], letter != "I"
                letters.append(letter)
                states.append(state)
        return "".join(letters), tuple(states), state

    def trace(self, symbols: bytes, end: int = 0, state: int = START) -> tuple[str, list, int]:
        """Letters and the state after each, over a stretch that starts in
        ``state`` and has the vector ``end`` behind it."""
        behind, _ = self.back(symbols, end)
        letters, states, at = [], [], 0
        for k, vector in enumerate(behind):
            to = len(symbols) % BLOCK + k * BLOCK
            part, after, state = self.expanded(symbols[at:to], vector, state)
            letters.append(part)
            states += after
            at = to
        return "".join(letters), states, state

    @staticmethod
    def closing(state: int) -> tuple[str, list]:
        """The turns that still have to be inserted after the last one."""
        states = []
        while state in (S, U):
            state = NEXT[state]
            states.append(state)
        return "I" * len(states), states


def repaired(letters: str, states: list, rows: list[tuple[str, str]]):
    """The lines ``role:text`` that the edits leave of the rows."""
    rows = iter(rows)
    for letter, state in zip(letters, states):
        role, text = (ROLE[state], "") if letter == "I" else next(rows)
        if letter != "D":
            yield f"{ROLE[state] if letter == 'R' else role}:{text}"
