"""Byte automata run over many chunks at once: a chunk gives a function of states, and functions compose."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes that one lane of the scan steps through. A chunk is a row of lanes.
LANE = 256
#: The symbol after a chunk's last byte in its last lane: states stay, nothing is counted.
BLANK = 256


@dataclass(frozen=True)
class Automaton:
    """``step[s, b]``: the state after byte b in state s; bit k of ``emits[s, b]``: counter k goes up. State 0 is the start."""

    step: np.ndarray
    emits: np.ndarray
    counters: int

    @property
    def states(self) -> int:
        return len(self.step)

    def packed(self) -> np.ndarray:
        """One number a cell: the state after it, times 2**counters, and what it counts. Flat, with the blank."""
        out = np.empty((self.states, 257), np.uint16)
        out[:, :256] = self.step.astype(np.uint16) << self.counters | self.emits
        out[:, BLANK] = np.arange(self.states) << self.counters
        return out.reshape(-1)


def characters() -> Automaton:
    """Counts code points of UTF-8 at their first byte. The state is the number of bytes that the code point still has."""
    step, emits = np.zeros((4, 256), np.uint8), np.ones((4, 256), np.uint8)
    for lead, left in ((0xC0, 1), (0xE0, 2), (0xF0, 3)):
        step[:, lead:] = left
    for state in (1, 2, 3):
        step[state, 0x80:0xC0], emits[state, 0x80:0xC0] = state - 1, 0
    return Automaton(step, emits, 1)


def words() -> Automaton:
    """Counts words at their first byte: the state says whether a word is open."""
    step, emits = np.ones((2, 256), np.uint8), np.zeros((2, 256), np.uint8)
    emits[0] = 1
    for space in (0x20, *range(0x09, 0x0E)):
        step[:, space], emits[:, space] = 0, 0
    return Automaton(step, emits, 1)


def marks(strings: tuple[str, ...]) -> Automaton:
    """Counts the bytes at which one of the strings ends. A state is the longest end of the text that begins one of them."""
    wanted = [s.encode() for s in strings]
    heads = sorted({w[:i] for w in wanted for i in range(len(w) + 1)}, key=lambda h: (len(h), h))
    step, emits = np.zeros((len(heads), 256), np.uint8), np.zeros((len(heads), 256), np.uint8)
    for s, head in enumerate(heads):
        for b in range(256):
            seen = head + bytes([b])
            step[s, b] = next(heads.index(seen[i:]) for i in range(len(seen) + 1) if seen[i:] in heads)
            emits[s, b] = any(seen.endswith(w) for w in wanted)
    return Automaton(step, emits, 1)


def both(a: Automaton, b: Automaton) -> Automaton:
    """The automaton that runs both, of the pairs of states that can be reached; counters of a, then of b."""
    pairs, todo = {(0, 0): 0}, [(0, 0)]
    rows = []
    for s, t in todo:
        row = []
        for byte in range(256):
            pair = (int(a.step[s, byte]), int(b.step[t, byte]))
            if pair not in pairs:
                pairs[pair] = len(pairs)
                todo.append(pair)
            row.append(pairs[pair])
        rows.append(row)
    emits = np.array([a.emits[s] | b.emits[t] << a.counters for s, t in todo], np.uint8)
    return Automaton(np.array(rows, np.uint8), emits, a.counters + b.counters)


class Lanes:
    """The bytes of several chunks, in lanes."""

    def __init__(self, automaton: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """``data``: uint8; chunk i has the bytes from starts[i] to ends[i]."""
        self.automaton, self.ends = automaton, ends
        count = -(-(ends - starts) // LANE)
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        self.chunk = np.repeat(np.arange(len(starts)), count)
        self.begin = starts[self.chunk] + (np.arange(len(self.chunk)) - self.first[self.chunk]) * LANE
        at = self.begin[None, :] + np.arange(LANE)[:, None]
        self.symbols = np.full(at.shape, BLANK, np.uint16)
        real = at < ends[self.chunk]
        self.symbols[real] = data[at[real]]
        self._run()

    def _run(self) -> None:
        """For each lane and start state: the state at its end and the counts."""
        table, k = self.automaton.packed(), self.automaton.counters
        n, states = len(self.chunk), self.automaton.states
        now = np.tile(np.arange(states, dtype=np.int64), (n, 1))
        counts = np.zeros((k, n, states), np.int64)
        for column in self.symbols:
            cell = table[now * 257 + column[:, None]]
            for c in range(k):
                counts[c] += cell >> c & 1
            now = (cell >> k).astype(np.int64)
        self.end, self.counts = now, counts

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk: the state at its end [chunk, state], and counts [counter, chunk, state]. Neighbouring functions
        compose, two at a time, until one is left a chunk; composition is associative, so any order gives the same."""
        n, states = len(self.first) - 1, self.automaton.states
        end = np.tile(np.arange(states), (n, 1))
        counts = np.zeros((self.automaton.counters, n, states), np.int64)
        owner, f, c = self.chunk, self.end, self.counts
        while len(owner):
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            left = np.flatnonzero(place % 2 == 0)
            right = left + 1
            paired = (right < len(owner)) & (owner[np.minimum(right, len(owner) - 1)] == owner[left])
            f2, c2 = f[left].copy(), c[:, left].copy()
            l, r = left[paired], right[paired]
            f2[paired] = np.take_along_axis(f[r], f[l], 1)
            c2[:, paired] = c[:, l] + np.take_along_axis(c[:, r], np.broadcast_to(f[l], c[:, l].shape), 2)
            owner, f, c = owner[left], f2, c2
            if not paired.any():
                end[owner], counts[:, owner] = f, c
                break
        return end, counts

    def place(self, chunk: np.ndarray, entry: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The byte of ``data`` at which counter 0 goes from ``wanted`` to one more, the given chunk entered in the given state;
        the chunk's end where it never does. Lanes are entered one after the other, then one lane is stepped through."""
        state, left = entry.astype(np.int64).copy(), wanted.astype(np.int64).copy()
        lane, stop = self.first[chunk].copy(), self.first[chunk + 1]
        out = self.ends[chunk].copy()
        going = np.flatnonzero(lane < stop)
        inside = []
        while len(going):
            has = self.counts[0][lane[going], state[going]]
            hit = has > left[going]
            inside.append(going[hit])
            going, has = going[~hit], has[~hit]
            left[going] -= has
            state[going] = self.end[lane[going], state[going]]
            lane[going] += 1
            going = going[lane[going] < stop[going]]
        rows = np.concatenate(inside) if inside else np.zeros(0, np.int64)
        table, k = self.automaton.packed(), self.automaton.counters
        for t in range(LANE):
            if not len(rows):
                break
            cell = table[state[rows] * 257 + self.symbols[t, lane[rows]]]
            hit = (cell & 1 == 1) & (left[rows] == 0)
            out[rows[hit]] = self.begin[lane[rows[hit]]] + t
            left[rows] -= cell & 1
            state[rows] = cell >> k
            rows = rows[~hit]
        return out
