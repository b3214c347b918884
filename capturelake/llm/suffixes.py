"""Runs of byte windows by their anchors, and a walk over sorted ranks in constant memory."""

from __future__ import annotations

import numpy as np

from capturelake.llm.hashing import Prefix, joined

LENGTH = 100
GRAM = 32


def _lesser(least: np.ndarray, where: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each value and the one ``step`` on, the lesser with its place; the left one of equals."""
    if not step:
        return least, where
    right = least[step:] < least[:-step]
    return np.where(right, least[step:], least[:-step]), np.where(right, where[step:], where[:-step])


def _least_places(ranks: np.ndarray, width: int, block: int = 1 << 17) -> np.ndarray:
    """The leftmost place of the least of every ``width`` neighbouring ranks. Blocks keep what it needs beside the result small."""
    n = len(ranks) - width + 1
    places = np.empty(n, np.int32 if len(ranks) < 1 << 31 else np.int64)
    for a in range(0, n, block):
        b = min(a + block, n)
        least, where = ranks[a : b + width - 1], np.arange(a, b + width - 1, dtype=places.dtype)
        span = 1
        while span * 2 <= width:
            least, where = _lesser(least, where, span)
            span *= 2
        places[a:b] = _lesser(least, where, width - span)[1]
    return places


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Splits all window starts of the texts by the anchor of their window.

    A window is ``length`` bytes; its anchor is the leftmost of its grams (``gram`` bytes) with the least hash, so equal
    windows have their anchor at one place. Neighbouring windows with one anchor form a run.
    Returns arrays (text, first start, last start, rank of the anchor's gram, rank of the run's whole stretch) with
    starts within the text, and (prefix sums, text starts) for further ranks.
    """
    data, starts = joined(texts)
    prefix, n = Prefix(data), len(data)
    empty = np.zeros(0, np.int64)
    lengths = np.diff(starts) - 1
    counts = np.maximum(lengths - length + 1, 0)
    if not counts.sum():
        return (empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)), prefix, starts
    at = np.arange(n - gram + 1)
    ranks = prefix.hashes(at, at + gram)
    del at
    # whole hashes, leftmost of equals: nothing of an anchor depends on the slice
    least = _least_places(ranks, length - gram + 1)
    text = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    place = np.arange(len(text)) - first[text] + starts[text]
    anchor = least[place]
    new = np.ones(len(place), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(place)) - 1
    lo, hi, x, text = place[begin], place[end], anchor[begin], text[begin]
    whole = prefix.hashes(lo, hi + length) ^ (x - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (text, lo - starts[text], hi - starts[text], ranks[x], whole), prefix, starts


class FirstOnes:
    """Walks rows sorted by (group, rank, doc, lo) in batches, in constant memory.

    ``feed`` returns two masks or row lists: rows whose rank an earlier position has (``covered``), and first positions
    of a rank in groups that have several ranks (``open``), which may agree with each other in part.
    """

    def __init__(self):
        self.last = None  # group, rank, doc, lo of the rank's first position, number of ranks in the group
        self.held = None  # the group's only rank so far: its first row

    def feed(self, group, rank, doc, lo, hi):
        n = len(group)
        if not n:
            return np.zeros(0, bool), (doc, lo, hi)
        new_g, new_r = np.ones(n, bool), np.ones(n, bool)
        new_g[1:] = group[1:] != group[:-1]
        new_r[1:] = new_g[1:] | (rank[1:] != rank[:-1])
        before = 0
        if self.last is not None and self.last[0] == group[0]:
            new_g[0] = False
            new_r[0] = self.last[1] != rank[0]
            before = self.last[4]
        at = np.arange(n)
        lead = np.maximum.accumulate(np.where(new_r, at, -1))
        lead_doc = np.where(lead >= 0, doc[lead], self.last[2] if self.last else 0)
        lead_lo = np.where(lead >= 0, lo[lead], self.last[3] if self.last else 0)
        covered = (doc != lead_doc) | (lo != lead_lo)
        # ranks so far in the row's group, and in the whole group as far as this batch goes
        number = np.cumsum(new_g) - new_g[0]
        ranks = np.bincount(number, new_r, number[-1] + 1).astype(np.int64)
        if not new_g[0]:
            ranks[0] += before
        several = ranks[number] > 1
        take = new_r & several
        out = [(doc[take], lo[take], hi[take])]
        if self.held is not None:
            if not new_g[0] and ranks[0] > 1:
                out.insert(0, tuple(np.array([v]) for v in self.held))
                self.held = None
            elif new_g[0] or number[-1] > 0:
                self.held = None
        if ranks[-1] == 1 and (number[-1] > 0 or new_g[0]):
            i = int(lead[-1])
            self.held = (doc[i], lo[i], hi[i])
        self.last = (group[-1], rank[-1], lead_doc[-1], lead_lo[-1], int(ranks[-1]))
        return covered, tuple(np.concatenate(c) for c in zip(*out))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of the union of [lo, hi), touching ones joined."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return lo[begin], reach[np.append(begin[1:], len(lo)) - 1]
