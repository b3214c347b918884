"""Hashes of the words, shingles and byte windows of a batch of texts, by arrays instead of loops."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class Prefix:
    """Hashes of any stretches of one byte array, from sums of byte values times powers."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(_powers[0]) < n:
            size = max(n, 1 << 20)
            for i, base in enumerate((_BASE, _BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps, dtype=np.uint64)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[data] * _powers[0][: n - 1], dtype=np.uint64, out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _powers[1][start] + (end - start).astype(np.uint64))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text followed by a space, and the texts' starts (one more than texts)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, hash) of every run of ``width`` words, in order; a shorter text with words gives one of all its words."""
    data, starts = joined(texts)
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = Prefix(data).hashes(first, last)
    owner = np.searchsorted(starts, first, side="right") - 1
    count = np.bincount(owner, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    total = np.zeros(len(words), np.uint64)
    for j in range(min(width, len(words))):
        total[: len(words) - j] += words[j:] * _powers[0][j + 1]
    keep = np.arange(len(words)) + width <= (begin + count)[owner]
    short = np.flatnonzero((count > 0) & (count < width))
    extra = np.zeros(len(short), np.uint64)
    for j in range(width - 1):
        has = count[short] > j
        extra[has] += words[begin[short[has]] + j] * _powers[0][j + 1]
    index = np.concatenate([owner[keep], short])
    value = mix(np.concatenate([total[keep], extra + np.uint64(1)]))
    if len(short):
        order = np.argsort(index, kind="stable")
        index, value = index[order], value[order]
    return index, value


def distinct(index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (index, value) with their counts, sorted."""
    order = np.lexsort((value, index))
    index, value = index[order], value[order]
    new = np.ones(len(index), bool)
    new[1:] = (index[1:] != index[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return index[at], value[at], np.diff(np.append(at, len(index)))
