"""Runs (maximal periodic stretches) of a sequence over an ordered alphabet in linear time, after Ellert and Fischer (ICALP 2021)."""

from __future__ import annotations

import numpy as np


def lyndon_array(a: list[int], n: int) -> tuple[list[int], list[int]]:
    """For each place of ``a[1..n]`` the start of the next smaller suffix, and how far both suffixes agree.

    ``a[0]`` and ``a[n + 1]`` are smaller than all symbols. From place i to the next smaller suffix goes the longest Lyndon word that begins at
    i. Suffixes are compared symbol by symbol, places in order; the stretch that was found equal and reaches farthest
    right, a[jl..] = a[il..k), is kept. A pair that lies in it has a counterpart one shift to the left, compared before, so
    what is known of that decides the new pair, or lets it go on from k. So no symbol is read again and again.
    """
    before, after = [0] * (n + 2), [n + 1] * (n + 2)
    agree_after, agree_before = [0] * (n + 2), [0] * (n + 2)
    jl = il = k = 0
    for i in range(2, n + 1):
        c, j = a[i], i - 1
        while True:
            x = a[j]
            if x < c:
                break
            if x > c:
                after[j] = i
                j = before[j]
                continue
            e, open_ended = 1, True
            if i < k:
                v = i - il + jl
                u = j - il + jl if j >= il else j
                known = agree_after[u] if after[u] == v else agree_before[v] if before[v] == u else -1
                if known >= 0:
                    e, open_ended = (known, False) if known < k - i else (k - i, known == k - i)
            if open_ended:
                while a[j + e] == a[i + e]:
                    e += 1
                if i + e > k:
                    jl, il, k = j, i, i + e
            if a[j + e] > a[i + e]:
                after[j], agree_after[j] = i, e
                j = before[j]
            else:
                agree_before[i] = e
                break
        before[i] = j
    return after, agree_after


def left_extensions(a: list[int], after: list[int], places: list[int]) -> dict[int, int]:
    """For each of the given places l, in falling order, how far the symbols left of l and left of after[l] agree. The mirror image of the
    reuse in :func:`lyndon_array`: the stretch that reaches farthest left is kept."""
    out: dict[int, int] = {}
    lh = rh = 0
    k = len(a)
    for x in places:
        r, e, open_ended = after[x], 0, True
        if x - 1 > k:
            d = rh - lh
            u, v = x + d, r + d if r <= lh else r
            if u == v:
                e = x - 1 - k
            else:
                known = (out.get(u, 0) if u <= v else -1) if u < len(after) - 1 and after[u] == v else -1
                if known >= 0:
                    e, open_ended = (known, False) if known < x - 1 - k else (x - 1 - k, known == x - 1 - k)
        if open_ended:
            while x - 1 - e > 0 and a[x - 1 - e] == a[r - 1 - e]:
                e += 1
            if x - 1 - e < k:
                lh, rh, k = x, r, x - 1 - e
        out[x] = e
    return out


def runs(symbols: list[int], times: int = 2, least: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period), places from 0, of all runs with length >= max(least, times * period), by start and period; ``times`` is 2 or more.

    ``symbols`` are numbers from 0 on. Every run has a Lyndon root that is a longest Lyndon word in the order of the numbers or in the
    reverse one, so the longest Lyndon words of both orders, extended to both sides, give all runs.
    """
    n = len(symbols)
    if n < 2:
        return []
    found = set()
    top = max(symbols)
    for a in ([-1, *symbols, -1], [-1, *[top - s for s in symbols], -1]):
        after, agree = lyndon_array(a, n)
        values, ends, e = np.array(a), np.array(after[1 : n + 1]), np.array(agree[1 : n + 1])
        places = np.arange(1, n + 1)
        left = values[places - 1] == values[ends - 1]
        extended = left_extensions(a, after, (np.flatnonzero(left)[::-1] + 1).tolist())
        period = ends - places
        # what is not extended to the left must be long enough to the right
        for x in (np.flatnonzero(left | (e >= (times - 1) * period)) + 1).tolist():
            p, f = after[x] - x, extended.get(x, 0)
            length = p + f + agree[x]
            if length >= times * p and length >= least:
                found.add((x - f - 1, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))
