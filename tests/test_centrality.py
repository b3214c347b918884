"""Betweenness by levels against brute force, in one block of sources and in many."""

import random

import pytest
from test_graph_algorithms import pairs
from test_whole_capture import between

from capturelake.operators import algorithms as alg


@pytest.mark.parametrize("states", [1_000_000, 40])
def test_by_blocks_of_sources(spark, states):
    rng = random.Random(6)
    rows = {tuple(sorted(rng.sample([f"n{i:02d}" for i in range(9)], 2))) for _ in range(13)} | {("x", "y"), ("y", "z"), ("z", "w"), ("w", "x"), ("p", "q")}
    around = {}
    for a, b in rows:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    want = {v: (len(around[v]), pytest.approx(x, abs=1e-5)) for v, x in between(around).items()}
    assert {r["node"]: (r["degree"], r["betweenness"]) for r in alg.centrality(pairs(spark, sorted(rows)), states).collect()} == want


def test_nothing_goes_through_the_driver(spark, monkeypatch):
    """Neither a broadcast variable nor rows of the edge table."""
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("broadcast"))
    monkeypatch.setattr(type(pairs(spark, [("a", "b")])), "toLocalIterator", lambda *_, **__: pytest.fail("rows to the driver"))
    alg.centrality(pairs(spark, [("a", "b"), ("b", "c")])).count()


def test_no_and_single_edges(spark):
    assert alg.centrality(pairs(spark, [("a", "b")]).limit(0)).count() == 0
    assert {tuple(r) for r in alg.centrality(pairs(spark, [("a", "b")])).collect()} == {("a", 1, 0.0), ("b", 1, 0.0)}


def test_many_nodes_with_the_same_neighbours(spark, monkeypatch):
    """Hundreds of nodes at a few hubs are a few classes: one small block of sources in place of one for each few nodes."""
    rng = random.Random(8)
    hubs = [f"h{i}" for i in range(4)]
    rows = {(f"n{i:03}", h) for i in range(240) for h in rng.choice([hubs[:2], hubs[1:], hubs[:1]])} | {("h0", "h3"), ("h3", "t1"), ("t1", "t2")}
    around = {}
    for a, b in rows:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    want = dict.fromkeys(around, 0.0)
    for s in around:
        order, depth, ways, before = [s], {s: 0}, {s: 1}, {}
        for v in order:
            for w in around[v]:
                if w not in depth:
                    depth[w], ways[w], before[w] = depth[v] + 1, 0, []
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    ways[w] += ways[v]
                    before[w].append(v)
        load = dict.fromkeys(order, 0.0)
        for w in reversed(order[1:]):
            want[w] += load[w]
            for v in before[w]:
                load[v] += ways[v] / ways[w] * (1 + load[w])
    calls, shares = [], alg._shares
    monkeypatch.setattr(alg, "_shares", lambda *a: calls.append(1) or shares(*a))
    got = {r["node"]: (r["degree"], r["betweenness"]) for r in alg.centrality(pairs(spark, sorted(rows)), 400).collect()}
    assert got == {v: (len(around[v]), pytest.approx(x, abs=1e-4)) for v, x in want.items()} and len(calls) == 1
