"""Modularity search against a plain local search, on planted groups; determinism, resolution, least size."""

import itertools
import random

from pyspark.sql import functions as F

from capturelake.operators import algorithms as alg


def planted(groups=6, size=12, inside=0.6, outside=0.03, seed=1):
    rng, edges = random.Random(seed), []
    for a, b in itertools.combinations(range(groups * size), 2):
        if rng.random() < (inside if a // size == b // size else outside):
            edges.append((f"n{a:03}", f"n{b:03}", rng.randrange(1, 5)))
    return edges


def modularity(edges, group, resolution=1.0):
    total = sum(w for *_, w in edges)
    inside, strength = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            strength[group[x]] = strength.get(group[x], 0) + w
        if group[a] == group[b]:
            inside[group[a]] = inside.get(group[a], 0) + w
    return sum(inside.get(g, 0) / total - resolution * (k / (2 * total)) ** 2 for g, k in strength.items())


def local_search(edges):
    """Nodes in turn move to the neighbouring group of most gain, then groups become nodes, until nothing rises."""
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    member, level = {x: x for x in names}, edges
    while True:
        group = {x: x for a, b, _ in level for x in (a, b)}
        total = sum(w for *_, w in level)
        k, around = {}, {}
        for a, b, w in level:
            k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
            if a != b:
                around.setdefault(a, []).append((b, w))
                around.setdefault(b, []).append((a, w))
        tot, moved, any_move = dict(k), True, False
        while moved:
            moved = False
            for x in sorted(group):
                links = {}
                for y, w in around.get(x, []):
                    links[group[y]] = links.get(group[y], 0) + w
                own = group[x]
                tot[own] -= k[x]
                best = max(sorted({own, *links}), key=lambda g: (links.get(g, 0) - k[x] * tot.get(g, 0) / (2 * total), g == own))
                tot[best] = tot.get(best, 0) + k[x]
                group[x] = best
                if best != own:
                    moved = any_move = True
        if not any_move:
            return member
        member = {x: group[m] for x, m in member.items()}
        sums = {}
        for a, b, w in level:
            pair = tuple(sorted((group[a], group[b])))
            sums[pair] = sums.get(pair, 0) + w
        level = [(*p, w) for p, w in sums.items()]


def clusters(spark, edges, parts=3, **options):
    df = spark.createDataFrame(edges, "a string, b string, weight long").repartition(parts)
    return {r["node"]: r["cluster"] for r in alg.modular(df, **options).collect()}


def test_planted_groups(spark):
    edges = planted()
    found = clusters(spark, edges)
    assert {frozenset(n for n in found if found[n] == c) for c in set(found.values())} == {frozenset(f"n{i:03}" for i in range(g * 12, g * 12 + 12)) for g in range(6)}
    assert modularity(edges, found) >= modularity(edges, local_search(edges)) - 1e-12
    shuffled = [(b, a, w) for a, b, w in random.Random(2).sample(edges, len(edges))]
    assert clusters(spark, shuffled, parts=7) == found
    df = spark.createDataFrame([(n, c) for n, c in found.items()], "node string, cluster int")
    given = spark.createDataFrame(edges, "a string, b string, weight long")
    assert abs(alg.modularity(given, df).first()[0] - modularity(edges, found)) < 1e-12


def test_weak_groups_come_near_a_local_search(spark):
    edges = planted(inside=0.35, outside=0.08, seed=3)
    found = clusters(spark, edges, least=1)
    assert modularity(edges, found) >= modularity(edges, local_search(edges)) * 0.95


def test_resolution_and_least_size(spark):
    edges = planted()
    many, few = clusters(spark, edges, resolution=4.0, least=1), clusters(spark, edges, resolution=0.1, least=1)
    assert len(set(many.values())) > 6 > len(set(few.values()))
    pair = [("x", "y", 5), ("z", "z", 2)]
    assert set(clusters(spark, pair)) == {"x", "y"} and set(clusters(spark, pair, least=1)) == {"x", "y", "z"}
    assert clusters(spark, pair, least=3) == {}


def test_no_edges(spark):
    assert alg.modular(spark.createDataFrame([], "a string, b string, weight long")).collect() == []


def test_numbers(spark):
    rows = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(9)
    assert [r["number"] for r in alg.numbered(rows, "x").orderBy("x").collect()] == list(range(1000))
