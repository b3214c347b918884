"""Graph algorithms on graphs made by hand."""

import pytest

from capturelake.operators import algorithms as alg

PATH = [("a", "b"), ("b", "c"), ("c", "d")]
STAR = [("hub", f"s{i}") for i in range(5)]
CLIQUES = [(x + str(i), x + str(j)) for x in "pq" for i in range(4) for j in range(i)] + [("p0", "q0")]


def pairs(spark, rows):
    return spark.createDataFrame([(min(r), max(r), 1) for r in rows], "a string, b string, weight long")


def groups(df, key="cluster"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], set()).add(r["node"])
    return sorted(map(sorted, out.values()))


def test_components(spark):
    assert groups(alg.components(pairs(spark, PATH + STAR)), "component") == [["a", "b", "c", "d"], ["hub", *(f"s{i}" for i in range(5))]]


def test_components_of_a_long_chain(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    assert groups(alg.components(pairs(spark, chain)), "component") == [[f"n{i:03d}" for i in range(61)]]


def test_no_edges(spark):
    assert alg.components(pairs(spark, [("x", "y")]).limit(0)).count() == 0


def test_core(spark):
    assert groups(alg.core_clusters(pairs(spark, CLIQUES + PATH))) == [[f"{x}{i}" for x in "pq" for i in range(4)]]


def test_hubs(spark):
    assert groups(alg.hubs(pairs(spark, STAR + PATH))) == [["hub", *(f"s{i}" for i in range(5))]]


def test_equivalent(spark):
    assert groups(alg.equivalent(pairs(spark, STAR))) == [[f"s{i}" for i in range(5)]]


def test_communities_split_the_cliques(spark):
    found = alg.communities(pairs(spark, CLIQUES))
    assert groups(found) == [[f"p{i}" for i in range(4)], [f"q{i}" for i in range(4)]]
    assert alg.modularity(pairs(spark, CLIQUES), found).first()["modularity"] == pytest.approx(2 * (6 / 13 - 0.25))


def test_paths(spark):
    rows = pairs(spark, [*PATH, ("a", "c")])
    assert [tuple(r) for r in alg.paths(rows, "a", "d").collect()] == [("a>c>d", 2), ("a>b>c>d", 3)]
    assert alg.paths(rows, "a", "d", cutoff=2).count() == 1
    assert alg.paths(rows, "d", "a", two_way=False).count() == 0


def test_centrality(spark):
    found = {r["node"]: (r["degree"], r["betweenness"]) for r in alg.centrality(pairs(spark, PATH)).collect()}
    assert found == {"a": (1, 0.0), "b": (2, 4.0), "c": (2, 4.0), "d": (1, 0.0)}


def test_hosts_merge_by_mac(spark):
    rows = [("10.0.0.1", "00:11:22:00:00:01", 1), ("fd00::1", "00:11:22:00:00:01", 2), ("10.0.0.9", "00:11:22:00:00:02", 3), ("127.0.0.1", "00:11:22:00:00:02", 4)]
    found = alg.merge_hosts(spark.createDataFrame(rows, "src_ip string, src_mac string, seq_no long"))
    assert {tuple(r) for r in found.collect()} == {("10.0.0.1", "10.0.0.1"), ("fd00::1", "10.0.0.1")}
