"""Graph queries and gap collapse over all packets of a small capture, against brute force."""

import datetime as dt
from collections import Counter, defaultdict
from itertools import combinations

import pytest

import __spark_entry__ as entry

#: (user, k of each packet): two components of several nodes, one pair, and no packet to port 22.
TALK = [(3, [0, 1, 2]), (5, [0, 1]), (6, [0]), (7, [0, 1]), (8, [2]), (10, [50, 50]), (11, [50, 51]), (12, [51]), (14, [53])]
#: Seconds before each packet: gaps of 9 and 30 s.
PAUSES = {5: 9, 9: 30}


@pytest.fixture(scope="module")
def capture(spark, tmp_path_factory):
    at, rows = 0.0, []
    for user, ks in TALK:
        for k in ks:
            n = len(rows)
            at += PAUSES.get(n, 0.5)
            rows.append((n, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at * 10_000), user, ("view", "click", "signup")[n % 3], 1.0 + n, f'{{"k": {k}}}'))
    path = str(tmp_path_factory.mktemp("capture"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    sent = Counter()
    for n, _, user, _, value, props in rows:
        k = int(props[6:-1])
        ip = f"192.168.1.{1 + k % 4}" if k < 50 else f"203.0.113.{1 + k % 5}"
        sent[f"10.0.0.{1 + user}", ip] += 60 + int(value * 10)
    packets = Counter((f"10.0.0.{1 + u}", f"192.168.1.{1 + k % 4}" if k < 50 else f"203.0.113.{1 + k % 5}") for u, ks in TALK for k in ks)
    around = defaultdict(set)
    for a, b in sent:
        around[a].add(b)
        around[b].add(a)
    return lambda name: entry.queries()[name](spark, path).collect(), around, sent, packets, rows


def parts(around, nodes=None):
    left, out = set(around if nodes is None else nodes), []
    while left:
        part, todo = set(), [min(left)]
        while todo:
            v = todo.pop()
            if v in left:
                left.remove(v)
                part.add(v)
                todo += around[v]
        out.append(part)
    return out


def clusters(rows):
    out = defaultdict(set)
    for r in rows:
        out[r["cluster"]].add(r["node"])
    return dict(out)


def walks(around, s, t, most):
    out, todo = [], [[s]]
    while todo:
        p = todo.pop()
        if p[-1] == t:
            out.append(p)
        elif len(p) <= most:
            todo += [[*p, w] for w in around[p[-1]] if w not in p]
    return out


def between(around):
    out = dict.fromkeys(around, 0.0)
    for s, t in combinations(around, 2):
        found = walks(around, s, t, len(around))
        shortest = [p for p in found if len(p) == min(map(len, found))]
        for p in shortest:
            for v in p[1:-1]:
                out[v] += 2 / len(shortest)
    return out


def test_components(capture):
    query, around, _, packets, _ = capture
    whole = parts(around)
    assert len(whole) == 3
    assert {(r["node"], r["component"]) for r in query("g03_components_all")} == {(v, min(p)) for p in whole for v in p}
    ranked = sorted(whole, key=lambda p: (-len(p), min(p)))
    assert clusters(query("g09_labelled_components_all")) == dict(enumerate(ranked))
    want = [(min(p), len(p), sum(a in p for a, _ in packets), sum(n for (a, _), n in packets.items() if a in p)) for p in ranked]
    assert [tuple(r) for r in query("a45_component_summary_all")] == want


def test_cores_hubs_and_equals(capture):
    query, around, *_ = capture
    kept = set(around)
    while weak := {v for v in kept if len(around[v] & kept) < 2}:
        kept -= weak
    assert kept and set(map(frozenset, clusters(query("g06_core")).values())) == set(map(frozenset, parts(around, kept)))
    leaves = defaultdict(set)
    for v, near in around.items():
        if len(near) == 1:
            leaves[min(near)].add(v)
    hubs = sorted((h for h in leaves if len(leaves[h]) >= 2), key=lambda h: (-len(around[h]), h))
    assert clusters(query("g07_hubs_all")) == {i: leaves[h] | {h} for i, h in enumerate(hubs)}
    same = defaultdict(set)
    for v, near in around.items():
        same[frozenset(near)].add(v)
    ranked = sorted((g for g in same.values() if len(g) >= 2), key=lambda g: (-len(g), min(g)))
    assert ranked and clusters(query("g08_equivalent_all")) == dict(enumerate(ranked))


def test_paths_and_communities(capture):
    query, around, *_ = capture
    want = sorted((len(p) - 1, ">".join(p)) for p in walks(around, "10.0.0.4", "192.168.1.1", 3))
    assert [(r["hops"], r["path"]) for r in query("g04_paths")] == want[:20]
    found = clusters(query("g05_communities"))
    whole = parts(around)
    assert found and all(any(c <= p for p in whole) for c in found.values())
    assert all(any(c <= p for c in found.values()) for p in whole)


def test_centrality(capture):
    query, around, sent, *_ = capture
    want = between(around)
    assert {r["node"]: (r["degree"], r["betweenness"]) for r in query("g10_centrality")} == {v: (len(around[v]), pytest.approx(want[v], abs=1e-6)) for v in around}
    size = {v: sum(n for pair, n in sent.items() if v in pair) for v in around}
    most = [max(map(len, around.values())), max(want.values()), max(size.values())]
    score = {v: (len(around[v]) / most[0] + want[v] / most[1] + size[v] / most[2]) / 3 for v in around}
    assert {r["node"]: r["score"] for r in query("n11_central_nodes")} == {v: pytest.approx(x, abs=1e-4) for v, x in score.items()}


def test_gaps(capture):
    query, *_, rows = capture
    at = [(r[1] - rows[0][1]).total_seconds() / 10_000 for r in rows]
    filled = Counter(min(int(x + 1e-6), int(at[-1] + 1 - 1e-6) - 1) for x in at)
    want, run = [], 0
    for i in range(max(filled) + 1):
        if filled[i]:
            want += ([(run, 0)] if run >= 5 else [(1, 0)] * run) + [(1, filled[i])]
            run = 0
        else:
            run += 1
    found = query("a20_gap_collapse_all")
    assert [(round(r["end_time"] - r["start_time"]), r["packet_count"]) for r in sorted(found, key=lambda r: r["index"])] == want
    assert sum(r["is_gap"] for r in found) == 2 and sum(r["packet_count"] for r in found) == len(rows)
