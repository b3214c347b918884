"""Near-duplicate classes where ids repeat, sets are weighted, or rows have maps."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from capturelake.llm import near_dup

SCHEMA = "doc_id long, text string"


def counts(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows, weighted=False):
    """Class of each id by all pairs; rows of one id are one document."""
    sets = [(i, counts(t) if weighted else Counter(dict.fromkeys(counts(t), 1))) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or (a and b and (a & b).total() >= 0.8 * (a | b).total()):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def prose(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_an_id_with_several_texts_is_one_document(spark, parts):
    rng = random.Random(1)
    a, b, c = prose(rng, 120), prose(rng, 130), prose(rng, 90)
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a + " x"), (5, b + " y"), (6, c), (6, c), (7, c + " z"), (8, prose(rng, 50)), (9, prose(rng, 50)), (9, ""), (10, " "), (11, prose(rng, 3))]
    found = near_dup.classes(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    assert len(found) == len(rows)
    got = {}
    for r in found:
        assert got.setdefault(r["doc_id"], r["class_id"]) == r["class_id"]
    assert got == brute(rows) and got[4] == got[5] == 1 and got[10] == 9


@pytest.mark.parametrize("weights", ["set", "count"])
def test_weights_reach_links_and_classes(spark, weights):
    rng = random.Random(2)
    rows = []
    for i in range(30):
        block = prose(rng, 25)
        other = prose(rng, 30)
        # as sets nearly equal, by counts far apart: one repeats its block, the other doesn't
        rows += [(3 * i, " ".join([block] * 8)), (3 * i + 1, " ".join([block] * rng.choice([2, 7]))), (3 * i + 2, other + " " + block)]
    found = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(rows, SCHEMA).repartition(4), weights=weights).collect()}
    assert found == brute(rows, weights == "count")
    assert brute(rows, True) != brute(rows)


def test_stage_keeps_maps_and_picks_one_row(spark):
    rng = random.Random(3)
    a = prose(rng, 80)
    rows = [(1, a, {"k": 2}, "b"), (1, a, {"k": 1}, "a"), (2, a, None, "c"), (None, a, {"k": 3}, "d"), (3, None, {}, None), (4, "", {}, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` map<string,int>, root string")
    kept = sorted((tuple(r) for r in near_dup.near_dup_stage(spark, docs, "").collect()), key=repr)
    assert [(r[0], r[3]) for r in kept] == [(1, "a"), (3, None), (None, "d")]
    assert near_dup.near_dup_stage(spark, docs.where(F.lit(False)), "").count() == 0
