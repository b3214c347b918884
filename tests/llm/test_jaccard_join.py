"""The Jaccard join against all pairs: borders of the threshold, dense groups, shared passages, repeats, blocks and salts."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelake.llm import jaccard_join as jj
from capturelake.llm.common import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n string, token string, rep string, leader string"


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, rows = text(60), [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, "É one"), (8, "é one"), (None, "one two"), (None, None)]
    number = itertools.count(9)
    for size in (12, 40, 120, 300):
        base = text(size)
        for _ in range(14):
            near = list(base)
            for _ in range(rng.randrange(0, max(2, size // 25))):
                near[rng.randrange(len(near))] = rng.choice(words)
            if rng.random() < 0.3:
                near = near[: -max(1, size // 30)]
            rows.append((next(number), " ".join(near)))
        # a chain: each like the one before, the ends unlike
        step = list(base)
        for _ in range(6):
            at = rng.randrange(len(step) - 1)
            step[at] = f"new{next(number)}"
            rows.append((next(number), "\n".join(step)))
    for _ in range(30):
        rows.append((next(number), " ".join(text(rng.randrange(1, 30)) + passage + text(rng.randrange(1, 30)))))
    rows += [(next(number), " ".join(text(rng.randrange(1, 60)))) for _ in range(30)]
    rows += [(next(number), " ".join(f"long{i}" for i in range(9000))), (next(number), " ".join(f"long{i}" for i in range(8700)))]
    return [*rows, rows[12], rows[12], (rows[20][0], rows[60][1]), (rows[30][0], "")]


def sets_of(rows):
    out = []
    for doc_id, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append((doc_id, {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()))
    return out


def expected(rows, percent):
    sets = sets_of(rows)
    root = {d: d for d, s in sets if d is not None and s}
    find = lambda x: x if root[x] == x else find(root[x])
    full = [(d, s) for d, s in sets if d is not None and s]
    for (a, x), (b, y) in itertools.combinations(full, 2):
        if 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted(((d, len(s), None if d is None else find(d) if s else d) for d, s in sets), key=repr)


@pytest.mark.parametrize(("seed", "percent", "bits", "hot"), [(1, 90, 16, 4096), (2, 90, 6, 4096), (3, 80, 16, 4), (4, 95, 10, 2)])
def test_components(spark, seed, percent, bits, hot):
    """Small counters (all shingles equally common) and salts at every shared shingle change nothing."""
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "n", "t", "r", "l") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, jj.jaccard_components(docs, percent=percent, bits=bits, hot=hot).collect()), key=repr)
    assert got == expected(rows, percent)


def test_empty_table(spark):
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), bits=8).collect() == []


def test_query_agrees_with_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(map(tuple, jj.op13_jaccard_join(spark, folder).collect())) == sorted(con.execute(jj.JACCARD_SQL).fetchall())


def test_border_of_the_threshold(spark):
    """18 of 20 shingles link, 17 of 19 do not."""
    w = [f"x{i}" for i in range(22)]
    rows = [(1, " ".join(w[:21])), (2, " ".join([*w[:20], "other"])), (3, " ".join(w[:20])), (4, " ".join(w[:19]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jj.jaccard_components(docs, bits=8).collect())) == expected(rows, 90)


def test_lists_do_not_depend_on_batches():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 4, (300, 6))
    rows[:, 1] = np.where(rows[:, 0] == 2, rows[:, 1], -1)
    rows = rows[np.lexsort(rows.T[::-1])].astype(np.int64)
    whole = jj.Lists().step(rows)
    for size in (1, 2, 7, 100):
        lists = jj.Lists()
        parts = np.vstack([lists.step(rows[i : i + size]) for i in range(0, len(rows), size)])
        assert sorted(map(tuple, parts)) == sorted(map(tuple, whole))
    want = set()
    for key in {tuple(r[:2]) for r in rows}:
        mine = [tuple(r) for r in rows if tuple(r[:2]) == key]
        if len({r[3:] for r in mine}) > 1 or key[1] >= 0:
            want |= {(*r, *mine[0][2:]) for r in mine}
    assert {tuple(map(int, r)) for r in whole} <= {tuple(map(int, r)) for r in want}
    assert {tuple(map(int, (*r[:2], *r[3:6]))) for r in whole} == {tuple(map(int, (*r[:2], *r[3:6]))) for r in want}


def test_near_copies_are_compared_with_their_leader_alone(spark):
    """A group of 300 near copies makes about one check a copy, not one a pair."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(300):
        t = list(base)
        t[rng.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    survey = cut(jj.surveyed(docs, 3, 16))
    reps = cut(survey.where("block is null").groupBy(*jj.SAME).agg(F.min("doc_id").alias("first_id")).withColumn("rep", F.monotonically_increasing_id()))
    levels = spark.sparkContext.broadcast(jj.commonness(survey, 16))
    lists = jj._numbered(jj.index_lists(jj.postings(docs, levels, 3, 90, 16), 90), reps)
    assert jj._leader_pairs(lists, 90).count() < 3000
    assert {r[2] for r in jj.jaccard_components(docs, bits=16).collect()} == {0}


def test_counters(spark):
    docs = spark.createDataFrame([(i, "a b c d") for i in range(100)], "doc_id long, text string").repartition(4)
    survey = jj.surveyed(docs, 3, 8)
    levels = jj.commonness(survey, 8)
    assert sorted(levels[levels > 0].tolist()) == [int(8 * np.log2(101))] * 2
    blocks = survey.where("block is not null").collect()
    assert sum(int(np.frombuffer(zlib.decompress(r["counts"]), np.uint32).sum()) for r in blocks) == 200
