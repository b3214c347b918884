"""Runs against brute force; work that grows in proportion to the text; the query against a plain-Python version of its contract."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capturelake.llm import lyndon, periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(s, times=2, least=2):
    """By period: stretches in which s[i] == s[i + p], at least (times - 1) * p long, whose smallest period is p."""
    found, n = {}, len(s)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            if j - i >= (times - 1) * p and j - i + p >= least and (i, j - i + p) not in found:
                found[i, j - i + p] = p
            i = max(j, i) + 1
    return sorted(((a, n, p) for (a, n), p in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.sampled_from([(2, 2), (3, 2), (4, 6)]))
def test_runs(symbols, limits):
    assert lyndon.runs(symbols, *limits) == brute(symbols, *limits)


@pytest.mark.parametrize("k", [1, 2, 3, 30])
def test_runs_of_long_sequences(k):
    rng = random.Random(k)
    base = [rng.randrange(k) for _ in range(60)]
    s = base * 5 + [rng.randrange(k) for _ in range(200)] + base[:7] * 9 + [0] * 50 + base * 2
    assert lyndon.runs(s) == brute(s)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    assert lyndon.runs(fib[-1]) == brute(fib[-1])


class Counting(list):
    reads = 0

    def __getitem__(self, i):
        Counting.reads += 1
        return list.__getitem__(self, i)


def hostile(n):
    rng = random.Random(1)
    fib, x = [0, 1], [0]
    while len(fib) < n:
        x, fib = fib, fib + x
    ruler = [0]
    while len(ruler) < n:
        ruler = ruler + [max(ruler) + 1] + ruler
    thue = [bin(i).count("1") % 2 for i in range(n)]
    return {"one": [0] * n, "fibonacci": fib[:n], "ruler": ruler[:n], "thue": thue, "binary": [rng.randrange(2) for _ in range(n)], "blocks": ([0] * 30 + [1]) * (n // 31), "copies": [rng.randrange(9) for _ in range(n // 8)] * 8}


@pytest.mark.parametrize("name", hostile(8))
def test_work_is_linear(name):
    """Symbols read, for a text of n words and one of eight times as many."""
    reads = []
    for n in (2_000, 16_000):
        s = hostile(n)[name]
        total = 0
        for a in ([-1, *s, -1], [-1, *[max(s) - v for v in s], -1]):
            Counting.reads = 0
            after, _ = lyndon.lyndon_array(Counting(a), len(s))
            lyndon.left_extensions(Counting(a), after, [x for x in range(len(s), 0, -1) if a[x - 1] == a[after[x] - 1]])
            total += Counting.reads
        reads.append(total / len(s))
    assert reads[1] < 30 and reads[1] < reads[0] * 1.3 + 1, reads


def texts():
    rng = random.Random(9)
    words = ["a", "b", "Å", "漢", "x" * 50]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "a b " * 9), (5, "a b\x0ba  b\n" * 400 + "c"), (6, "a a a a a"), (7, "a a a a a a"), (8, " ".join(["lorem", "ipsum"] * 8000))]
    rows += [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(9, 400)]
    return [*rows, rows[5], rows[5], (5, "other text")]


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str("null" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute(words, 4, 6)
    drop = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    row = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *row, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_against_brute_force(spark, tmp_path):
    """Nulls, empties, repeats, ties, long runs, clashing columns."""
    rows = [(i, t, "clash", "clash") for i, t in texts()]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, bytes string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t in texts()), key=repr)


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.length("text") < 20_000).select("doc_id", "text")
    got = {r[0]: tuple(r) for r in periodic.op12_periodic_runs(spark, folder).collect()}
    for doc_id, text in docs.collect():
        assert got[doc_id] == expected(doc_id, text)


def test_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
