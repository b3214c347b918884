"""Fill-in-middle against brute force: cut places, forms, rebuilt texts; automata against plain scans."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelake.llm import automata, fim

SCHEMA = "doc_id long, text string, n long, key string, h1 string, bytes string"


def texts():
    rng = random.Random(3)
    letters = "ab é<ß>PSM 漢🙂\n"
    made = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(1, None), (2, ""), (3, "x"), (4, "a <P> b"), (5, "<S>"), (6, "<M"), (7, "🙂"), (None, "no id"), (8, "é" * 999), (9, made(40_000).replace("<P>", "").replace("<S>", "").replace("<M>", ""))]
    rows += [(i, made(rng.randrange(0, 60))) for i in range(10, 150)]
    rows += [(i, "漢字 and words " * rng.randrange(200, 900)) for i in range(150, 170)]
    return [*rows, rows[9], rows[9], (9, "another text of nine"), rows[20]]


def expected(doc_id, text, unit="chars"):
    text = text or ""
    places = list(range(len(text) + 1)) if unit == "chars" else [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    n = len(places) - 1
    places[0] = 0 if n else places[0]
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = (places[c] if c else 0 for c in (lo, hi))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return doc_id, n, "spm" if spm else "psm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, "clash", "clash", "clash") for i, t in texts()], SCHEMA).repartition(4).cache()


@pytest.mark.parametrize(("unit", "chunk"), [("chars", 1 << 16), ("chars", 700), ("chars", 257), ("words", 1 << 16), ("words", 999)])
def test_forms_and_places(docs, unit, chunk):
    """Chunks of any size, those that part a code point or a mark too, give what plain slices give."""
    got = sorted(map(tuple, fim.fill_in_middle(docs, unit, chunk=chunk).collect()), key=repr)
    assert got == sorted((expected(i, t, unit) for i, t in texts()), key=repr)


def test_texts_are_rebuilt(docs):
    done = fim.fill_in_middle(docs, chunk=999).collect()
    assert sorted(((r["doc_id"], fim.rebuilt(r["form"], r["output"].encode()).decode()) for r in done), key=repr) == sorted(((i, t or "") for i, t in texts()), key=repr)
    assert {r["form"] for r in done} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = [tuple(r) for r in fim.fill_in_middle(docs, chunk=999, digests=True).collect()]
    assert sorted(digests, key=repr) == sorted(((*(row := expected(i, t))[:5], sha(row[5]), sha(t or "")) for i, t in texts()), key=repr)


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_agrees_with_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = fim.op11_fill_in_middle(spark, folder)
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(fim.FIM_SQL).fetchall())


def test_functions_compose():
    """The function of joined chunks is the composition of theirs, for every start state and place of the join."""
    machine = fim.automaton()
    data = np.frombuffer("a<é<P>漢🙂<S<S>>".encode() * 40, np.uint8)
    whole = automata.Lanes(machine, data, np.array([0]), np.array([len(data)])).functions()
    for cut in range(0, len(data), 7):
        (f, g), (c, d) = automata.Lanes(machine, data, np.array([0, cut]), np.array([cut, len(data)])).functions()[0], automata.Lanes(machine, data, np.array([0, cut]), np.array([cut, len(data)])).functions()[1].transpose(1, 0, 2)
        assert (g[f] == whole[0][0]).all()
        assert (c + d[:, f] == whole[1][:, 0]).all()


def test_long_texts_are_dealt_to_several_tasks(spark):
    row = [(1, "long text é " * 200_000)]
    docs = spark.createDataFrame(row, "doc_id long, text string").coalesce(1)
    seen = fim.fill_in_middle(docs).collect()
    assert tuple(seen[0]) == expected(*row[0])
    plan = fim._across_tasks(docs.select("doc_id", F.col("text").cast("binary").alias("bytes"), *[F.lit(1).cast("long").alias(f"h{i}") for i in range(1, 5)]), "chars", 1 << 16, 10, 20)._jdf.queryExecution().toString()
    assert "hashpartitioning(key" in plan
