"""The corpus pipeline on a small corpus, stage by stage."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from capturelake.llm import secrets
from capturelake.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    good = {i: text(rng.randrange(60, 120)) for i in range(80)}
    good[80] = good[3]
    good[81] = good[4] + " tail"
    good[82] = good[82 - 60] + ' password = "hunter2hunter2"'
    bad = {i: " ".join("#$%" + str(rng.randrange(9999)) for _ in range(80)) for i in range(200, 240)}
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in {**good, **bad, 300: None, 301: ""}.items()]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in list(good)[:60]] + [(i, 0, 0) for i in list(bad)[:30]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), good, bad


def test_stages(spark, folder):
    path, good, bad = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    quality, unique, clean, mixed = kept
    assert set(quality) == set(good)
    assert set(unique) == set(good) - {80, 81, 82}
    assert set(clean) == set(unique)
    assert not any(secrets.base_spans(t) for t in clean.values())
    assert Counter(r["doc_id"] for r in docs.collect()).most_common(1)[0][1] <= 3 and set(mixed) <= set(clean)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert rows and {r["doc_id"] for r in rows} <= set(folder[1])
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_a_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
