"""Documents are drawn as often as their inclusion probabilities say."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from capturelake.llm import mixing

N = 8000


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(2)
    rows = [(i, f"s{i % 2}", int(2 ** rng.uniform(0, 11))) for i in range(N)]
    units = spark.createDataFrame(rows, "doc_id long, source string, size long")
    return mixing.copies(units, cycle=(1, 2)).collect()


def test_frequencies_are_the_probabilities(drawn):
    by_chance, words = defaultdict(list), defaultdict(int)
    for r in drawn:
        assert 0 <= r["copies"] <= 3 and 0 <= r["p"] < 1
        by_chance[r["source"], r["p"]].append(r["copies"])
        words[r["source"], r["target"]] += r["copies"] * r["size"]
    assert len(by_chance) >= 20  # unequal among the documents of one source
    for (source, p), copies in by_chance.items():
        n, whole = len(copies), min(copies)
        assert set(copies) <= {whole, whole + 1}
        # closing documents of a class are at most OFFERS more
        assert sum(copies) / n - whole == pytest.approx(p, abs=4 * (p * (1 - p) / n) ** 0.5 + mixing.OFFERS / n), (source, p)
    for (_, target), n in words.items():
        assert n == pytest.approx(target, abs=3)


def test_longer_documents_are_likelier(drawn):
    expected = {r["size"].bit_length(): r["p"] + (r["copies"] if r["p"] == 0 else 0) for r in drawn if r["source"] == "s0"}
    values = [expected[k] for k in sorted(expected)]
    assert values == sorted(values) and len(set(values)) == len(values) and values[0] > 0


def test_one_seed_one_sample_and_hostile_rows(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40) or None, rng.choice(["a", "b", None]), rng.choice([0, 1, 5, 900, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("rank", F.lit("clash")).withColumn("s", F.lit("clash")).withColumn("p", F.lit("clash"))
    one = sorted(map(repr, mixing.copies(df).collect()))
    assert one == sorted(map(repr, mixing.copies(df.repartition(7)).collect())) and len(one) == 300
    assert mixing.copies(df.limit(0)).count() == 0
    only = mixing.copies(df.where("size = 0")).collect()
    assert only and all(r["copies"] == 0 and r["target"] == 0 for r in only)
