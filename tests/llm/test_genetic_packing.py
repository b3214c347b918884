"""The genetic algorithm finds packings that best fit does not."""

import random
from collections import defaultdict

import pytest

from capturelake.llm import packing


def triples(seed, n):
    """Lengths that n full bins of three hold; no bin holds four, and best fit pairs the long ones wrongly."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        x = rng.randrange(260, 500)
        y = rng.randrange(258, 1024 - x - 257)
        out += [x, y, 1024 - x - y]
    return sorted(out, reverse=True)


def valid(bins, lengths):
    assert sorted(i for _, x in bins for i in x) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in x) == load <= 1024 for load, x in bins)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_better_than_best_fit(seed):
    lengths = triples(seed, 100)
    first = packing.best_fit(list(range(300)), lengths, [], 1024)
    population = packing.evolve(lengths, [], 1024, 100, f"{seed}")
    for bins in population:
        valid(bins, lengths)
    assert len(first) >= 110 and 100 <= len(population[0]) <= 106
    # an epoch never loses the best solution, and one seed gives one result
    again = packing.evolve(lengths, population, 1024, 5, "more")
    assert packing.fitness(again[0]) >= packing.fitness(population[0])
    assert packing.evolve(lengths, [], 1024, 100, f"{seed}") == population


def test_the_operator_packs_by_it(spark):
    lengths = triples(9, 100)
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    found = packing.pack(rows, children=40).collect()
    bins = defaultdict(int)
    for r in found:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 1024 and sum(bins.values()) == sum(lengths) and len(found) == 300
    assert len(bins) <= 106 < len(packing.best_fit(list(range(300)), lengths, [], 1024))


def test_parts_keep_every_item():
    rng = random.Random(1)
    for n in (1, 2, 3, 40):
        lengths = [rng.randint(1, 1023) for _ in range(n)]
        a, b = ([*packing.refill(rng.sample(range(n), n), lengths, [], 1024)] for _ in range(2))
        valid(a, lengths)
        valid(packing.mutate(packing.crossover(a, b, lengths, 1024, rng), lengths, 1024, rng), lengths)


def test_null_ids_and_equal_rows_are_packed_one_by_one(spark):
    rows = spark.createDataFrame([(None, 10)] * 3 + [(1, 1000)] * 2 + [(2, 1024), (None, 1024)], "doc_id long, length long")
    found = packing.pack(rows).collect()
    assert len(found) == 7 and len({r["sequence_id"] for r in found}) == 4
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == 7
