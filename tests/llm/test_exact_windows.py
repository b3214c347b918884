"""Windows of words and bytes where hashes agree by chance: op2's counts stay exact, op3's anchors do not depend on the slice."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelake.llm import quality, suffixes
from capturelake.llm.common import words_of


def repeated(words):
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)})


KEYS = {
    "whole hash": F.xxhash64,
    "one value": lambda a, b, c: F.length(a).cast("long") * 0 + 7,
    "few values": lambda a, b, c: F.shiftleft(F.pmod(F.xxhash64(a, b, c), F.lit(3)), 40),
    "first word": lambda a, b, c: F.xxhash64(a),
}


@pytest.mark.parametrize("key", KEYS)
def test_repeat_words_are_exact_for_every_key(spark, key):
    rng = random.Random(5)
    texts = ["", "a", "a b", "a b c", "a b c a b c", "a a a a a", "a b d a c d a b d", None]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(3, 60))) for _ in range(40)]
    texts += [" ".join(f"w{rng.randrange(30)}" for _ in range(400)) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["n"] for r in df.select("id", quality._repeated(words_of(F.col("text")), KEYS[key]).alias("n")).collect()}
    assert got == {i: repeated((t or "").split()) for i, t in enumerate(texts)}


class FewBits(suffixes.Prefix):
    """Hashes that differ in their low bits alone."""

    def hashes(self, start, end):
        return super().hashes(start, end) & np.uint64(0xFFF)


@pytest.mark.parametrize("prefix", [suffixes.Prefix, FewBits])
def test_anchors_are_the_leftmost_least_grams_in_every_slice(monkeypatch, prefix):
    monkeypatch.setattr(suffixes, "Prefix", prefix)
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcde ") for _ in range(900)) + b"xy" * 150
    other = [bytes(rng.choice(b"abcde ") for _ in range(n)) for n in (50, 70_000, 140)]
    (_, lo, hi, rank, whole), _, _ = suffixes.runs([text])
    for texts in ([other[0], text], [*other, text]):
        (owner, lo2, hi2, rank2, whole2), _, _ = suffixes.runs(texts)
        mine = owner == len(texts) - 1
        for x, y in ((lo, lo2), (hi, hi2), (rank, rank2), (whole, whole2)):
            assert np.array_equal(x, y[mine])
    data, _ = suffixes.joined([text])
    at = np.arange(len(text) - suffixes.GRAM + 1)
    ranks = prefix(data).hashes(at, at + suffixes.GRAM)
    best = [s + int(np.argmin(ranks[s : s + suffixes.LENGTH - suffixes.GRAM + 1])) for s in range(len(text) - suffixes.LENGTH + 1)]
    edges = [0, *[i for i in range(1, len(best)) if best[i] != best[i - 1]]]
    assert lo.tolist() == edges and rank.tolist() == [int(ranks[best[i]]) for i in edges]
