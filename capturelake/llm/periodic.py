"""Periodic stretches of words in documents, and documents with each stretch cut down to its first period."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import documents, let, words_of
from capturelake.llm.lyndon import runs

TIMES, LEAST = 4, 6
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def ranks(words: list[bytes]) -> list[int]:
    """Each word's number in the order of the distinct words."""
    order = {w: i for i, w in enumerate(sorted(set(words)))}
    return [order[w] for w in words]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words outside of every run's repeats, those after its first period, joined by spaces."""
    if not found:
        return b" ".join(words)
    drop = bytearray(len(words))
    for start, length, period in found:
        drop[start + period : start + length] = b"\1" * (length - period)
    return b" ".join(w for w, d in zip(words, drop, strict=True) if not d)


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs(doc_id, text)``.

    ``runs``: (start, length, period) of each run of words with at least ``times`` periods and ``least`` words, by start, then period;
    ``times`` is 2 or more. A run is a stretch in which words at the distance of its smallest period are the same and which no
    neighbour extends. ``collapsed``: the text's words without those that repeat in a run, joined by one space.

    Each text is one linear pass in its task (:mod:`capturelake.llm.lyndon`); nothing is shuffled, and no two words are
    compared other than by order. A task holds one text's words at a time, about 150 bytes a word.

    A null text or one of white space has no words, no run, and an empty result; null ids stay null; rows that repeat give the same row again;
    an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, of_rows, short = [], [], []
            for value in batch.column("bytes"):
                words = value.as_py().split()
                found = runs(ranks(words), times, least)
                size.append(len(words))
                of_rows.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                short.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(of_rows, RUNS), pa.array(short, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, or, for a tenth of the documents, its words with everything from a drawn place on replaced by repeats of what begins there.

    With h the crc32 of decimal doc_id and g = floor(h / 10): where h % 10 = 0 and there are n > 0 words, each word i >= a becomes
    word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null id counts as the text 'null'.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)).cast("long") + 1
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(words, (a + i % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, let(words_of(text), repeated)).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Every document, a tenth with planted repeats, with its runs of four periods and six words or more; nulls, empties and repeats as in
    :func:`periodic_runs`. The longest run is the one with the smallest start, then period, of those with the most words."""
    docs = documents(spark, sf_dir)
    done = periodic_runs(docs.select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    done = done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    longest = [(-F.col("best.s")).alias("start"), F.col("best.l").alias("length"), (-F.col("best.p")).alias("period")]
    exponent = F.floor(F.col("best.l") * 1000 / -F.col("best.p")).cast("long").alias("exponent_milli")
    return done.select("doc_id", "n_runs", *longest, exponent, "runs_sha256", "collapsed_sha256")
