"""A turn of the modularity search is one written table and one read of it."""

from pyspark.sql import functions as F

from capturelake import scratch
from capturelake.operators import algorithms as alg


def test_jobs_of_a_turn(spark, monkeypatch):
    edges = [(g * 4 + a, g * 4 + b, 5.0) for g in range(3) for a in range(4) for b in range(a)] + [(0, 4, 1.0), (4, 8, 1.0)]
    one = spark.createDataFrame(edges, "a long, b long, weight double")
    pairs = one.union(one.select("b", "a", "weight"))
    strength = pairs.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k")).withColumn("loop", F.lit(0.0))
    frame, plain, reads, turns = type(one), scratch.table, [], []
    for name in ("first", "isEmpty", "count", "collect"):
        monkeypatch.setattr(frame, name, lambda self, *a, f=getattr(frame, name), n=name: (reads.append(n), f(self, *a))[1])
    monkeypatch.setattr(scratch, "table", lambda df: (turns.append("moved" in df.columns), plain(df))[1])
    found, q = alg._local_moves(pairs, strength, 92.0, 1.0, 24)
    assert sum(turns) > 2 and sum(n in ("first", "isEmpty") for n in reads) == sum(turns) + 1
    assert q > 0.5 and len({tuple(r) for r in found.select((F.col("node") / 4).cast("int"), "group").collect()}) == 3
