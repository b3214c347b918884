"""Numbers over all rows; the animation of endpoint events with missing times, ties and repeated rows."""

from pyspark.sql import functions as F

from capturelake.operators import forensic as fx
from capturelake.operators import numbering


def test_numbers_are_dense(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("a"), F.xxhash64("id").alias("b")).repartition(5)
    for order in (("a", "b"), ("a",)):
        found = [tuple(r) for r in numbering.dense(rows, *order).orderBy("number").collect()]
        assert [r[2] for r in found] == list(range(5000))
        keys = [r[: len(order)] for r in found]
        assert keys == sorted(keys)
    assert numbering.dense(rows.limit(0), "a").collect() == []


def events(spark, rows):
    raw = spark.createDataFrame(rows, "eid int, image string, target string, ts string").select(
        "eid", F.lit("h").alias("computer"), F.to_timestamp("ts").alias("time_created"),
        F.create_map(F.lit("Image"), "image", F.lit("ProcessId"), F.lit("1"), F.lit("TargetFilename"), "target", F.lit("TargetObject"), "target").alias("event_data"),
    )
    return fx.dissect(raw)


def test_animation(spark):
    rows = [
        (11, "a.exe", "f", "2024-01-01 00:00:05"), (11, "a.exe", "f", "2024-01-01 00:00:05"), (13, "b.exe", "k", None), (11, "a.exe", "f", None),
        (11, "a.exe", None, "2024-01-01 00:00:05"), (13, "b.exe", "k", "2024-01-01 00:00:01"), (11, "a.exe", "g", None),
    ]
    start = 1704067200.0
    found = [(r["number"], r["dst_id"], r["time"]) for r in fx.animation(events(spark, rows)).orderBy("number").collect()]
    assert found == [(0, "fx:file:f", 0.0), (1, "fx:file:g", 0.001), (2, "fx:reg:k", 0.002), (3, "fx:reg:k", start + 1), (4, "fx:file:f", start + 5), (5, "fx:file:f", start + 5)]
    lit = [r["dst_id"] for r in fx.animation(events(spark, rows), ["fx:reg:k"]).orderBy("number").collect()]
    assert lit == ["fx:reg:k"] * 2
    nodes = {r["id"]: r["is_spotlight"] for r in fx.animation_nodes(events(spark, rows), ["fx:reg:k"]).collect()}
    assert nodes == {"fx:reg:k": True, "fx:proc:h:b.exe:1": False}
    assert fx.animation(events(spark, rows).limit(0)).collect() == []
