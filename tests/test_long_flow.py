"""One flow over many Arrow batches: its state goes from batch to batch, and no row gathers it."""

import random

from pyspark.sql import functions as F
from test_sessions import COLUMNS, packet

from capturelake.operators import sessions as ses


def test_state_passes_between_batches(spark):
    rng, rows, at = random.Random(5), [], 0.0
    for n in range(3000):
        at += rng.choice([0.1] * 60 + [4.0, 6.0, 121.0])
        rows.append(packet(n, at, rng.choice(["ACK"] * 40 + ["SYN", "SYN ACK", "FIN ACK", "RST"]), rng.choice([n, n, n, 5_000_000 + n])))
    frame = spark.createDataFrame(rows, COLUMNS).repartition(7)
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = {r["seq_no"]: r["generation"] for r in ses.with_generations(frame).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        small = {r["seq_no"]: r["generation"] for r in ses.with_generations(frame).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    assert len(whole) == 3000 and small == whole and [whole[n] for n in range(3000)] == sorted(whole.values()) and max(small.values()) > 20


def test_no_row_gathers_a_flow(spark):
    frame = spark.createDataFrame([packet(1, 0), packet(2, 1)], COLUMNS)
    plan = ses.with_generations(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan


def test_no_packet_is_lost_or_doubled_by_equal_numbers(spark):
    frame = spark.createDataFrame([packet(1, 0), packet(1, 130), packet(1, 131)], COLUMNS)
    assert sorted((r["timestamp"] % 1000, r["generation"]) for r in ses.with_generations(frame).collect()) == [(0.0, 0), (130.0, 1), (131.0, 1)]


def test_one_flow_is_spread_over_tasks(spark):
    """A flow of all packets, with and without gaps that reset the state, over more ranges than cores; as one reader folds it."""
    for gaps in ([0.1] * 60 + [4.0, 6.0, 121.0], [0.1] * 30 + [4.0, 6.0]):
        rng, rows, at = random.Random(8), [], 0.0
        for n in range(2000):
            at += rng.choice(gaps)
            rows.append(packet(n, at, rng.choice(["ACK"] * 40 + ["SYN", "SYN ACK", "FIN ACK", "RST"]), rng.choice([n, n, n, 5_000_000 + n])))
        frame = spark.createDataFrame(rows, COLUMNS).repartition(3)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        found = {}
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            named = ses.with_generations(frame)
            found[parts] = {r["seq_no"]: r["generation"] for r in named.collect()}
            if parts == "13":
                assert named.where("transport = 'TCP'").groupBy(F.spark_partition_id()).count().count() > 8
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert len(found["1"]) == 2000 and found["1"] == found["13"] and max(found["1"].values()) > 20


def test_signals_cross_ranges(spark):
    """Protocol times and transactions of one flow go from range to range."""
    rng, rows, at = random.Random(3), [], 0.0
    for n in range(400):
        at += rng.choice([1.0, 2.0, 9.0, 11.0, 61.0])
        rows.append((*packet(n, at, "", n), rng.choice([None, "a.test"]), rng.choice([None, None, 7, 8])))
    frame = spark.createDataFrame(rows, f"{COLUMNS}, dns_query string, dhcp_xid long") if isinstance(COLUMNS, str) else spark.createDataFrame(rows, [*COLUMNS, "dns_query", "dhcp_xid"])
    frame = frame.withColumn("transport", F.lit("UDP"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = {}
    for parts in ("1", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found[parts] = {r["seq_no"]: r["generation"] for r in ses.with_generations(frame).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found["1"] == found["11"] and max(found["1"].values()) > 20
