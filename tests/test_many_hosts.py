"""Over 64,000 users: the capture view numbers hosts on past 255 within an address; queries agree with their SQL there, too."""

import pytest
from pyspark.sql import functions as F
from test_entry import plain

import __spark_entry__ as entry
from capturelake.functions import net

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("many")
    kinds = F.element_at(F.array(*map(F.lit, ("view", "click", "purchase", "signup", "other"))), (F.col("id") % 5 + 1).cast("int"))
    rows = spark.range(300).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 7_000_000_000).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 9).otherwise(63_990 + F.col("id") % 40 * 11).alias("user_id"), kinds.alias("event_type"),
        (F.col("id") % 50 * 1.5).alias("value"), F.concat(F.lit('{"k": '), (F.col("id") * 7 % 100).cast("string"), F.lit("}")).alias("props"),
    )
    rows.coalesce(1).write.parquet(str(out / "events.parquet"))
    return str(out)


NAMES = ["x04_ip_number", "a01_view_nodes", "a44_collapse", "a07_subnet_edges", "a08_subnets", "a09_analysis_nodes", "n16_roles", "j01_subnet_edge_sessions", "s16_block_ranges", "s14_capture_ranges", "s14_time_pushdown"]


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, folder, name):
    found = entry.queries()[name](spark, folder)
    names = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_only_where_asked_for(spark):
    """Without ``carry`` such text is no address; with it, addresses have the same networks as before."""
    ip = F.col("ip")
    frame = spark.createDataFrame([("10.0.300.5",), ("10.7.200.77",), ("10.0.3",), ("x",), (None,)], "ip string")
    rows = {r["ip"]: tuple(r)[1:] for r in frame.select("ip", net.ip_number(ip), net.is_private(ip), net.subnet(ip, 24), net.ip_number(ip, True), net.is_private(ip, True), *[net.subnet(ip, p, True) for p in (24, 20, 13, 8)]).collect()}
    assert rows["10.0.300.5"] == (None, False, "10.0.300.5", (10 << 24) + 300 * 256 + 5, True, "10.0.300.0/24", "10.0.288.0/20", "10.0.0.0/13", "10.0.0.0/8")
    same = (10 << 24) + (7 << 16) + 200 * 256 + 77
    assert rows["10.7.200.77"] == (same, True, "10.7.200.0/24", same, True, "10.7.200.0/24", "10.7.192.0/20", "10.0.0.0/13", "10.0.0.0/8")
    assert rows["10.0.3"] == (None, False, "10.0.3", None, False, *["10.0.3"] * 4) and rows["x"][:2] == (None, False) and rows[None][0] is None
