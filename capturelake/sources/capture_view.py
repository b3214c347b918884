"""The capture view: packets derived from the events table, in Spark and as text for a checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BODY = """
SELECT event_id AS seq_no,
  CAST(1700000000 AS DOUBLE) + CAST({us} - 1704067200000000 AS DOUBLE) / CAST(10000000000 AS DOUBLE) AS timestamp,
  concat('10.0.', CAST({u250} AS {s}), '.', CAST(1 + user_id % 250 AS {s})) AS src_ip,
  CASE WHEN k < 50 THEN concat('192.168.1.', CAST(1 + k % 4 AS {s})) ELSE concat('203.0.113.', CAST(1 + k % 5 AS {s})) END AS dst_ip,
  CAST(40000 + user_id % 20 AS INT) AS src_port,
  CAST(CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 80 WHEN 'purchase' THEN 22 WHEN 'signup' THEN 53 ELSE 445 END AS INT) AS dst_port,
  CASE WHEN event_type = 'signup' THEN 'UDP' ELSE 'TCP' END AS transport,
  CASE event_type WHEN 'view' THEN 'HTTPS' WHEN 'click' THEN 'HTTP' WHEN 'purchase' THEN 'SSH' WHEN 'signup' THEN 'DNS' ELSE 'SMB' END AS protocol,
  60 + CAST(floor(value * 10) AS BIGINT) AS orig_len,
  CAST(CASE k % 3 WHEN 0 THEN 64 WHEN 1 THEN 128 ELSE 255 - k % 7 END AS INT) AS ttl,
  CASE WHEN event_type = 'signup' THEN '' ELSE CASE k % 4 WHEN 0 THEN 'SYN' WHEN 1 THEN 'SYN ACK' WHEN 2 THEN 'ACK' ELSE 'FIN ACK' END END AS tcp_flags_str,
  event_id * 1000 + 1 AS seq_num
FROM (SELECT *, CAST({k} AS INT) AS k FROM {events}) q
"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets (seq_no, timestamp, endpoints, ports, protocol, orig_len, ttl, flags, seq_num) from ``events``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    body = _BODY.format(us="unix_micros(CAST(ts AS TIMESTAMP))", u250="(user_id div 250)", k="get_json_object(props,'$.k')", s="STRING", events="{events}")
    return spark.sql(body, events=events)


PACKETS_SQL = _BODY.format(us="epoch_us(ts)", u250="(user_id // 250)", k="json_extract(props,'$.k')", s="VARCHAR", events="events")


def with_packets(sql: str) -> str:
    """SQL over ``packets`` (and ``events``) for the checking engine."""
    return f"WITH RECURSIVE packets AS ({PACKETS_SQL}), {sql[5:]}" if sql.lstrip()[:5].upper() == "WITH " else f"WITH packets AS ({PACKETS_SQL}) {sql}"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow rows from lineitem and orders: customer to supplier, bytes from the price, time from the ship date."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).selectExpr(
        "concat('c', o_custkey) as src_ip", "concat('s', l_suppkey) as dst_ip", "concat(l_returnflag, l_linestatus) as protocol",
        "cast(floor(l_extendedprice) as bigint) as orig_len", "cast(unix_micros(cast(l_shipdate as timestamp)) / 1000000 as double) + l_linenumber as timestamp",
        "l_orderkey * 10 + l_linenumber as seq_no",
    )


FLOWS_SQL = """
SELECT concat('c', CAST(o_custkey AS VARCHAR)) AS src_ip, concat('s', CAST(l_suppkey AS VARCHAR)) AS dst_ip, concat(l_returnflag, l_linestatus) AS protocol,
  CAST(floor(l_extendedprice) AS BIGINT) AS orig_len, CAST(epoch_us(l_shipdate) / 1000000 AS DOUBLE) + l_linenumber AS timestamp, l_orderkey * 10 + l_linenumber AS seq_no
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
