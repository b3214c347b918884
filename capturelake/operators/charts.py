"""Chart datasets: rows ready to draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GANTT_ROWS = 2000
MIN_BAR = 0.5
MAX_CATEGORIES = 20


def session_gantt(sessions: DataFrame, rows: int = GANTT_ROWS) -> DataFrame:
    """The sessions of most packets, by start, with times from the first start; bars are at least MIN_BAR long."""
    first = F.broadcast(sessions.agg(F.min("start_time").alias("t0")))
    top = sessions.orderBy(F.desc("packet_count"), "id").limit(rows).crossJoin(first)
    return top.select("id", "protocol", F.round(F.col("start_time") - F.col("t0"), 6).alias("start"), F.round(F.greatest("duration", F.lit(MIN_BAR)), 6).alias("length"), "packet_count")


def conversation(packets: DataFrame, target: str) -> DataFrame:
    """Packets of one address with the peer and direction."""
    out = F.col("src_ip") == target
    return packets.where(out | (F.col("dst_ip") == target)).select("seq_no", "timestamp", F.when(out, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("peer"), F.when(out, "out").otherwise("in").alias("direction"), "protocol", "orig_len")


def ttl_between(packets: DataFrame, a: str, b: str) -> DataFrame:
    pair = ((F.col("src_ip") == a) & (F.col("dst_ip") == b)) | ((F.col("src_ip") == b) & (F.col("dst_ip") == a))
    return packets.where(pair & (F.col("ttl") != 0)).select("seq_no", "timestamp", F.concat_ws(" -> ", "src_ip", "dst_ip").alias("direction"), "ttl")


def bytes_over_time(packets: DataFrame) -> DataFrame:
    """Running bytes of each session and direction."""
    order = Window.partitionBy("session_key", "src_ip").orderBy("timestamp", "seq_no").rowsBetween(Window.unboundedPreceding, 0)
    return packets.select("seq_no", "session_key", "src_ip", "timestamp", F.sum("orig_len").over(order).alias("running_bytes"))


def relative_sequence(packets: DataFrame) -> DataFrame:
    """Sequence numbers from the least of their session and direction."""
    side = Window.partitionBy("session_key", "src_ip")
    return packets.where("seq_num > 0").select("seq_no", "session_key", "src_ip", (F.col("seq_num") - F.min("seq_num").over(side)).alias("relative_seq"))


def protocol_packets(packets: DataFrame, protocol: str) -> DataFrame:
    """One protocol's packets over time: the source of the DNS and user-agent timelines."""
    return packets.where(F.col("protocol") == protocol).select("seq_no", "timestamp", "src_ip", "dst_ip", "orig_len")


def exploded_hashes(sessions: DataFrame, column: str, target: str) -> DataFrame:
    """A row for each fingerprint of each session of an address (JA3 and JA4 timelines)."""
    mine = (F.col("src_ip") == target) | (F.col("dst_ip") == target)
    return sessions.where(mine).select("id", "start_time", F.explode(column).alias("hash"))


def custom_source(packets: DataFrame, protocol: str | None, fields: list[str]) -> DataFrame:
    """Base fields of a custom chart; unknown fields are left out."""
    rows = packets if protocol is None else packets.where(F.col("protocol") == protocol)
    return rows.select(*[c for c in fields if c in packets.columns])


def categories(df: DataFrame, column: str, most: int = MAX_CATEGORIES) -> DataFrame:
    """The values shown as categories, most frequent first."""
    return df.groupBy(F.col(column).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(most)


def entry_filter(df: DataFrame, kinds: dict[str, str], wanted: dict) -> DataFrame:
    """Filters by field kind: ip prefix, string contains (any case), numeric (low, high) inclusive, list membership."""
    out = F.lit(True)
    for name, value in wanted.items():
        kind, c = kinds.get(name), F.col(name)
        if kind == "ip":
            out &= c.startswith(value)
        elif kind == "string":
            out &= F.lower(c).contains(value.lower())
        elif kind == "numeric":
            low, high = value
            out &= (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high)
        elif kind == "list":
            out &= c.isin(list(value))
    return df.where(F.coalesce(out, F.lit(False)))


def animation(sessions: DataFrame, nodes: list[str], protocols: list[str] | None = None) -> DataFrame:
    """A start and an end event for each session that touches the nodes; starts come first at equal times."""
    rows = sessions.where(F.col("src_ip").isin(nodes) | F.col("dst_ip").isin(nodes))
    if protocols:
        rows = rows.where(F.col("protocol").isin(protocols))
    event = F.explode(F.array(F.struct(F.col("start_time").alias("time"), F.lit("start").alias("type")), F.struct(F.col("end_time").alias("time"), F.lit("end").alias("type"))))
    return rows.select(event.alias("e"), F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "id", "protocol", F.col("total_bytes").alias("bytes"), F.col("packet_count").alias("packets")).select("e.*", "src", "dst", "id", "protocol", "bytes", "packets").orderBy("time", F.col("type") == "end", "id")


def animation_nodes(events: DataFrame) -> DataFrame:
    starts = events.where("type = 'start'").select(F.explode(F.array("src", "dst")).alias("node"), "bytes", "packets")
    return starts.groupBy("node").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))
