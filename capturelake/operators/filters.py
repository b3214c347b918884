"""Row filters on packets: the shared WHERE clause, and the filters at load time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions import net


@dataclass
class PacketFilter:
    """The filters of graph, chart and slice requests; an unset one lets every row pass."""

    include_ipv6: bool = True
    exclude_broadcasts: bool = False
    time_range: tuple[float, float] | None = None
    protocol_filters: list[str] = field(default_factory=list)
    protocols: list[str] = field(default_factory=list)
    ip: str = ""
    port: str = ""
    flag: str = ""
    search: str = ""

    def column(self, columns: list[str]) -> Column:
        out = F.lit(True)
        src, dst = F.col("src_ip"), F.col("dst_ip")
        if not self.include_ipv6:
            out &= ~src.contains(":") & ~dst.contains(":")
        if self.exclude_broadcasts:
            out &= ~net.is_broadcast(src) & ~net.is_broadcast(dst)
        if self.time_range:
            out &= F.col("timestamp").between(*self.time_range)
        triples = [t for t in (composite(x) for x in self.protocol_filters) if t]
        if triples:
            any_of = F.lit(False)
            for version, transport, protocol in triples:
                one = (F.col("transport") == transport) & (F.col("protocol") == protocol)
                any_of |= one & (_version(columns) == version) if version else one
            out &= any_of
        elif self.protocols:
            out &= F.col("protocol").isin(self.protocols)
        if self.ip:
            out &= F.lower("src_ip").contains(self.ip.lower()) | F.lower("dst_ip").contains(self.ip.lower())
        if self.port.strip().lstrip("-").isdigit():
            out &= (F.col("src_port") == int(self.port)) | (F.col("dst_port") == int(self.port))
        if self.flag:
            out &= F.col("tcp_flags_str").contains(self.flag.upper())
        if self.search:
            names = [c for c in ("src_ip", "dst_ip", "src_mac", "dst_mac", "protocol", "tcp_flags_str", "src_port", "dst_port") if c in columns]
            any_of = F.lit(False)
            for c in names:
                any_of |= F.lower(F.col(c).cast("string")).contains(self.search.lower())
            out &= any_of
        return F.coalesce(out, F.lit(False))

    def apply(self, packets: DataFrame) -> DataFrame:
        return packets.where(self.column(packets.columns))


def composite(text: str) -> tuple[int, str, str] | None:
    """'version/transport/protocol', version 0 for any; None for other forms, which are ignored."""
    parts = text.split("/")
    if len(parts) != 3 or not parts[0].isdigit():
        return None
    return int(parts[0]), parts[1], parts[2]


def _version(columns: list[str]) -> Column:
    return F.col("ip_version") if "ip_version" in columns else F.when(F.col("src_ip").contains(":"), 6).otherwise(4)


@dataclass
class LoadFilter:
    """Filters at load, applied in this order: protocols, addresses, ports, top talkers, number of packets."""

    time_range: tuple[float, float] | None = None
    protocols: list[str] = field(default_factory=list)
    ip_allow: list[str] = field(default_factory=list)
    ip_deny: list[str] = field(default_factory=list)
    port_allow: list[str] = field(default_factory=list)
    port_deny: list[str] = field(default_factory=list)
    top_talkers: int = 0
    max_packets: int = 0

    def apply(self, packets: DataFrame) -> DataFrame:
        if self.time_range:
            packets = packets.where(F.col("timestamp").between(*self.time_range))
        if self.protocols:
            names = [p.upper() for p in self.protocols]
            packets = packets.where(F.upper("protocol").isin(names) | F.upper("transport").isin(names))
        if self.ip_allow:
            packets = packets.where(_touches_ip(self.ip_allow))
        if self.ip_deny:
            packets = packets.where(~_touches_ip(self.ip_deny))
        if self.port_allow:
            packets = packets.where(_touches_port(self.port_allow))
        if self.port_deny:
            packets = packets.where(~_touches_port(self.port_deny))
        if self.top_talkers:
            packets = top_talkers(packets, self.top_talkers)
        if self.max_packets:
            packets = packets.orderBy("timestamp", "seq_no").limit(self.max_packets)
        return packets


def _touches_ip(items: list[str]) -> Column:
    exact = [i for i in items if "/" not in i]
    blocks = [i for i in items if "/" in i]
    return F.col("src_ip").isin(exact) | F.col("dst_ip").isin(exact) | net.in_blocks(F.col("src_ip"), blocks) | net.in_blocks(F.col("dst_ip"), blocks)


def _touches_port(items: list[str]) -> Column:
    out = F.lit(False)
    for item in items:
        lo, _, hi = item.partition("-")
        if lo.strip().isdigit() and (not hi or hi.strip().isdigit()):
            a, b = int(lo), int(hi or lo)
            out |= F.col("src_port").between(a, b) | F.col("dst_port").between(a, b)
    return out


def endpoints(packets: DataFrame, *keep: str) -> DataFrame:
    """Two rows a packet: (ip, peer, sender) with the columns kept."""
    half = F.explode(F.array(
        F.struct(F.col("src_ip").alias("ip"), F.col("dst_ip").alias("peer"), F.lit(True).alias("sender")),
        F.struct(F.col("dst_ip").alias("ip"), F.col("src_ip").alias("peer"), F.lit(False).alias("sender")),
    ))
    return packets.select(half.alias("_e"), *keep).select("_e.*", *keep)


def top_talkers(packets: DataFrame, k: int) -> DataFrame:
    """Packets that touch one of the ``k`` addresses with most appearances (ties: first seen)."""
    top = endpoints(packets, "seq_no").groupBy("ip").agg(F.count(F.lit(1)).alias("n"), F.min("seq_no").alias("first")).orderBy(F.desc("n"), "first", "ip").limit(k).select("ip")
    left = packets.join(top.withColumnRenamed("ip", "_a"), F.col("src_ip") == F.col("_a"), "left").join(top.withColumnRenamed("ip", "_b"), F.col("dst_ip") == F.col("_b"), "left")
    return left.where(F.col("_a").isNotNull() | F.col("_b").isNotNull()).drop("_a", "_b")


def search_sessions(sessions: DataFrame, text: str) -> DataFrame:
    """Sessions with the text in an address, the protocol or a port."""
    out = F.lit(False)
    for c in ("src_ip", "dst_ip", "protocol", "src_port", "dst_port"):
        out |= F.lower(F.col(c).cast("string")).contains(text.lower())
    return sessions.where(out)


def keys_in_range(packets: DataFrame, start: float, end: float, width: float = 15.0) -> DataFrame:
    """Session keys with a packet in a bucket that the range overlaps; buckets count from the first packet."""
    first = packets.agg(F.min("timestamp").alias("t0"))
    at = F.floor((F.col("timestamp") - F.col("t0")) / width)
    rows = packets.select("timestamp", net.session_key().alias("session_key")).crossJoin(F.broadcast(first))
    inside = at.between(F.floor((F.lit(start) - F.col("t0")) / width), F.floor((F.lit(end) - F.col("t0")) / width))
    return rows.where(inside).select("session_key").distinct()
