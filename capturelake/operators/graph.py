"""View graph (directed, by protocol) and analysis graph (undirected, one edge a pair)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions import net
from capturelake.operators.filters import endpoints

TOP = 10


def with_ids(packets: DataFrame, subnet_prefix: int | None = None, keep: tuple[str, ...] = (), carry: bool = False) -> DataFrame:
    """Adds the node ids (src, dst): addresses, or their networks but for ``keep``. Packets without one, or with equal ones, go."""

    def node(ip: str):
        c = F.col(ip)
        return c if subnet_prefix is None else F.when(c.isin(list(keep)), c).otherwise(net.subnet(c, subnet_prefix, carry))

    return packets.withColumn("src", node("src_ip")).withColumn("dst", node("dst_ip")).where("src <> '' and dst <> '' and src <> dst")


def view_nodes(packets: DataFrame, carry: bool = False) -> DataFrame:
    """A row for each node id of (src, dst): both ends of a packet count it. ``carry`` as in :func:`capturelake.functions.net.ip_number`."""
    half = F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.col("src_ip").alias("ip"), F.col("ttl").alias("ttl_out"), F.lit(None).cast("int").alias("ttl_in")),
        F.struct(F.col("dst").alias("id"), F.col("dst_ip").alias("ip"), F.lit(None).cast("int").alias("ttl_out"), F.col("ttl").alias("ttl_in")),
    ))
    return packets.select(half.alias("e"), "protocol", "orig_len").groupBy("e.id").agg(
        F.array_sort(F.collect_set("e.ip")).alias("ips"), F.array_sort(F.collect_set("protocol")).alias("protocols"),
        F.sum("orig_len").alias("total_bytes"), F.count(F.lit(1)).alias("packet_count"),
        F.array_sort(F.collect_set(F.when(F.col("e.ttl_out") > 0, F.col("e.ttl_out")))).alias("ttls_out"),
        F.array_sort(F.collect_set(F.when(F.col("e.ttl_in") > 0, F.col("e.ttl_in")))).alias("ttls_in"),
        F.bool_or(net.is_private(F.col("e.ip"), carry)).alias("is_private"),
    )


def view_edges(packets: DataFrame) -> DataFrame:
    """A row for each (src, dst, protocol); first_seen is of the first packet in input order."""
    both = F.array("src_port", "dst_port")
    return packets.groupBy("src", "dst", "protocol").agg(
        F.sum("orig_len").alias("total_bytes"), F.count(F.lit(1)).alias("packet_count"),
        F.min_by("timestamp", "seq_no").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.array_sort(F.collect_set("src_port")).alias("src_ports"), F.array_sort(F.collect_set("dst_port")).alias("dst_ports"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(both)))).alias("ports"),
    ).withColumn("id", F.concat_ws("|", "src", "dst", "protocol"))


def top_lists(packets: DataFrame, kind: str, n: int = TOP) -> DataFrame:
    """(id, rank, key, amount): a node's top source ports it sends from, destination ports of its packets, neighbours or protocols by bytes."""
    sides = {"src_ports": (("src", "src_port"),), "dst_ports": (("src", "dst_port"), ("dst", "dst_port")), "neighbors": (("src", "dst"), ("dst", "src")), "protocols": (("src", "protocol"), ("dst", "protocol"))}[kind]
    amount = F.lit(1) if kind.endswith("ports") else F.col("orig_len")
    half = F.explode(F.array(*[F.struct(F.col(a).alias("id"), F.col(b).cast("string").alias("key")) for a, b in sides]))
    sums = packets.select(half.alias("e"), amount.cast("long").alias("x"), "seq_no").groupBy("e.id", "e.key").agg(F.sum("x").alias("amount"), F.min("seq_no").alias("first"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("amount"), "first", "key"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= n).select("id", "rank", "key", "amount")


def node_edge_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), "id").groupBy("node").agg(F.array_sort(F.collect_set("id")).alias("edge_ids"))


def subnets(packets: DataFrame, prefix: int = 24, carry: bool = False) -> DataFrame:
    ips = endpoints(packets).select("ip").distinct().where((net.is_dotted if carry else net.is_ipv4)(F.col("ip")))
    return ips.groupBy(net.subnet(F.col("ip"), prefix, carry).alias("subnet")).agg(F.array_sort(F.collect_set("ip")).alias("ips"))


def analysis_edges(packets: DataFrame) -> DataFrame:
    """One row for each unordered pair of addresses, over all packets."""
    flags = F.split("tcp_flags_str", " ")
    return packets.where("src_ip <> '' and dst_ip <> ''").groupBy(F.least("src_ip", "dst_ip").alias("a"), F.greatest("src_ip", "dst_ip").alias("b")).agg(
        F.array_sort(F.collect_set("protocol")).alias("protocols"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("src_port", "dst_port"))))).alias("ports"),
        F.count(F.lit(1)).alias("packets"), F.sum("orig_len").alias("bytes"),
        F.bool_or(F.array_contains(flags, "SYN") & ~F.array_contains(flags, "ACK")).alias("has_handshake"), F.bool_or(F.array_contains(flags, "RST")).alias("has_reset"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )


def analysis_nodes(packets: DataFrame, carry: bool = False) -> DataFrame:
    """One row for each address: a sender counts its source port, a receiver the destination port; with degree."""
    rows = endpoints(packets.where("src_ip <> '' and dst_ip <> ''"), "protocol", "src_port", "dst_port", "orig_len", "ttl")
    loop = F.max(F.when(F.col("ip") == F.col("peer"), 1).otherwise(0))
    return rows.groupBy("ip").agg(
        F.array_sort(F.collect_set("protocol")).alias("protocols"), F.array_sort(F.collect_set(F.when(F.col("sender"), F.col("src_port")).otherwise(F.col("dst_port")))).alias("ports"),
        F.array_sort(F.collect_set(F.when(F.col("ttl") > 0, F.col("ttl")))).alias("ttls"), F.count(F.lit(1)).alias("packets"), F.sum("orig_len").alias("bytes"),
        (F.count_distinct("peer") + loop).alias("degree"),
    ).withColumn("is_private", net.is_private(F.col("ip"), carry))


def generic_graph(table: DataFrame, source: str, target: str, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, count, size 4-20) and directed edges (source, target, count, weight 0.5-5.5) of any table."""
    rows = table.select(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("w")).where("source is not null and target is not null")
    nodes = rows.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("count"))
    edges = rows.groupBy("source", "target").agg(F.count(F.lit(1)).alias("count"), F.max("w").alias("w"))
    return scaled(nodes, "count", "size", 4.0, 20.0), scaled(edges, "w", "weight", 0.5, 5.5).drop("w")


def scaled(df: DataFrame, column: str, name: str, low: float, high: float) -> DataFrame:
    """Min-max scaling; the low end where all values are equal. The range is one row."""
    ends = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    x = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, x * (high - low) + low).drop("_lo", "_hi")


def collapse(nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of ``clusters(node, cluster)`` become one node; edges inside one go, edges between ids merge by sorted pair and protocol."""
    name = F.coalesce(F.concat(F.lit("cluster:"), F.col("cluster").cast("string")), F.col("id"))
    big = nodes.join(clusters, nodes["id"] == clusters["node"], "left").groupBy(name.alias("id")).agg(F.sum("total_bytes").alias("total_bytes"), F.sum("packet_count").alias("packet_count"), F.count(F.lit(1)).alias("members"))
    side = lambda c, to: clusters.select(F.col("node").alias(f"_{to}"), F.concat(F.lit("cluster:"), F.col("cluster").cast("string")).alias(to))
    moved = edges.join(side("src", "s"), F.col("src") == F.col("_s"), "left").join(side("dst", "d"), F.col("dst") == F.col("_d"), "left")
    moved = moved.select(F.coalesce("s", "src").alias("s"), F.coalesce("d", "dst").alias("d"), "protocol", "total_bytes", "packet_count").where("s <> d")
    return big, moved.groupBy(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b"), "protocol").agg(F.sum("total_bytes").alias("total_bytes"), F.sum("packet_count").alias("packet_count"))
