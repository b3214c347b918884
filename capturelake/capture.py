"""The Capture object: one set of packets and what can be asked of it, as DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.operators import algorithms, charts, detect, fields, filters, graph, stats
from capturelake.operators import sessions as ses
from capturelake.plans import predicates, recipe
from capturelake.sources import negotiation, pcap, text_logs


class Capture:
    """Everything is lazy; nothing is global."""

    def __init__(self, packets: DataFrame):
        self.packets = packets
        self.sets: dict[str, DataFrame] = {}

    @classmethod
    def read(cls, spark: SparkSession, *paths: str, source: str | None = None, mapping: dict[str, str] | None = None, load: filters.LoadFilter | None = None) -> Capture:
        def one(path: str) -> DataFrame:
            if source == "pcap" or path.endswith((".pcap", ".pcapng", ".cap")):
                return pcap.read(spark, path, load and load.time_range)
            if source == "parquet" or path.endswith(".parquet"):
                return text_logs.parquet_flows(spark, path, mapping)
            return negotiation.read(spark, path, source, mapping)

        packets = negotiation.merge(*map(one, paths))
        return cls(load.apply(packets) if load else packets)

    @cached_property
    def split(self) -> DataFrame:
        """Packets with session_id."""
        return ses.with_generations(self.packets)

    def sessions(self, sort: str = "total_bytes", limit: int = 100, offset: int = 0, search: str = "") -> DataFrame:
        found = ses.sessions(self.split)
        return ses.page(filters.search_sessions(found, search) if search else found, sort, limit, offset)

    def session_packets(self, session_id: str, limit: int = 1000, offset: int = 0) -> DataFrame:
        return self.split.where(self.split["session_id"] == session_id).orderBy("timestamp", "seq_no").offset(offset).limit(limit)

    def stats(self) -> DataFrame:
        return stats.totals(self.packets)

    def timeline(self, width: float = 15.0) -> DataFrame:
        return stats.collapse_gaps(stats.buckets(self.packets, width))

    def graph(self, where: filters.PacketFilter | None = None, subnet_prefix: int | None = None) -> tuple[DataFrame, DataFrame]:
        rows = graph.with_ids(where.apply(self.packets) if where else self.packets, subnet_prefix)
        return graph.view_nodes(rows), graph.view_edges(rows)

    def protocols(self) -> DataFrame:
        return self.packets.where("trim(protocol) <> ''").select("protocol").distinct()

    def subnets(self, prefix: int = 24) -> DataFrame:
        return graph.subnets(self.packets, prefix)

    def paths(self, source: str, target: str, cutoff: int = algorithms.CUTOFF, most: int = algorithms.MAX_PATHS, directed: bool = False) -> DataFrame:
        edges = self.graph()[1]
        pairs = algorithms.directed(edges) if directed else algorithms.undirected(edges)
        return algorithms.paths(pairs, source, target, cutoff, most, two_way=not directed)

    def clusters(self, algorithm: str = "modular", **options) -> DataFrame:
        known = {"modular": algorithms.modular, "communities": algorithms.communities, "core": algorithms.core_clusters, "hubs": algorithms.hubs, "equivalent": algorithms.equivalent}
        if algorithm not in known:
            raise ValueError(f"unknown algorithm {algorithm!r}: {', '.join(known)}")
        return known[algorithm](algorithms.undirected(self.graph()[1]), **options)

    def query(self, target: str, conditions: list[predicates.Condition], logic: str = "AND") -> DataFrame:
        """Matching nodes, edges or sessions; without conditions no node or edge, but every session."""
        items = ses.sessions(self.split) if target == "sessions" else self.graph()[target == "edges"]
        return predicates.match(items, conditions, logic, self.sets, empty=target == "sessions")

    def run_recipe(self, steps: list[recipe.Step]) -> recipe.Outcome:
        wanted = any(s.target == "sessions" for s in steps)
        out = recipe.run(*self.graph(), steps, self.sets, ses.sessions(self.split) if wanted else None)
        self.sets = out.sets
        return out

    def sql(self, text: str) -> DataFrame:
        """SQL over {packets}, {sessions}, {nodes} and {edges}, planned by Catalyst."""
        nodes, edges = self.graph()
        return self.packets.sparkSession.sql(text, packets=self.packets, sessions=ses.sessions(self.split), nodes=nodes, edges=edges)

    def alerts(self, malicious: DataFrame | None = None) -> DataFrame:
        """Alerts of every detector whose columns the packets have; ``malicious(hash, name)`` lists known TLS client hashes."""
        found, has = ses.sessions(self.split), set(self.packets.columns)
        out = [detect.port_scans(found), detect.port_scans(found, "UDP")]
        if {"arp_src_ip", "arp_src_mac"} <= has:
            out.append(detect.arp_spoofing(self.packets))
            if {"arp_dst_ip", "arp_opcode"} <= has:
                out.append(detect.arp_flood(self.packets))
        opened = self.split.join(found.select(F.col("id").alias("session_id"), F.col("src_ip").alias("initiator")), "session_id")
        if "ja3" in has and malicious is not None:
            tls = fields.accumulate(opened, ["tls"])
            out.append(detect.malicious_ja3(found.join(tls, found["id"] == tls["session_id"]), malicious))
        if "tls_selected_version" in has:
            tls = fields.accumulate(opened, ["tls"])
            out.append(detect.weak_tls(found.join(tls, found["id"] == tls["session_id"])))
        if "http_user_agent" in has:
            http = fields.accumulate(opened, ["http"]).withColumnRenamed("http_fwd_user_agents", "user_agents")
            agents = found.join(http, found["id"] == http["session_id"])
            out += [detect.user_agents(agents), detect.empty_user_agents(agents)]
        return detect.alerts(*out)

    def gantt(self) -> DataFrame:
        return charts.session_gantt(ses.sessions(self.split))
