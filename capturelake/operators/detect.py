"""Detectors and insights over packets and sessions. Alerts have one schema: (severity, kind, subject, evidence, first_seen)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions import net

SEVERITY = ("critical", "high", "medium", "low", "info")
SCAN_PORTS, SCAN_HIGH, SCAN_RATIO = 15, 50, 0.6
ARP_FLOOD = 15
# User-agent rules (first match wins), weak TLS versions, systems by TTL, window and segment size.
USER_AGENTS = ("python-requests", "python-urllib", "curl/", "wget/", "zgrab", "masscan", "nikto", "nmap", "sqlmap", "go-http-client", "gobuster", "dirbuster", "hydra", "scrapy")
WEAK_TLS = ("TLS 1.0", "TLS 1.1", "SSLv2", "SSLv3")
SYSTEMS = (
    ("Windows 10/11", (120, 128), (8192, 65535), (1460, 1460), ()),
    ("Windows 7/8", (120, 128), (8192, 65535), (1460, 1460), ()),
    ("Windows (generic)", (100, 128), (1024, 65535), None, ()),
    ("Linux 4.x/5.x", (50, 64), (26000, 65535), (1460, 1460), ("SAckOK", "Timestamp")),
    ("Linux (generic)", (50, 64), (1024, 65535), None, ()),
    ("macOS/iOS", (50, 64), (65535, 65535), None, ()),
    ("Cisco IOS", (250, 255), (4128, 4128), None, ()),
    ("Network device", (250, 255), None, None, ()),
    ("FreeBSD", (50, 64), (65535, 65535), (1460, 1460), ()),
    ("Solaris", (250, 255), (8760, 65535), None, ()),
)


def alerts(*found: DataFrame) -> DataFrame:
    """All alerts, by severity and then time."""
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("severity")), F.lit(0))
    return out.orderBy(F.when(rank == 0, 99).otherwise(rank), F.coalesce("first_seen", F.lit(0.0)), "kind", "subject")


def _alert(df: DataFrame, kind: str, severity, subject, evidence, first="first_seen") -> DataFrame:
    return df.select(severity.alias("severity"), F.lit(kind).alias("kind"), subject.alias("subject"), evidence.alias("evidence"), F.col(first).cast("double").alias("first_seen"))


def port_scans(sessions: DataFrame, transport: str = "TCP", ports: int = SCAN_PORTS, high: int = SCAN_HIGH, ratio: float = SCAN_RATIO) -> DataFrame:
    """Pairs with many destination ports; for TCP also most sessions without a handshake."""
    pairs = sessions.where(F.col("transport") == transport).groupBy("src_ip", "dst_ip").agg(
        F.count_distinct("dst_port").alias("ports"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("has_handshake")).alias("open"), F.min("start_time").alias("first_seen")
    )
    found = pairs.where(F.col("ports") >= ports)
    if transport == "TCP":
        found = found.where(F.col("open") / F.col("n") >= ratio)
    severity = F.when(F.col("ports") >= high, "high").otherwise("medium")
    return _alert(found, f"{transport.lower()}_port_scan", severity, F.concat_ws(" -> ", "src_ip", "dst_ip"), F.concat(F.col("ports").cast("string"), F.lit(" ports")))


def arp_spoofing(packets: DataFrame) -> DataFrame:
    """Addresses that ARP packets (arp_src_ip, arp_src_mac, timestamp) claim for several MACs; evidence by first sight."""
    macs = packets.where("arp_src_ip <> '' and arp_src_mac <> ''").groupBy("arp_src_ip", "arp_src_mac").agg(F.min("timestamp").alias("t"))
    found = macs.groupBy("arp_src_ip").agg(F.array_sort(F.collect_list(F.struct("t", "arp_src_mac"))).alias("m"), F.min("t").alias("first_seen")).where(F.size("m") >= 2)
    return _alert(found, "arp_spoofing", F.lit("high"), F.col("arp_src_ip"), F.array_join(F.col("m.arp_src_mac"), ","))


def arp_flood(packets: DataFrame, least: int = ARP_FLOOD) -> DataFrame:
    """Gratuitous replies: opcode 2 with equal source and target address."""
    rows = packets.where("arp_opcode = 2 and arp_src_ip = arp_dst_ip and arp_src_ip <> ''")
    found = rows.groupBy("arp_src_mac").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_seen")).where(F.col("n") >= least)
    return _alert(found, "gratuitous_arp", F.lit("medium"), F.col("arp_src_mac"), F.col("n").cast("string"))


def malicious_ja3(sessions: DataFrame, known: DataFrame) -> DataFrame:
    """Sessions (id, ja3_hashes) whose first listed hash is in ``known(hash, name)``."""
    rows = sessions.select("id", "start_time", F.posexplode("ja3_hashes").alias("at", "hash")).join(known, "hash")
    found = rows.groupBy("id").agg(F.min_by(F.struct("hash", "name"), "at").alias("x"), F.min("start_time").alias("first_seen"))
    return _alert(found, "malicious_ja3", F.lit("critical"), F.col("id"), F.concat_ws(" ", "x.name", "x.hash"))


def weak_tls(sessions: DataFrame) -> DataFrame:
    found = sessions.withColumn("weak", F.array_sort(F.array_intersect("tls_versions", F.array(*map(F.lit, WEAK_TLS))))).where(F.size("weak") > 0)
    return _alert(found, "deprecated_tls", F.lit("medium"), F.col("id"), F.array_join("weak", ","), "start_time")


def user_agents(sessions: DataFrame) -> DataFrame:
    """Tool user agents, one alert a pair: the rule that comes first on the pair's earliest session."""
    lower = F.explode(F.transform("user_agents", lambda x: F.lower(x)))
    rows = sessions.select("src_ip", "dst_ip", "start_time", "id", lower.alias("ua"))
    rule = F.lit(None).cast("string")
    for r in reversed(USER_AGENTS):
        rule = F.when(F.col("ua").contains(r), r).otherwise(rule)
    found = rows.withColumn("rule", rule).where("rule is not null").groupBy("src_ip", "dst_ip").agg(F.min_by("rule", F.struct("start_time", "id", "ua")).alias("rule"), F.min("start_time").alias("first_seen"))
    return _alert(found, "suspicious_ua", F.lit("medium"), F.concat_ws(" -> ", "src_ip", "dst_ip"), F.col("rule"))


def empty_user_agents(sessions: DataFrame) -> DataFrame:
    found = sessions.where((F.col("protocol") == "HTTP") & (F.coalesce(F.size("user_agents"), F.lit(0)) <= 0)).groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"), F.min("start_time").alias("first_seen"))
    return _alert(found, "empty_ua", F.lit("low"), F.col("src_ip"), F.col("n").cast("string"))


def characterise(sessions: DataFrame) -> DataFrame:
    """Adds fg, bg and label: additive scores on duration, packet rate, packet size and TCP state."""
    d, n = F.col("duration"), F.col("packet_count")
    rate = F.when(d > 0, n / d).otherwise(n.cast("double"))
    size = F.col("total_bytes") / n
    on = lambda c, x=1: F.when(c, x).otherwise(0)
    fg = on(d < 2, 2) + on((d >= 2) & (d < 30)) + on(rate > 10, 2) + on((rate > 2) & (rate <= 10)) + on(size > 500) + on(F.col("has_handshake"), 2) + on(F.col("has_fin") & (d < 10))
    bg = on(d > 300, 2) + on((d >= 30) & (d <= 300)) + on(rate <= 2) + on(size < 80, 2) + on(F.col("has_reset"))
    arp = F.upper("protocol") == "ARP"
    out = sessions.withColumn("fg", F.when(arp, 0).otherwise(fg)).withColumn("bg", F.when(arp, 10).otherwise(bg))
    return out.withColumn("label", F.when(F.col("fg") > F.col("bg"), "foreground").when(F.col("bg") > F.col("fg"), "background").otherwise("ambiguous"))


def characterisation_summary(sessions: DataFrame) -> DataFrame:
    total = F.sum(F.count(F.lit(1))).over(Window.partitionBy())
    return characterise(sessions).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("total_bytes").alias("bytes"), F.round(F.count(F.lit(1)) * 100.0 / total, 1).alias("percent"))


def fingerprints(packets: DataFrame) -> DataFrame:
    """(ip, system, score): each sender's first SYN, else its first SYN-ACK, against the systems; the first of the best scores."""
    flags = F.split("tcp_flags_str", " ")
    syn, ack = F.array_contains(flags, "SYN"), F.array_contains(flags, "ACK")
    has = lambda c, kind: F.col(c) if c in packets.columns else F.lit(None).cast(kind)
    seen = F.struct("ttl", has("window_size", "int").alias("window"), has("mss", "int").alias("mss"), has("options", "array<string>").alias("options"))
    one = packets.where(syn & (F.col("ttl") > 0)).groupBy(F.col("src_ip").alias("ip")).agg(F.min_by(seen, F.struct(ack, F.col("seq_no"))).alias("p")).select("ip", "p.*")
    best = F.struct(F.lit(0).alias("score"), F.lit(0).alias("order"), F.lit(None).cast("string").alias("system"))
    for k, (name, ttl, window, mss, options) in enumerate(SYSTEMS):
        score = F.lit(3)
        if window:
            score += F.when(F.coalesce(F.col("window").between(*window), F.lit(False)), 2).otherwise(0)
        if mss:
            score += F.when(F.coalesce(F.col("mss").between(*mss), F.lit(False)), 1).otherwise(0)
        if options:
            score += F.when(F.coalesce(F.size(F.array_except(F.array(*map(F.lit, options)), "options")) == 0, F.lit(False)), 2).otherwise(0)
        this = F.struct(F.when(F.col("ttl").between(*ttl), score).otherwise(0).alias("score"), F.lit(-k - 1).alias("order"), F.lit(name).alias("system"))
        best = F.greatest(best, this)
    t = F.col("ttl")
    guess = F.when(t.between(50, 64), "Unix-like (Linux/macOS/BSD)").when(t.between(100, 128), "Windows (likely)").when(t.between(200, 255), "Network device (likely)").otherwise(F.format_string("Unknown (TTL=%d)", t))
    out = one.withColumn("b", best).select("ip", F.when(F.col("b.score") > 0, F.col("b.system")).otherwise(guess).alias("system"), F.greatest("b.score", F.lit(1)).alias("score"))
    return out.withColumn("confidence", F.least(F.lit(100), (F.col("score") * 100 / 8).cast("int")))


def roles(packets: DataFrame, external: int = 3) -> DataFrame:
    """(ip, role, hops): gateways are destinations MACs of several external addresses, then hosts by address and distance."""
    ends = packets.select(F.col("src_ip").alias("ip"), "ttl").groupBy("ip").agg(F.max("ttl").alias("ttl")).where("ip <> ''")
    hops = net.hops(F.col("ttl"))
    role = F.when(net.is_external(F.col("ip")), "external").when(hops == 0, "lan").otherwise("routed")
    out = ends.select("ip", role.alias("role"), hops.alias("hops"))
    if "dst_mac" not in packets.columns:
        return out
    gates = packets.where(net.is_external(F.col("dst_ip"))).groupBy("dst_mac").agg(F.count_distinct("dst_ip").alias("n")).where(F.col("n") >= external)
    owners = packets.join(gates, packets["src_mac"] == gates["dst_mac"], "left_semi").where(net.is_role_private(F.col("src_ip"))).select(F.col("src_ip").alias("_ip")).distinct()
    return out.join(owners, F.col("ip") == F.col("_ip"), "left").select("ip", F.when(F.col("_ip").isNotNull(), "gateway").otherwise(F.col("role")).alias("role"), "hops")


def flag_senders(packets: DataFrame, n: int = 10) -> DataFrame:
    """(kind, ip, packets): top senders of pure SYN, SYN-ACK, FIN and RST."""
    flags = F.split("tcp_flags_str", " ")
    has = lambda f: F.array_contains(flags, f)
    kinds = F.filter(F.array(F.when(has("SYN") & ~has("ACK"), "syn"), F.when(has("SYN") & has("ACK"), "syn_ack"), F.when(has("FIN"), "fin"), F.when(has("RST"), "rst")), lambda x: x.isNotNull())
    rows = packets.select("src_ip", F.explode(kinds).alias("kind")).groupBy("kind", F.col("src_ip").alias("ip")).agg(F.count(F.lit(1)).alias("packets"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("packets"), "ip"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select("kind", "ip", "packets")


def dns_names(packets: DataFrame) -> DataFrame:
    """(ip, names): answers that are addresses, of responses (dns_qr = 1; dns_query, dns_answers)."""
    rows = packets.where("dns_qr = 1 and dns_query <> ''").select(F.col("dns_query").alias("name"), F.explode("dns_answers").alias("ip"))
    rows = rows.where(net.is_ipv4(F.col("ip")) | F.col("ip").rlike(r"\A[0-9a-fA-F:]*:[0-9a-fA-F:]*\z"))
    return rows.groupBy("ip").agg(F.array_sort(F.collect_set(F.rtrim(F.lower("name")))).alias("names"))


def top_domains(packets: DataFrame, n: int = 20) -> DataFrame:
    return packets.where("dns_query <> ''").groupBy(F.lower("dns_query").alias("domain")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(n)
