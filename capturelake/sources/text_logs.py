"""Connection logs as text: tab-separated logs with a #fields header, and tab-separated packet exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake import scratch
from capturelake.functions import net

#: Columns every packet source gives, with their defaults.
DEFAULTS = {
    "timestamp": ("double", 0.0), "src_ip": ("string", ""), "dst_ip": ("string", ""), "src_port": ("int", 0), "dst_port": ("int", 0), "transport": ("string", ""),
    "protocol": ("string", ""), "orig_len": ("bigint", 0), "payload_len": ("bigint", 0), "ttl": ("int", 0), "tcp_flags_str": ("string", ""), "seq_num": ("bigint", 0),
    "src_mac": ("string", ""), "dst_mac": ("string", ""), "source_type": ("string", ""),
}


def as_packets(df: DataFrame, columns: dict[str, Column], extra: dict[str, Column] | None = None) -> DataFrame:
    """Packet rows: the given columns, defaults for the others, extra columns, and seq_no by time and line.

    Rows without an address or a time go. seq_no is a number that grows with (timestamp, line) in a sort of all rows. The rows
    are checkpointed with it, so that every branch of a plan sees one numbering.
    """
    chosen = {c: F.coalesce(columns[c].cast(kind), F.lit(value).cast(kind)) if c in columns else F.lit(value).cast(kind) for c, (kind, value) in DEFAULTS.items()}
    rows = df.select(*[v.alias(k) for k, v in chosen.items()], *[v.alias(k) for k, v in (extra or {}).items()], *([F.col("_line")] if "_line" in df.columns else []))
    rows = rows.where("src_ip <> '' and dst_ip <> '' and timestamp > 0")
    line = "_line" if "_line" in rows.columns else "src_ip"
    return scratch.cut(rows.orderBy("timestamp", line).withColumn("seq_no", F.monotonically_increasing_id()).drop("_line"))


def read_fields_log(spark: SparkSession, *paths: str) -> DataFrame:
    """A log whose '#fields' line names the columns: other '#' lines and rows of another width are skipped, '-' is null.

    Each file's first header names its columns; where all headers are one, it holds for files without one too. The driver
    sees a line for each different header. Columns that a file lacks are null.
    """
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    headers = lines.where(F.col("value").startswith("#fields")).groupBy("_file").agg(F.min_by("value", "_line").alias("_header"))
    layouts = sorted(r[0] for r in headers.select("_header").distinct().collect())
    if not layouts:
        raise ValueError(f"{', '.join(paths)}: no #fields line")
    rows = lines.where(~F.col("value").startswith("#"))
    if len(layouts) > 1:
        rows = rows.join(headers, "_file")
    out = None
    for header in layouts:
        names = header.split("\t")[1:]
        mine = rows.where(F.col("_header") == header) if len(layouts) > 1 else rows
        parts = mine.select(F.split("value", "\t").alias("p"), "_line").where(F.size("p") == len(names))
        part = parts.select(*[net.clean(F.col("p")[i]).alias(n) for i, n in enumerate(names)], "_line")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _c(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _list(value: Column) -> Column:
    return F.when(value.isNotNull(), F.split(value, ",")).otherwise(F.array().cast("array<string>"))


def _ends(df: DataFrame, transport: Column) -> dict[str, Column]:
    return {
        "timestamp": net.number(_c(df, "ts")), "src_ip": _c(df, "id.orig_h"), "dst_ip": _c(df, "id.resp_h"), "src_port": net.number(_c(df, "id.orig_p"), "int"),
        "dst_port": net.number(_c(df, "id.resp_p"), "int"), "transport": transport,
    }


def _true(value: Column) -> Column:
    return F.coalesce(value == "T", F.lit(False))


def conn(df: DataFrame, source: str = "zeek") -> DataFrame:
    """One packet row a flow: service, else protocol by port; flags from the history string."""
    transport = F.upper(F.coalesce(_c(df, "proto"), F.lit("")))
    ends = _ends(df, transport)
    service = F.upper(_c(df, "service"))
    name = F.when(service == "SSL", "TLS").otherwise(service)
    size = lambda a, b: net.number(_c(df, a), "bigint") + net.number(_c(df, b), "bigint")
    flags = net.history_flags(_c(df, "history"))
    done = _c(df, "conn_state").isin("S1", "S2", "S3", "SF", "RSTO", "RSTR")
    return as_packets(
        df, ends | {"protocol": F.coalesce(name, net.protocol_by_port(transport, ends["src_port"], ends["dst_port"])), "orig_len": size("orig_ip_bytes", "resp_ip_bytes"), "payload_len": size("orig_bytes", "resp_bytes"), "tcp_flags_str": F.array_join(flags, " "), "source_type": F.lit(source)},
        {"uid": _c(df, "uid"), "conn_state": _c(df, "conn_state"), "history": _c(df, "history"), "duration": net.number(_c(df, "duration")), "service": _c(df, "service"), "has_handshake": F.coalesce(done, F.lit(False))},
    )


def dns(df: DataFrame) -> DataFrame:
    """A row with answers, or with any response code (a missing one reads 0), is a response."""
    answers = _list(_c(df, "answers"))
    return as_packets(
        df, _ends(df, F.upper(F.coalesce(_c(df, "proto"), F.lit("udp")))) | {"protocol": F.lit("DNS"), "source_type": F.lit("zeek")},
        {"dns_query": F.coalesce(_c(df, "query"), F.lit("")), "dns_qtype_name": _c(df, "qtype_name"), "dns_rcode": net.number(_c(df, "rcode"), "int"), "dns_rcode_name": _c(df, "rcode_name"), "dns_answers": answers, "dns_ttls": F.transform(_list(_c(df, "TTLs")), lambda x: net.number(x)),
         "dns_qr": F.when((F.size(answers) > 0) | (net.number(_c(df, "rcode"), "int") >= 0), 1).otherwise(0), "dns_aa": _true(_c(df, "AA")), "dns_rd": _true(_c(df, "RD")), "dns_ra": _true(_c(df, "RA"))},
    )


def http(df: DataFrame) -> DataFrame:
    user = _c(df, "username")
    return as_packets(
        df, _ends(df, F.lit("TCP")) | {"protocol": F.lit("HTTP"), "orig_len": net.number(_c(df, "request_body_len"), "bigint") + net.number(_c(df, "response_body_len"), "bigint"), "source_type": F.lit("zeek")},
        {"http_method": _c(df, "method"), "http_host": _c(df, "host"), "http_uri": _c(df, "uri"), "http_referer": _c(df, "referrer"), "http_user_agent": _c(df, "user_agent"), "http_status": net.number(_c(df, "status_code"), "int"), "http_content_type": F.get(_list(_c(df, "resp_mime_types")), F.lit(0)), "http_username": user, "http_authorization": F.when(user.isNotNull(), "Basic")},
    )


def ssl(df: DataFrame) -> DataFrame:
    cert = F.struct(_c(df, "subject").alias("subject"), _c(df, "issuer").alias("issuer"))
    return as_packets(df, _ends(df, F.lit("TCP")) | {"protocol": F.lit("TLS"), "source_type": F.lit("zeek")}, {"tls_sni": _c(df, "server_name"), "tls_selected_version": _c(df, "version"), "tls_selected_cipher": _c(df, "cipher"), "ja3": _c(df, "ja3"), "tls_cert": cert})


def smb(df: DataFrame) -> DataFrame:
    """File actions without their prefixes; share mapping rows are TREE_CONNECT."""
    action = F.regexp_replace(F.coalesce(_c(df, "action"), F.lit("SMB::TREE_CONNECT")), "^SMB::(FILE_)?", "")
    return as_packets(df, _ends(df, F.lit("TCP")) | {"protocol": F.lit("SMB"), "source_type": F.lit("zeek")}, {"smb_operation": action, "smb_path": _c(df, "path"), "smb_file": _c(df, "name"), "smb_share_type": _c(df, "share_type")})


def dce_rpc(df: DataFrame) -> DataFrame:
    return as_packets(df, _ends(df, F.lit("TCP")) | {"protocol": F.lit("DCE/RPC"), "source_type": F.lit("zeek")}, {"rpc_endpoint": _c(df, "endpoint"), "rpc_operation": _c(df, "operation"), "rpc_pipe": _c(df, "named_pipe"), "rpc_rtt": net.number(_c(df, "rtt"))})


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated export, names in its first line; a row with one leading value more (an index) loses it, others of another width go. The header may come again, as in several files."""
    lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())
    first = lines.orderBy("_line").limit(1).collect()
    if not first:
        raise ValueError(f"{path}: empty")
    names, at = first[0]["value"].split("\t"), first[0]["_line"]
    n = len(names)
    p = F.split("value", "\t")
    parts = lines.where((F.col("_line") != at) & (F.col("value") != first[0]["value"])).select(F.when(F.size(p) == n + 1, F.slice(p, 2, n)).otherwise(p).alias("p"), "_line").where(F.size("p") == n)
    return parts.select(*[net.clean(F.col("p")[i]).alias(name) for i, name in enumerate(names)], "_line")


def export_metadata(df: DataFrame) -> DataFrame:
    """Frame-level columns: addresses, ports (0 for ICMP), flags from the bit mask. Rows with empty or any-addresses go."""
    number = lambda c, kind="int": net.number(_c(df, c), kind)
    proto = number("ip.proto")
    transport = F.when(proto == 6, "TCP").when(proto == 17, "UDP").when(proto.isin(1, 58), "ICMP").otherwise("")
    icmp = transport == "ICMP"
    port = lambda side: F.when(icmp, 0).otherwise(F.greatest(number(f"tcp.{side}port"), number(f"udp.{side}port")))
    mask = F.coalesce(F.conv(F.regexp_replace(_c(df, "tcp.flags"), "^0x", ""), 16, 10).cast("int"), F.lit(0))
    rows = df.where(~_c(df, "ip.src").isin("0.0.0.0", "255.255.255.255") & ~_c(df, "ip.dst").isin("0.0.0.0", "255.255.255.255"))
    return as_packets(
        rows, {"timestamp": number("frame.time_epoch", "double"), "src_ip": _c(df, "ip.src"), "dst_ip": _c(df, "ip.dst"), "src_port": port("src"), "dst_port": port("dst"), "transport": transport, "protocol": F.when(icmp, "ICMP").otherwise(net.protocol_by_port(transport, port("src"), port("dst"))),
               "orig_len": number("frame.len", "bigint"), "ttl": number("ip.ttl"), "tcp_flags_str": F.array_join(net.flags_of(mask), " "), "seq_num": number("tcp.seq", "bigint"), "src_mac": _c(df, "eth.src"), "dst_mac": _c(df, "eth.dst"), "source_type": F.lit("tshark")},
        {"frame": number("frame.number", "bigint")},
    )


def with_frames(rows: DataFrame, metadata: DataFrame, frame: str = "frameNumber") -> DataFrame:
    """Protocol rows joined to the metadata of their frame; of repeated frames the last counts, rows without one go."""
    last = metadata.groupBy("frame").agg(F.max_by(F.struct(*[c for c in metadata.columns if c != "frame"]), "seq_no").alias("m")).select("frame", "m.*")
    return rows.withColumn("frame", net.number(F.col(frame), "bigint")).drop(*[c for c in last.columns if c != "frame" and c in rows.columns], "_line").join(last, "frame")


def export_arp(df: DataFrame) -> DataFrame:
    """ARP rows with their own addresses; probes and broadcasts go."""
    odd = ("0.0.0.0", "255.255.255.255")
    rows = df.where(~_c(df, "arp.src.proto_ipv4").isin(*odd) & ~_c(df, "arp.dst.proto_ipv4").isin(*odd))
    return as_packets(
        rows, {"timestamp": net.number(_c(df, "frame.time_epoch")), "src_ip": _c(df, "arp.src.proto_ipv4"), "dst_ip": _c(df, "arp.dst.proto_ipv4"), "protocol": F.lit("ARP"), "src_mac": _c(df, "arp.src.hw_mac"), "dst_mac": _c(df, "arp.dst.hw_mac"), "source_type": F.lit("tshark")},
        {"arp_opcode": net.number(_c(df, "arp.opcode"), "int"), "arp_src_ip": _c(df, "arp.src.proto_ipv4"), "arp_src_mac": _c(df, "arp.src.hw_mac"), "arp_dst_ip": _c(df, "arp.dst.proto_ipv4")},
    )


def parquet_flows(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """A flow table in Parquet: columns as in a connection log, or renamed by ``mapping``; a timestamp ts becomes seconds."""
    df = spark.read.parquet(path).withColumnsRenamed(mapping or {})
    df = df.withColumnsRenamed({a: b for a, b in RENAMES.items() if a in df.columns and b not in df.columns})
    if dict(df.dtypes).get("ts", "").startswith("timestamp"):
        df = df.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return conn(df, "parquet")


RENAMES = {"timestamp": "ts", "src_ip": "id.orig_h", "src_port": "id.orig_p", "dst_ip": "id.resp_h", "dst_port": "id.resp_p", "transport": "proto"}
