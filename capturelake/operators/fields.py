"""Per-protocol session fields, entity enrichment, and search over a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake import scratch

#: Longest list that a session keeps; ``<name>_total`` has the number of all values.
MOST = 500
#: (field, how, packet column): set, first (by order), any (true once), last; 'fwd:' and 'rev:' take one direction.
ACCUMULATORS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "tls": (("tls_snis", "set", "tls_sni"), ("tls_versions", "set", "tls_selected_version"), ("tls_ciphers", "set", "tls_selected_cipher"), ("ja3_hashes", "set", "ja3"), ("ja4_hashes", "set", "ja4"), ("tls_alpn", "first", "tls_alpn_selected")),
    "http": (("http_hosts", "set", "http_host"), ("http_methods", "set", "http_method"), ("http_uris", "ordered", "http_uri"), ("http_fwd_user_agents", "fwd:set", "http_user_agent"), ("http_rev_servers", "rev:set", "http_server"), ("http_statuses", "set", "http_status"), ("http_has_auth", "any", "http_authorization")),
    "dns": (("dns_queries", "set", "dns_query"), ("dns_types", "set", "dns_qtype_name"), ("dns_codes", "set", "dns_rcode_name")),
    "dhcp": (("dhcp_hostnames", "set", "dhcp_hostname"), ("dhcp_vendors", "set", "dhcp_vendor_class"), ("dhcp_types", "set", "dhcp_msg_type"), ("dhcp_lease", "last", "dhcp_lease_time")),
    "arp": (("arp_opcodes", "set", "arp_opcode_name"), ("arp_macs", "set", "arp_src_mac")),
    "icmp": (("icmp_types", "set", "icmp_type_name"), ("icmp_codes", "set", "icmp_code_name")),
    "smb": (("smb_operations", "set", "smb_operation"), ("smb_paths", "set", "smb_path"), ("smb_files", "set", "smb_file"), ("smb_versions", "set", "smb_version")),
    "kerberos": (("krb_principals", "set", "krb_cname"), ("krb_services", "set", "krb_sname"), ("krb_errors", "set", "krb_error")),
    "ldap": (("ldap_operations", "set", "ldap_op"), ("ldap_names", "set", "ldap_dn")),
    "smtp": (("smtp_banner", "first", "smtp_banner"), ("smtp_senders", "set", "smtp_from"), ("smtp_receivers", "set", "smtp_to"), ("smtp_has_auth", "any", "smtp_auth")),
    "ftp": (("ftp_banner", "first", "ftp_banner"), ("ftp_users", "set", "ftp_user"), ("ftp_files", "set", "ftp_file"), ("ftp_has_credentials", "any", "ftp_pass")),
    "ssh": (("ssh_client", "fwd:first", "ssh_banner"), ("ssh_server", "rev:first", "ssh_banner"), ("ssh_kex", "set", "ssh_kex")),
    "quic": (("quic_versions", "set", "quic_version"), ("quic_snis", "set", "quic_sni"), ("quic_alpn", "set", "quic_alpn")),
    "mdns": (("mdns_names", "set", "mdns_query"), ("mdns_services", "set", "mdns_service")),
    "ssdp": (("ssdp_targets", "set", "ssdp_st"), ("ssdp_locations", "set", "ssdp_location")),
    "llmnr": (("llmnr_names", "set", "llmnr_query"),),
    "dcerpc": (("rpc_endpoints", "set", "rpc_endpoint"), ("rpc_operations", "set", "rpc_operation")),
    "flow": (("conn_state", "last", "conn_state"), ("conn_history", "last", "history"), ("conn_uid", "last", "uid")),
}


def accumulate(packets: DataFrame, protocols: list[str] | None = None) -> DataFrame:
    """(session_id, fields of the protocols) of packets with session_id; fields whose column is missing are left out.

    With an ``initiator`` column, directions count its packets as forward.
    """
    at = F.struct("timestamp", "seq_no")
    forward = F.col("src_ip") == F.col("initiator") if "initiator" in packets.columns else F.lit(True)
    out = []
    for name in protocols or ACCUMULATORS:
        for field, how, column in ACCUMULATORS[name]:
            if column not in packets.columns:
                continue
            side, _, how = how.rpartition(":")
            c = F.col(column)
            value = F.when(c.isNotNull() & (c.cast("string") != ""), c)
            if side:
                value = F.when(forward if side == "fwd" else ~forward, value)
            if how == "set":
                found = F.array_sort(F.collect_set(value))
                out += [F.slice(found, 1, MOST).alias(field), F.size(found).alias(f"{field}_total")]
            elif how == "ordered":
                firsts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("timestamp", "seq_no", value.alias("v"))))), lambda x: x["v"]))
                out += [F.slice(firsts, 1, MOST).alias(field), F.size(firsts).alias(f"{field}_total")]
            elif how == "any":
                out.append(F.bool_or(value.isNotNull()).alias(field))
            else:
                pick = F.min_by if how == "first" else F.max_by
                out.append(pick(value, F.when(value.isNotNull(), at)).alias(field))
    if not out:
        return packets.select("session_id").distinct()
    return packets.groupBy("session_id").agg(*out)


def edge_details(packets: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """(src, dst, protocol, sets of the columns): an array column gives its first ten values a packet."""
    kinds = dict(packets.dtypes)
    out = []
    for c in columns:
        values = F.slice(c, 1, 10) if kinds[c].startswith("array") else F.array(c)
        flat = F.array_distinct(F.flatten(F.collect_set(values)))
        out.append(F.slice(F.array_sort(F.filter(flat, lambda x: x.isNotNull() & (x.cast("string") != ""))), 1, most).alias(c))
    return packets.groupBy("src", "dst", "protocol").agg(*out)


def enrich(nodes: DataFrame, facts: DataFrame, slot: str) -> DataFrame:
    """Adds ``slot``: the facts (key, value) of a node's addresses, the last address's first. Nodes have id and ips."""
    pairs = nodes.select("id", F.posexplode("ips").alias("_at", "_ip")).join(facts, F.col("_ip") == F.col("key"))
    found = pairs.groupBy(F.col("id").alias("_id")).agg(F.max_by("value", F.struct("_at", F.col("_ip"))).alias(slot))
    return nodes.join(found, F.col("id") == F.col("_id"), "left").drop("_id")


def with_vendor(df: DataFrame, vendors: DataFrame, mac: str = "src_mac") -> DataFrame:
    """Adds vendor by the first three bytes of a MAC: ``vendors(prefix, vendor)``, prefixes like 00:1A:2B."""
    plain = F.upper(F.regexp_replace(F.col(mac), "-", ":"))
    return df.join(vendors, F.substring(plain, 1, 8) == F.col("prefix"), "left").drop("prefix")


def resolve(packets: DataFrame, hosts: DataFrame, include_ipv6: bool = True) -> DataFrame:
    """Adds src and dst by an entity map (ip, host). Without IPv6 a packet needs one end that resolves to none, and no end may be one in the result."""
    side = lambda c, to: hosts.select(F.col("ip").alias(f"_{to}"), F.col("host").alias(to))
    rows = packets.join(side("src_ip", "src"), F.col("src_ip") == F.col("_src"), "left").join(side("dst_ip", "dst"), F.col("dst_ip") == F.col("_dst"), "left").drop("_src", "_dst")
    rows = rows.withColumns({"src": F.coalesce("src", "src_ip"), "dst": F.coalesce("dst", "dst_ip")})
    return rows if include_ipv6 else rows.where(~F.col("src").contains(":") & ~F.col("dst").contains(":"))


def of_components(packets: DataFrame, parts: DataFrame, chosen: list[str]) -> DataFrame:
    """Packets with an end in the chosen components (node, component)."""
    ips = parts.where(F.col("component").isin(chosen)).select("node").distinct()
    left = packets.join(ips.withColumnRenamed("node", "_a"), F.col("src_ip") == F.col("_a"), "left").join(ips.withColumnRenamed("node", "_b"), F.col("dst_ip") == F.col("_b"), "left")
    return left.where("_a is not null or _b is not null").drop("_a", "_b")


def search(nodes: DataFrame, edges: DataFrame, sessions: DataFrame, text: str) -> DataFrame:
    """(kind, id) of all that hold the text in a field: a session promotes its pair's edges, an edge its ends."""
    low = text.lower()

    def holds(df: DataFrame, names: list[str]):
        kinds, out = dict(df.dtypes), F.lit(False)
        for c in names:
            if kinds.get(c, "").startswith("array"):
                out |= F.exists(c, lambda x: F.lower(x.cast("string")).contains(low))
            elif c in kinds:
                out |= F.lower(F.col(c).cast("string")).contains(low)
        return F.coalesce(out, F.lit(False))

    # sessions, edges and nodes are looked through once each; what is used again is written
    hit = scratch.cut(sessions.where(holds(sessions, ["src_ip", "dst_ip", "protocol", "src_port", "dst_port"])).select("id", "src_ip", "dst_ip"))
    pairs = hit.select(F.least("src_ip", "dst_ip").alias("a"), F.greatest("src_ip", "dst_ip").alias("b"), F.lit(True).alias("_hit")).distinct()
    keyed = edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    shown = scratch.cut(keyed.join(pairs, ["a", "b"], "left").where(holds(edges, ["id", "protocol", "ports"]) | F.col("_hit").isNotNull()).select("id", "src", "dst").distinct())
    ends = shown.select(F.explode(F.array("src", "dst")).alias("id"))
    found = nodes.where(holds(nodes, ["id", "ips", "protocols"])).select("id").union(ends).distinct()
    return found.select(F.lit("node").alias("kind"), "id").union(shown.select(F.lit("edge"), "id")).union(hit.select(F.lit("session"), "id").distinct())
