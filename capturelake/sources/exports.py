"""Protocol tables of packet exports: DNS, HTTP, SMB and RPC rows that get their addresses from the metadata table of their frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.functions import net
from capturelake.sources.text_logs import _c, as_packets, read_export

# Names of DNS record types and response codes, transports by number, interface ids by name.
DNS_TYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 35: "NAPTR", 43: "DS", 46: "RRSIG", 47: "NSEC",
    48: "DNSKEY", 65: "HTTPS", 255: "ANY",
}
DNS_CODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 5: "REFUSED"}
TRANSPORTS = {6: "TCP", 17: "UDP", 1: "ICMP", 58: "ICMPv6"}
INTERFACES = {
    "EPM": "e1af8308-5d1f-11c9-91a4-08002b14a0fa",
    "DRSUAPI": "e3514235-4b06-11d1-ab04-00c04fc2dcd2",
    "SAMR": "12345778-1234-abcd-ef00-0123456789ac",
    "LSARPC": "12345778-1234-abcd-ef00-0123456789ab",
    "NETLOGON": "12345678-1234-abcd-ef00-01234567cffb",
    "SVCCTL": "367abb81-9844-35f1-ad32-98f038001003",
    "WINREG": "338cd001-2244-31f1-aaaa-900038001003",
    "SRVSVC": "4b324fc8-1670-01d3-1278-5a47bf6ee188",
    "WKSSVC": "6bffd098-a112-3610-9833-46c3f87e345a",
    "ATSVC": "1ff70682-0a51-30e8-076d-740be8cee98b",
    "IRemoteWinspool": "76f03f96-cdfd-44fc-a22c-64950a001209",
    "SPOOLSS": "12345678-1234-abcd-ef00-0123456789ab",
}
#: Cookies keep so many characters.
COOKIE = 500
#: A whole literal string, or characters that begin neither a string nor a word; possessive, so that long rows need no deep stack.
_OUTSIDE = r"""\G((?:[^'"NTF]|'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)"""


def literal(text: Column, schema: str) -> Column:
    """A nested literal ({'a': 1.0, 'b': None}, lists of them) as a value of ``schema``; null if it is none.

    Single quotes, escapes of bytes and the three words for null and truth are turned into JSON, outside and inside strings as they must; the
    JVM's JSON reader does the rest. Tuples, sets and joined strings are not read.
    """
    out = text
    for word, json in (("None", "null"), ("True", "true"), ("False", "false")):
        others = _OUTSIDE.replace("NTF", word[0])
        out = F.regexp_replace(out, others + word, "$1" + json)
    out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*+)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    return F.from_json(out, schema, {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"})


def _named(table: dict, key: Column) -> Column:
    """The name of a key, else the key as text."""
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(names, key), key.cast("string"))


def networks(metadata: DataFrame) -> DataFrame:
    """(frame, ends) of a metadata table: addresses, ports, transport, lifetime of each frame; of repeated frames the last row counts.

    The rows of a frame are reduced before they are shuffled. A frame is named by its text, empty ones go.
    """
    number = lambda c: net.number(_c(metadata, c), "int")
    text = lambda c: F.coalesce(_c(metadata, c), F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in TRANSPORTS.items() for x in kv])
    ends = F.struct(
        text("sourceIp").alias("src_ip"), text("destIp").alias("dst_ip"), number("sourcePort").alias("src_port"), number("destPort").alias("dst_port"),
        text("sourceMac").alias("src_mac"), text("destMac").alias("dst_mac"), F.coalesce(F.element_at(names, number("ipProtoType")), F.lit("")).alias("transport"),
        number("ipTtl").alias("ttl"),
    )
    rows = metadata.select(_c(metadata, "frameNumber").alias("frame"), ends.alias("ends"), "_line").where("frame <> ''")
    return rows.groupBy("frame").agg(F.max_by("ends", "_line").alias("ends"))


def _packets(rows: DataFrame, metadata: DataFrame, protocol: str, extra: dict[str, Column]) -> DataFrame:
    """Packets of protocol rows by their frames; rows without a time, a frame in the metadata or one of its addresses go."""
    timed = rows.select(_c(rows, "frameNumber").alias("frame"), net.number(_c(rows, "ts")).alias("timestamp"), "_line", *[v.alias(k) for k, v in extra.items()])
    joined = timed.where("timestamp <> 0").join(networks(metadata), "frame")
    columns = {c: F.col(f"ends.{c}") for c in ("src_ip", "dst_ip", "src_port", "dst_port", "src_mac", "dst_mac", "transport", "ttl")}
    columns |= {"timestamp": F.col("timestamp"), "protocol": F.lit(protocol), "source_type": F.lit("tshark")}
    return as_packets(joined, columns, {"frame": F.col("frame")} | {k: F.col(k) for k in extra})


def dns(rows: DataFrame, metadata: DataFrame, response: bool) -> DataFrame:
    """DNS questions, or answers with the response code of the flags' last four bits. Types without a name keep their number."""
    asked = literal(_c(rows, "query"), "qname string, qtype double")
    kind = F.coalesce(asked["qtype"].cast("int"), F.lit(0))
    extra = {
        "dns_query": F.coalesce(asked["qname"], F.lit("")), "dns_qtype_name": _named(DNS_TYPES, kind), "dns_trans_id": net.number(_c(rows, "transId"), "int"),
        "dns_qr": F.lit(int(response)),
    }
    if response:
        given = F.coalesce(literal(_c(rows, "answers"), "array<struct<rname string, rtype double, answer string, ttl double>>"), F.expr("array()"))
        answer = lambda a: F.struct(
            F.coalesce(a["rname"], F.lit("")).alias("name"), _named(DNS_TYPES, F.coalesce(a["rtype"].cast("int"), F.lit(0))).alias("type"),
            F.coalesce(a["answer"], F.lit("")).alias("data"), F.coalesce(a["ttl"].cast("int"), F.lit(0)).alias("ttl"),
        )
        code = net.number(_c(rows, "flags"), "int").bitwiseAND(15)
        extra |= {
            "dns_records": F.transform(given, answer), "dns_answers": F.transform(given, lambda a: F.coalesce(a["answer"], F.lit(""))),
            "dns_ttls": F.transform(given, lambda a: F.coalesce(a["ttl"], F.lit(0.0))), "dns_rcode": code, "dns_rcode_name": _named(DNS_CODES, code),
        }
    return _packets(rows, metadata, "DNS", extra)


def http(rows: DataFrame, metadata: DataFrame, response: bool) -> DataFrame:
    """HTTP requests or responses with the headers that sessions use; written-out line ends at a header's end go, empty headers are null."""
    headers = literal(F.trim(_c(rows, "httpResponseHeaders" if response else "httpRequestHeaders"), F.lit('"')), "map<string,string>")

    def header(name: str) -> Column:
        value = F.trim(F.regexp_replace(F.element_at(headers, name), r"(\\r|\\n|\s)++$", ""))
        return F.when(value != "", value)

    if response:
        extra = {
            "http_status": net.number(_c(rows, "httpResponseCode"), "int"), "http_status_phrase": _c(rows, "httpResponsePhrase"), "http_version": _c(rows, "httpResponseVersion"),
            "http_server": header("Server"), "http_content_type": header("Content-Type"), "http_set_cookie": F.substring(header("Set-Cookie"), 1, COOKIE),
        }
    else:
        extra = {
            "http_method": _c(rows, "httpRequestMethod"), "http_uri": _c(rows, "httpRequestUri"), "http_version": _c(rows, "httpRequestVersion"), "http_host": header("Host"),
            "http_user_agent": header("User-Agent"), "http_content_type": header("Content-Type"), "http_cookie": F.substring(header("Cookie"), 1, COOKIE),
        }
    return _packets(rows, metadata, "HTTP", extra)


def smb(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """SMB commands; a status of success and a tree number 0 are null."""
    tree, status = net.number(_c(rows, "smbTid"), "int"), _c(rows, "smbStatus")
    extra = {
        "smb_operation": _c(rows, "smbCmdName"), "smb_command_code": _c(rows, "smbCmd"), "smb_version": net.number(_c(rows, "smbVersion"), "int"),
        "smb_status": F.when(status != "0x00000000", status), "smb_tree": F.when(tree != 0, tree), "smb_flags": _c(rows, "smbFlags"),
    }
    return _packets(rows, metadata, "SMB", extra)


def dce_rpc(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """RPC calls: the interface, its id where the name is known, and the operation's number (0 if it isn't digits)."""
    name, operation = _c(rows, "endpoint"), _c(rows, "operation")
    ids = F.create_map(*[F.lit(x) for kv in INTERFACES.items() for x in kv])
    extra = {"rpc_endpoint": name, "rpc_operation": operation, "rpc_opnum": F.when(operation.rlike("^[0-9]+$"), net.number(operation, "int")).otherwise(0), "rpc_interface_id": F.element_at(ids, name)}
    return _packets(rows, metadata, "DCE/RPC", extra)


#: Columns that tell a protocol table, and its reader; the first that fits.
TABLES = (
    (("transId", "queriesCount", "answers", "requestAt"), lambda r, m: dns(r, m, True)),
    (("transId", "queriesCount", "query", "responseAt"), lambda r, m: dns(r, m, False)),
    (("httpRequestMethod", "httpRequestUri", "httpRequestVersion"), lambda r, m: http(r, m, False)),
    (("httpResponseVersion", "httpResponseCode", "httpResponsePhrase"), lambda r, m: http(r, m, True)),
    (("smbCmd", "smbStatus", "smbCmdName", "smbVersion"), smb),
    (("endpoint", "operation"), dce_rpc),
)


def read(spark: SparkSession, path: str, metadata: str) -> DataFrame:
    """Packets of a protocol table, told by its columns, with the metadata table of the same capture."""
    rows = read_export(spark, path)
    reader = next((r for names, r in TABLES if set(names) <= set(rows.columns)), None)
    if reader is None:
        raise ValueError(f"{path}: no protocol table has these columns")
    return reader(rows, read_export(spark, metadata))
