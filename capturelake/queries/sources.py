"""Queries over log files: the capture view written in each format and read back by its reader."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake import scratch
from capturelake.queries.registry import Registry
from capturelake.sources import exports, negotiation, text_logs
from capturelake.sources.capture_view import packets

R = Registry()
ENDS = {"ts": "timestamp", "uid": "concat('C', seq_no)", "id.orig_h": "src_ip", "id.orig_p": "src_port", "id.resp_h": "dst_ip", "id.resp_p": "dst_port"}


def write_log(rows: DataFrame, columns: dict[str, str], fields: bool = True) -> str:
    """Path of a tab-separated log of the rows, a file a partition, each with its header; nulls are '-'."""
    header = "\t".join((["#fields"] if fields else []) + list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    text = F.concat_ws("\t", *[F.coalesce(F.expr(e).cast("string"), F.lit("-")) for e in columns.values()])
    path = scratch.fresh(rows.sparkSession, "log")
    rows.select(text.alias("value")).mapInArrow(run, "value string").write.text(path)
    return path


def add(name, columns, select, sql, where="true", fields=True, **options):
    """The rows where ``where`` holds, as a log of ``columns``, read as packets, of which ``select`` is returned."""

    def query(s, d):
        path = write_log(packets(s, d).where(where), columns, fields)
        return negotiation.read(s, path, **options).selectExpr(*select)

    R.add(name, query, f"{sql} FROM packets WHERE {where}")


END_COLUMNS = ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "transport", "protocol"]
ENDS_SQL = "SELECT timestamp, src_ip, dst_ip, src_port, dst_port, "
STATE = "CASE seq_no % 4 WHEN 0 THEN 'SF' WHEN 1 THEN 'S0' WHEN 2 THEN 'REJ' ELSE 'RSTO' END"
CONN = ENDS | {"proto": "lower(transport)", "service": "CASE protocol WHEN 'HTTPS' THEN 'ssl' WHEN 'DNS' THEN 'dns' END", "duration": "ttl / 10", "orig_bytes": "orig_len - 40", "resp_bytes": "CASE WHEN seq_no % 3 > 0 THEN ttl END", "orig_ip_bytes": "orig_len", "resp_ip_bytes": "ttl", "conn_state": STATE}
CONN_SELECT = [*END_COLUMNS, "orig_len", "payload_len", "conn_state", "has_handshake", "uid", "duration"]
CONN_SQL = ENDS_SQL + f"transport, CASE protocol WHEN 'HTTPS' THEN 'TLS' ELSE protocol END AS protocol, orig_len + ttl AS orig_len, orig_len - 40 + CASE WHEN seq_no % 3 > 0 THEN ttl ELSE 0 END AS payload_len, {STATE} AS conn_state, seq_no % 4 IN (0, 3) AS has_handshake, concat('C', CAST(seq_no AS VARCHAR)) AS uid, ttl / 10 AS duration"
add("s05_connection_log", CONN, CONN_SELECT, CONN_SQL)
add("s02_forced_source", CONN, CONN_SELECT, CONN_SQL, source="zeek_conn")
add("s20_mapped_columns", {("when" if k == "ts" else k): v for k, v in CONN.items()}, CONN_SELECT, CONN_SQL, source="zeek_conn", mapping={"when": "ts"})
add("s06_dns_log", ENDS | {"proto": "lower(transport)", "query": "concat('n', seq_no % 30)", "answers": "CASE WHEN seq_no % 3 = 0 THEN concat(dst_ip, ',x.example') END", "rcode": "CASE WHEN seq_no % 2 = 0 THEN seq_no % 5 END", "qtype_name": "'A'", "AA": "CASE WHEN seq_no % 7 = 0 THEN 'T' ELSE 'F' END"},
    [*END_COLUMNS, "dns_query", "dns_rcode", "size(dns_answers) AS answers", "get(dns_answers, 0) = dst_ip AS same", "dns_aa", "dns_qr"],
    ENDS_SQL + "transport, protocol, concat('n', CAST(seq_no % 30 AS VARCHAR)) AS dns_query, CAST(CASE WHEN seq_no % 2 = 0 THEN seq_no % 5 ELSE 0 END AS INT) AS dns_rcode, CASE WHEN seq_no % 3 = 0 THEN 2 ELSE 0 END AS answers, CASE WHEN seq_no % 3 = 0 THEN true END AS same, seq_no % 7 = 0 AS dns_aa, 1 AS dns_qr", "protocol = 'DNS'")
add("s07_http_log", ENDS | {"method": "CASE WHEN seq_no % 2 = 0 THEN 'GET' ELSE 'POST' END", "host": "concat('h', seq_no % 7, '.example')", "uri": "concat('/', seq_no % 13)", "user_agent": "CASE WHEN seq_no % 5 > 0 THEN 'browser' END", "status_code": "200 + seq_no % 3", "request_body_len": "orig_len", "response_body_len": "ttl", "username": "CASE WHEN seq_no % 11 = 0 THEN 'me' END"},
    [*END_COLUMNS, "orig_len", "http_method", "http_host", "http_uri", "http_user_agent", "http_status", "http_authorization"],
    ENDS_SQL + "'TCP' AS transport, 'HTTP' AS protocol, orig_len + ttl AS orig_len, CASE WHEN seq_no % 2 = 0 THEN 'GET' ELSE 'POST' END AS http_method, concat('h', CAST(seq_no % 7 AS VARCHAR), '.example') AS http_host, concat('/', CAST(seq_no % 13 AS VARCHAR)) AS http_uri, CASE WHEN seq_no % 5 > 0 THEN 'browser' END AS http_user_agent, CAST(200 + seq_no % 3 AS INT) AS http_status, CASE WHEN seq_no % 11 = 0 THEN 'Basic' END AS http_authorization", "protocol = 'HTTP'")
add("s08_ssl_log", ENDS | {"version": "CASE WHEN seq_no % 17 = 0 THEN 'TLSv10' ELSE 'TLSv13' END", "cipher": "concat('c', seq_no % 4)", "server_name": "concat('s', seq_no % 9, '.example')", "ja3": "CASE WHEN seq_no % 2 = 0 THEN concat('j', seq_no % 40) END"},
    [*END_COLUMNS, "tls_sni", "tls_selected_version", "tls_selected_cipher", "ja3"],
    ENDS_SQL + "'TCP' AS transport, 'TLS' AS protocol, concat('s', CAST(seq_no % 9 AS VARCHAR), '.example') AS tls_sni, CASE WHEN seq_no % 17 = 0 THEN 'TLSv10' ELSE 'TLSv13' END AS tls_selected_version, concat('c', CAST(seq_no % 4 AS VARCHAR)) AS tls_selected_cipher, CASE WHEN seq_no % 2 = 0 THEN concat('j', CAST(seq_no % 40 AS VARCHAR)) END AS ja3", "protocol = 'HTTPS'")
add("s09_smb_files_log", ENDS | {"action": "CASE WHEN seq_no % 2 = 0 THEN 'SMB::FILE_OPEN' ELSE 'SMB::PRINT_CLOSE' END", "path": "concat('share', seq_no % 3)", "name": "concat('f', seq_no % 8, '.doc')"},
    [*END_COLUMNS, "smb_operation", "smb_path", "smb_file"],
    ENDS_SQL + "'TCP' AS transport, 'SMB' AS protocol, CASE WHEN seq_no % 2 = 0 THEN 'OPEN' ELSE 'PRINT_CLOSE' END AS smb_operation, concat('share', CAST(seq_no % 3 AS VARCHAR)) AS smb_path, concat('f', CAST(seq_no % 8 AS VARCHAR), '.doc') AS smb_file", "protocol = 'SMB'")
add("s10_dce_rpc_log", ENDS | {"endpoint": "concat('e', seq_no % 3)", "operation": "concat('o', seq_no % 5)", "named_pipe": "'pipe'", "rtt": "ttl / 1000"},
    [*END_COLUMNS, "rpc_endpoint", "rpc_operation", "rpc_pipe", "rpc_rtt"],
    ENDS_SQL + "'TCP' AS transport, 'DCE/RPC' AS protocol, concat('e', CAST(seq_no % 3 AS VARCHAR)) AS rpc_endpoint, concat('o', CAST(seq_no % 5 AS VARCHAR)) AS rpc_operation, 'pipe' AS rpc_pipe, ttl / 1000 AS rpc_rtt", "protocol = 'SMB'")
MASK = "CASE tcp_flags_str WHEN 'SYN' THEN '0x0002' WHEN 'SYN ACK' THEN '0x0012' WHEN 'ACK' THEN '0x0010' WHEN 'FIN ACK' THEN '0x0011' END"
add("s11_packet_export", {"frame.number": "seq_no", "frame.time_epoch": "timestamp", "ip.src": "src_ip", "ip.dst": "dst_ip", "ip.proto": "CASE transport WHEN 'TCP' THEN 6 ELSE 17 END", "tcp.srcport": "CASE transport WHEN 'TCP' THEN src_port END", "tcp.dstport": "CASE transport WHEN 'TCP' THEN dst_port END", "udp.srcport": "CASE transport WHEN 'UDP' THEN src_port END", "udp.dstport": "CASE transport WHEN 'UDP' THEN dst_port END", "tcp.flags": MASK, "frame.len": "orig_len", "ip.ttl": "ttl", "tcp.seq": "seq_num"},
    ["frame", *END_COLUMNS, "orig_len", "ttl", "tcp_flags_str", "seq_num"],
    "SELECT seq_no AS frame, timestamp, src_ip, dst_ip, src_port, dst_port, transport, protocol, orig_len, ttl, tcp_flags_str, seq_num", fields=False)
add("s12a_arp_export", {"frame.time_epoch": "timestamp", "arp.src.proto_ipv4": "CASE WHEN seq_no % 50 = 0 THEN '0.0.0.0' ELSE src_ip END", "arp.dst.proto_ipv4": "dst_ip", "arp.src.hw_mac": "concat('m', seq_no % 3)", "arp.dst.hw_mac": "'m9'", "arp.opcode": "1 + seq_no % 2"},
    ["timestamp", "src_ip", "dst_ip", "protocol", "arp_opcode", "arp_src_mac", "dst_mac"],
    "SELECT timestamp, src_ip, dst_ip, 'ARP' AS protocol, CAST(1 + seq_no % 2 AS INT) AS arp_opcode, concat('m', CAST(seq_no % 3 AS VARCHAR)) AS arp_src_mac, 'm9' AS dst_mac", fields=False)
# probes have no address and go
R.sql["s12a_arp_export"] += " AND seq_no % 50 <> 0"


def parquet_flows(s, d):
    """Renamed columns, and the time as a timestamp."""
    path = scratch.fresh(s, "flows")
    rows = packets(s, d).selectExpr("timestamp_micros(seq_no * 1000000) AS ts", "src_ip", "src_port", "dst_ip", "dst_port", "lower(transport) AS proto", "orig_len AS orig_ip_bytes", "ttl AS resp_ip_bytes", "protocol AS what")
    rows.write.parquet(path)
    return text_logs.parquet_flows(s, path, {"what": "service"}).selectExpr(*END_COLUMNS, "orig_len")


R.add("s03_parquet_flows", parquet_flows, "SELECT CAST(seq_no AS DOUBLE) AS timestamp, src_ip, dst_ip, src_port, dst_port, transport, protocol, orig_len + ttl AS orig_len FROM packets WHERE seq_no > 0")


def mixed_headers(s, d):
    """Files of one folder whose headers differ in order and columns."""
    rows = packets(s, d)
    one = write_log(rows.where("seq_no % 2 = 0"), CONN)
    other = write_log(rows.where("seq_no % 2 = 1"), dict(reversed(CONN.items())) | {"extra": "'x'"})
    return text_logs.conn(text_logs.read_fields_log(s, one, other)).selectExpr(*CONN_SELECT)


R.add("s04_headers_by_file", mixed_headers, CONN_SQL + " FROM packets")


def merged(s, d):
    """Two logs as one capture: every packet has a number of its own."""
    rows = packets(s, d)
    parts = [negotiation.read(s, write_log(rows.where(f"seq_no % 3 {t} 0"), CONN)) for t in ("=", ">")]
    both = negotiation.merge(*parts)
    return both.groupBy("src_ip").agg(F.count(F.lit(1)).alias("packets"), F.count_distinct("seq_no").alias("numbers"), F.min("timestamp").alias("first"), F.sum("orig_len").alias("bytes"))


R.add("s17_merged_logs", merged, "SELECT src_ip, count(*) AS packets, count(*) AS numbers, min(timestamp) AS first, CAST(sum(orig_len + ttl) AS BIGINT) AS bytes FROM packets GROUP BY src_ip")


METADATA = {
    "frameNumber": "seq_no", "ts": "timestamp", "sourceIp": "src_ip", "destIp": "dst_ip", "sourcePort": "src_port", "destPort": "dst_port",
    "ipProtoType": "CASE transport WHEN 'TCP' THEN '6.0' ELSE '17.0' END", "ipTtl": "ttl", "sourceMac": "concat('m', seq_no % 3)", "destMac": "'m9'",
}
FRAME = {"frameNumber": "seq_no", "ts": "timestamp + 1"}
FRAME_SQL = "SELECT CAST(seq_no AS VARCHAR) AS frame, timestamp + 1 AS timestamp, src_ip, dst_ip, src_port, dst_port, transport, ttl, "
FRAME_COLUMNS = ["frame", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "transport", "ttl", "protocol"]
#: Frames that the metadata lack, and ones of which they have an older row too.
LACKING, TWICE = "seq_no % 10 = 3", "seq_no % 10 = 4"


def add_table(name, columns, select, sql, where):
    """A protocol table of the rows where ``where`` holds, read with the metadata of all packets."""

    def query(s, d):
        rows = packets(s, d)
        # the older row comes first in its file
        older = rows.where(TWICE).withColumns({"_n": F.lit(0), "src_ip": F.lit("198.51.100.1"), "ttl": F.lit(1)})
        known = rows.where(f"not ({LACKING})").withColumn("_n", F.lit(1)).unionByName(older)
        metadata = write_log(known.repartition("seq_no").sortWithinPartitions("_n"), METADATA, fields=False)
        table = write_log(rows.where(where), FRAME | columns, fields=False)
        return exports.read(s, table, metadata).selectExpr(*FRAME_COLUMNS, *select)

    R.add(name, query, f"{FRAME_SQL} {sql} FROM packets WHERE {where} AND NOT ({LACKING})")


add_table(
    "s12_dns_requests",
    {"transId": "seq_no % 65536", "queriesCount": "1", "query": "concat('{\\'qname\\': \\'n', seq_no % 30, '.example\\', \\'qtype\\': ', CASE seq_no % 3 WHEN 0 THEN '1.0' WHEN 1 THEN '28' ELSE 'None' END, '}')", "responseAt": "''"},
    ["dns_query", "dns_qtype_name", "dns_trans_id"],
    "'DNS' AS protocol, concat('n', seq_no % 30, '.example') AS dns_query, CASE seq_no % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' ELSE '0' END AS dns_qtype_name, CAST(seq_no % 65536 AS INT) AS dns_trans_id",
    "protocol = 'DNS'",
)
ANSWERS = (
    "CASE WHEN seq_no % 4 = 0 THEN '[]' ELSE concat('[{\\'rname\\': \\'n', seq_no % 30, '\\', \\'rtype\\': 5.0, \\'answer\\': \"it\\'s None\", \\'ttl\\': 60.0}, "
    "{\\'rname\\': None, \\'rtype\\': 77, \\'answer\\': \\'', dst_ip, '\\', \\'ttl\\': ', seq_no % 50, '}]') END"
)
add_table(
    "s12_dns_responses",
    {"transId": "7", "flags": "32768 + seq_no % 6", "queriesCount": "1", "query": "'{}'", "answers": ANSWERS, "requestAt": "''"},
    ["size(dns_records) AS answers", "get(dns_records, 0).type AS first_type", "get(dns_records, 0).data AS first_data", "get(dns_records, 1).name AS second_name", "get(dns_records, 1).type AS second_type",
     "get(dns_records, 1).data AS second_data", "get(dns_records, 1).ttl AS second_ttl", "dns_rcode_name"],
    "'DNS' AS protocol, CAST(CASE WHEN seq_no % 4 = 0 THEN 0 ELSE 2 END AS INT) AS answers, CASE WHEN seq_no % 4 > 0 THEN 'CNAME' END AS first_type, CASE WHEN seq_no % 4 > 0 THEN 'it''s None' END AS first_data, CASE WHEN seq_no % 4 > 0 THEN '' END AS second_name, "
    "CASE WHEN seq_no % 4 > 0 THEN '77' END AS second_type, CASE WHEN seq_no % 4 > 0 THEN dst_ip END AS second_data, CASE WHEN seq_no % 4 > 0 THEN CAST(seq_no % 50 AS INT) END AS second_ttl, "
    "CASE seq_no % 6 WHEN 0 THEN 'NOERROR' WHEN 1 THEN 'FORMERR' WHEN 2 THEN 'SERVFAIL' WHEN 3 THEN 'NXDOMAIN' WHEN 4 THEN '4' ELSE 'REFUSED' END AS dns_rcode_name",
    "protocol = 'DNS'",
)
add_table(
    "s12_http_requests",
    {"httpRequestMethod": "'GET'", "httpRequestUri": "concat('/', seq_no % 13)", "httpRequestVersion": "'HTTP/1.1'", "httpRequestHeaders": "concat('{\\'Host\\': \\'h', seq_no % 7, '.example\\\\r\\\\n\\', \\'User-Agent\\': \\'', CASE WHEN seq_no % 5 > 0 THEN 'agent (None)' ELSE '' END, '\\'}')"},
    ["http_uri", "http_host", "http_user_agent", "http_cookie"],
    "'HTTP' AS protocol, concat('/', seq_no % 13) AS http_uri, concat('h', seq_no % 7, '.example') AS http_host, CASE WHEN seq_no % 5 > 0 THEN 'agent (None)' END AS http_user_agent, CAST(NULL AS VARCHAR) AS http_cookie",
    "protocol = 'HTTP'",
)
add_table(
    "s12_http_responses",
    {"httpResponseVersion": "'HTTP/1.1'", "httpResponseCode": "200 + seq_no % 3", "httpResponsePhrase": "'OK'", "httpResponseHeaders": "concat('{\\'Server\\': \\'s', seq_no % 4, '\\', \\'Set-Cookie\\': \\'', repeat('c', cast(seq_no % 3 * 300 as int)), '\\'}')"},
    ["http_status", "http_status_phrase", "http_server", "length(http_set_cookie) AS cookie"],
    "'HTTP' AS protocol, CAST(200 + seq_no % 3 AS INT) AS http_status, 'OK' AS http_status_phrase, concat('s', seq_no % 4) AS http_server, CAST(CASE seq_no % 3 WHEN 1 THEN 300 WHEN 2 THEN 500 END AS INT) AS cookie",
    "protocol = 'HTTP'",
)
add_table(
    "s12_smb_commands",
    {"smbCmd": "5", "smbStatus": "CASE WHEN seq_no % 2 = 0 THEN '0x00000000' ELSE '0xc0000034' END", "smbFlags": "'0x01'", "smbTid": "seq_no % 3", "smbVersion": "2", "smbCmdName": "'Create'"},
    ["smb_operation", "smb_status", "smb_tree", "smb_version"],
    "'SMB' AS protocol, 'Create' AS smb_operation, CASE WHEN seq_no % 2 = 1 THEN '0xc0000034' END AS smb_status, CAST(nullif(seq_no % 3, 0) AS INT) AS smb_tree, CAST(2 AS INT) AS smb_version",
    "protocol = 'SMB'",
)
add_table(
    "s12_rpc_calls",
    {"endpoint": "CASE seq_no % 3 WHEN 0 THEN 'SAMR' WHEN 1 THEN 'EPM' ELSE 'OTHER' END", "operation": "CASE WHEN seq_no % 2 = 0 THEN cast(seq_no % 40 as string) ELSE 'Open' END"},
    ["rpc_endpoint", "rpc_opnum", "rpc_interface_id"],
    "'DCE/RPC' AS protocol, CASE seq_no % 3 WHEN 0 THEN 'SAMR' WHEN 1 THEN 'EPM' ELSE 'OTHER' END AS rpc_endpoint, CAST(CASE WHEN seq_no % 2 = 0 THEN seq_no % 40 ELSE 0 END AS INT) AS rpc_opnum, "
    "CASE seq_no % 3 WHEN 0 THEN '12345778-1234-abcd-ef00-0123456789ac' WHEN 1 THEN 'e1af8308-5d1f-11c9-91a4-08002b14a0fa' END AS rpc_interface_id",
    "protocol = 'SMB'",
)
