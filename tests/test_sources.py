"""Small files of each source."""

import struct

from pyspark.sql import functions as F

from capturelake.capture import Capture
from capturelake.operators import detect
from capturelake.operators.filters import LoadFilter
from capturelake.sources import negotiation, pcap, text_logs

CONN = "\n".join([
    "#separator \\x09", "#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice\tduration\torig_bytes\tresp_bytes\tconn_state\thistory\torig_ip_bytes\tresp_ip_bytes",
    "1700000001.5\tC1\t10.0.0.1\t40000\t10.0.0.2\t443\ttcp\tssl\t1.0\t100\t200\tSF\tShADadFf\t140\t240", "1700000000.5\tC2\t10.0.0.3\t40001\t10.0.0.2\t53\tudp\t-\t-\t10\t20\tSF\tDd\t38\t48",
    "short\trow", "1700000002\tC3\t-\t1\t10.0.0.2\t2\ttcp\t-\t-\t-\t-\t-\t-\t-\t-", "#close",
])


def test_connection_log(spark, tmp_path):
    (tmp_path / "conn.log").write_text(CONN)
    path = str(tmp_path / "conn.log")
    assert negotiation.detect(spark, path) == "zeek_conn"
    rows = Capture.read(spark, path).packets.orderBy("seq_no").collect()
    assert [(r["src_ip"], r["protocol"], r["orig_len"]) for r in rows] == [("10.0.0.3", "DNS", 86), ("10.0.0.1", "TLS", 380)]
    assert rows[1]["tcp_flags_str"].split()[:3] == ["SYN", "SYN", "ACK"] and rows[1]["has_handshake"]
    assert Capture.read(spark, path, load=LoadFilter(port_allow=["443"])).packets.count() == 1


def test_dns_log(spark, tmp_path):
    (tmp_path / "dns.log").write_text("#fields\tts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tquery\tanswers\tTTLs\trcode\tAA\n1\t10.0.0.1\t5\t10.0.0.2\t53\tudp\tX.example\t1.2.3.4,y.example\t60,30\t0\tT\n")
    rows = negotiation.read(spark, str(tmp_path / "dns.log"))
    one = rows.first()
    assert (one["dns_answers"], one["dns_qr"], one["dns_aa"]) == (["1.2.3.4", "y.example"], 1, True)
    assert [tuple(r) for r in detect.dns_names(rows).collect()] == [("1.2.3.4", ["x.example"])]


def test_export_joins_by_frame(spark, tmp_path):
    head = "frame.number\tframe.time_epoch\tip.src\tip.dst\tip.proto\ttcp.srcport\ttcp.dstport\tudp.srcport\tudp.dstport\ttcp.flags\tframe.len\tip.ttl"
    (tmp_path / "m.csv").write_text(head + "\n1\t5.5\t10.0.0.1\t10.0.0.2\t6\t1\t80\t\t\t0x0012\t60\t64\n0\t2\t6.5\t10.0.0.1\t10.0.0.2\t1\t9\t9\t\t\t\t60\t64\n3\t7\t0.0.0.0\t10.0.0.2\t6\t1\t2\t\t\t\t60\t1\n")
    rows = text_logs.export_metadata(text_logs.read_export(spark, str(tmp_path / "m.csv")))
    assert [(r["frame"], r["tcp_flags_str"], r["protocol"], r["dst_port"]) for r in rows.orderBy("seq_no").collect()] == [(1, "SYN ACK", "HTTP", 80), (2, "", "ICMP", 0)]
    more = spark.createDataFrame([("1", "GET"), ("7", "POST")], "frameNumber string, method string")
    assert [(r["method"], r["src_ip"]) for r in text_logs.with_frames(more, rows).collect()] == [("GET", "10.0.0.1")]


def test_negotiation():
    report = negotiation.inspect(["timestamp", "id.orig_h", "id.resp_h", "proto", "odd"], "zeek_conn")
    assert report.missing_required == ("ts",) and report.suggestions == {"ts": "timestamp"} and not report.clean


def test_renamed_parquet(spark, tmp_path):
    path = str(tmp_path / "f.parquet")
    spark.sql("select timestamp'2024-01-01 00:00:01' as timestamp, '10.0.0.1' as src_ip, 5 as src_port, '10.0.0.2' as dst_ip, 22 as dst_port, 'tcp' as transport, 10 as orig_ip_bytes").write.parquet(path)
    one = text_logs.parquet_flows(spark, path).first()
    assert (one["timestamp"], one["protocol"], one["source_type"]) == (1704067201.0, "SSH", "parquet")


def test_pcap_round_trip(spark, tmp_path):
    ip = bytes.fromhex("4500002c000000004006000 0".replace(" ", "")) + bytes([10, 0, 0, 1, 10, 0, 0, 2])
    tcp = struct.pack(">HHIIBBHHH", 1234, 443, 7, 0, 0x50, 0x02, 512, 0, 0) + b"abcd"
    frame = bytes(6) + bytes([2, 0, 0, 0, 0, 1]) + b"\x08\x00" + ip + tcp
    record = struct.pack("<IIII", 1700000000, 500000, len(frame), len(frame)) + frame
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + record + record[:20]
    (tmp_path / "a.pcap").write_bytes(data)
    rows = pcap.read(spark, str(tmp_path / "a.pcap"))
    one = rows.first()
    assert rows.count() == 1
    assert (one["timestamp"], one["src_ip"], one["dst_port"], one["tcp_flags_str"], one["payload_len"]) == (1700000000.5, "10.0.0.1", 443, "SYN", 4)
    (out,) = pcap.slice_bytes(rows.coalesce(1)).collect()
    assert bytes(out["pcap"])[24:] == record
    assert pcap.read(spark, str(tmp_path / "a.pcap"), (0.0, 1.0)).count() == 0


def test_arp_alerts(spark):
    rows = [(float(i), "10.0.0.1", f"m{i % 2}", "10.0.0.1", 2) for i in range(30)]
    df = spark.createDataFrame(rows, "timestamp double, arp_src_ip string, arp_src_mac string, arp_dst_ip string, arp_opcode int")
    found = detect.alerts(detect.arp_spoofing(df), detect.arp_flood(df)).collect()
    assert [(r["severity"], r["subject"], r["evidence"]) for r in found] == [("high", "10.0.0.1", "m0,m1"), ("medium", "m0", "15"), ("medium", "m1", "15")]


def test_session_alerts(spark):
    rows = [("s1", "a", "b", "HTTP", 1.0, ["Curl/8"], ["x", "bad"], ["TLS 1.0", "TLS 1.3"]), ("s2", "c", "b", "HTTP", 2.0, [], [], [])]
    df = spark.createDataFrame(rows, "id string, src_ip string, dst_ip string, protocol string, start_time double, user_agents array<string>, ja3_hashes array<string>, tls_versions array<string>")
    known = spark.createDataFrame([("bad", "Family")], "hash string, name string")
    found = detect.alerts(detect.user_agents(df), detect.empty_user_agents(df), detect.malicious_ja3(df, known), detect.weak_tls(df)).select("kind", "evidence")
    assert [tuple(r) for r in found.collect()] == [("malicious_ja3", "Family bad"), ("deprecated_tls", "TLS 1.0"), ("suspicious_ua", "curl/"), ("empty_ua", "1")]


def test_streaming_buckets(spark, tmp_path):
    from capturelake.streaming import windows

    spark.sql("select timestamp'2024-01-01 00:00:01' ts, 'DNS' protocol, 10L orig_len union all select timestamp'2024-01-01 00:00:16', 'DNS', 5L union all select timestamp'2024-01-01 00:10:00', 'DNS', 5L").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, protocol string, orig_len long").parquet(str(tmp_path / "in"))
    query = windows.buckets(stream).writeStream.outputMode("append").format("memory").queryName("buckets").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r["bytes"] for r in spark.table("buckets").orderBy("start").collect()][:2] == [10, 5]


def test_idle_sessions(spark):
    from capturelake.streaming import windows

    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) ts, 'a' src_ip, 'b' dst_ip, 1 src_port, 2 dst_port, 'UDP' transport, 1L orig_len from values (0), (60), (121) t(s)")
    assert windows.idle_sessions(rows).count() == 2
    assert rows.select(F.count("*")).first()[0] == 3
