"""Session boundaries and metrics on cases made by hand."""

import pytest

from capturelake.operators import sessions as ses

T0 = 1_700_000_000.0
COLUMNS = "seq_no long, timestamp double, src_ip string, dst_ip string, src_port int, dst_port int, transport string, protocol string, orig_len long, ttl int, tcp_flags_str string, seq_num long"


def packet(n, at, flags="ACK", seq=0, back=False, transport="TCP", protocol="TCP"):
    a, b = ("10.0.0.1", 1234), ("10.0.0.2", 443)
    (src, sport), (dst, dport) = (b, a) if back else (a, b)
    return (n, T0 + at, src, dst, sport, dport, transport, protocol, 100, 64, flags, seq)


def generations(spark, *rows):
    found = ses.with_generations(spark.createDataFrame(list(rows), COLUMNS)).collect()
    return [r["generation"] for r in sorted(found, key=lambda r: r["seq_no"])]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([packet(1, 0, "SYN", 1), packet(2, 1, "FIN ACK", 5), packet(3, 2, "SYN", 900)], [0, 0, 1]),  # FIN, then a new connection
        ([packet(1, 0), packet(2, 1, "FIN ACK"), packet(3, 1.1, "FIN ACK", back=True), packet(4, 1.2, "ACK")], [0, 0, 0, 0]),  # teardown
        ([packet(1, 0, "RST"), packet(2, 4.9), packet(3, 5.1)], [0, 0, 1]),  # over the grace period
        ([packet(1, 0), packet(2, 120), packet(3, 240.5)], [0, 0, 1]),  # TCP gap
        ([packet(1, 0, "ACK", 10), packet(2, 4, "ACK", 5_000_000), packet(3, 10, "ACK", 10)], [0, 0, 1]),  # jump needs a pause too
        ([packet(1, 0, "ACK", 2**32 - 10), packet(2, 6, "ACK", 20)], [0, 0]),  # wraps
        ([packet(1, 0, "SYN ACK", 50, True), packet(2, 1, "FIN"), packet(3, 2, "SYN ACK", 50, True), packet(4, 3, "SYN ACK", 77, True)], [0, 0, 0, 1]),  # other responder number
        ([packet(1, 0, "", transport="UDP"), packet(2, 60, "", transport="UDP"), packet(3, 120.1, "", transport="UDP")], [0, 0, 1]),
    ],
)
def test_boundaries(spark, rows, want):
    assert generations(spark, *rows) == want


def test_metrics_follow_the_running_initiator(spark):
    rows = [packet(1, 0, "ACK", 1, back=True), packet(2, 1, "SYN", 2), packet(3, 2, "SYN ACK", 3, back=True, protocol="TLS"), packet(4, 3, "ACK", 4)]
    (one,) = ses.sessions(ses.with_generations(spark.createDataFrame(rows, COLUMNS))).collect()
    assert (one["src_ip"], one["dst_ip"], one["protocol"]) == ("10.0.0.1", "10.0.0.2", "TLS")
    assert (one["fwd_packets"], one["rev_packets"]) == (3, 1)  # the first packet's sender counted as the initiator then
    assert one["has_handshake"] and not one["has_fin"] and one["duration"] == 3.0


def test_empty(spark):
    assert ses.sessions(ses.with_generations(spark.createDataFrame([], COLUMNS))).count() == 0


@pytest.mark.parametrize(
    ("column", "rows", "want"),
    [
        ("dns_query string", [(0, "a"), (9, "b"), (19.5, "c"), (25, None), (29, "d")], [0, 0, 1, 1, 1]),
        ("http_host string", [(0, "a"), (30, "b"), (60.5, "c"), (85, "")], [0, 0, 1, 1]),
        ("dhcp_xid long", [(0, 7), (1, 7), (2, 8), (13, 8), (14, 7)], [0, 0, 1, 2, 3]),
    ],
)
@pytest.mark.parametrize("transport", ["UDP", "TCP"])
def test_protocol_boundaries(spark, column, rows, want, transport):
    data = [(*packet(n, at, "ACK", 1, transport=transport), value) for n, (at, value) in enumerate(rows)]
    found = ses.with_generations(spark.createDataFrame(data, f"{COLUMNS}, {column}")).collect()
    assert [r["generation"] for r in sorted(found, key=lambda r: r["seq_no"])] == want


def test_window_and_acknowledgement_columns(spark):
    data = [(*packet(n, n, "ACK", 1, back=n % 2 == 1), size, ack) for n, (size, ack) in enumerate([(100, 0), (50, 7), (300, 9), (0, 11)])]
    (one,) = ses.sessions(ses.with_generations(spark.createDataFrame(data, f"{COLUMNS}, window_size int, ack_num long"))).collect()
    assert (one["fwd_window_min"], one["fwd_window_max"], one["fwd_window_avg"]) == (100, 300, 200.0)
    assert (one["rev_window_min"], one["rev_window_max"], one["ack_first"], one["ack_last"]) == (50, 50, 7, 11)


def test_capture_runs_every_detector_it_has_columns_for(spark):
    from capturelake.capture import Capture

    data = [(*packet(n, n / 10, "ACK", 1, protocol="HTTP"), "sqlmap/1.0", "TLS 1.0", "bad", "10.0.0.1", f"m{n % 2}", "10.0.0.1", 2) for n in range(40)]
    columns = f"{COLUMNS}, http_user_agent string, tls_selected_version string, ja3 string, arp_src_ip string, arp_src_mac string, arp_dst_ip string, arp_opcode int"
    rows = Capture(spark.createDataFrame(data, columns)).alerts(spark.createDataFrame([("bad", "family")], "hash string, name string")).collect()
    assert {(r["severity"], r["kind"]) for r in rows} == {("critical", "malicious_ja3"), ("high", "arp_spoofing"), ("medium", "gratuitous_arp"), ("medium", "deprecated_tls"), ("medium", "suspicious_ua")}
    assert [r["severity"] for r in rows][:2] == ["critical", "high"]
    plain = Capture(spark.createDataFrame([packet(1, 0)], COLUMNS)).alerts().collect()
    assert plain == []


def test_sessions_of_analysis_edges(spark):
    found = spark.createDataFrame(
        [("s1", "b", "a", "HTTP", "TCP"), ("s2", "a", "b", "DNS", "UDP"), ("s3", "a", "b", "SSH", "TCP"), ("s4", "a", "c", "HTTP", "TCP"), ("s5", "a", "b", None, "TCP")],
        "id string, src_ip string, dst_ip string, protocol string, transport string",
    )
    edges = spark.createDataFrame([("a", "b", ["HTTP", "TCP"]), ("a", "d", ["HTTP"]), ("a", "c", [])], "a string, b string, protocols array<string>")
    assert sorted(map(tuple, ses.of_analysis_edges(found, edges).collect())) == [("a|b", "s1"), ("a|b", "s3"), ("a|b", "s5")]
