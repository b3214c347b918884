"""Payload signatures in their priority, agreement with ports, and fingerprints of TLS clients by published vectors."""

import struct

import pytest
from pyspark.sql import functions as F

from capturelake.functions import signatures, tls


def dhcp(op):
    return bytes([op]) + bytes(235) + bytes.fromhex("63825363")


SEEN = [
    (b"\x16\x03\x01\x00\x05x", "TLS"), (b"\x16\x05\x00\x00\x00\x00", "TLS"), (b"\x16\x03\x01\x00\x05", None), (b"\x16\x03\x09abc", "TLS"),
    (bytes.fromhex("05000b0310000000480000000100000000"), "DCE/RPC"), (bytes.fromhex("05000b03000000000048000001000000"), "DCE/RPC"), (bytes.fromhex("05000b03100000000f00000001000000"), None),
    (bytes.fromhex("05000b1410000000480000000100000000"), "DCE/RPC"), (bytes.fromhex("0500140310000000480000000100000000"), None),
    (bytes.fromhex("c000000001ff"), "QUIC"), (bytes.fromhex("8000000000"), "QUIC"), (bytes.fromhex("c0ff00001d"), "QUIC"), (bytes.fromhex("c06b3343cf"), "QUIC"), (bytes.fromhex("4000000001"), None), (bytes.fromhex("c012345678"), None),
    (b"GET / HTTP/1.1", "HTTP"), (b"OPTIONS *", "HTTP"), (b"get / x", None), (b"HTTP/1.1 200", "HTTP"), (b"CONNECT x", "HTTP"),
    (b"\xffSMBxxxx", "SMB"), (b"abcd\xfeSMB", "SMB"), (b"\xfeSMB", None),
    (b"\x6a\x01\x02\x03", "Kerberos"), (b"\x7e\x01\x02\x03", "Kerberos"), (b"\x77\x01\x02\x03", None),
    (dhcp(1), "DHCP"), (dhcp(2), "DHCP"), (dhcp(3), None), (dhcp(1)[:-1], None), (b"SSH-2.0-x", "SSH"),
    (bytes.fromhex("300c020101600702010304008000"), "LDAP"), (bytes.fromhex("3084000000050201076300"), "LDAP"), (bytes.fromhex("300c0201015f070201030400"), None), (bytes.fromhex("3000020101600700"), None), (bytes.fromhex("300c0202010160070201"), "LDAP"),
    (b"220 mail ESMTP ready\r\n", "SMTP"), (b"220 files ftp\r\n", "FTP"), (b"220 x\r\nFTP", None), (b"220 ftp and smtp", "SMTP"), (b"abc", None), (b"", None), (None, None), (b"\x00" * 400, None),
]


def test_signatures(spark):
    rows = [(i, None if p is None else bytearray(p)) for i, (p, _) in enumerate(SEEN)]
    df = spark.createDataFrame(rows, "i int, payload binary").select("i", signatures.by_payload(F.col("payload")).alias("p"))
    got = {r["i"]: r["p"] for r in df.collect()}
    assert [(SEEN[i][0], got[i]) for i in range(len(SEEN))] == SEEN


@pytest.mark.parametrize(
    ("transport", "port", "payload", "want"),
    [
        ("TCP", 443, b"\x16\x03\x01\x00\x05x", ("HTTPS", "HTTPS", "TLS", "port+payload", False)),
        ("TCP", 80, b"GET / HTTP", ("HTTP", "HTTP", "HTTP", "port+payload", False)),
        ("TCP", 22, b"GET / HTTP", ("HTTP", "SSH", "HTTP", "payload", True)),
        ("TCP", 9, b"SSH-2.0", ("SSH", "", "SSH", "payload", False)),
        ("UDP", 53, b"\x00\x01\x01\x00\x00", ("DNS", "DNS", "", "port", False)),
        ("UDP", 9, b"\x00\x01\x01\x00\x00", ("UDP", "", "", "", False)),
        ("TCP", 443, b"", ("HTTPS", "", "", "", False)),
        ("TCP", 443, None, ("HTTPS", "", "", "", False)),
    ],
)
def test_confidence(spark, transport, port, payload, want):
    df = spark.createDataFrame([(transport, 50000, port, payload)], "transport string, src_port int, dst_port int, payload binary")
    assert tuple(df.select(signatures.classified(F.col("payload")).alias("c")).first()["c"]) == want


def extension(kind, body):
    return struct.pack(">HH", kind, len(body)) + body


def hello(version, ciphers, extensions=None):
    two = lambda values: b"".join(struct.pack(">H", v) for v in values)
    body = struct.pack(">H", version) + bytes(32) + b"\x03abc" + struct.pack(">H", 2 * len(ciphers)) + two(ciphers) + b"\x01\x00"
    if extensions is not None:
        joined = b"".join(extensions)
        body += struct.pack(">H", len(joined)) + joined
    message = b"\x01" + len(body).to_bytes(3) + body
    return b"\x16\x03\x01" + struct.pack(">H", len(message)) + message


CURVES = extension(10, struct.pack(">HHHHH", 8, 23, 0x2A2A, 24, 25))
POINTS = extension(11, b"\x01\x00")
NAME = extension(0, struct.pack(">HBH", 14, 0, 11) + b"example.com")
FIRST = hello(769, [47, 53, 5, 10, 49161, 49162, 49171, 49172, 50, 56, 19, 4], [NAME, extension(0x4A4A, b""), CURVES, POINTS])
SECOND = hello(769, [4, 5, 10, 9, 100, 98, 3, 6, 19, 18, 99])


def test_published_vectors():
    import hashlib

    for data, text, digest in (
        (FIRST, "769,47-53-5-10-49161-49162-49171-49172-50-56-19-4,0-10-11,23-24-25,0", "ada70206e40642a3e4461f35503241d5"),
        (SECOND, "769,4-5-10-9-100-98-3-6-19-18-99,,,", "de350869b8c85de67a350c8d186f11e6"),
    ):
        assert tls._described(tls.client_hello(data))["ja3_string"] == text
        assert hashlib.md5(text.encode()).hexdigest() == digest


def test_fingerprints(spark):
    versions = extension(43, b"\x06" + struct.pack(">HHH", 0x7A7A, 0x0304, 0x0303))
    third = hello(0x0303, [0x0A0A, 0x1301, 0xC02B], [versions, extension(16, b"\x00\x03\x02h2"), NAME])
    cut = [FIRST[:n] for n in range(0, len(FIRST), 7)]
    rows = [(0, FIRST), (1, SECOND), (2, third), (3, None), (4, b"GET / HTTP/1.1"), (5, FIRST + b"more")] + [(10 + i, c) for i, c in enumerate(cut)]
    df = spark.createDataFrame(rows, "i int, p binary").select("i", tls.fingerprints(F.col("p")).alias("f")).select("i", "f.*")
    got = {r["i"]: r for r in df.collect()}
    assert (got[0]["ja3"], got[0]["sni"]) == ("ada70206e40642a3e4461f35503241d5", "example.com") and got[5]["ja3"] == got[0]["ja3"]
    assert (got[1]["ja3"], got[1]["sni"], got[1]["ja4"][:10]) == ("de350869b8c85de67a350c8d186f11e6", None, "ti10110000")
    assert got[2]["ja4"].startswith("td130203h2_") and got[2]["ja3_string"] == "771,4865-49195,43-16-0,,"
    assert all(got[i]["ja3"] is None for i in got if i in (3, 4) or i >= 10)
