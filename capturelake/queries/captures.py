"""Queries over capture files and payload bytes. Payloads are made of packets' fields, alike in Spark and in the checking SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capturelake import scratch
from capturelake.functions import net, signatures, tls
from capturelake.queries.registry import Registry
from capturelake.sources import pcap
from capturelake.sources.capture_view import packets

R = Registry()
#: Bytes of a range in the queries, so that every table's files have several.
RANGE = 1 << 18
ENDS = ("src_ip", "dst_ip")
#: Columns of packets that the queries over capture files use.
READ = [*ENDS, "src_port", "dst_port", "transport", "orig_len", "ttl", "timestamp", "tcp_flags_str", "seq_num", "payload"]
INSIDE = net.block_range("10.0.0.0/8")


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def hello(seq: Column) -> Column:
    """A TLS client's first message whose version, ciphers, extensions, curves, protocol and server name follow from a number."""
    name = F.hex(F.encode(F.concat(F.lit("host"), (seq % 7).cast("string"), F.lit(".test")), "UTF-8"))
    size = F.length(name) / 2
    server = F.when(seq % 3 == 0, "").otherwise(F.concat(F.lit("0000"), _hex((size + 5).cast("int"), 4), _hex((size + 3).cast("int"), 4), F.lit("00"), _hex(size.cast("int"), 4), name))
    ciphers = F.concat(F.lit("0A0A1301"), _hex(F.lit(0xC02B) + seq % 5, 4), F.when(seq % 2 == 0, "009C").otherwise(""))
    extensions = F.concat(
        F.lit("2A2A0000"), server, F.lit("000A000800063A3A001D0017"), F.lit("000B00020100"),
        F.when(seq % 4 == 0, "").otherwise("0010000B000908687474702F312E31"), F.when(seq % 5 == 0, "").otherwise("002B0005041A1A0304"),
    )
    counted = lambda text, digits=4: signatures.once(text, lambda t: F.concat(_hex((F.length(t) / 2).cast("int"), digits), t))
    body = F.concat(F.lit("0303"), F.repeat(F.lit("AB"), 32), F.lit("00"), counted(ciphers), F.lit("0100"), counted(extensions))
    message = F.concat(F.lit("01"), counted(body, 6))
    return F.unhex(F.concat(F.lit("160301"), counted(message)))


def with_payloads(s, d):
    """Packets with a payload by their type: TLS, HTTP, SSH and names by their ports, one in nine HTTP wherever it goes, one in ten none, one in
    thirteen that says nothing, one in 17 cut off after 60 bytes."""
    seq = F.col("seq_no")
    usual = F.when(F.col("protocol") == "HTTPS", hello(seq)).when(F.col("protocol") == "HTTP", F.encode(F.lit("GET /a HTTP/1.1\r\n\r\n"), "UTF-8")).when(
        F.col("protocol") == "SSH", F.encode(F.lit("SSH-2.0-x\r\n"), "UTF-8")
    ).when(F.col("protocol") == "DNS", F.unhex(F.lit("123401000001000000000000"))).otherwise(F.unhex(F.lit("00000010FE534D4240000100")))
    made = F.when(seq % 10 == 0, F.unhex(F.lit(""))).when(seq % 13 == 0, F.unhex(F.lit("FFFFFFFFFFFF"))).when(seq % 9 == 0, F.encode(F.lit("HTTP/1.1 200 OK\r\n"), "UTF-8")).otherwise(usual)
    return packets(s, d).withColumn("payload", F.when(seq % 17 == 0, F.substring(made, 1, 60)).otherwise(made))


SEEN = """SELECT *, CASE WHEN seq_no % 10 = 0 THEN NULL WHEN seq_no % 13 = 0 THEN 'QUIC' WHEN seq_no % 9 = 0 THEN 'HTTP'
  ELSE CASE protocol WHEN 'HTTPS' THEN 'TLS' WHEN 'HTTP' THEN 'HTTP' WHEN 'SSH' THEN 'SSH' WHEN 'SMB' THEN 'SMB' END END AS seen, seq_no % 10 <> 0 AS has FROM packets"""
FAMILY = "(seen = protocol OR (seen = 'TLS' AND protocol = 'HTTPS'))"
R.add("x08_payload_signature", lambda s, d: with_payloads(s, d).select("seq_no", signatures.by_payload(F.col("payload")).alias("by_payload")),
      f"SELECT seq_no, seen AS by_payload FROM ({SEEN})")
R.add("x09_confidence", lambda s, d: with_payloads(s, d).select("seq_no", signatures.classified(F.col("payload")).alias("c")).select("seq_no", "c.*"),
      f"""SELECT seq_no, CASE WHEN seen IS NOT NULL AND NOT {FAMILY} THEN seen ELSE protocol END AS protocol, CASE WHEN has THEN protocol ELSE '' END AS by_port, coalesce(seen, '') AS by_payload,
      CASE WHEN NOT has THEN '' WHEN seen IS NULL THEN 'port' WHEN {FAMILY} THEN 'port+payload' ELSE 'payload' END AS confidence, coalesce(NOT {FAMILY}, false) AS conflict FROM ({SEEN})""")  # fmt: skip

HELLO = """SELECT seq_no, CASE WHEN seq_no % 3 <> 0 THEN 'host' || seq_no % 7 || '.test' END AS sni,
  '4865-' || (49195 + seq_no % 5) || CASE WHEN seq_no % 2 = 0 THEN '-156' ELSE '' END AS ciphers,
  '009c'[1:CASE WHEN seq_no % 2 = 0 THEN 4 ELSE 0 END] AS even, printf('%04x', 49195 + seq_no % 5) AS own,
  CASE WHEN seq_no % 3 = 0 THEN '' ELSE '0-' END || '10-11' || CASE WHEN seq_no % 4 = 0 THEN '' ELSE '-16' END || CASE WHEN seq_no % 5 = 0 THEN '' ELSE '-43' END AS extensions,
  CASE WHEN seq_no % 5 = 0 THEN '000a,000b' ELSE '000a,000b,002b' END AS others
  FROM packets WHERE protocol = 'HTTPS' AND seq_no % 10 <> 0 AND seq_no % 13 <> 0 AND seq_no % 9 <> 0 AND seq_no % 17 <> 0"""
PRINTS = f"""SELECT seq_no, sni, '771,' || ciphers || ',' || extensions || ',29-23,0' AS ja3_string,
  CASE WHEN sni IS NULL THEN 'ti' ELSE 'td' END || CASE WHEN seq_no % 5 = 0 THEN '12' ELSE '13' END || CASE WHEN seq_no % 2 = 0 THEN '03' ELSE '02' END
  || lpad(CAST(len(string_split(extensions, '-')) AS VARCHAR), 2, '0') || CASE WHEN seq_no % 4 = 0 THEN '00' ELSE 'ht' END
  || '_' || substr(sha256(CASE WHEN even = '' THEN '' ELSE even || ',' END || '1301,' || own), 1, 12) || '_' || substr(sha256(others), 1, 12) AS ja4 FROM ({HELLO})"""
R.add("x20_fingerprints", lambda s, d: with_payloads(s, d).select("seq_no", tls.fingerprints(F.col("payload")).alias("f")).where("f is not null").select("seq_no", "f.*"),
      f"SELECT seq_no, md5(ja3_string) AS ja3, ja3_string, ja4, sni FROM ({PRINTS})")


def _framed(ip: Column) -> Column:
    """The capture view's hosts 10.0.N.n as addresses of a frame: N over 255 goes on in the number before it."""
    over = F.raise_error(F.lit("a frame has no address for the hosts over 10.0.65535"))
    return signatures.once(net.ip_number(ip, carry=True), lambda number: F.when(ip.startswith("10.") & (number > INSIDE[1]), over).otherwise(net.ip_text(number)))


def _named(ip: Column) -> Column:
    """The host of an address that :func:`_framed` made."""
    text = lambda place: F.concat(F.lit("10.0."), F.shiftright(place, 8).cast("string"), F.lit("."), (place % 256).cast("string"))
    return signatures.once(net.ip_number(ip), lambda number: F.when(number.between(*INSIDE), text(number - INSIDE[0])).otherwise(ip))


def _read_back(s, d, form: str, **options):
    """The capture as files of one format, and its packets read back from byte ranges."""
    folder = scratch.fresh(s, f"capture-{form}")
    framed = with_payloads(s, d).withColumns({c: _framed(F.col(c)) for c in ENDS})
    paths = pcap.write(pcap.with_frames(framed), folder, form)
    return pcap.read(s, paths, range_bytes=RANGE, columns=READ, **options).withColumns({c: _named(F.col(c)) for c in ENDS})


def _flows(rows):
    found = rows.withColumns({"c": signatures.classified(F.col("payload")), "f": tls.fingerprints(F.col("payload"))})
    return found.groupBy("src_ip", "dst_ip", "src_port", "dst_port", "transport", F.col("c.protocol").alias("protocol")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("orig_len").alias("bytes"), F.min("ttl").alias("ttl"), F.sum(F.floor("timestamp")).alias("seconds"), F.max("tcp_flags_str").alias("flags"),
        F.sum("seq_num").alias("seqs"), F.count_distinct("f.ja3").alias("clients"), F.count("f.sni").alias("named"),
    )


FLOWS = f"""WITH p AS (SELECT q.*, round(timestamp * 1000000) / 1000000 AS t, f.ja3_string, f.sni, CASE WHEN seen IS NOT NULL AND NOT {FAMILY} THEN seen ELSE protocol END AS found
  FROM ({SEEN}) q LEFT JOIN ({PRINTS}) f ON f.seq_no = q.seq_no)
SELECT src_ip, dst_ip, src_port, dst_port, transport, found AS protocol, count(*) AS packets, CAST(sum(orig_len) AS BIGINT) AS bytes, min(ttl) AS ttl, CAST(sum(CAST(floor(t) AS BIGINT)) AS BIGINT) AS seconds,
  max(tcp_flags_str) AS flags, CAST(sum(CASE WHEN transport = 'TCP' THEN seq_num % 4294967296 ELSE 0 END) AS BIGINT) AS seqs, count(DISTINCT ja3_string) AS clients, count(sni) AS named FROM p """
GROUPED = " GROUP BY 1, 2, 3, 4, 5, 6"
R.add("s14_capture_ranges", lambda s, d: _flows(_read_back(s, d, "pcap")), FLOWS + GROUPED)
R.add("s16_block_ranges", lambda s, d: _flows(_read_back(s, d, "pcapng")), FLOWS + GROUPED)
LO, HI = 1700000050.0, 1700000100.0
R.add("s14_time_pushdown", lambda s, d: _flows(_read_back(s, d, "pcap", time_range=(LO, HI))), FLOWS + f"WHERE t BETWEEN {LO} AND {HI}" + GROUPED)
