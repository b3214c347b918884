"""Packet capture files: decoding to packet rows on the executors, and writing them back."""

from __future__ import annotations

import ipaddress
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.functions.net import FLAG_BITS
from capturelake.sources import capture_files

SCHEMA = "timestamp double, src_mac string, dst_mac string, src_ip string, dst_ip string, ip_version int, ttl int, src_port int, dst_port int, transport string, tcp_flags_str string, seq_num long, ack_num long, window_size int, orig_len long, payload_len long, payload binary, link int, raw binary"
#: Link types that are decoded.
ETHERNET, RAW_IP, COOKED = 1, (12, 101), 113
def _link_layer(frame: bytes, link: int) -> tuple[dict, int, int] | None:
    """(addresses, type of what follows, its place) by the link type; None for other types and cut headers."""
    mac = lambda b: ":".join(f"{x:02x}" for x in b)
    if link == ETHERNET and len(frame) >= 14:
        return {"dst_mac": mac(frame[:6]), "src_mac": mac(frame[6:12])}, int.from_bytes(frame[12:14]), 14
    if link in RAW_IP and frame:
        return {}, {4: 0x0800, 6: 0x86DD}.get(frame[0] >> 4, 0), 0
    if link == COOKED and len(frame) >= 16:
        return {"src_mac": mac(frame[6:12])}, int.from_bytes(frame[14:16]), 16
    return None


def decode(frame: bytes, link: int = 1) -> dict | None:
    """Ethernet, cooked or raw frames with VLAN tags, IPv4 or IPv6, TCP, UDP or ICMP; None for other frames."""
    if (found := _link_layer(frame, link)) is None:
        return None
    addresses, kind, at = found
    row = addresses | {"src_port": 0, "dst_port": 0, "tcp_flags_str": "", "seq_num": 0, "ack_num": 0, "window_size": 0}
    while kind in (0x8100, 0x88A8) and len(frame) >= at + 4:
        kind, at = int.from_bytes(frame[at + 2 : at + 4]), at + 4
    if kind == 0x0800 and len(frame) >= at + 20:
        head = (frame[at] & 15) * 4
        row |= {"ip_version": 4, "ttl": frame[at + 8], "src_ip": str(ipaddress.IPv4Address(frame[at + 12 : at + 16])), "dst_ip": str(ipaddress.IPv4Address(frame[at + 16 : at + 20]))}
        proto, end = frame[at + 9], min(len(frame), at + int.from_bytes(frame[at + 2 : at + 4]))
    elif kind == 0x86DD and len(frame) >= at + 40:
        head = 40
        row |= {"ip_version": 6, "ttl": frame[at + 7], "src_ip": str(ipaddress.IPv6Address(frame[at + 8 : at + 24])), "dst_ip": str(ipaddress.IPv6Address(frame[at + 24 : at + 40]))}
        proto, end = frame[at + 6], min(len(frame), at + 40 + int.from_bytes(frame[at + 4 : at + 6]))
    else:
        return None
    at += head
    row["transport"] = {6: "TCP", 17: "UDP", 1: "ICMP", 58: "ICMP"}.get(proto, "")
    if proto == 6 and end >= at + 20:
        s, d, seq, ack = struct.unpack_from(">HHII", frame, at)
        mask = frame[at + 13]
        row |= {"src_port": s, "dst_port": d, "seq_num": seq, "ack_num": ack, "window_size": int.from_bytes(frame[at + 14 : at + 16]), "tcp_flags_str": " ".join(n for b, n in FLAG_BITS if mask & b)}
        at += (frame[at + 12] >> 4) * 4
    elif proto == 17 and end >= at + 8:
        row["src_port"], row["dst_port"] = struct.unpack_from(">HH", frame, at)
        at += 8
    row["payload_len"], row["payload"] = max(0, end - at), frame[at:end]
    return row


def _texts(codes: np.ndarray, text) -> pa.Array:
    """``text`` of each number, made once for each that occurs."""
    found, at = np.unique(codes, return_inverse=True)
    return pa.DictionaryArray.from_arrays(pa.array(at, pa.int32()), pa.array(map(text, found.tolist()), pa.string())).cast(pa.string())


def _numbers(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Big-endian numbers of n bytes at the places."""
    out = data[at].astype(np.int64)
    for k in range(1, n):
        out = out << 8 | data[at + k]
    return out


def is_plain(frame: bytes, link: int) -> bool:
    """An Ethernet frame without tags with the fixed part of an IPv4 header: nearly all there are."""
    return link == ETHERNET and frame[12:14] == b"\x08\x00" and len(frame) >= 34


def decode_plain(frames: list[bytes], names: list[str]) -> dict[str, pa.Array]:
    """Columns ``names`` of :func:`decode` for frames that :func:`is_plain` takes, all at once."""
    size = np.fromiter(map(len, frames), np.int64, len(frames))
    # bytes past the last frame are read, but never used
    data = np.frombuffer(b"".join(frames) + bytes(64), np.uint8)
    start = np.cumsum(size) - size
    head, proto = (data[start + 14] & 15).astype(np.int64) * 4, data[start + 23]
    end, at = np.minimum(size, 14 + _numbers(data, start + 16, 2)), 14 + head
    tcp, udp = (proto == 6) & (end >= at + 20), (proto == 17) & (end >= at + 8)
    inside = start + np.where(tcp | udp, at, 0)
    body = at + np.where(tcp, (data[np.where(tcp, inside + 12, 0)] >> 4).astype(np.int64) * 4, np.where(udp, 8, 0))
    field = lambda known, place, n: np.where(known, _numbers(data, np.where(known, inside + place, 0), n), 0)
    mac = lambda code: ":".join(f"{b:02x}" for b in code.to_bytes(6))
    address = lambda code: str(ipaddress.IPv4Address(code))
    columns = {
        "dst_mac": lambda: _texts(_numbers(data, start, 6), mac), "src_mac": lambda: _texts(_numbers(data, start + 6, 6), mac),
        "src_ip": lambda: _texts(_numbers(data, start + 26, 4), address), "dst_ip": lambda: _texts(_numbers(data, start + 30, 4), address),
        "ip_version": lambda: np.full(len(frames), 4), "ttl": lambda: data[start + 22], "src_port": lambda: field(tcp | udp, 0, 2), "dst_port": lambda: field(tcp | udp, 2, 2),
        "transport": lambda: _texts(proto, lambda code: {6: "TCP", 17: "UDP", 1: "ICMP", 58: "ICMP"}.get(code, "")),
        "tcp_flags_str": lambda: _texts(field(tcp, 13, 1), lambda mask: " ".join(n for b, n in FLAG_BITS if mask & b)),
        "seq_num": lambda: field(tcp, 4, 4), "ack_num": lambda: field(tcp, 8, 4), "window_size": lambda: field(tcp, 14, 2), "payload_len": lambda: np.maximum(0, end - body),
        "payload": lambda: pa.array([f[a:b] for f, a, b in zip(frames, body.tolist(), end.tolist())], pa.binary()),
    }
    return {name: columns[name]() for name in names if name in columns}


def read(spark: SparkSession, path: str | list[str], time_range: tuple[float, float] | None = None, range_bytes: int = capture_files.RANGE, counter=None, columns: list[str] | None = None) -> DataFrame:
    """Packets of all capture files at ``path``, of either format, read in byte ranges by as many tasks.

    ``seq_no`` is a packet's place among all records, files by name, so it does not depend on ranges or the time range. Ranges and packets outside the
    time range aren't decoded (``counter``, an accumulator, counts those that are). Frames of other kinds have no row. ``columns``: those that are
    made, all without it.
    """
    schema = ", ".join(c for c in f"seq_no long, {SCHEMA}".split(", ") if columns is None or c.split()[0] in columns)
    kinds = capture_files.arrow_schema(schema)
    names = kinds.names

    def together(rows: list[tuple]) -> pa.RecordBatch:
        number, time, length, link, frames = zip(*rows, strict=True)
        own = {"seq_no": number, "timestamp": time, "orig_len": length, "link": link, "raw": frames}
        made = own | decode_plain(frames, names)
        return pa.RecordBatch.from_arrays([made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], kinds.field(n).type) for n in names], schema=kinds)

    def one_by_one(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for number, time, length, link, frame in rows:
            if (row := decode(frame, link)) is not None:
                out.append(row | {"seq_no": number, "timestamp": time, "orig_len": length, "link": link, "raw": frame})
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], kinds.field(n).type) for n in names], schema=kinds)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        plain = [r for r in rows if is_plain(r[4], r[3])]
        if len(plain) == len(rows):
            return together(rows)
        others = one_by_one([r for r in rows if not is_plain(r[4], r[3])])
        return pa.concat_batches([together(plain), others]) if plain else others

    return capture_files.records(capture_files.index(spark, path, range_bytes), time_range, emit, schema, counter)


#: Layout of the frames that :func:`with_frames` makes.
_EMPTY_MAC = bytes([2, 0, 0, 0, 0, 1])


def frame_of(src_ip: str, dst_ip: str, src_port: int, dst_port: int, transport: str, ttl: int, flags: str, seq: int, payload: bytes = b"") -> bytes:
    """An Ethernet frame of an IPv4 packet with these fields, checksums left 0."""
    return frames_of(*[[v] for v in (src_ip, dst_ip, src_port, dst_port, transport, ttl, flags, seq, payload)])[0]


def frames_of(sources: list, targets: list, src_ports: list, dst_ports: list, transports: list, ttls: list, flag_texts: list, numbers: list, payloads: list) -> list[bytes]:
    """:func:`frame_of` of each row of these columns; addresses and flags are read once for each that occurs."""
    address = {ip: ipaddress.IPv4Address(ip).packed for ip in {*sources, *targets}}
    masks = {flags: sum(b for b, n in FLAG_BITS if n in flags.split()) for flags in {f for f, t in zip(flag_texts, transports) if t == "TCP"}}
    tcp, udp, ip = struct.Struct(">HHIIBBHHH"), struct.Struct(">HHHH"), struct.Struct(">BBHHHBBH")
    start = _EMPTY_MAC + _EMPTY_MAC + b"\x08\x00"
    out = []
    for src, dst, src_port, dst_port, transport, ttl, flags, seq, payload in zip(sources, targets, src_ports, dst_ports, transports, ttls, flag_texts, numbers, payloads, strict=True):
        if transport == "TCP":
            head, proto = tcp.pack(src_port, dst_port, seq & 0xFFFFFFFF, 0, 0x50, masks[flags], 0, 0, 0), 6
        else:
            head, proto = udp.pack(src_port, dst_port, 8 + len(payload), 0), 17
        out.append(b"".join((start, ip.pack(0x45, 0, 20 + len(head) + len(payload), 0, 0, ttl, proto, 0), address[src], address[dst], head, payload)))
    return out


def _listed(column: pa.Array) -> list:
    """The values as Python's, which by way of numpy takes a tenth of the time; nulls would become other values there."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def with_frames(packets: DataFrame) -> DataFrame:
    """(timestamp, orig_len, raw): packets without raw bytes as frames that have their fields, and ``payload`` where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = frames_of(*[_listed(c) for c in batch.columns[2:]])
            yield pa.RecordBatch.from_arrays([batch["timestamp"], batch["orig_len"], pa.array(raw, pa.binary())], names=["timestamp", "orig_len", "raw"])

    payload = F.col("payload") if "payload" in packets.columns else F.lit(b"")
    fields = ["src_ip", "dst_ip", "src_port", "dst_port", "transport", "ttl", "tcp_flags_str", "seq_num"]
    return packets.select("timestamp", "orig_len", *fields, payload.alias("payload")).mapInArrow(run, "timestamp double, orig_len long, raw binary")


def _pcap_head() -> bytes:
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1)


def _pcap_record(time: float, length: int, frame: bytes) -> bytes:
    micros = round(time * 1e6)
    return struct.pack("<IIII", micros // 1_000_000, micros % 1_000_000, len(frame), length) + frame


def _block(kind: int, body: bytes) -> bytes:
    size = 12 + len(body)
    return struct.pack("<II", kind, size) + body + struct.pack("<I", size)


def _blocks_head() -> bytes:
    section = struct.pack("<IHHq", capture_files.MARK, 1, 0, -1)
    return _block(capture_files.SECTION, section) + _block(capture_files.INTERFACE, struct.pack("<HHI", 1, 0, 262144))


def _blocks_record(time: float, length: int, frame: bytes) -> bytes:
    micros = round(time * 1e6)
    return _block(capture_files.PACKET, struct.pack("<IIIII", 0, micros >> 32, micros & 0xFFFFFFFF, len(frame), length) + frame + bytes(-len(frame) % 4))


FORMATS = {"pcap": (_pcap_head, _pcap_record), "pcapng": (_blocks_head, _blocks_record)}


def write(packets: DataFrame, folder: str, form: str = "pcap") -> list[str]:
    """Writes (timestamp, orig_len, raw) as capture files, one a partition, packet by packet, so files of any size; returns their paths.

    Each attempt of a task writes a file of its own; only files of attempts that Spark took are returned. Remove the
    others, if tasks were lost, with the folder.
    """
    head, record = FORMATS[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{folder}/part-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.{form}"
        count = 0
        with capture_files.created(name) as out:
            out.write(head())
            for batch in batches:
                rows = zip(_listed(batch["timestamp"]), _listed(batch["orig_len"]), _listed(batch["raw"]), strict=True)
                out.write(b"".join(record(*r) for r in rows))
                count += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["path", "n"])

    done = packets.select("timestamp", "orig_len", "raw").mapInArrow(run, "path string, n long").collect()
    return sorted(r["path"] for r in done)


def slice_bytes(packets: DataFrame) -> DataFrame:
    """(part, pcap): the packets' raw frames as pcap files, one a partition of up to 2 GB; :func:`write` makes files without that limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        out = [_pcap_head()]
        for pdf in batches:
            for t, length, frame in zip(pdf["timestamp"], pdf["orig_len"], pdf["raw"]):
                out.append(_pcap_record(t, length, frame))
        if len(out) > 1:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "pcap": [b"".join(out)]})

    return packets.select("timestamp", "orig_len", "raw").mapInPandas(run, "part int, pcap binary")
