"""MPEG audio as media columns: storing bytes in frames, and scanning streams of frames."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import documents

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version 1?, layer) and Hz by version.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

#: Payload bytes that a stored frame carries.
UNIT = 192
#: MPEG-1 layer III, checksum, 48 kbit/s, 32 kHz, mono: frames of 216 bytes and exactly 36 ms.
STORED_HEADER = bytes((0xFF, 0xFA, 0x38, 0xC4))
SIDE = 17


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    checked: bool
    kbits: int
    hertz: int
    channels: int
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        return (32, 17)[self.channels == 1] if self.version == 3 else (17, 9)[self.channels == 1]


@lru_cache(4096)
def parse_header(four: bytes) -> Header | None:
    """The frame header in four bytes; None if they are none (or free format, whose length they don't tell)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hertz = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    kbits, hz, pad = KBITS[version == 3, layer][rate], HERTZ[version][hertz], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    slot = 4 if layer == 1 else 1
    length = (samples // 8 // slot * kbits * 1000 // hz + pad) * slot
    return Header(version, layer, not four[1] & 1, kbits, hz, 1 if four[3] >> 6 == 3 else 2, length, samples)


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """The checksum of protected frames: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = crc << 1 ^ (0x8005 if crc & 0x8000 else 0)
        crc &= 0xFFFF
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


@dataclass
class Scan:
    """What a stream holds. ``offsets``: of each audio frame from the start; the tag frame isn't one."""

    header: Header | None = None
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    checked: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    id3: dict[str, str] = field(default_factory=dict)
    vbr: dict | None = None

    @property
    def seconds(self) -> tuple[int, int]:
        """Exact duration as samples over samples a second."""
        return self.samples, self.header.hertz if self.header else 1


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Length of a tag at the start, and its text frames (versions 2.3 and 2.4)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    end = 10 + sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0)))
    at, found = 10, {}
    while at + 10 <= min(end, len(data)) and data[at]:
        name, raw = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
        n = sum(b << s for b, s in zip(raw, (21, 14, 7, 0))) if data[3] == 4 else int.from_bytes(raw)
        body = data[at + 10 : at + 10 + n]
        if name[0] == "T" and body:
            found[name] = body[1:].decode({0: "latin-1", 1: "utf-16", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
        at += 10 + n
    return end, found


def _vbr(data: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table of the frame at ``at`` (Xing, Info or VBRI)."""
    for start in (at + 4 + 2 * h.checked + h.side, at + 4 + h.side):
        kind = data[start : start + 4]
        if kind in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[start + 4 : start + 8]), start + 8
            out: dict = {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = int.from_bytes(data[p : p + 4]), p + 4
            if flags & 4:
                out["toc"] = list(data[p : p + 100])
            return out
    p = at + 36
    if data[p : p + 4] == b"VBRI":
        size, frames = struct.unpack(">II", data[p + 10 : p + 18])
        return {"kind": "VBRI", "frames": frames, "bytes": size}
    return None


def scan_stream(data: bytes) -> Scan:
    """Walks the frames. After bytes that are no frame it goes on at the next header that another one, or the end, follows."""
    out = Scan()
    at, out.id3 = _id3v2(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    trusted = False
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        ok = h is not None and at + h.length <= end
        if ok and not trusted:
            after = at + h.length
            nxt = parse_header(data[after : after + 4])
            ok = after == end or nxt is not None and (nxt.version, nxt.layer, nxt.hertz) == (h.version, h.layer, h.hertz)
        if not ok:
            nxt_at = data.find(b"\xff", at + 1, end)
            nxt_at = end if nxt_at < 0 else nxt_at
            out.skipped += nxt_at - at
            at, trusted = nxt_at, False
            continue
        if h.checked and h.layer == 3:
            out.checked += 1
            if crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != int.from_bytes(data[at + 4 : at + 6]):
                out.bad_checksums += 1
        if out.header is None:
            out.header, out.vbr = h, _vbr(data, at, h) if h.layer == 3 else None
            if out.vbr:
                at, trusted = at + h.length, True
                continue
        out.offsets.append(at)
        out.samples += h.samples
        at, trusted = at + h.length, True
    return out


def store(payload: bytes, title: str = "payload") -> bytes:
    """A stream with ``payload`` (a multiple of UNIT bytes) in the ancillary bytes of its frames.

    ID3v2 tag, a frame with the table of frames and bytes, a checked frame for each unit, ID3v1 tag. The side
    information is all zero (no audio data), so a player gives silence of the right length.
    """
    length = parse_header(STORED_HEADER).length
    start = STORED_HEADER + crc16(STORED_HEADER[2:] + bytes(SIDE)).to_bytes(2) + bytes(SIDE)
    n = len(payload) // UNIT
    frames = np.zeros((n, length), np.uint8)
    frames[:, : len(start)] = np.frombuffer(start, np.uint8)
    frames[:, len(start) : len(start) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    toc = bytes(min(255, (i * n // 100 + 1) * 256 // (n + 1)) for i in range(100))
    table = b"Info" + struct.pack(">III", 7, n, (n + 1) * length) + toc
    text = b"\3" + title.encode()
    frame = b"TIT2" + len(text).to_bytes(4) + b"\0\0" + text
    return b"".join([b"ID3\3\0\0", _syncsafe(len(frame)), frame, (start + table).ljust(length, b"\0"), frames.tobytes(), b"TAG" + title.encode()[:30].ljust(30, b"\0") + bytes(95)])


def load(media: bytes, found: Scan) -> bytes:
    """The payload of a stored stream."""
    skip = 6 + found.header.side if found.header else 0
    return b"".join([media[o + skip : o + skip + UNIT] for o in found.offsets])


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def with_audio(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, padded by spaces, stored as audio. Null: ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([store(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


SCAN_SCHEMA = """doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,
media_sha256 string, version int, layer int, hertz int, channels int, n_frames long, n_samples long, bad_checksums long,
skipped_bytes long, vbr_kind string, vbr_frames long, title string, offsets array<long>"""


def scan_audio(df: DataFrame) -> DataFrame:
    """Scans rows (doc_id, n_bytes, media): payload digests, format, exact duration (n_samples / hertz), checksums, tags
    and the byte offset of every frame. Media without a frame has null format columns and no payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, media in zip(*(c.to_pylist() for c in batch.columns)):
                media = media or b""
                s = scan_stream(media)
                h, v, payload = s.header, s.vbr or {}, load(media, s)
                rows.append({
                    "doc_id": doc_id, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
                    "version": h and h.version, "layer": h and h.layer, "hertz": h and h.hertz, "channels": h and h.channels,
                    "n_frames": len(s.offsets), "n_samples": s.samples, "bad_checksums": s.bad_checksums, "skipped_bytes": s.skipped,
                    "vbr_kind": v.get("kind"), "vbr_frames": v.get("frames"), "title": s.id3.get("TIT2"), "offsets": s.offsets,
                })
            yield pa.RecordBatch.from_pylist(rows, ARROW_SCAN)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, SCAN_SCHEMA)


_LONG, _INT, _TEXT = pa.int64(), pa.int32(), pa.string()
ARROW_SCAN = pa.schema([
    ("doc_id", _LONG), ("n_bytes", _LONG), ("payload_bytes", _LONG), ("payload_sha256", _TEXT), ("tail_crc32", _LONG), ("media_bytes", _LONG),
    ("media_sha256", _TEXT), ("version", _INT), ("layer", _INT), ("hertz", _INT), ("channels", _INT), ("n_frames", _LONG), ("n_samples", _LONG),
    ("bad_checksums", _LONG), ("skipped_bytes", _LONG), ("vbr_kind", _TEXT), ("vbr_frames", _LONG), ("title", _TEXT), ("offsets", pa.list_(_LONG)),
])


def op7_audio(spark, sf_dir: str) -> DataFrame:
    found = scan_audio(with_audio(documents(spark, sf_dir)))
    feature = F.concat_ws(
        ";", F.format_string("v%d-l%d-%dHz-%dch", "version", "layer", "hertz", "channels"), F.format_string("frames=%d", "n_frames"),
        F.format_string("samples=%d", "n_samples"), F.format_string("bad=%d", "bad_checksums"), F.format_string("last=%d", F.element_at("offsets", -1)),
    )
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
