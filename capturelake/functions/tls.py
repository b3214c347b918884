"""Fingerprints of TLS clients from the bytes of their first message."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers of extensions that are read, and the names of versions in a fingerprint.
SERVER_NAME, CURVES, POINT_FORMATS, PROTOCOLS, VERSIONS = 0, 10, 11, 16, 43
VERSION_NAMES = {0x0300: "s3", 0x0301: "10", 0x0302: "11", 0x0303: "12", 0x0304: "13"}


def _reserved(value: int) -> bool:
    """Values that clients add at random, which no fingerprint counts: both bytes the same and ending in A."""
    return value & 0x0F0F == 0x0A0A and value >> 8 == value & 0xFF


def _numbers(data: bytes) -> list[int]:
    return [v for (v,) in struct.iter_unpack(">H", data[: len(data) // 2 * 2]) if not _reserved(v)]


class _Reader:
    """Length-prefixed fields in turn; a field that is cut off raises."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def field(self, prefix: int) -> bytes:
        return self.take(int.from_bytes(self.take(prefix)))

    @property
    def left(self) -> int:
        return len(self.data) - self.at


def client_hello(data: bytes) -> dict | None:
    """version, ciphers, extensions, curves, points, the offered version, protocol and server name of a first message; None for other and
    cut payloads."""
    try:
        if len(data) < 10 or data[0] != 0x16 or data[5] != 1:
            return None
        record = _Reader(data[5:])
        record.take(1)
        hello = _Reader(record.field(3))
        version = int.from_bytes(hello.take(2))
        hello.take(32)
        hello.field(1)
        out = {"version": version, "ciphers": _numbers(hello.field(2)), "extensions": [], "curves": [], "points": [], "offered": version, "protocol": None, "server": None}
        hello.field(1)
        parts = _Reader(hello.field(2) if hello.left >= 2 else b"")
        while parts.left >= 4:
            kind, body = int.from_bytes(parts.take(2)), parts.field(2)
            if not _reserved(kind):
                out["extensions"].append(kind)
            if kind == SERVER_NAME and len(body) > 5:
                out["server"] = body[5 : 5 + int.from_bytes(body[3:5])].decode(errors="replace")
            elif kind == CURVES and len(body) >= 2:
                out["curves"] = _numbers(body[2 : 2 + int.from_bytes(body[:2])])
            elif kind == POINT_FORMATS and body:
                out["points"] = list(body[1 : 1 + body[0]])
            elif kind == PROTOCOLS and len(body) >= 4:
                out["protocol"] = body[3 : 3 + body[2]].decode(errors="replace")
            elif kind == VERSIONS and body:
                out["offered"] = max([version, *_numbers(body[1:])])
        return out
    except ValueError:
        return None


def _described(hello: dict | None) -> dict | None:
    """The texts that fingerprints are digests of."""
    if hello is None:
        return None
    dashed = lambda values: "-".join(map(str, values))
    listed = lambda values: ",".join(f"{v:04x}" for v in sorted(values))
    name = VERSION_NAMES.get(hello["offered"], "00")
    head = f"t{'d' if hello['server'] else 'i'}{name}{min(len(hello['ciphers']), 99):02}{min(len(hello['extensions']), 99):02}{(hello['protocol'] or '00')[:2]}"
    ja3 = ",".join([str(hello["version"]), *(dashed(hello[k]) for k in ("ciphers", "extensions", "curves", "points"))])
    return {"ja3_string": ja3, "head": head, "ciphers": listed(hello["ciphers"]), "others": listed(e for e in hello["extensions"] if e not in (SERVER_NAME, PROTOCOLS)), "sni": hello["server"]}


_TEXTS = pa.struct([(k, pa.string()) for k in ("ja3_string", "head", "ciphers", "others", "sni")])


def fingerprints(payload: Column) -> Column:
    """struct(ja3, ja3_string, ja4, sni) of a payload that is a TLS client's first message; null for others and cut ones.

    Python reads the fields of those payloads alone; digests are built in.
    """

    @F.arrow_udf("struct<ja3_string:string,head:string,ciphers:string,others:string,sni:string>")
    def described(data: pa.Array) -> pa.Array:
        return pa.array([None if v is None else _described(client_hello(v)) for v in data.to_pylist()], _TEXTS)

    hello = F.when((F.length(payload) >= 10) & (F.hex(F.substring(payload, 1, 1)) == "16") & (F.hex(F.substring(payload, 6, 1)) == "01"), payload)
    texts = described(hello)
    short = lambda text: F.substring(F.sha2(text, 256), 1, 12)
    ja4 = F.concat_ws("_", texts["head"], short(texts["ciphers"]), short(texts["others"]))
    return F.when(texts.isNotNull(), F.struct(F.md5(texts["ja3_string"]).alias("ja3"), texts["ja3_string"].alias("ja3_string"), ja4.alias("ja4"), texts["sni"].alias("sni")))
