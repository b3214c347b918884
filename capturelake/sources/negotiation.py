"""Which source a file is, and how its columns meet a declared schema."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake import scratch
from capturelake.sources import text_logs
from capturelake.sources.text_logs import RENAMES

#: Required and optional columns by source; the specific logs come before the connection log.
SCHEMAS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "zeek_dns": (("ts", "id.orig_h", "id.resp_h", "query"), ("answers", "TTLs", "rcode", "qtype_name")),
    "zeek_http": (("ts", "id.orig_h", "id.resp_h", "method", "host"), ("uri", "user_agent", "status_code", "referrer")),
    "zeek_ssl": (("ts", "id.orig_h", "id.resp_h", "cipher"), ("server_name", "version", "ja3")),
    "zeek_smb_files": (("ts", "id.orig_h", "id.resp_h", "action"), ("path", "name")),
    "zeek_smb_mapping": (("ts", "id.orig_h", "id.resp_h", "share_type"), ("path",)),
    "zeek_dce_rpc": (("ts", "id.orig_h", "id.resp_h", "endpoint", "operation"), ("named_pipe", "rtt")),
    "zeek_conn": (("ts", "id.orig_h", "id.resp_h", "proto"), ("id.orig_p", "id.resp_p", "service", "history", "duration")),
    "export_metadata": (("frame.number", "frame.time_epoch", "ip.src", "ip.dst"), ("frame.len", "tcp.flags", "ip.ttl")),
    "export_arp": (("frame.time_epoch", "arp.src.proto_ipv4", "arp.opcode"), ("arp.dst.proto_ipv4", "arp.src.hw_mac")),
}
READERS = {
    "zeek_dns": text_logs.dns, "zeek_http": text_logs.http, "zeek_ssl": text_logs.ssl, "zeek_smb_files": text_logs.smb, "zeek_smb_mapping": text_logs.smb,
    "zeek_dce_rpc": text_logs.dce_rpc, "zeek_conn": text_logs.conn, "export_metadata": text_logs.export_metadata, "export_arp": text_logs.export_arp,
}


@dataclass(frozen=True)
class Report:
    missing_required: tuple[str, ...]
    missing_optional: tuple[str, ...]
    unknown: tuple[str, ...]
    suggestions: dict[str, str]

    @property
    def clean(self) -> bool:
        return not self.missing_required and not self.unknown


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def suggest(missing: str, unknown: list[str]) -> str | None:
    """The unknown column that a missing one may be: a known alias, the same letters, or one holding the other; only if it is the only one."""
    for test in (lambda u: RENAMES.get(u) == missing, lambda u: _plain(u) == _plain(missing), lambda u: _plain(u) in _plain(missing) or _plain(missing) in _plain(u)):
        hits = [u for u in unknown if _plain(u) and test(u)]
        if hits:
            return hits[0] if len(hits) == 1 else None
    return None


def inspect(columns: list[str], source: str) -> Report:
    required, optional = SCHEMAS[source]
    unknown = [c for c in columns if c not in required + optional and not c.startswith("_")]
    gone = [c for c in required if c not in columns]
    return Report(tuple(gone), tuple(c for c in optional if c not in columns), tuple(unknown), {m: s for m in gone if (s := suggest(m, unknown))})


def detect(spark: SparkSession, path: str) -> str | None:
    """The first source whose required columns the file's first lines name; None if there is none."""
    head = [r["value"] for r in spark.read.text(path).limit(50).collect()]
    names = next((x.split("\t")[1:] for x in head if x.startswith("#fields")), None)
    columns = set(names or (head[0].split("\t") if head else []))
    return next((s for s, (required, _) in SCHEMAS.items() if set(required) <= columns and s.startswith("zeek") == (names is not None)), None)


def read(spark: SparkSession, path: str, source: str | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """Packets of a text log; ``mapping`` renames columns before they are read."""
    source = source or detect(spark, path)
    if source not in READERS:
        raise ValueError(f"{path}: no source reads it")
    df = (text_logs.read_fields_log if source.startswith("zeek") else text_logs.read_export)(spark, path)
    return READERS[source](df.withColumnsRenamed(mapping or {}))


def merge(*captures: DataFrame) -> DataFrame:
    """Several captures as one, numbered anew in order of time; of equal times and numbers the earlier capture's packet first.
    Checkpointed with its numbers, as each source is."""
    if len(captures) == 1:
        return captures[0]
    placed = [df.withColumn("_capture", F.lit(n)) for n, df in enumerate(captures)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed).orderBy("timestamp", "seq_no", "_capture")
    return scratch.cut(rows.withColumn("seq_no", F.monotonically_increasing_id()).drop("_capture"))
