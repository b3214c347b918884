"""Capture files are walked and decoded by several tasks, neighbouring ranges in one go, and plain frames all at once; the packets are the same."""

import os
import random

import pyarrow as pa
from pyspark.sql import functions as F
from test_capture_files import packets, pcap_file, pcapng_file

from capturelake.sources import capture_files, pcap


def test_packets_come_from_several_tasks(spark, tmp_path):
    """The ranges' rows are few bytes, so adaptive execution used to put all of them into one task."""
    path = tmp_path / "x.pcap"
    path.write_bytes(pcap_file(packets(300)))
    parts = pcap.read(spark, str(path), range_bytes=4_000, columns=["seq_no"]).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(parts) > 8 and sum(r["count"] for r in parts) == 300


def test_packets_of_a_time_come_from_several_tasks(spark, tmp_path):
    path = tmp_path / "x.pcapng"
    path.write_bytes(pcapng_file(packets(300)))
    lo, hi = 1700000100.0, 1700000260.0
    found = pcap.read(spark, str(path), time_range=(lo, hi), range_bytes=4_000, columns=["timestamp"]).groupBy(F.spark_partition_id().alias("part"))
    parts = found.agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).collect()
    assert len(parts) > 4 and sum(r["n"] for r in parts) == 160 and min(r["first"] for r in parts) >= lo and max(r["last"] for r in parts) <= hi


def test_rows_are_dealt_evenly(spark):
    rows = spark.range(1000).coalesce(1)
    counts = [r["count"] for r in capture_files.dealt(rows, 20).groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert len(counts) == 50 and max(counts) - min(counts) <= 2
    assert capture_files.dealt(spark.range(0), 20).count() == 0


def test_only_the_first_range_of_a_stretch_looks_for_a_record(tmp_path, monkeypatch):
    looked = []
    real = capture_files.synchronised
    monkeypatch.setattr(capture_files, "synchronised", lambda *a: looked.append(a[2]) or real(*a))
    for layout in (pcap_file, pcapng_file):
        path = tmp_path / f"{layout.__name__}.cap"
        path.write_bytes(layout(packets(400)))
        size, n = path.stat().st_size, 3_000
        whole = list(capture_files._stretch(str(path), size, 0, 0, size, None, n))
        assert [r["no"] for r in whole] == list(range(-(-size // n))) and all(b["start"] == a["end"] for a, b in zip(whole, whole[1:])) and sum(r["n"] for r in whole) == 400
        assert looked == [0]
        looked.clear()
        part = list(capture_files._stretch(str(path), size, 20, 20 * n, 30 * n, None, n))
        assert looked == [20 * n]
        assert [(r["start"], r["end"], r["n"], r["begin"], r["stop"]) for r in part] == [(r["start"], r["end"], r["n"], r["begin"], r["stop"]) for r in whole[20:30]]
        looked.clear()


def test_after_a_range_that_ends_early_the_next_looks_for_itself(tmp_path):
    whole = pcap_file(packets(400))
    path = tmp_path / "x.pcap"
    path.write_bytes(whole[:30_000] + b"\xff" * 3_000 + whole[33_000:])
    rows = list(capture_files._stretch(str(path), len(whole), 0, 0, len(whole), None, 4_000))
    early = next(i for i, r in enumerate(rows) if r["end"] is not None and r["end"] < r["stop"])
    assert 6 <= early <= 8 and rows[early + 3]["start"] is not None and rows[early + 3]["n"] > 0


def test_turns_grow_with_the_logarithm_of_the_ranges(spark, tmp_path, monkeypatch):
    """Big-endian records whose bytes lead other chains on to the file's end: 382 turns, when each walked one range."""
    path = tmp_path / "x.pcap"
    path.write_bytes(pcap_file(packets(400), ">"))
    cuts = []
    real = capture_files.scratch.cut
    monkeypatch.setattr(capture_files.scratch, "cut", lambda df: cuts.append(1) or real(df))
    rows = capture_files.index(spark, str(path), 700).orderBy("no").collect()
    assert sum(r["n"] for r in rows) == 400 and all(b["start"] == a["end"] for a, b in zip(rows, rows[1:]))
    assert 4 < len(cuts) <= 2 + 2 * 10


def test_frames_decoded_at_once_are_those_decoded_one_by_one():
    rng = random.Random(3)
    frames = []
    for i in range(3000):
        frame = pcap.frame_of(f"10.0.{i % 9}.{i % 7}", "203.0.113.3", i, 443, rng.choice(["TCP", "UDP"]), i % 256, rng.choice(["", "SYN ACK", "FIN"]), rng.randrange(1 << 40), rng.randbytes(rng.randrange(50)))
        # cut off anywhere after the fixed part of the header, or with lengths, protocols and flags changed
        frame = bytearray(frame[: rng.choice([34, 35, 40, 50, 53, len(frame), len(frame)])])
        for _ in range(rng.randrange(4)):
            frame[14 + rng.randrange(len(frame) - 14)] = rng.choice([0, 6, 17, 1, 58, 255, rng.randrange(256)])
        frames.append(bytes(frame))
    names = [c.split()[0] for c in pcap.SCHEMA.split(", ")]
    columns = {k: v.to_pylist() if isinstance(v, pa.Array) else v.tolist() for k, v in pcap.decode_plain(frames, names).items()}
    assert [dict(zip(columns, values)) for values in zip(*columns.values())] == [{k: pcap.decode(f)[k] for k in columns} for f in frames]
    assert set(columns) == set(pcap.decode(frames[0]))


def test_other_frames_among_plain_ones(spark, tmp_path):
    """Tagged, cut and foreign frames are decoded one by one, or have no row."""
    rows = packets(60)
    for i in (3, 20, 41):
        s, us, f = rows[i]
        rows[i] = (s, us, f[:12] + b"\x81\x00\x00\x05" + f[12:])
    rows[30] = (*rows[30][:2], rows[30][2][:20])
    rows[31] = (*rows[31][:2], b"\x00" * 60)
    path = tmp_path / "x.pcap"
    path.write_bytes(pcap_file(rows))
    got = {r["seq_no"]: r.asDict() for r in pcap.read(spark, str(path), range_bytes=9_000).collect()}
    want = {i: pcap.decode(f) | {"seq_no": i, "timestamp": s + us / 1e6, "orig_len": len(f) + 5, "link": 1, "raw": f} for i, (s, us, f) in enumerate(rows) if i not in (30, 31)}
    assert {k: {**v, "raw": bytes(v["raw"]), "payload": bytes(v["payload"])} for k, v in got.items()} == want
    assert os.path.getsize(path) > 9_000
    few = pcap.read(spark, str(path), columns=["ttl", "src_ip"])
    assert sorted(few.columns) == ["src_ip", "ttl"] and few.count() == 58
