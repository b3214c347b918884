"""Capture files in byte ranges: the same packets whatever the ranges, hostile payloads, cut files, times, both formats and byte orders."""

import random
import struct

import pytest

from capturelake.sources import capture_files, pcap

FIELDS = ["seq_no", "timestamp", "src_ip", "dst_ip", "src_port", "orig_len", "payload"]


def packets(n, seed=1):
    rng = random.Random(seed)
    inner = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 1700000000 + i, i, 24, 24) + bytes(24) for i in range(40))
    out = []
    for i in range(n):
        # payloads that look like records: whole captures inside a packet, up to its very end, and zeros
        payload = rng.choice([b"", rng.randbytes(rng.randrange(200)), inner, inner[24:], bytes(400), b"\n" * 30])
        out.append((1700000000 + i, (i * 37) % 10**6, pcap.frame_of("10.0.0.1", f"10.0.{i % 7}.2", 1000 + i % 50, 443, "TCP", 64, "ACK", i, payload)))
    return out


def pcap_file(rows, order="<", magic=0xA1B2C3D4, unit=1):
    head = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 262144, 1)
    return head + b"".join(struct.pack(order + "IIII", s, us * unit, len(f), len(f) + 5) + f for s, us, f in rows)


def block(order, kind, body):
    size = 12 + len(body) + -len(body) % 4
    return struct.pack(order + "II", kind, size) + body + bytes(-len(body) % 4) + struct.pack(order + "I", size)


def pcapng_file(rows, sections=2, interfaces=2):
    """Sections of alternating byte order, interfaces with their own ticks (microseconds, nanoseconds) and link types, statistics between."""
    out, per = [], -(-len(rows) // sections)
    for k in range(sections):
        order = "<>"[k % 2]
        out.append(block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)))
        units = [6, 9][:interfaces]
        for unit in units:
            out.append(block(order, 1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3x", 9, 1, unit) + struct.pack(order + "HH", 0, 0)))
        for i, (s, us, f) in enumerate(rows[k * per : (k + 1) * per]):
            number = i % interfaces
            ticks = s * 10 ** units[number] + us * 10 ** (units[number] - 6)
            out.append(block(order, 6, struct.pack(order + "IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f) + 5) + f))
            if i % 50 == 0:
                out.append(block(order, 5, struct.pack(order + "III", number, 0, 0)))
    return b"".join(out)


@pytest.fixture(scope="module")
def given():
    return packets(400)


def read(spark, path, **options):
    return sorted(tuple(r[c] for c in FIELDS) for r in pcap.read(spark, path, **options).collect())


@pytest.fixture(scope="module")
def plain(spark, given, tmp_path_factory):
    path = tmp_path_factory.mktemp("plain") / "a.pcap"
    path.write_bytes(pcap_file(given))
    rows = read(spark, str(path))
    assert [r[1] for r in rows] == [s + us / 1e6 for s, us, _ in given] and [r[0] for r in rows] == list(range(len(given)))
    assert [r[6] for r in rows] == [f[54:] for _, _, f in given]
    return rows


LAYOUTS = {
    "little": pcap_file, "big": lambda r: pcap_file(r, ">"), "nano": lambda r: pcap_file(r, "<", 0xA1B23C4D, 1000), "big nano": lambda r: pcap_file(r, ">", 0xA1B23C4D, 1000),
    "blocks": pcapng_file, "one section": lambda r: pcapng_file(r, 1), "five sections": lambda r: pcapng_file(r, 5),
}


@pytest.mark.parametrize("size", [700, 5_003, 40_000])
@pytest.mark.parametrize("name", LAYOUTS)
def test_ranges_of_any_size_give_the_same_packets(spark, given, plain, tmp_path, name, size):
    path = tmp_path / "x.cap"
    path.write_bytes(LAYOUTS[name](given))
    assert read(spark, str(path), range_bytes=size) == plain
    assert capture_files.index(spark, str(path), size).count() == -(-path.stat().st_size // size)


@pytest.mark.parametrize("layout", [pcap_file, pcapng_file])
def test_cut_and_broken_files_end_where_one_reader_ends(spark, given, plain, tmp_path, layout):
    whole = layout(given)
    cut, broken = tmp_path / "cut.pcap", tmp_path / "broken.pcap"
    cut.write_bytes(whole[: len(whole) * 2 // 3])
    middle = len(whole) // 2
    broken.write_bytes(whole[:middle] + b"\xff" * 3000 + whole[middle + 3000 :])
    for path in (cut, broken):
        one = read(spark, str(path))
        assert 0 < len(one) < len(plain)
        assert read(spark, str(path), range_bytes=3_000) == one
        if path == cut:
            assert one == plain[: len(one)]


@pytest.mark.parametrize("layout", [pcap_file, lambda r: pcapng_file(r, 1)])
def test_a_time_filter_opens_only_the_ranges_it_needs(spark, given, plain, tmp_path, layout):
    path = tmp_path / "x.pcap"
    path.write_bytes(layout(given))
    counter = spark.sparkContext.accumulator(0)
    lo, hi = plain[100][1], plain[119][1]
    assert read(spark, str(path), time_range=(lo, hi), range_bytes=4_000, counter=counter) == plain[100:120]
    assert counter.value == 20
    indexed = capture_files.index(spark, str(path), 4_000)
    near = indexed.where((indexed.t_max >= lo) & (indexed.t_min <= hi)).count()
    assert 0 < near < indexed.count() / 4


def test_several_files_and_others(spark, given, plain, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap_file(given[:150]))
    (tmp_path / "b.pcap").write_bytes(pcapng_file(given[150:]))
    (tmp_path / "c.pcap").write_bytes(b"")
    (tmp_path / "d.pcap").write_bytes(b"no capture at all, only text")
    assert read(spark, f"{tmp_path}/*.pcap", range_bytes=9_000) == plain
    assert read(spark, str(tmp_path / "c.pcap")) == [] and read(spark, str(tmp_path / "d.pcap")) == []


@pytest.mark.parametrize("form", ["pcap", "pcapng"])
def test_written_files_read_back(spark, plain, given, tmp_path, form):
    (tmp_path / "a.pcap").write_bytes(pcap_file(given))
    first = pcap.read(spark, str(tmp_path / "a.pcap"), range_bytes=20_000)
    paths = pcap.write(first.repartition(3), f"file://{tmp_path}/out", form)
    assert len(paths) == 3
    assert sorted(r[1:] for r in read(spark, paths, range_bytes=5_000)) == sorted(r[1:] for r in plain)


def test_link_types():
    frame = pcap.frame_of("10.0.0.1", "10.0.0.2", 5, 53, "UDP", 9, "", 0, b"abc")
    for link, data in ((1, frame), (101, frame[14:]), (12, frame[14:]), (113, bytes(6) + bytes(8) + b"\x08\x00" + frame[14:])):
        row = pcap.decode(data, link)
        assert (row["src_ip"], row["dst_port"], row["ttl"], row["payload"]) == ("10.0.0.1", 53, 9, b"abc")
    assert pcap.decode(frame, 999) is None and pcap.decode(b"", 101) is None and pcap.decode(frame[:10]) is None


def test_a_range_begins_at_a_record_though_others_lead_far_on(tmp_path):
    """Frames longer than their told length, with many bytes that can be a header; no range needs a second walk."""
    rng = random.Random(4)
    head, record = pcap.FORMATS["pcap"]
    hello = bytes.fromhex("160301009c010000980303") + b"\xab" * 32 + bytes.fromhex("00000c0a0a1301c02c009c010000632a2a000000000012001000000d000a000800063a3a001d0017000b000201000010000b")
    records = [record(1.7e9 + i, 60 + rng.randrange(40), pcap.frame_of(f"10.0.{rng.randrange(200)}.7", "203.0.113.3", 40000, 443, "TCP", 64, "ACK", i * 1000 + 1, rng.choice([hello, b"", b"GET / HTTP/1.1"]))) for i in range(9000)]
    path, starts = tmp_path / "x.pcap", [24]
    path.write_bytes(head() + b"".join(records))
    for r in records:
        starts.append(starts[-1] + len(r))
    size = path.stat().st_size
    for no in range(1, size // 100_000 + 1):
        begin, stop = no * 100_000, min(size, (no + 1) * 100_000)
        row = capture_files._walked(str(path), size, no, begin, stop, None)
        assert row["start"] == min(s for s in starts if s >= begin) and row["end"] == min(s for s in starts if s >= stop)
