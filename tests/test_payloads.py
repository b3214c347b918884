import math
from collections import Counter

from pyspark.sql import functions as F

from capturelake.functions import payload


def test_payload_functions(spark):
    data = [b"", b"a" * 15, b"a" * 16, bytes(range(256)), b"\x00\xffGET / HTTP/1.1\r\n\r\n" * 3, None]
    df = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(data)], "id int, data binary")
    rows = df.select("id", payload.entropy(F.col("data")).alias("e"), payload.hex_dump(F.col("data")).alias("d")).orderBy("id").collect()
    for d, r in zip(data, rows):
        d = d or b""
        want = round(sum(-c / len(d) * math.log2(c / len(d)) for c in Counter(d).values()), 2) if len(d) >= 16 else None
        assert r["e"] == want
        lines = [(d[i : i + 16].hex(" ").ljust(47), "".join(chr(b) if 32 <= b < 127 else "." for b in d[i : i + 16])) for i in range(0, len(d), 16)]
        assert r["d"] == "\n".join(f"{i * 16:04x}  {h}  {t}" for i, (h, t) in enumerate(lines))


def test_iso_epoch(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T01:00:00.5+01:00",), ("soon",), (None,)], "t string")
    assert [r[0] for r in df.select(payload.iso_epoch(F.col("t"))).collect()] == [1704067200.0, 1704067200.5, None, None]
