"""Protocol tables of packet exports: literals, frames, hostile rows."""

import ast
import json
import random

import pytest
from pyspark.sql import functions as F

from capturelake.sources import exports

META = "frameNumber\tts\tsourceIp\tdestIp\tipProtoType\tsourcePort\tdestPort\tsourceMac\tdestMac\tipTtl\n"


def test_literals_as_the_language_reads_them(spark):
    rng = random.Random(4)
    words = ["None", "True", "x", "it's", 'a "b"', "\\", "\n\t", "é", "\x07", "\x1f", "\\x41", "N", "{'a': None}", ""]
    rows = []
    for _ in range(300):
        value = {"".join(rng.choices(words, k=3)) + str(i): rng.choice([*words, *words, None, True, False, 5, 2.5]) for i in range(rng.randrange(5))}
        rows.append((repr(value),))
    found = [r[0] for r in spark.createDataFrame(rows, "t string").select(F.to_json(exports.literal(F.col("t"), "map<string,string>"), {"ignoreNullFields": "false"})).collect()]
    for (text,), got in zip(rows, found, strict=True):
        want = {k: None if v is None else json.dumps(v) if not isinstance(v, str) else v for k, v in ast.literal_eval(text).items()}
        assert json.loads(got) == want, text


def test_odd_literals_are_null(spark):
    rows = [("{'a': ",), ("",), (None,), ("None",), ("'" * 100_001,), ("{'a': '" + "\\'N" * 200_000 + "'}",)]
    found = spark.createDataFrame(rows, "t string").select(exports.literal(F.col("t"), "a string")["a"].alias("a")).collect()
    assert [r["a"] for r in found[:5]] == [None] * 5 and found[5]["a"] == "'N" * 200_000


def test_frames(spark, tmp_path):
    (tmp_path / "m.csv").write_text(META + "1\t1\t10.0.0.9\t10.0.0.2\t17.0\t9\t53\ta\tb\t1\n2\t2\t\t10.0.0.2\t6\t1\t2\ta\tb\t64\n1\t1\t10.0.0.1\t10.0.0.2\t17.0\t5353.0\t53.0\ta\tb\t64\n")
    head = "frameNumber\tts\ttransId\tflags\tqueriesCount\tquery\tresponseAt\n"
    (tmp_path / "q.csv").write_text(head + "1\t5\t7\t0\t1\t{'qname': 'a.example', 'qtype': 65.0}\t\n0\t1\t6\t8\t0\t1\t{broken\t\n2\t5\t7\t0\t1\t{}\t\n9\t5\t7\t0\t1\t{}\t\n1\tx\t7\t0\t1\t{}\t\n")
    rows = exports.read(spark, str(tmp_path / "q.csv"), str(tmp_path / "m.csv")).orderBy("seq_no").collect()
    assert [(r["src_ip"], r["src_port"], r["transport"], r["dns_query"], r["dns_qtype_name"], r["timestamp"]) for r in rows] == [
        ("10.0.0.1", 5353, "UDP", "a.example", "HTTPS", 5.0),
        ("10.0.0.1", 5353, "UDP", "", "0", 6.0),
    ]
    (tmp_path / "o.csv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="no protocol table"):
        exports.read(spark, str(tmp_path / "o.csv"), str(tmp_path / "m.csv"))
