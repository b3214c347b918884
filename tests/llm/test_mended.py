"""Rows and columns that once broke an operator: ids with several texts, failed first rules, clashing names, repeated responses."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from capturelake.llm import mixing, quality, repeats, warc


def removed(rows):
    """Brute force: bytes covered by a 100-byte string that starts earlier, by id, then text digest."""
    import hashlib

    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0], hashlib.sha256(r[1].encode()).hexdigest())):
        data, gone = text.encode(), set()
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone |= set(range(i, i + 100))
            seen.add(data[i : i + 100])
        out[doc_id, text] = len(gone)
    return out


def test_an_id_with_other_texts_loses_nothing_of_its_own(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    a, b, c = text(300), text(300), text(500)
    rows = [(0, a), (1, a), (1, b), (1, b), (2, b[:200] + c), (3, c), (3, c + a), (3, text(250)), (4, text(90) + c[100:300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.without_repeats(docs).select("doc_id", "n_bytes", "n_removed").collect()
    want = removed(rows)
    assert sorted(map(tuple, got)) == sorted((i, len(t), want[i, t]) for i, t in rows)
    assert want[1, b] == 0


def statistics(spark, rows):
    names = "key long, label int, n_words long, word_chars long, n_symbols long, n_upper long, n_repeat_words long, n_dup_lines long"
    return spark.createDataFrame(rows, names)


def test_learning_goes_on_after_a_failed_rule(spark):
    """Long words come first in the growing half and fail in the pruning half; symbols are the rule that holds."""
    keys = spark.range(6000).select("id", (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("pruning"))
    pruning = {r[0]: r[1] for r in keys.collect()}
    rows = []
    for key, held in pruning.items():
        kind = key % 10
        bad, longer, symbols = kind < 3, kind in (0, 1) or (held and kind in (7, 8)), kind in (0, 2) or False
        rows.append((key, 0 if bad else 1, 100, 900 if longer else 450, 40 if symbols else 0, 10, 0, 0))
    learned = quality.fit(statistics(spark, rows))
    assert any("symbol_share" in t for t in learned.text()), learned.text()
    assert learned.ended == "no rule left"
    assert not any(t.startswith("word_length") and " and " not in t for t in learned.text())
    assert quality.fit(statistics(spark, rows), max_rules=0).ended == "max_rules"


def test_a_repeated_label_counts_once(spark, tmp_path):
    spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stats = spark.createDataFrame([(1,), (2,), (3,), (None,)], "doc_id long")
    assert sorted((r["doc_id"], r["label"]) for r in quality.labelled_statistics(spark, str(tmp_path), stats).collect()) == [(1, 0), (2, 1)]


NAMES = ("_id", "_source", "_copies", "_copy", "_kept", "id", "ID_", "of", "copies", "copy", "kept", "a.b")


@pytest.mark.parametrize("stage", [quality.quality_stage, mixing.mix_stage])
def test_stages_with_clashing_columns(spark, stage):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60")
    plain = sorted(r["doc_id"] for r in stage(spark, docs, folder).collect())
    clash = stage(spark, docs.withColumns({c: F.lit(c) for c in NAMES}), folder)
    assert clash.columns == [*docs.columns, *NAMES]
    rows = clash.collect()
    assert sorted(r["doc_id"] for r in rows) == plain
    assert all(r[c] == c for r in rows for c in NAMES)


def records(data):
    """A second reader of WARC files: by lines, without the module's own parser."""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.0"
        fields = dict(re.fullmatch(r"([A-Za-z-]+): (.*)", x).groups() for x in lines[1:])
        size = int(fields["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        yield fields, rest[:size]
        data = rest[size + 4 :]


def test_each_response_has_its_own_id(spark):
    rows = [(3, "http://h/", "x"), (3, "http://h/", "x"), (3, "http://h/", "y"), (3, None, None), (None, None, None), (3, "", "")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, time string, times string")
    found = warc.responses(pages).collect()
    assert len(found) == len({r["record_id"] for r in found}) == len(rows)
    again = warc.responses(pages.repartition(5)).collect()
    assert {r["record_id"] for r in again} == {r["record_id"] for r in found}


def test_records_of_the_given_pages(spark):
    """Read back by another parser: every response has its two records, which name it, its target and digest."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    long_page = spark.createDataFrame([(-1, "http://long/", "<p>word</p> " * 100_000)], "page_id long, url string, html string")
    found = warc.responses(pages.select("page_id", "url", "html").unionByName(long_page)).cache()
    data = b"".join(bytes(r["record"]) for r in found.collect()) + b"".join(bytes(r["record"]) for r in warc.derivatives(found).collect())
    source, derived = {}, {}
    for fields, block in records(data):
        uuid.UUID(fields["WARC-Record-ID"][10:-1])
        if fields["WARC-Type"] == "response":
            source[fields["WARC-Record-ID"]] = fields
            body = block.partition(b"\r\n\r\n")[2]
            assert fields["WARC-Payload-Digest"] == warc.digest(body) and fields["WARC-Block-Digest"] == warc.digest(block)
        else:
            derived.setdefault(fields["WARC-Refers-To"], []).append((fields, block))
    assert len(source) == pages.count() + 1 and set(derived) == set(source)
    for rid, two in derived.items():
        assert sorted(f["WARC-Type"] for f, _ in two) == ["conversion", "metadata"]
        for fields, block in two:
            assert fields["WARC-Target-URI"] == source[rid]["WARC-Target-URI"]
            assert fields["WARC-Refers-To-Payload-Digest"] == source[rid]["WARC-Payload-Digest"]
            assert fields["WARC-Block-Digest"] == warc.digest(block)
