"""Exact removal of repeated passages: anchored window hashing in place of prefix doubling.

No rank is made from ranks of an earlier round: two sorts group hashes of bytes. Full doubling would sort a row for each byte in each round. Two facts make the rows few:

* Windows that are equal have their anchor (least-hashed 32-byte gram) at one place, so only anchors are grouped first:
  a window whose anchor's hash is unique is unique. These are about one position in 30.
* Neighbouring windows with one anchor form a run. Two runs of one hash over their whole stretch repeat each other in every window, so
  a long copy takes a row for each run, and only runs that share an anchor but not the stretch - at the ends of a copy -
  are grouped by single windows: pairs (hash of 64 bytes here, hash of 64 bytes at offset 36).

Spark sorts (hashes, position); the first place of a hash stays and later ones are covered. Hashes have 64 bits and are not
compared with the bytes. Copies within one task's slice are folded before the shuffle, so a passage of a third of all documents
comes to each sort once a slice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.llm.common import CLEANUP, cut, documents, scratch_dir
from capturelake.llm.hashing import Prefix, joined, mix
from capturelake.llm.suffixes import LENGTH, FirstOnes, merged, runs
from capturelake.llm.tokens import slices

NO_ID = -(1 << 63)
#: Length of the ranks that the last round pairs, at offsets 0 and LENGTH - HALF.
HALF = 64
#: Texts of one doc_id lie this far apart in the order of places; a text is shorter.
APART = 1 << 32


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared scratch folder and read again; what the write shuffled is removed when it has ended."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/repeats-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64))


def _fold(key: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """True where an earlier position of the same key is among the rows."""
    order = np.lexsort((lo, doc, key))
    k, d, p = key[order], doc[order], lo[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    out = np.zeros(len(k), bool)
    out[order] = (d != d[first]) | (p != p[first])
    return out


RANKED = "spread long, anchor long, stretch long, doc_id long, lo long, hi long, sure boolean"
FOUND = "doc_id long, lo long, hi long, covered boolean"


def _rank_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        shift = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) * APART
        for a, b in slices(texts):
            (text, lo, hi, anchor, stretch), _, _ = runs([t.encode() for t in texts[a:b]])
            lo, hi = lo + shift[a:b][text], hi + shift[a:b][text]
            doc = ids[a:b][text]
            sure = _fold(stretch, doc, lo)
            # repeats of this slice go straight on, a row for each stretch of bytes
            parts = []
            where = np.flatnonzero(sure)
            for t in np.split(where, np.flatnonzero(np.diff(text[where])) + 1) if len(where) else []:
                x, y = merged(lo[t], hi[t] + LENGTH)
                parts.append((np.full(len(x), doc[t[0]]), x, y))
            s_doc, s_lo, s_hi = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
            rest = ~sure
            zero = np.zeros(len(s_doc), np.uint64)
            spread = mix(s_doc.view(np.uint64) * np.uint64(31) + s_lo.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(np.concatenate([anchor[rest], spread])), _signed(np.concatenate([anchor[rest], zero])), _signed(np.concatenate([stretch[rest], zero])),
                    pa.array(np.concatenate([doc[rest], s_doc])), pa.array(np.concatenate([lo[rest], s_lo])), pa.array(np.concatenate([hi[rest] + LENGTH, s_hi])),
                    pa.array(np.concatenate([np.zeros(rest.sum(), bool), np.ones(len(s_doc), bool)])),
                ],
                names=["spread", "anchor", "stretch", "doc_id", "lo", "hi", "sure"],
            )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = FirstOnes()
    for batch in batches:
        anchor, stretch, doc, lo, hi, sure = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 7))
        sure = sure.astype(bool)
        cols = [c[~sure] for c in (anchor, stretch, doc, lo, hi)]
        covered, (o_doc, o_lo, o_hi) = state.feed(*cols)
        doc = np.concatenate([doc[sure], cols[2][covered], o_doc])
        lo = np.concatenate([lo[sure], cols[3][covered], o_lo])
        hi = np.concatenate([hi[sure], cols[4][covered], o_hi])
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), pa.array(hi), pa.array(np.arange(len(doc)) < len(doc) - len(o_doc))], names=["doc_id", "lo", "hi", "covered"])


def _rank_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts, spans = batch.column(1).to_pylist(), batch.column(3).to_pylist()
        shift = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) * APART
        for a, b in slices(texts):
            data, starts = joined([t.encode() for t in texts[a:b]])
            prefix = Prefix(data)
            lo, hi, owner = [], [], []
            for i, s in enumerate(spans[a:b]):
                x, y = merged(np.array([e["lo"] for e in s]), np.array([e["hi"] - LENGTH + 1 for e in s]))
                lo.append(x)
                hi.append(y)
                owner.append(np.full(len(x), i))
            lo, hi, owner = np.concatenate(lo), np.concatenate(hi), np.concatenate(owner)
            n = hi - lo
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            owner = np.repeat(owner, n)
            at = place + starts[owner]
            near, far = prefix.hashes(at, at + HALF), prefix.hashes(at + LENGTH - HALF, at + LENGTH)
            pair = mix(near * np.uint64(3) + mix(far))
            doc = ids[a:b][owner]
            place += shift[a:b][owner]
            sure = _fold(pair, doc, place)
            spread = np.where(sure, mix(doc.view(np.uint64) + place.view(np.uint64)), pair)
            yield pa.RecordBatch.from_arrays([_signed(spread), _signed(pair), pa.array(doc), pa.array(place), pa.array(sure)], names=["spread", "pair", "doc_id", "lo", "sure"])


def _walk_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = FirstOnes()
    for batch in batches:
        pair, doc, lo, sure = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
        sure = sure.astype(bool)
        covered, _ = state.feed(pair[~sure], pair[~sure], doc[~sure], lo[~sure], lo[~sure])
        doc, lo = np.concatenate([doc[sure], doc[~sure][covered]]), np.concatenate([lo[sure], lo[~sure][covered]])
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo)], names=["doc_id", "lo"])


def numbered_texts(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``version``: 0, or the place of the text among the different texts of its doc_id, by their digests.

    Texts are dealt out by it only where some doc_id has several.
    """
    prints = docs.select("doc_id", F.sha2("text", 256).alias("print"))
    several = cut(prints.groupBy("doc_id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo <> hi").select("doc_id"))
    if several.isEmpty():
        return docs.withColumn("version", F.lit(0).cast("long"))
    known = prints.join(several, "doc_id", "left_semi").distinct()
    known = cut(known.withColumn("version", F.row_number().over(Window.partitionBy("doc_id").orderBy("print")).cast("long") - 1))
    docs = docs.withColumn("print", F.sha2("text", 256))
    return docs.join(known, ["doc_id", "print"], "left").select("doc_id", "text", F.coalesce("version", F.lit(0).cast("long")).alias("version"))


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, version, lo, hi): stretches of bytes of whole texts covered by a 100-byte string that also starts earlier.

    Stretches may overlap; together they are exactly the covered bytes. ``docs(doc_id, text, version)`` needs
    long ids without nulls (:func:`numbered_texts`). Rows of one doc_id and text are one document; further texts of the id come
    after its first, in the order of their versions.
    """
    ranked = docs.select("doc_id", "text", "version").mapInArrow(_rank_runs, RANKED)
    found = _stored(ranked.repartition("spread").sortWithinPartitions("anchor", "stretch", "doc_id", "lo").mapInArrow(_walk, FOUND))
    version = F.floor(F.col("lo") / APART).cast("long")
    apart = [version.alias("version"), (F.col("lo") - version * APART).alias("lo"), (F.col("hi") - version * APART).alias("hi")]
    checks = found.where("not covered").select("doc_id", *apart).groupBy("doc_id", "version").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    windows = docs.join(checks, ["doc_id", "version"]).select("doc_id", "text", "version", "spans")
    windows = windows.mapInArrow(_rank_windows, "spread long, pair long, doc_id long, lo long, sure boolean")
    single = windows.repartition("spread").sortWithinPartitions("pair", "doc_id", "lo").mapInArrow(_walk_windows, "doc_id long, lo long")
    single = _stored(single)
    both = found.where("covered").select("doc_id", "lo", "hi").unionByName(single.select("doc_id", "lo", (F.col("lo") + LENGTH).alias("hi")))
    return both.select("doc_id", *apart)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, removed) for each row of ``docs(doc_id, text)``.

    ``kept`` has the bytes left (binary: a cut may fall inside a character), ``removed`` the spans. Null texts count as '',
    texts under 100 bytes lose nothing. Rows that repeat an id and its text are one document, each of which loses the same; rows
    that repeat an id with other texts are documents of their own, one after the other by their texts' digests. Null ids sort
    first, as one id. An empty table gives no rows, other columns are not read.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = numbered_texts(docs)
    spans = repeated(docs).groupBy("doc_id", "version").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                lo, hi = merged(np.array([s["lo"] for s in found or []], np.int64), np.array([s["hi"] for s in found or []], np.int64))
                edges = zip([0, *hi.tolist()], [*lo.tolist(), len(data)])
                kept = b"".join([data[x:y] for x, y in edges])
                rows.append((None if doc_id == NO_ID else doc_id, len(data), len(data) - len(kept), len(lo), kept, [{"lo": x, "hi": y} for x, y in zip(lo.tolist(), hi.tolist())]))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.binary(), span]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])

    return docs.join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<lo: long, hi: long>>"
    )


def op3_repeats(spark, sf_dir: str) -> DataFrame:
    """Every document with what :func:`without_repeats` removes; nulls, empties and repeats as there."""
    out = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
