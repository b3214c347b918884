"""Token-id output: concatenated ids with Elias-Fano encoded document boundaries.

A shard is one binary value, complete in itself:

    magic ``TOKEF1\\0\\0`` | u64 n_docs | u64 n_ids | u64 id_width | u64 low_bits | u64 high_words | u64 samples
    low parts (n_docs + 1 values of low_bits bits, packed little-endian, padded to 8 bytes)
    high parts (unary, as 64-bit words) | select samples (u64: place of every 256th one) | doc ids (i64) | ids

Boundaries are the n_docs + 1 offsets 0 .. n_ids; each takes 2 + low_bits bits. The shards are rows of a Parquet
table written by Spark: (part, shard, n_docs, n_ids, payload); its commit makes a lost task's output whole again.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.llm.common import documents, scratch_dir
from capturelake.llm.tokens import encoder, model_path, slices

MAGIC = b"TOKEF1\0\0"
SAMPLE = 256
#: A shard ends after so many ids.
SHARD_IDS = 1 << 21
END_ID = 0


class EliasFano:
    """A non-decreasing sequence of integers with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples
        self._bits = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        low = np.packbits(bits, bitorder="little")
        low = np.concatenate([low, np.zeros(-len(low) % 8, np.uint8)])
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(((int(ones[-1]) + 1 if n else 0) + 63) // 64 * 64, np.uint8)
        unary[ones] = 1
        high = np.packbits(unary, bitorder="little").view("<u8")
        return cls(n, low_bits, low, high, ones[::SAMPLE].astype("<u8"))

    def select(self, i: int) -> int:
        """Place of the i-th one (from 0) in the unary part: from the sample before it, word by word."""
        at = int(self.samples[i // SAMPLE])
        left, word = i % SAMPLE, at >> 6
        bits = int(self.high[word]) >> (at & 63) << (at & 63)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        return (word << 6) + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, first = self.select(i) - i << self.low_bits, i * self.low_bits
        low = int.from_bytes(self.low[first // 8 : (first + self.low_bits) // 8 + 1].tobytes(), "little")
        return value | (low >> first % 8) & ((1 << self.low_bits) - 1)

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        upper = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return upper | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def pack_shard(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """The bytes of one shard; ``ids`` are little-endian, ``width`` bytes each. A null doc id is stored as the least long."""
    ends = np.concatenate([[0], np.cumsum([len(x) // width for x in ids], dtype=np.uint64)]).astype(np.uint64)
    ef = EliasFano.encode(ends)
    head = struct.pack("<6Q", len(ids), int(ends[-1]), width, ef.low_bits, len(ef.high), len(ef.samples))
    keys = np.array([-(1 << 63) if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, head, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), keys.tobytes(), *ids])


class Shard:
    """Reads a shard: ``len``, ``doc_ids``, ``start(i)``, ``ids(i)``."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a token shard")
        n, self.n_ids, width, low_bits, high, samples = struct.unpack_from("<6Q", payload, 8)
        at, self.n = 56, n
        low = ((n + 1) * low_bits + 7) // 8
        low += -low % 8
        take = lambda kind, count: np.frombuffer(payload, kind, count, at)
        parts = []
        for kind, count in (("u1", low), ("<u8", high), ("<u8", samples), ("<i8", n), (f"<u{width}", self.n_ids)):
            parts.append(take(kind, count))
            at += parts[-1].nbytes
        self.bounds = EliasFano(n + 1, low_bits, *parts[:3])
        self.doc_ids, self._ids = parts[3], parts[4]

    def __len__(self) -> int:
        return self.n

    def start(self, i: int) -> int:
        return self.bounds[i]

    def ids(self, i: int) -> np.ndarray:
        return self._ids[self.bounds[i] : self.bounds[i + 1]]


SHARD_SCHEMA = "part int, shard int, n_docs long, n_ids long, payload binary"


def write_shards(df: DataFrame, path: str, model: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Writes (doc_id, text) as shards in ascending doc_id order (null ids first, equal ids in any order).

    The rows are dealt by ranges of doc_id before they are encoded, so ids never move between machines. A null
    text counts as ''; every document ends with ``end_id``. A table without rows gives no shard.
    """
    spark = df.sparkSession
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, shard = encoder(model), TaskContext.get().partitionId(), 0
        width = enc.dtype.itemsize
        end = np.array([end_id], enc.dtype).tobytes()
        keys: list[int | None] = []
        done: list[bytes] = []
        held = 0

        def flush():
            nonlocal keys, done, held, shard
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_docs": [len(keys)], "n_ids": [held], "payload": pa.array([pack_shard(keys, done, width)], pa.binary())}
            )
            keys, done, held, shard = [], [], 0, shard + 1
            return row

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                for d, x in zip(doc_ids[a:b], enc.encode(texts[a:b])):
                    keys.append(d)
                    done.append(x + end)
                    held += len(x) // width + 1
                    if held >= SHARD_IDS:
                        yield flush()
        if keys:
            yield flush()

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = rows.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    rows.mapInArrow(write, SHARD_SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the shards at ``path``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(payload)
                bounds = shard.bounds.decode().astype(np.int64)
                wide = shard._ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                n = len(shard)
                keys = pa.array([None if d == -(1 << 63) else d for d in shard.doc_ids.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), keys, pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    rows = shards.select("part", "shard", "payload").mapInArrow(read, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # where a shard starts: sums over the parts, then within a part; one row a shard
    by_part = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    inside = Window.partitionBy("part").orderBy("shard")
    starts = shards.select("part", "shard", "n_ids").withColumn("inside", F.sum("n_ids").over(inside) - F.col("n_ids"))
    starts = starts.join(by_part.select("part", "base"), "part").select("part", "shard", (F.col("base") + F.col("inside")).alias("first"))
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_shards(documents(spark, sf_dir).select("doc_id", "text"), path, model_path())
    return read_documents(spark, path)
