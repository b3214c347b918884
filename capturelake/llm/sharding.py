"""Sharding by extendible hashing: a directory on hash-prefix bits whose oversized buckets split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.llm.common import cut, documents

#: Hash bits used; rows that agree in all of them cannot be parted.
HASH_BITS = 60
#: Directory bits that one pass over the rows can add.
STEP_BITS = 12
SHARD_BYTES = 1 << 20


def _hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def shards(items: DataFrame, limit: int, step_bits: int = STEP_BITS) -> DataFrame:
    """(key, n_bytes, depth, shard, shard_bytes, oversized) for rows ``items(key, n_bytes)``.

    A shard is a bucket of the extendible-hashing directory: ``depth`` leading bits of the key's hash,
    named ``shard`` (the bits as text, '' for one bucket of all). A bucket over ``limit`` bytes splits on the
    next bit; others stay. All splits of ``step_bits`` bits come from one grouped sum of the rows still in oversized
    buckets, so passes, not splits, read them, and only as many passes run as the depth needs.

    Rows with equal keys share all bits: a bucket of only such rows, or one row over the limit, stays whole at
    the depth where nothing more parts and is marked ``oversized``. Null keys hash alike, null sizes count as
    0, and an empty table gives no rows.
    """
    rows = cut(items.select("key", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), _hash(F.col("key")).alias("h")))
    open_rows, done, depth = rows, None, 0
    while True:
        last = min(depth + step_bits, HASH_BITS)
        cells = open_rows.groupBy(F.shiftright("h", HASH_BITS - last).alias("cell")).agg(
            F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        levels = F.explode(F.sequence(F.lit(depth), F.lit(last))).alias("d")
        up = cells.select("*", levels).select("*", F.expr(f"shiftright(cell, {last} - d)").alias("p"))
        sums = up.groupBy("d", "p").agg(F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        # a bucket is final if it fits, or if its rows have one hash: then no bit parts them
        final = sums.where((F.col("b") <= limit) | (F.col("lo") == F.col("hi")))
        leaf = up.select("cell", "d", "p").join(final.select("d", "p", "b"), ["d", "p"])
        leaf = cut(leaf.groupBy("cell").agg(F.min(F.struct("d", "p", "b")).alias("leaf")))
        placed = open_rows.withColumn("cell", F.shiftright("h", HASH_BITS - last)).join(leaf, "cell", "left")
        got = placed.where("leaf is not null").select("key", "n_bytes", F.col("leaf.d").alias("depth"), F.col("leaf.p").alias("p"), F.col("leaf.b").alias("shard_bytes"))
        done = got if done is None else done.union(got)
        if last >= HASH_BITS:
            break
        open_rows = cut(placed.where("leaf is null").select("key", "n_bytes", "h"))
        if open_rows.isEmpty():
            break
        depth = last
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(conv(cast(p as string), 10, 2), depth, '0')"))
    return done.select("key", "n_bytes", F.col("depth").cast("int").alias("depth"), bits.alias("shard"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def directory(placed: DataFrame) -> DataFrame:
    """One row a shard: (shard, depth, n_rows, shard_bytes, slots), slots being its share of the 2**max(depth) entries."""
    one = placed.groupBy("shard", "depth").agg(F.count(F.lit(1)).alias("n_rows"), F.max("shard_bytes").alias("shard_bytes"))
    deepest = F.max("depth").over(Window.partitionBy())
    return one.withColumn("slots", F.pow(F.lit(2.0), deepest - F.col("depth")).cast("long"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return shards(docs.select(F.col("doc_id").alias("key"), size.alias("n_bytes")), SHARD_BYTES).withColumnRenamed("key", "doc_id")


SHARD_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
l AS (SELECT d.*, t.d AS depth, h >> CAST({HASH_BITS} - t.d AS BIGINT) AS p FROM d, (SELECT unnest(range(0, 41)) AS d) t),
b AS (SELECT depth, p, sum(n_bytes) AS b, min(h) AS lo, max(h) AS hi FROM l GROUP BY depth, p),
f AS (SELECT l.doc_id, l.n_bytes, l.depth, l.p, b.b, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) AS n
      FROM l JOIN b ON l.depth = b.depth AND l.p = b.p WHERE b.b <= {SHARD_BYTES} OR b.lo = b.hi)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(b AS BIGINT) AS shard_bytes, b > {SHARD_BYTES} AS oversized
FROM f WHERE n = 1
"""
