"""Dense numbers over all rows of a table."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake import scratch


def dense(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Adds 0, 1, 2, ... in ``order``; rows equal in all of it are numbered in any order.

    Rows are dealt out in sorted ranges and written down, so that a lost task cannot change the ranges; a row's number is its place in its
    range plus the sizes of the ranges before. The driver sees one size a range. Rows of one hot key need not share a range if ``order`` tells
    them apart.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = scratch.cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["count"] for r in kept.groupBy(part.alias("part")).count().collect()}
    known = sorted(sizes)
    before = dict(zip(known, accumulate([0, *(sizes[p] for p in known)]), strict=False))
    if not before:
        return kept.select(*rows.columns, F.col("_place").alias(name))
    starts = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])
    return kept.select(*rows.columns, (F.element_at(starts, part) + place).alias(name))
