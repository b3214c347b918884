"""Statistics and timelines of a capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions import net
from capturelake.operators.filters import endpoints

MAX_BUCKETS = 15_000
GAP_SECONDS, GAP_SHARE = 600.0, 0.20


def totals(packets: DataFrame) -> DataFrame:
    one = packets.agg(
        F.count(F.lit(1)).alias("packets"), F.sum("orig_len").alias("bytes"), F.round(F.max("timestamp") - F.min("timestamp"), 3).alias("duration"),
        F.count_distinct("src_ip").alias("sources"), F.count_distinct("dst_ip").alias("destinations"), F.count_distinct("protocol").alias("protocols"),
    )
    ips = endpoints(packets).where("ip <> ''").agg(F.count_distinct("ip").alias("unique_ips"))
    rate = lambda c: F.round(F.when(F.col("duration") > 0, F.col(c) / F.col("duration")).otherwise(0.0), 2)
    return one.crossJoin(ips).withColumns({"avg_packet_size": F.round(F.col("bytes") / F.col("packets"), 2), "packets_per_second": rate("packets"), "bytes_per_second": rate("bytes")})


def protocols(packets: DataFrame) -> DataFrame:
    return packets.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("orig_len").alias("bytes"), F.min_by("transport", F.when(F.col("transport") != "", F.col("seq_no"))).alias("transport"),
        F.count_if(~F.col("src_ip").contains(":")).alias("v4"), F.count_if(F.col("src_ip").contains(":")).alias("v6"),
    )


def talkers(packets: DataFrame, n: int = 15) -> DataFrame:
    return endpoints(packets, "orig_len").groupBy("ip").agg(F.sum("orig_len").alias("bytes")).orderBy(F.desc("bytes"), "ip").limit(n)


def ports(packets: DataFrame, n: int = 15) -> DataFrame:
    both = packets.select(F.explode(F.array("src_port", "dst_port")).alias("port")).where("port > 0")
    return both.groupBy("port").agg(F.count(F.lit(1)).alias("packets")).orderBy(F.desc("packets"), "port").limit(n).withColumn("service", net.service(F.col("port")))


def counts(packets: DataFrame) -> DataFrame:
    """(kind, value, n): TCP flags, the ten most frequent TTLs, transports."""
    flags = packets.where("tcp_flags_str <> ''").select(F.explode(F.split("tcp_flags_str", " ")).alias("value")).groupBy("value").count()
    ttls = packets.where("ttl > 0").groupBy(F.col("ttl").cast("string").alias("value")).count().orderBy(F.desc("count"), "value").limit(10)
    transports = packets.groupBy(F.col("transport").alias("value")).count()
    named = [df.select(F.lit(k).alias("kind"), "value", F.col("count").alias("n")) for k, df in (("flag", flags), ("ttl", ttls), ("transport", transports))]
    return named[0].union(named[1]).union(named[2])


def buckets(packets: DataFrame, width: float = 15.0) -> DataFrame:
    """(bucket, start_time, packet_count, total_bytes) with empty ones; wider where there would be over MAX_BUCKETS. The last takes the end."""
    span = packets.agg(F.min("timestamp").alias("t0"), F.greatest(F.lit(1.0), F.max("timestamp") - F.min("timestamp")).alias("total")).where("t0 is not null")
    span = span.withColumn("w", F.when(F.col("total") / width > MAX_BUCKETS, F.ceil(F.col("total") / MAX_BUCKETS).cast("double")).otherwise(F.lit(float(width))))
    span = span.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("total") / F.col("w")).cast("int")))
    span = F.broadcast(span)
    at = F.least(F.floor((F.col("timestamp") - F.col("t0")) / F.col("w")).cast("int"), F.col("n") - 1)
    sums = packets.crossJoin(span).groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("c"), F.sum("orig_len").alias("b"))
    spine = span.select("t0", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bucket"))
    return spine.join(sums, "bucket", "left").select(
        "bucket", (F.col("t0") + F.col("bucket") * F.col("w")).alias("start_time"), (F.col("t0") + (F.col("bucket") + 1) * F.col("w")).alias("end_time"),
        F.coalesce("c", F.lit(0)).alias("packet_count"), F.coalesce("b", F.lit(0)).alias("total_bytes"),
    )


def bucket_protocols(packets: DataFrame, width: float = 15.0) -> DataFrame:
    first = F.broadcast(packets.agg(F.min("timestamp").alias("t0")))
    at = F.floor((F.col("timestamp") - F.col("t0")) / width).cast("int")
    return packets.crossJoin(first).groupBy(at.alias("bucket"), "protocol").agg(F.count(F.lit(1)).alias("n"))


def collapse_gaps(rows: DataFrame, min_seconds: float = GAP_SECONDS, share: float = GAP_SHARE) -> DataFrame:
    """Runs of empty buckets as long as the larger of ``min_seconds`` and ``share`` of the span become one gap row; the index is dense again.

    The rows are the timeline's, at most MAX_BUCKETS, so one window over all of them is small.
    """
    order = Window.orderBy("bucket")
    empty = F.col("packet_count") == 0
    run = F.sum(F.when(empty & F.coalesce(F.lag("packet_count").over(order) == 0, F.lit(False)), 0).otherwise(1)).over(order)
    whole = Window.partitionBy()
    width = F.col("end_time") - F.col("start_time")
    need = F.ceil(F.greatest(F.lit(min_seconds), (F.max("end_time").over(whole) - F.min("start_time").over(whole)) * share) / width)
    rows = rows.withColumn("run", run).withColumn("need", need).withColumn("len", F.count(F.lit(1)).over(Window.partitionBy("run")))
    gap = empty & (F.col("len") >= F.col("need"))
    key = F.when(gap, -F.col("run")).otherwise(F.col("bucket") + 1)
    out = rows.withColumn("is_gap", gap).groupBy(key.alias("key"), "is_gap").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("packet_count").alias("packet_count"), F.sum("total_bytes").alias("total_bytes"))
    return out.select((F.row_number().over(Window.orderBy("start_time")) - 1).alias("index"), "start_time", "end_time", "packet_count", "total_bytes", "is_gap")
