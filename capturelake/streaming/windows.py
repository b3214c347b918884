"""Streaming forms of the time operators (extensions): buckets, and sessions by inactivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.functions import net


def buckets(packets: DataFrame, width: str = "15 seconds", late: str = "1 minute", time: str = "ts") -> DataFrame:
    """Packets and bytes by window and protocol; rows later than ``late`` are left out, state is freed by the watermark."""
    return packets.withWatermark(time, late).groupBy(F.window(time, width), "protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("orig_len").alias("bytes")).select("window.start", "window.end", "protocol", "packets", "bytes")


def idle_sessions(packets: DataFrame, gap: str = "60 seconds", late: str = "1 minute", time: str = "ts") -> DataFrame:
    """Sessions of a flow key that end after ``gap`` without a packet; a gap of just that length still joins."""
    rows = packets.withWatermark(time, late).withColumn("session_key", net.session_key())
    return rows.groupBy(F.session_window(time, gap), "session_key").agg(F.count(F.lit(1)).alias("packets"), F.sum("orig_len").alias("bytes")).select("session_key", "session_window.start", "session_window.end", "packets", "bytes")
