"""Queries over payload bytes; an event's type and properties stand for a packet's payload."""

from __future__ import annotations

from pyspark.sql import functions as F

from capturelake.functions import payload
from capturelake.queries.registry import Registry

R = Registry()


def _payloads(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq_no"), F.encode(F.concat("event_type", "props"), "UTF-8").alias("data"))


R.add("a47_payload_entropy", lambda s, d: _payloads(s, d).select("seq_no", payload.entropy(F.col("data")).alias("entropy")).withColumn("label", payload.entropy_label(F.col("entropy"))),
      """WITH p AS (SELECT event_id, concat(event_type, props) t FROM events), c AS (SELECT event_id, unnest(string_split(t, '')) ch, length(t) n FROM p),
      g AS (SELECT event_id, n, count(*) / n q FROM c GROUP BY event_id, n, ch), e AS (SELECT event_id seq_no, CASE WHEN n >= 16 THEN round(-sum(q * log2(q)), 2) END entropy FROM g GROUP BY event_id, n)
      SELECT *, CASE WHEN entropy < 1 THEN 'Structured/repetitive' WHEN entropy < 3.5 THEN 'Low entropy (structured binary)' WHEN entropy < 5 THEN 'Text/markup' WHEN entropy < 6.5 THEN 'Mixed/encoded' END "label" FROM e""", packets=False)  # fmt: skip
R.add("x13_iso_epoch", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", payload.iso_epoch(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("seconds")),
      "SELECT event_id, CAST(epoch_us(date_trunc('second', ts)) / 1000000 AS DOUBLE) AS seconds FROM events", packets=False)
