"""Session boundaries of a stream of packets: the fold of the batch form, a flow of state at a time."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegerType, StructField, StructType

from capturelake.functions import net
from capturelake.operators.sessions import SIGNALS, Boundary

#: The event time of a packet in the stream's plan, made from its timestamp.
TIME = "_time"
#: The column that flows are dealt out by, and into how many.
BUCKET, BUCKETS = "_bucket", 4096
READ = ("session_key", "timestamp", "transport", "tcp_flags_str", "seq_num", *(c for names in SIGNALS.values() for c in names))


def _micros(packet: tuple, at: int) -> int:
    return int(packet[at] * 1_000_000)


class Fold(StatefulProcessor):
    """Keeps what the rule needs of a bucket's flows (each one's boundary state and the number of its splits) and the packets that wait.

    A call to the state is a round trip to the JVM, so flows are dealt out into buckets and a bucket's state is read and written as a whole.
    A packet waits until the watermark has passed it: only then no earlier one can come. Waiting packets are a list of pieces, a piece
    for each call, so that a call writes its own rows alone, and are read when one of them is due; those that are due are put in order of flow,
    time and seq_no, folded and given out.
    """

    def __init__(self, rows: StructType, keep_ms: int):
        self.names, self.keep_ms = rows.names, keep_ms
        self.key, self.time, self.number = (self.names.index(c) for c in ("session_key", "timestamp", "seq_no"))
        self.read = [(c, self.names.index(c), to_arrow_type(rows[c].dataType)) for c in READ if c in self.names and c != "session_key"]

    def init(self, handle) -> None:
        self.handle = handle
        self.flows = handle.getValueState("flows", "packed binary")
        self.first = handle.getValueState("first", "us long")
        self.waiting = handle.getListState("waiting", "packets binary")

    def close(self) -> None:
        pass

    def _first(self, packets: list[tuple]) -> int:
        return min(_micros(p, self.time) for p in packets)

    def _known(self) -> dict[str, tuple]:
        """(boundary state, generation, last time) by flow."""
        return pickle.loads(self.flows.get()[0]) if self.flows.exists() else {}

    def _folded(self, due: list[tuple], flows: dict[str, tuple]) -> list[int]:
        """Generations of packets in order of flow and time; ``flows`` follows. Over ``keep`` of rest a flow begins anew, whether it has been forgotten by
        then or not: so no split into micro-batches makes a difference."""
        lives, entries, ends = [], {}, {}
        flow, last, life = None, 0, 0
        for p in due:
            key, at = p[self.key], _micros(p, self.time)
            if key != flow:
                flow, life, kept = key, 0, flows.get(key)
                last = kept[2] if kept else at
                if kept:
                    entries[f"{key}\0{life}"] = kept[:2]
            life, last = life + (at - last > self.keep_ms * 1000), at
            lives.append(f"{key}\0{life}")
            ends[key] = (lives[-1], at)
        boundary = Boundary(entries=entries)
        columns = [pa.array(lives, pa.string()), *(pa.array([p[i] for p in due], kind) for _, i, kind in self.read)]
        found = boundary.feed(pa.RecordBatch.from_arrays(columns, names=["session_key", *(c for c, _, _ in self.read)]))
        flows.update({key: (*boundary.exits[name], at) for key, (name, at) in ends.items()})
        return found

    def _due(self, first: int | None, watermark_ms: int) -> Iterator[Row]:
        """The packets up to the watermark, with their generation; sets the timer of what is left. ``first``: the time of the first that waits."""
        flows = None
        if first is not None and first <= watermark_ms * 1000:
            packets = [p for piece in self.waiting.get() for p in pickle.loads(piece[0])]
            due = sorted((p for p in packets if _micros(p, self.time) <= watermark_ms * 1000), key=lambda p: (p[self.key], p[self.time], p[self.number]))
            left = [p for p in packets if _micros(p, self.time) > watermark_ms * 1000]
            flows = self._known()
            generations = self._folded(due, flows)
            self.flows.update((pickle.dumps(flows),))
            if left:
                first = self._first(left)
                self.waiting.put([(pickle.dumps(left),)])
                self.first.update((first,))
            else:
                first = None
                self.waiting.clear()
                self.first.clear()
            out = Row(*self.names, "generation")
            yield from (out(*p, g) for p, g in zip(due, generations, strict=True))
        # one timer a bucket: when its next packet is due, or when flows at rest are forgotten, some time late so that several go at once
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if first is not None:
            self.handle.registerTimer(max(first // 1000 + 1, watermark_ms + 1))
        elif flows := self._known() if flows is None else flows:
            oldest = min(at for *_, at in flows.values())
            self.handle.registerTimer(max(oldest // 1000 + 1 + self.keep_ms + self.keep_ms // 4, watermark_ms + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        packets, places = [], None
        for r in rows:
            places = places or [r.__fields__.index(c) for c in self.names]
            packets.append(tuple(tuple(r)[i] for i in places))
        first = self.first.get()[0] if self.first.exists() else None
        if packets:
            self.waiting.appendValue((pickle.dumps(packets),))
            earliest = self._first(packets)
            if first is None or earliest < first:
                first = earliest
                self.first.update((first,))
        yield from self._due(first, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        first = self.first.get()[0] if self.first.exists() else None
        if first is None or first > watermark * 1000:
            flows = {f: kept for f, kept in self._known().items() if kept[2] + self.keep_ms * 1000 > watermark * 1000}
            if flows:
                self.flows.update((pickle.dumps(flows),))
            else:
                self.flows.clear()
        yield from self._due(first, watermark)


def with_generations(packets: DataFrame, late: str = "1 minute", keep_seconds: float = 86_400.0, buckets: int = BUCKETS) -> DataFrame:
    """A stream of packets with session_key, generation and session_id, by the rule of the batch form
    (:func:`capturelake.operators.sessions.with_generations`), whatever micro-batches the packets come in.

    Packets may come out of order by ``late``; later ones are dropped by Spark, as with any watermark. A packet is given out once the watermark has
    passed it, so what a flow holds is bounded by its packets within ``late``. A flow is forgotten ``keep_seconds`` after its last packet;
    if it comes back after that its generations begin at 0 again, else they go on. Packets without an
    address or a time go; packets of equal time go by seq_no. Flows are kept in ``buckets`` by a hash, a number that must stay while a stream lives; more of them
    mean less state read and written for a packet, but more calls. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = packets.where("src_ip <> '' and dst_ip <> '' and timestamp is not null").withColumns({"session_key": net.session_key(), "seq_num": F.col("seq_num").cast("long")})
    timed = rows.withColumn(TIME, F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("long"))).withWatermark(TIME, late)
    out = StructType([*rows.schema.fields, StructField("generation", IntegerType())])
    named = timed.withColumn(BUCKET, F.pmod(F.xxhash64("session_key"), F.lit(buckets)).cast("int")).groupBy(BUCKET).transformWithState(Fold(rows.schema, int(keep_seconds * 1000)), out, "Append", "EventTime")
    return named.withColumn("session_id", F.when(F.col("generation") > 0, F.concat("session_key", F.lit("#"), F.col("generation").cast("string"))).otherwise(F.col("session_key")))


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
