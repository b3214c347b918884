"""Bidirectional sessions: boundaries, metrics, and their joins to edges and packets."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from capturelake import scratch
from capturelake.functions import net

TCP_GAP, UDP_GAP = 120.0, 60.0
SEQ_JUMP, SEQ_JUMP_GAP, SEQ_SPACE = 1_000_000, 5.0, 2**32
CLOSE_GRACE = 5.0
#: A packet is of one of these protocols if it has a value in a column of it; packets of one so many seconds apart are of two sessions.
SIGNALS = {"dhcp": ("dhcp_msg_type", "dhcp_xid"), "dns": ("dns_query", "dns_qr"), "http": ("http_method", "http_status", "http_host")}
QUIET = {"dhcp": 10.0, "dns": 10.0, "http": 30.0}


def by_gap(packets: DataFrame) -> DataFrame:
    """Adds session_key and generation from the time gap alone: exact for UDP without protocol signals."""
    order = Window.partitionBy("session_key").orderBy("timestamp", "seq_no")
    limit = F.when(F.col("transport") == "TCP", TCP_GAP).otherwise(UDP_GAP)
    rows = packets.where("src_ip <> '' and dst_ip <> ''").withColumn("session_key", net.session_key())
    gap = F.col("timestamp") - F.lag("timestamp").over(order)
    rows = rows.withColumn("_new", F.when(F.coalesce(gap > limit, F.lit(False)), 1).otherwise(0))
    return rows.withColumn("generation", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def _protocol_split(seen: dict, kinds: list[str], xid, t: float) -> bool:
    """Does a protocol's own rule open a new session at time t? ``seen`` has the last times by protocol and the last xid."""
    if "dhcp" in kinds:
        quiet = seen.get("dhcp", 0) > 0 and t - seen["dhcp"] > QUIET["dhcp"]
        seen["dhcp"] = t
        if quiet:
            seen["xid"] = xid
            return True
    if xid:
        before, seen["xid"] = seen.get("xid"), xid
        if before is not None and before != xid:
            return True
    for kind in ("dns", "http"):
        if kind in kinds:
            before, seen[kind] = seen.get(kind, 0), t
            if before > 0 and t - before > QUIET[kind]:
                return True
    return False


class Boundary:
    """The boundary rule over packets in order of flow and time, a packet of state: what closed the session, the last time and numbers, and the
    protocols' last times. ``entry`` is the state of the flow whose packets come first, if it began before. With ``entries``, (state, generation) by flow
    of all that began before, ``exits`` has the same of all flows fed."""

    FRESH = ((0.0, 0.0, None, None, ()), 0)

    def __init__(self, entry: tuple | None = None, generation: int = 0, entries: dict[str, tuple] | None = None):
        self.flow, self.state, self.generation = None, self.FRESH[0], generation
        self.entries, self.exits = entries, {}
        if entry:
            self.flow, self.state = entry

    def feed(self, batch: pa.RecordBatch) -> list[int]:
        """The generation of each row."""
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("session_key", "timestamp", "transport", "tcp_flags_str", "seq_num")]
        marks = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for names in SIGNALS.values() for c in names if c in batch.schema.names}
        flow, generation, (closed, last, seq, isn, known) = self.flow, self.generation, self.state
        seen, out = dict(known), []
        for row, (key, t, transport, said, number) in enumerate(zip(*columns, strict=True)):
            if key != flow:
                if self.entries is not None and flow is not None:
                    self.exits[flow] = ((closed, last, seq, isn, tuple(sorted(seen.items()))), generation)
                flow, ((closed, last, seq, isn, known), generation) = key, (self.entries or {}).get(key, self.FRESH)
                seen = dict(known)
            tcp, flags = transport == "TCP", (said or "").split(" ")
            syn, ack = "SYN" in flags, "ACK" in flags
            gap = t - last if last and last > 0 and t is not None else 0.0
            reopened = tcp and closed > 0 and ((syn and not ack) or (syn and ack and None not in (isn, number) and number != isn) or (t is not None and t - closed > CLOSE_GRACE))
            raw = abs(number - seq) if None not in (number, seq) else 0
            jump = tcp and min(raw, SEQ_SPACE - raw) > SEQ_JUMP and gap > SEQ_JUMP_GAP
            split = reopened or gap > (TCP_GAP if tcp else UDP_GAP) or jump
            if marks and not split and t is not None:
                kinds = [k for k, names in SIGNALS.items() if any(marks[c][row] for c in names if c in marks)]
                split = bool(kinds) and _protocol_split(seen, kinds, marks["dhcp_xid"][row] if "dhcp_xid" in marks else None, t)
            if split:
                generation, closed, seq, isn = generation + 1, 0.0, None, None
            elif tcp:
                if closed == 0 and t is not None and ("FIN" in flags or "RST" in flags):
                    closed = t
                seq, isn = number, number if syn and ack else isn
            last = t
            out.append(generation)
        self.flow, self.generation, self.state = flow, generation, (closed, last, seq, isn, tuple(sorted(seen.items())))
        if self.entries is not None and flow is not None:
            self.exits[flow] = (self.state, generation)
        return out


def _ends(rows: DataFrame, entries: dict[int, tuple], wanted: set[int] | None) -> list:
    """For each partition (of ``wanted``) with rows: part, its first and last flow, the splits inside the first, and the last one's state and
    generation at the end. Only rows of these two flows are folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if wanted is not None and part not in wanted:
            return
        boundary, first, splits, last = Boundary(entries.get(part)), None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index("session_key"))
            first, last = keys[0].as_py() if first is None else first, keys[-1].as_py()
            mine = batch.filter(pc.or_(pc.equal(keys, first), pc.equal(keys, last)))
            found = boundary.feed(mine)
            of_first = pc.sum(pc.equal(mine.column(mine.schema.get_field_index("session_key")), first)).as_py()
            splits = found[of_first - 1] if of_first else splits
        if first is not None:
            exit_state = pickle.dumps((boundary.flow, boundary.state))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (first, pa.string()), (last, pa.string()), (splits, pa.int32()), (boundary.generation, pa.int32()), (exit_state, pa.binary()))], names=["part", "first", "last", "splits", "generation", "state"])

    return rows.mapInArrow(run, "part int, first string, last string, splits int, generation int, state binary").collect()


def _folded(rows: DataFrame) -> DataFrame:
    """Adds generation to rows whose partitions are ranges of (flow, time, seq_no), each sorted.

    A flow may span partitions. Each partition is folded as if its first flow began there; then again with the state in which the one
    before it ended, as long as that changes. A gap over the limit resets the state, so most flows settle in one more pass; a busy
    flow without such a gap takes a pass a partition. A partition's ends are a few values; the driver sees nothing else.
    """
    entries: dict[int, tuple] = {}
    ends = {r["part"]: r for r in _ends(rows, entries, None)}
    order = sorted(ends)
    while True:
        due = {p: ends[q]["state"] for q, p in pairwise(order) if ends[q]["last"] == ends[p]["first"]}
        changed = {p for p, state in due.items() if entries.get(p) != pickle.loads(state)}
        if not changed:
            break
        entries |= {p: pickle.loads(due[p]) for p in changed}
        ends |= {r["part"]: r for r in _ends(rows, entries, changed)}
    before = dict.fromkeys(order, 0)
    for q, p in pairwise(order):
        if p in due:
            before[p] = ends[q]["generation"] + (before[q] if ends[q]["first"] == ends[q]["last"] else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        boundary = Boundary(entries.get(part), before.get(part, 0))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(boundary.feed(batch), pa.int32())], names=[*batch.schema.names, "generation"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("generation", IntegerType())]))


def with_generations(packets: DataFrame) -> DataFrame:
    """Adds session_key, generation and session_id by all signals, with an ordered fold over each flow.

    A flow splits at: a packet after FIN or RST that opens a connection (pure SYN, SYN-ACK of a new
    number) or comes over 5 s later; a gap over 120 s (TCP) or 60 s; a sequence jump over a million with a gap over 5 s; and, where
    the packets have the columns of SIGNALS, DNS or DHCP packets over 10 s or HTTP ones over 30 s apart, or another DHCP transaction.
    Without such columns, flows without a TCP packet take the window form. The rest are dealt out in ranges of flow and time, so a flow
    of all packets is spread over all tasks, and folded range by range with a state of one packet (:func:`_folded`). Packets of equal time go
    by seq_no; ones without an address go.
    """
    rows = packets.where("src_ip <> '' and dst_ip <> ''").withColumn("session_key", net.session_key()).withColumn("seq_num", F.col("seq_num").cast("long"))
    signals = any(c in packets.columns for names in SIGNALS.values() for c in names)
    tcp = F.coalesce(F.col("transport") == "TCP", F.lit(False))
    parts = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["session_key", "timestamp", "seq_no"]
    # checkpointed, so that every pass sees the same ranges
    named = _folded(scratch.cut((rows if signals else rows.where(tcp)).repartitionByRange(parts, *order).sortWithinPartitions(*order)))
    if not signals:
        named = named.unionByName(by_gap(packets.where(~tcp)).withColumn("seq_num", F.col("seq_num").cast("long")))
    return named.withColumn("session_id", F.when(F.col("generation") > 0, F.concat("session_key", F.lit("#"), F.col("generation").cast("string"))).otherwise(F.col("session_key")))


def sessions(packets: DataFrame) -> DataFrame:
    """Sessions of packets that have session_id: totals, directions by the running initiator, TCP state, ranges.

    Packets with window_size or ack_num also give the window's range and mean by direction, or the first and last number.
    The initiator of a packet is the sender of the last pure SYN up to it, else of the session's first packet.
    """
    order = Window.partitionBy("session_id").orderBy("timestamp", "seq_no")
    flags = F.split("tcp_flags_str", " ")
    has = lambda f: F.array_contains(flags, f)
    ends = F.struct("src_ip", "src_port", "dst_ip", "dst_port")
    opener = F.last(F.when(has("SYN") & ~has("ACK"), ends), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = packets.withColumn("_who", F.coalesce(opener, F.first(ends).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    forward = F.col("src_ip") == F.col("_who.src_ip")
    at = F.struct("timestamp", "seq_no")
    count = lambda c: F.count_if(c)
    sent = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0))
    specific = F.min_by("protocol", F.when(F.col("protocol") != F.col("transport"), at))
    more = []
    if "window_size" in packets.columns:
        for side, mine in (("fwd", forward), ("rev", ~forward)):
            size = F.when(mine & (F.col("window_size") > 0), F.col("window_size"))
            more += [F.min(size).alias(f"{side}_window_min"), F.max(size).alias(f"{side}_window_max"), F.avg(size).alias(f"{side}_window_avg")]
    if "ack_num" in packets.columns:
        known = F.when(F.col("ack_num") > 0, at)
        more += [F.min_by("ack_num", known).alias("ack_first"), F.max_by("ack_num", known).alias("ack_last")]
    names = ["fwd_window_min", "fwd_window_max", "fwd_window_avg", "rev_window_min", "rev_window_max", "rev_window_avg"] if "window_size" in packets.columns else []
    names += ["ack_first", "ack_last"] if "ack_num" in packets.columns else []
    out = rows.groupBy(F.col("session_id").alias("id")).agg(
        *more,
        F.max_by("_who", at).alias("who"), F.min_by("transport", at).alias("transport"), F.min_by("protocol", at).alias("_first"), specific.alias("_specific"),
        F.count(F.lit(1)).alias("packet_count"), F.sum("orig_len").alias("total_bytes"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
        count(forward).alias("fwd_packets"), sent(forward, "orig_len").alias("fwd_bytes"), count(~forward).alias("rev_packets"), sent(~forward, "orig_len").alias("rev_bytes"),
        count(has("SYN")).alias("syn"), count(has("ACK")).alias("ack"), count(has("FIN")).alias("fin"), count(has("RST")).alias("rst"),
        F.coalesce(F.min(F.when(F.col("ttl") > 0, F.col("ttl"))), F.lit(0)).alias("ttl_min"), F.coalesce(F.max("ttl"), F.lit(0)).alias("ttl_max"),
        F.coalesce(F.min_by("seq_num", F.when(F.col("seq_num") > 0, at)), F.lit(0)).alias("seq_first"), F.coalesce(F.max_by("seq_num", F.when(F.col("seq_num") > 0, at)), F.lit(0)).alias("seq_last"),
    )
    return out.select(
        "id", "who.src_ip", "who.src_port", "who.dst_ip", "who.dst_port", "transport",
        F.when(F.col("_first") == F.col("transport"), F.coalesce("_specific", "_first")).otherwise(F.col("_first")).alias("protocol"),
        "packet_count", "total_bytes", "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"), "fwd_packets", "fwd_bytes", "rev_packets", "rev_bytes",
        ((F.col("syn") >= 2) & (F.col("ack") >= 1)).alias("has_handshake"), (F.col("fin") >= 1).alias("has_fin"), (F.col("rst") >= 1).alias("has_reset"), "ttl_min", "ttl_max", "seq_first", "seq_last", *names,
    )


def of_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge, session): equal pairs in either direction whose protocol or transport is the edge's."""
    s = found.select(F.col("id").alias("session"), F.least("src_ip", "dst_ip").alias("a"), F.greatest("src_ip", "dst_ip").alias("b"), F.explode(F.array_distinct(F.array("protocol", "transport"))).alias("protocol"))
    e = edges.select(F.col("id").alias("edge"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "protocol")
    return e.join(s, ["a", "b", "protocol"]).select("edge", "session").distinct()


def of_subnet_edges(found: DataFrame, edges: DataFrame, prefix: int, carry: bool = False) -> DataFrame:
    """The same for edges between networks of one prefix length: the addresses' networks make it an equality join."""
    a, b = net.subnet(F.col("src_ip"), prefix, carry), net.subnet(F.col("dst_ip"), prefix, carry)
    s = found.select(F.col("id").alias("session"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.explode(F.array_distinct(F.array("protocol", "transport"))).alias("protocol"))
    e = edges.select(F.col("id").alias("edge"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "protocol")
    return e.join(s, ["a", "b", "protocol"]).select("edge", "session").distinct()


def of_analysis_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge, session) of the analysis graph's edges (a, b, protocols), named a|b: sessions between the two addresses, in either direction, whose protocol or
    transport is one of the edge's; a session that fits by several is there once."""
    return of_edges(found, edges.select(F.concat_ws("|", "a", "b").alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.explode("protocols").alias("protocol")))


def page(found: DataFrame, sort: str = "total_bytes", limit: int = 100, offset: int = 0) -> DataFrame:
    """Sessions by bytes, packets or duration, largest first, or by start time."""
    key = F.col(sort) if sort == "start_time" else F.desc(sort)
    return found.orderBy(key, "id").offset(offset).limit(limit)


def edge_initiators(found: DataFrame) -> DataFrame:
    """(a, b, initiator) of each pair: the one address that opened its sessions, or 'both'."""
    pairs = found.groupBy(F.least("src_ip", "dst_ip").alias("a"), F.greatest("src_ip", "dst_ip").alias("b"))
    return pairs.agg(F.min("src_ip").alias("lo"), F.max("src_ip").alias("hi")).select("a", "b", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("both").alias("initiator"))
