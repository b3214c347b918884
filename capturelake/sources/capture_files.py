"""Capture files read in byte ranges: an index of record starts and times first, then only the ranges that a time filter needs.

A range of a file owns the records that begin in it. A range that begins inside a record finds the next one by resynchronising: an offset counts
if headers follow each other from there to the range's end. Small ranges that follow each other are walked in one go, so only the first of them
has to. The index then checks that each range begins where the one before it ended, and walks those that do not again from there, so what is read
never depends on the ranges.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from capturelake import scratch

#: Bytes of a range.
RANGE = 64 << 20
#: A range looks for its first record from so far before its begin: what looks like a header inside a packet's bytes has left that packet by then.
LOOK_BACK = 1 << 20
#: Ranges that follow each other are walked in one go while they are no more than so many, and no longer than so many bytes.
STRETCH, STRETCH_BYTES = 16, 4 << 20
#: No record keeps more bytes of a packet.
LONGEST = 1 << 18
#: Magic numbers of capture files in little-endian order, with the byte order and fractions a second they stand for.
MAGICS = {0xA1B2C3D4: ("<", 10**6), 0xD4C3B2A1: (">", 10**6), 0xA1B23C4D: ("<", 10**9), 0x4D3CB2A1: (">", 10**9)}
#: Block types of the block format, its byte-order mark and the options read.
SECTION, INTERFACE, PACKET, MARK, RESOLUTION, OFFSET = 0x0A0D0D0A, 1, 6, 0x1A2B3C4D, 9, 14
KNOWN_BLOCKS = {SECTION, INTERFACE, PACKET, 2, 3, 4, 5, 10, 0xBAD, 0x40000BAD}


def opened(path: str):
    """The file for random reads, on any file system that Arrow knows; a plain or file: path is a local or mounted one."""
    if local := re.fullmatch(r"(?:file:/*(?=/))?(/.*)", path):
        return pafs.LocalFileSystem().open_input_file(local[1])
    system, name = pafs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def created(path: str):
    """A new file to write, its folder made, on the file systems of :func:`opened`."""
    if local := re.fullmatch(r"(?:file:/*(?=/))?(/.*)", path):
        system, name = pafs.LocalFileSystem(), local[1]
    else:
        system, name = pafs.FileSystem.from_uri(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name)


@dataclass
class Section:
    """Byte order and interfaces in force at a place of a file: (link type, ticks a second, seconds added) each."""

    order: str = "<"
    interfaces: list[tuple[int, int, int]] = field(default_factory=list)
    #: Interfaces before the range that the walk itself has not seen.
    unseen: bool = False


class Pieces:
    """Bytes of a file around a place, read in pieces of a few megabytes."""

    def __init__(self, file, size: int, piece: int = 4 << 20):
        self.file, self.size, self.piece = file, size, piece
        self.at, self.data = 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.data):
            self.data, self.at = self.file.read_at(max(min(self.piece, self.size - at), 0) if n <= self.piece else min(n, self.size - at), at), at
        return self.data[at - self.at : at - self.at + n]


class Pcap:
    """Records with a 16-byte header."""

    first, step = 24, 1

    def __init__(self, head: bytes):
        self.order, self.fraction = MAGICS[struct.unpack("<I", head[:4])[0]]
        self.link = struct.unpack(self.order + "I", head[20:24])[0] & 0xFFFF

    def start(self) -> Section:
        return Section(self.order, [(self.link, self.fraction, 0)])

    def synchronised(self, window: Pieces, low: int, begin: int, goal: int) -> tuple[int, None] | None:
        """As :func:`synchronised`, from ``low``: of all chains that reach ``goal`` the one of most headers. Any bytes can be a header that leads far on, so
        some chain of a few long records nearly always reaches the goal, too.
        """
        data = window.file.read_at(min(goal + 15, window.size) - low, low)
        n = len(data) - 15
        if n <= 0:
            return None
        kind = np.dtype(self.order + "u4")
        word = lambda k: np.ndarray((n,), kind, data, k, (1,))
        # some writers keep more bytes than they tell the packet had, so the length proves nothing
        fraction, kept = word(4), word(8)
        places = np.flatnonzero((fraction < self.fraction) & (kept <= LONGEST))
        after = places + 16 + kept[places]
        inside = after + low <= window.size
        places, after = places[inside], after[inside]
        links: dict[int, int] = {}
        best, most = None, 0
        for at, to in zip(places[::-1].tolist(), after[::-1].tolist()):
            count = 1 if to + low >= goal else links.get(to, -1) + 1
            if count:
                links[at] = count
                # a chain begins at a record with bytes: empty ones are found in any run of zeros
                if count >= most and to > at + 16:
                    best, most = at, count
        if best is None:
            return None
        following = dict(zip(places.tolist(), after.tolist()))
        while best + low < begin:
            best = following[best]
        return best + low, None

    def walk(self, window: Pieces, at: int, stop: int, state: Section) -> Iterator[tuple]:
        """('packet', place, end, interface, ticks, length, data place, kept) of each record that begins before ``stop``."""
        head = struct.Struct(self.order + "IIII")
        while at < stop:
            raw = window.bytes(at, 16)
            if len(raw) < 16:
                return
            seconds, part, kept, length = head.unpack(raw)
            if kept > LONGEST or at + 16 + kept > window.size:
                return
            yield "packet", at, at + 16 + kept, 0, seconds * self.fraction + part, length, at + 16, kept
            at += 16 + kept


class Blocks:
    """Blocks with their length at both ends; sections and interfaces change what follows."""

    first, step, forms = 0, 4, ("<", ">")

    def __init__(self, head: bytes):
        self.order = "<" if struct.unpack("<I", head[8:12])[0] == MARK else ">"

    def start(self) -> Section:
        return Section(self.order)

    def likely(self, data: bytes, form: str) -> np.ndarray:
        n = (len(data) - 8) // 4
        if n <= 0:
            return np.zeros(0, np.int64)
        words = np.frombuffer(data, form + "u4", len(data) // 4)
        kinds, sizes = words[:n], words[1 : n + 1]
        return np.flatnonzero(np.isin(kinds, list(KNOWN_BLOCKS)) & (sizes >= 12) & (sizes % 4 == 0) & (sizes <= 1 << 24)) * 4

    @staticmethod
    def _order(window: Pieces, at: int, kind: int, order: str) -> str:
        if kind != SECTION:
            return order
        return "<" if window.bytes(at + 8, 4) == struct.pack("<I", MARK) else ">"

    def next(self, window: Pieces, at: int, form: str) -> int | None:
        head = window.bytes(at, 12)
        if len(head) < 12:
            return None
        order = self._order(window, at, struct.unpack("<I", head[:4])[0], form)
        kind, size = struct.unpack(order + "II", head[:8])
        if kind not in KNOWN_BLOCKS or size < 12 or size % 4 or at + size > window.size or size > 1 << 24:
            return None
        return at + size if window.bytes(at + size - 4, 4) == struct.pack(order + "I", size) else None

    def walk(self, window: Pieces, at: int, stop: int, state: Section) -> Iterator[tuple]:
        """As in :class:`Pcap`; also ('section', place, end, order) ('interface', place, end, link, ticks a second, seconds added) and
        ('other', place, end). ``state`` follows."""
        while at < stop:
            head = window.bytes(at, 28)
            if len(head) < 12:
                return
            if struct.unpack("<I", head[:4])[0] == SECTION:
                state.order, state.interfaces, state.unseen = self._order(window, at, SECTION, ""), [], False
            kind, size = struct.unpack(state.order + "II", head[:8])
            if size < 12 or size % 4 or at + size > window.size:
                return
            if kind == SECTION:
                yield "section", at, at + size, state.order
            elif kind == INTERFACE and size >= 20:
                state.interfaces.append(self._interface(window.bytes(at + 8, size - 12), state.order))
                yield "interface", at, at + size, *state.interfaces[-1]
            elif kind == PACKET and size >= 32:
                number, high, low, kept, length = struct.unpack(state.order + "IIIII", head[8:28])
                yield "packet" if kept <= size - 32 else "other", at, at + size, number, high << 32 | low, length, at + 28, kept
            else:
                yield "other", at, at + size
            at += size

    @staticmethod
    def _interface(body: bytes, order: str) -> tuple[int, int, int]:
        ticks, added, at = 10**6, 0, 8
        while at + 4 <= len(body):
            code, size = struct.unpack_from(order + "HH", body, at)
            value = body[at + 4 : at + 4 + size]
            if code == 0:
                break
            if code == RESOLUTION and value:
                ticks = 1 << (value[0] & 127) if value[0] & 128 else 10 ** value[0]
            elif code == OFFSET and size == 8:
                added = struct.unpack(order + "q", value)[0]
            at += 4 + size + -size % 4
        return struct.unpack_from(order + "H", body)[0], ticks, added


def layout(window: Pieces) -> Pcap | Blocks | None:
    """How the file is laid out; None if it is no capture."""
    head = window.bytes(0, 24)
    if len(head) < 24:
        return None
    magic = struct.unpack("<I", head[:4])[0]
    return Pcap(head) if magic in MAGICS else Blocks(head) if magic == SECTION else None


def synchronised(kind: Pcap | Blocks, window: Pieces, begin: int, stop: int) -> tuple[int, str | None] | None:
    """(place, form) of the first record at or after ``begin``: the first chain of headers from up to a megabyte before it that holds for a megabyte
    after it, or to the range's or the file's end."""
    if begin <= kind.first:
        return kind.first, getattr(kind, "order", None)
    low = max(kind.first, begin - LOOK_BACK)
    low += -low % kind.step
    goal = min(stop, begin + LOOK_BACK)
    if isinstance(kind, Pcap):
        return kind.synchronised(window, low, begin, goal)
    data = window.file.read_at(min(begin + 2 * LONGEST, window.size) - low, low)
    dead: set[tuple[int, str | None]] = set()
    found = sorted((int(o) + low, form) for form in kind.forms for o in kind.likely(data, form))
    for at, form in found:
        path, here, order = [], at, form
        while (here, order) not in dead and here < goal and here < window.size:
            path.append((here, order))
            after = kind.next(window, here, order)
            if after is None:
                dead.update(path)
                break
            if isinstance(kind, Blocks) and window.bytes(here, 4) == struct.pack("<I", SECTION):
                order = kind._order(window, here, SECTION, order)
            here = after
        else:
            if (here, order) in dead:
                dead.update(path)
                continue
            if first := next(((p, o) for p, o in path if p >= begin), None):
                return first
            if here >= begin:
                return here, order
    return None


INDEX = "path string, size long, no long, begin long, stop long, start long, end long, n long, t_min double, t_max double, carried array<struct<number:int,lo:long,hi:long>>, defined array<struct<at:long,order:string,link:int,ticks:long,added:long>>"


def seconds(ticks: int, interface: tuple[int, int, int]) -> float:
    return ticks // interface[1] + interface[2] + ticks % interface[1] / interface[1]


def _walked(path: str, size: int, no: int, begin: int, stop: int, start: int | None) -> dict:
    """One row of the index. ``start``: where the range before ended, where that is known."""
    with opened(path) as file:
        window = Pieces(file, size)
        return _walked_in(window, layout(window), path, no, begin, stop, start)


def _stretch(path: str, size: int, no: int, begin: int, stop: int, start: int | None, range_bytes: int) -> Iterator[dict]:
    """Rows of the index of the ranges from ``begin`` to ``stop``. Each begins where the one before it ended; the first, and one after a range that
    ended early, find their first record. If ``start`` is given, the first begins there, and a range that ends early is the last."""
    given = start is not None
    with opened(path) as file:
        window = Pieces(file, size)
        kind = layout(window)
        for k, at in enumerate(range(begin, max(stop, begin + 1), range_bytes)):
            end = min(stop, at + range_bytes)
            yield (row := _walked_in(window, kind, path, no + k, at, end, start))
            start = None if row["end"] is None or row["end"] < end else row["end"]
            if given and start is None:
                return


def _walked_in(window: Pieces, kind: Pcap | Blocks | None, path: str, no: int, begin: int, stop: int, start: int | None) -> dict:
    row = {"path": path, "size": window.size, "no": no, "begin": begin, "stop": stop, "start": start, "end": None, "n": 0, "t_min": None, "t_max": None, "carried": [], "defined": []}
    if kind is None:
        return row | {"start": begin, "end": stop}
    state = kind.start()
    if start is None:
        place = synchronised(kind, window, begin, stop)
        if place is None:
            return row
        start, state.order = place[0], place[1] or state.order
    elif isinstance(kind, Blocks):
        state.order = next((o for o in kind.forms if kind.next(window, start, o) is not None), state.order)
    state.unseen = isinstance(kind, Blocks) and start > 0
    times, carried, end = [], {}, start
    for item in kind.walk(window, start, stop, state):
        end = item[2]
        if item[0] == "packet":
            number, ticks = item[3], item[4]
            row["n"] += 1
            if state.unseen:
                lo, hi = carried.get(number, (ticks, ticks))
                carried[number] = (min(lo, ticks), max(hi, ticks))
            elif number < len(state.interfaces):
                times.append(seconds(ticks, state.interfaces[number]))
        elif item[0] == "section":
            row["defined"].append({"at": item[1], "order": item[3], "link": None, "ticks": None, "added": None})
        elif item[0] == "interface":
            row["defined"].append({"at": item[1], "order": state.order, "link": item[3], "ticks": item[4], "added": item[5]})
    row |= {"start": start, "end": max(end, start), "carried": [{"number": k, "lo": lo, "hi": hi} for k, (lo, hi) in carried.items()]}
    if times:
        row |= {"t_min": min(times), "t_max": max(times)}
    return row


def at_place(defined: list[dict], place: int, order: str = "<") -> Section:
    """Section and interfaces in force at a place, of a file's definitions."""
    state = Section(order)
    for d in sorted(defined, key=lambda d: d["at"]):
        if d["at"] >= place:
            break
        if d["link"] is None:
            state = Section(d["order"])
        else:
            state.interfaces.append((d["link"], d["ticks"], d["added"]))
    return state


def arrow_schema(names: str) -> pa.Schema:
    """A schema in Spark's words as Arrow's; on the driver alone."""
    return to_arrow_schema(StructType.fromDDL(names))


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """Rows that stand for much work each, evenly in several tasks a core, of up to ``most`` rows. A number is given, as adaptive execution goes by the bytes of
    the rows and would join them all into one task."""
    n = rows.count()
    return rows.repartition(max(1, min(n, 4 * rows.sparkSession.sparkContext.defaultParallelism), -(-n // most)))


def _walks(range_bytes: int):
    schema = arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for rows in batched(_stretch(**r, range_bytes=range_bytes), 256):
                    yield pa.RecordBatch.from_pylist(list(rows), schema)

    return run


def index(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE) -> DataFrame:
    """One row a range of each capture file at ``path``: first record, end, number and times of records, and what the file defines.

    Files that are no capture have no records. The index walks record headers; no packet is decoded.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    together = max(1, min(STRETCH, STRETCH_BYTES // range_bytes))
    long = together * range_bytes
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / long).cast("long")))
    stretches = files.select("path", "size", k.alias("k")).select("path", "size", (F.col("k") * together).alias("no"), (F.col("k") * long).alias("begin"), F.least("size", (F.col("k") + 1) * long).alias("stop"), F.lit(None).cast("long").alias("start"))
    found = scratch.cut(dealt(stretches, 64).mapInArrow(_walks(range_bytes), INDEX))
    by_place, reach = Window.partitionBy("path").orderBy("no"), long
    before, following = F.lag("end").over(by_place), F.lead("begin").over(by_place)
    while True:
        # a range must begin where the one before it ended; where it does not, it is walked again from there. Where the one before has no end
        # yet, that one comes first. A file ends at its first record that is cut off or no record.
        checked = found.withColumn("due", before).withColumn("wrong", F.expr("no > 0 and (start is null or start <> coalesce(due, start))"))
        ends = checked.where("not wrong and end < stop").groupBy("path").agg(F.min("no").alias("last"))
        checked = checked.join(ends, "path", "left")
        wrong = checked.where("wrong and due is not null and no <= coalesce(last, no)")
        if wrong.isEmpty():
            found = checked.withColumn("n", F.when(F.col("no") > F.col("last"), 0).otherwise(F.col("n"))).select(*found.columns)
            break
        # the ranges after it are walked on, too, up to the next wrong one and twice as far each time: turns grow with the logarithm of a file's ranges
        until = F.least("size", F.col("begin") + reach, F.coalesce(following, "size"))
        again = scratch.cut(dealt(wrong.select("path", "size", "no", "begin", until.alias("stop"), F.col("due").alias("start")), 1024).mapInArrow(_walks(range_bytes), INDEX))
        found = scratch.cut(found.join(again.select("path", "no"), ["path", "no"], "left_anti").unionByName(again))
        reach *= 2
    return _settled(found)


def _settled(found: DataFrame) -> DataFrame:
    """The index with each range's times in seconds, the definitions of its file, and ``before``: the records before it, files by name."""
    of_file = found.select("path", F.explode("defined").alias("d")).groupBy("path").agg(F.array_sort(F.collect_list("d")).alias("known"))
    schema = f"{INDEX}, known array<struct<at:long,order:string,link:int,ticks:long,added:long>>"

    kinds = arrow_schema(schema)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                state = at_place(r["known"] or [], r["start"] or 0)
                times = [seconds(c[x], state.interfaces[c["number"]]) for c in r["carried"] for x in ("lo", "hi") if c["number"] < len(state.interfaces)]
                times += [t for t in (r["t_min"], r["t_max"]) if t is not None]
                r |= {"t_min": min(times, default=None), "t_max": max(times, default=None)}
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    done = scratch.cut(found.join(of_file, "path", "left").select(*found.columns, "known").mapInArrow(settle, schema))
    files = done.groupBy("path").agg(F.sum("n").alias("all")).withColumn("earlier", F.coalesce(F.sum("all").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return done.join(files.select("path", "earlier"), "path").withColumn("before", F.col("earlier") + inside).drop("earlier")


def records(indexed: DataFrame, time_range: tuple[float, float] | None, emit, schema: str, counter=None) -> DataFrame:
    """The packets of the ranges of :func:`index`: ``emit(rows)`` makes a record batch of (number, time, length, link type, bytes).

    Ranges that lie outside the time range are not opened, packets outside of it are not handed to ``emit``. A packet's number is its place in
    the files, by name. ``counter``: an accumulator of the packets handed over.
    """
    lo, hi = time_range or (-np.inf, np.inf)
    wanted = indexed.where("n > 0")
    if time_range:
        wanted = wanted.where((F.col("t_max") >= lo) & (F.col("t_min") <= hi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["path"]) as file:
                    # a range and its last record, no more of what comes after
                    window = Pieces(file, r["size"], min(4 << 20, r["stop"] - r["start"] + 4096) if r["stop"] > r["start"] else 4096)
                    kind = layout(window)
                    state = at_place(r["known"] or [], r["start"]) if isinstance(kind, Blocks) else kind.start()
                    if isinstance(kind, Blocks) and not (r["known"] and r["known"][0]["at"] < r["start"]):
                        state.order = kind.order
                    rows, number = [], r["before"]
                    for item in kind.walk(window, r["start"], r["stop"], state):
                        if item[0] != "packet":
                            continue
                        number += 1
                        if item[3] >= len(state.interfaces):
                            continue
                        interface = state.interfaces[item[3]]
                        time = seconds(item[4], interface)
                        if lo <= time <= hi:
                            rows.append((number - 1, time, item[5], interface[0], window.bytes(item[6], item[7])))
                        if len(rows) >= 10_000:
                            if counter is not None:
                                counter.add(len(rows))
                            yield emit(rows)
                            rows = []
                    if rows:
                        if counter is not None:
                            counter.add(len(rows))
                        yield emit(rows)

    return dealt(wanted.select("path", "size", "start", "stop", "before", "known"), 1024).mapInArrow(run, schema)
