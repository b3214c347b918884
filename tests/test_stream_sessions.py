"""The fold over a stream: any micro-batches give what the batch form gives; flows at rest are forgotten."""

import random

import pytest
from test_sessions import COLUMNS, packet

from capturelake.operators import sessions as ses
from capturelake.streaming import sessions as stream

LATE = 30
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


@pytest.fixture(autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, stream.PROVIDER)
    yield
    spark.conf.set(name, before)


def run(spark, folder, frame, pieces, **options):
    """Rows of ``frame`` by the stream, a file for each list of numbers in ``pieces``."""
    for n, piece in enumerate(pieces):
        part = frame.where(frame["seq_no"].isin(piece)).coalesce(1)
        part.write.mode("append").parquet(str(folder / "in" / f"{n:04}"))
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder / "in"))
    query = stream.with_generations(source, f"{LATE} seconds", **options).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    return spark.read.parquet(str(folder / "out"))


def flows(rng, n):
    rows, at = [], 0.0
    for i in range(n):
        at += rng.choice([0.1] * 30 + [4.0, 6.0, 11.0, 121.0])
        row = list(packet(i, at, rng.choice(["ACK"] * 30 + ["SYN", "SYN ACK", "FIN ACK", "RST"]), rng.choice([i, i, i, 5_000_000 + i, None])))
        row[NAMES.index("src_port")] = rng.choice([5, 6])
        rows.append(tuple(row))
    # another flow's packet, long after: the watermark passes all others
    last = list(packet(n, at + 1000, "ACK", 1))
    last[NAMES.index("src_port")] = 7
    return [*rows, tuple(last)]


@pytest.mark.parametrize("size,jump", [(200, 0), (37, 12)])
def test_any_split_equals_the_batch_form(spark, tmp_path, size, jump):
    rng = random.Random(size)
    rows = flows(rng, 400)
    frame = spark.createDataFrame(rows, COLUMNS)
    # places are out of order by less than the watermark's delay
    times = {r[NAMES.index("seq_no")]: r[NAMES.index("timestamp")] for r in rows}
    order = sorted(times, key=lambda n: times[n] + rng.uniform(0, jump))
    pieces = [order[i : i + size] for i in range(0, len(order), size)]
    want = {r["seq_no"]: (r["generation"], r["session_id"]) for r in ses.with_generations(frame).collect()}
    found = [(r["seq_no"], (r["generation"], r["session_id"])) for r in run(spark, tmp_path, frame, pieces).collect()]
    assert len(found) == len(dict(found)) == 400
    assert dict(found) == {k: v for k, v in want.items() if k < 400} and max(g for g, _ in want.values()) > 8


def test_flows_at_rest_are_forgotten(spark, tmp_path):
    def other(n, at):
        row = list(packet(n, at, "ACK", n))
        row[NAMES.index("src_port")] = 9
        return tuple(row)

    rows = [packet(0, 0, "ACK", 0), packet(1, 130, "ACK", 0), other(2, 2000), packet(3, 2001, "ACK", 0), other(4, 9000)]
    frame = spark.createDataFrame(rows, COLUMNS)
    for keep, generation in ((600, 0), (86_400, 2)):
        folder = tmp_path / str(keep)
        found = {r["seq_no"]: r["generation"] for r in run(spark, folder, frame, [[0, 1], [2], [3], [4]], keep_seconds=keep).collect()}
        assert found == {0: 0, 1: 1, 2: 0, 3: generation}


def test_many_flows_of_a_bucket(spark, tmp_path):
    """Three buckets of 60 flows, which begin, split, rest and go on in different micro-batches."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        row = list(packet(i, i * 0.5 + rng.uniform(0, 5), rng.choice(["ACK"] * 9 + ["SYN", "FIN ACK"]), i))
        row[NAMES.index("src_port")] = 100 + rng.randrange(60)
        rows.append(tuple(row))
    last = list(packet(900, 10_000, "ACK", 1))
    frame = spark.createDataFrame([*rows, tuple(last)], COLUMNS)
    want = {r["seq_no"]: r["generation"] for r in ses.with_generations(frame).collect() if r["seq_no"] < 900}
    found = [(r["seq_no"], r["generation"]) for r in run(spark, tmp_path, frame, [list(range(i, i + 300)) for i in range(0, 900, 300)] + [[900]], buckets=3).collect()]
    assert len(found) == 900 and dict(found) == want and max(want.values()) > 1
