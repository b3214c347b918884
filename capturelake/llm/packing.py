"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import cut, documents
from capturelake.llm.tokens import encoder, model_path, slices

CAPACITY = 1024
END_ID = 2
#: Pieces that one population packs; the blocks are independent problems of this size whatever the corpus is.
BLOCK = 4096
ISLANDS = 3
POPULATION = 4
EPOCHS = 3
#: Children an island makes in an epoch.
CHILDREN = 10

#: A bin is its load and its items.
Bins = list[tuple[int, list[int]]]


def pieces(docs: DataFrame, model: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each row's ids and ``end_id``, cut into pieces of ``capacity``.

    A document of up to ``capacity`` tokens is one piece; of a longer one the first piece takes what is over.
    A null text counts as '' and is one piece of the end id. Null ids stay null; rows that repeat are cut each for itself;
    an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                rows = []
                for d, raw in zip(doc_ids[a:b], enc.encode(texts[a:b])):
                    ids = np.append(np.frombuffer(raw, enc.dtype), enc.dtype.type(end_id)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
                    for i, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
                        rows.append((d, i, x, y - x, zlib.crc32(ids[x:y])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(items: list[int], lengths: list[int], bins: Bins, capacity: int) -> Bins:
    """Puts ``items``, longest first, into the fullest bin with room, or into a new one. ``bins`` itself stays as it is."""
    bins = list(bins)
    free = sorted((capacity - load, n) for n, (load, _) in enumerate(bins) if load < capacity)
    for i in sorted(items, key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, n = free.pop(at)
            load, inside = bins[n]
            bins[n] = (load + size, [*inside, i])
        else:
            room, n = capacity, len(bins)
            bins.append((size, [i]))
        if room > size:
            insort(free, (room - size, n))
    return bins


def fitness(bins: Bins) -> tuple[int, int]:
    """Fewer bins first, then the sum of the squared loads: of two packings in as many bins the one with fuller bins."""
    return -len(bins), sum(load * load for load, _ in bins)


def exchange(items: list[int], lengths: list[int], bins: Bins, capacity: int) -> tuple[list[int], Bins]:
    """Fills open bins from ``items``: one goes in, for nothing, one or two shorter ones of the bin, wherever that leaves the
    least room. Passes over the bins end with one that changes nothing, or the third. Returns the items left and the bins."""
    bins, pool = list(bins), sorted((lengths[i], i) for i in items)
    open_bins = [n for n, (load, _) in enumerate(bins) if load < capacity]
    for _ in range(3):
        moved, still_open = 0, []
        for n in open_bins:
            load, inside = bins[n]
            room, gain = capacity - load, 0
            outs = [(0, ())] + [(lengths[x], (x,)) for x in inside]
            if len(inside) < 9:
                outs += [(lengths[x] + lengths[y], (x, y)) for k, x in enumerate(inside) for y in inside[:k]]
            for size, out in outs:
                at = bisect_left(pool, (size + room + 1,)) - 1
                if at >= 0 and pool[at][0] - size > gain:
                    gain, leave, enter = pool[at][0] - size, out, at
                    if gain == room:
                        break
            if gain:
                _, i = pool.pop(enter)
                for x in leave:
                    insort(pool, (lengths[x], x))
                bins[n] = (load + gain, [*(x for x in inside if x not in leave), i])
                moved += gain
            if gain < room:
                still_open.append(n)
        open_bins = still_open
        if not moved:
            break
    return [i for _, i in pool], bins


def refill(items: list[int], lengths: list[int], bins: Bins, capacity: int) -> Bins:
    """Adds new bins for ``items``: the longest one, then again and again the one or two others that fit best."""
    bins, pool = list(bins), sorted((lengths[i], i) for i in items)
    while pool:
        load, first = pool.pop()
        inside, take = [first], (0,)
        while pool and take:
            room, best, take = capacity - load, 0, ()
            top = bisect_left(pool, (room + 1,)) - 1
            if top >= 0:
                best, take = pool[top][0], (top,)
            low = 0
            while low < top and best < room:
                both = pool[low][0] + pool[top][0]
                if best < both <= room:
                    best, take = both, (top, low)
                low, top = (low, top - 1) if both > room else (low + 1, top)
            inside += [pool.pop(k)[1] for k in take]
            load += best
        bins.append((load, inside))
    return bins


def place_displaced(items: list[int], lengths: list[int], bins: Bins, capacity: int) -> Bins:
    """Displaced items fill open bins by exchange; those left are best-fitted into new ones."""
    left, bins = exchange(items, lengths, bins, capacity)
    return refill(left, lengths, bins, capacity)


def dissolve(bins: Bins, rng: random.Random, share: int) -> tuple[Bins, list[int]]:
    """Takes the emptiest bins and some others apart, up to one in ``share``. Returns the bins left and the displaced items."""
    ranked = sorted(range(len(bins)), key=lambda k: bins[k][0])
    gone = set(ranked[: rng.randint(1, max(4, len(bins) // 40))])
    gone |= set(rng.sample(ranked, min(len(bins), rng.randint(0, max(8, len(bins) // share)))))
    return [x for k, x in enumerate(bins) if k not in gone], [i for k in sorted(gone) for i in bins[k][1]]


def crossover(a: Bins, b: Bins, lengths: list[int], capacity: int, rng: random.Random, share: int = 15) -> Bins:
    """Injects a section of b's well-filled bins whole into a. a's bins that share an item with them are taken apart, and some
    others as in a mutation; the items that lose their place are placed anew."""
    ranked = sorted(b, key=lambda x: -x[0])[: max(1, len(b) // 2)]
    at = rng.randrange(len(ranked))
    section = ranked[at : at + rng.randint(1, max(2, len(b) // 40))]
    inside = {i for _, x in section for i in x}
    kept, displaced = [], []
    for one in a:
        if inside.isdisjoint(one[1]):
            kept.append(one)
        else:
            displaced += [i for i in one[1] if i not in inside]
    kept, more = dissolve([*section, *kept], rng, share)
    return place_displaced(displaced + more, lengths, kept, capacity)


def mutate(bins: Bins, lengths: list[int], capacity: int, rng: random.Random, share: int = 15) -> Bins:
    """Takes bins apart and places their items anew."""
    kept, displaced = dissolve(bins, rng, share)
    return place_displaced(displaced, lengths, kept, capacity)


def evolve(lengths: list[int], population: list[Bins], capacity: int, children: int, seed: str) -> list[Bins]:
    """One island's epoch, of a population filled up by mutation and ``children`` by crossover; best solution first. It ends at
    once where the bound of full bins is met."""
    rng = random.Random(seed)
    bound = -(-sum(lengths) // capacity)
    if not population:
        population = [best_fit(list(range(len(lengths))), lengths, [], capacity)]
    # by fitness: of equal ones, taken for equal solutions, one stays, so that the population keeps its variety
    scored = {fitness(x): x for x in population}
    ranked = sorted(scored, reverse=True)
    for _ in range(POPULATION - len(ranked) + children):
        best = scored[ranked[0]]
        if len(best) <= bound:
            break
        if len(ranked) < POPULATION:
            child = mutate(best, lengths, capacity, rng, 8)
        else:
            mine, other = rng.sample(ranked, 2)
            child = crossover(scored[mine], scored[other], lengths, capacity, rng)
        scored[fitness(child)] = child
        ranked = sorted(scored, reverse=True)[:POPULATION]
        scored = {f: scored[f] for f in ranked}
    return [scored[f] for f in ranked]


def _as_labels(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, (_, inside) in enumerate(bins):
        for i in inside:
            out[i] = k
    return out


def _as_bins(labels, lengths: list[int]) -> Bins:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(labels.tolist()):
        bins.setdefault(k, []).append(i)
    return [(sum(lengths[i] for i in x), x) for x in bins.values()]


def pack(rows: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, children: int = CHILDREN) -> DataFrame:
    """Adds (sequence_id, offset) to rows (.., length), 1 <= length <= capacity.

    Full pieces are sequences by themselves. The others are dealt into blocks of about ``block`` rows, evenly
    however often a row repeats. A block has ``islands`` populations; in each epoch every island breeds alone and then
    sends its best solution to the next one. The best of a block's islands is its packing. Reruns on one
    table of pieces agree. Rows that repeat, or that have a null id, are packed one by one like others; rows of one length are
    told apart by their place in the block. An empty table gives no rows.
    """
    rows = cut(rows)
    names = rows.columns
    row_number = F.monotonically_increasing_id()
    full = rows.where(F.col("length") >= capacity).select("*", (-1 - row_number).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = rows.where(F.col("length") < capacity)
    blocks = max(1, -(-short.count() // block))
    # the rows are few and the work on each is long, so their number of tasks is fixed
    tasks = max(1, min(blocks * islands, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = short.select(F.struct(*names).alias("item"), F.pmod(F.xxhash64(row_number), F.lit(blocks)).alias("block"))
    # a block's rows, longest first: about `block` of them by the even deal
    grouped = cut(dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(F.col("item.length").alias("by"), "item")), False).alias("x")).select("block", F.col("x.item").alias("items")))

    state = "block long, island int, lengths array<int>, solutions array<array<int>>"

    def breed(epoch: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for n, island, lengths, solutions in pdf[["block", "island", "lengths", "solutions"]].itertuples(index=False):
                    lengths = lengths.tolist()
                    best = evolve(lengths, [_as_bins(s, lengths) for s in solutions], capacity, children, f"{n}/{island}/{epoch}")
                    out.append((n, island, lengths, [_as_labels(s, len(lengths)) for s in best]))
                yield pd.DataFrame(out, columns=["block", "island", "lengths", "solutions"])

        return run

    lengths = F.transform("items", lambda x: x["length"].cast("int"))
    now = grouped.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), lengths.alias("lengths"), F.array().cast("array<array<int>>").alias("solutions"))
    for epoch in range(epochs):
        if epoch:
            stay = F.struct("island", "solutions")
            move = F.struct(((F.col("island") + 1) % islands).alias("island"), F.slice("solutions", 1, 1).alias("solutions"))
            sent = now.select("block", "lengths", F.explode(F.array(stay, move)).alias("m"))
            now = sent.groupBy("block", "m.island").agg(F.first("lengths").alias("lengths"), F.flatten(F.array_sort(F.collect_list("m.solutions"))).alias("solutions"))
        now = now.repartition(tasks, "block", "island").mapInPandas(breed(epoch), state)
        now = cut(now)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, lengths, solutions in pdf[["block", "lengths", "solutions"]].itertuples(index=False):
                lengths = lengths.tolist()
                bins = max((_as_bins(s, lengths) for s in solutions), key=fitness)
                offsets = [0] * len(lengths)
                for _, inside in bins:
                    at = 0
                    for i in inside:
                        offsets[i], at = at, at + lengths[i]
                out.append((n, _as_labels(bins, len(lengths)), offsets))
            yield pd.DataFrame(out, columns=["block", "labels", "offsets"])

    elites = now.groupBy("block").agg(F.first("lengths").alias("lengths"), F.array_sort(F.collect_list(F.get("solutions", F.lit(0)))).alias("solutions"))
    best = elites.mapInPandas(place, "block long, labels array<long>, offsets array<long>")
    zipped = F.explode(F.arrays_zip("items", "labels", "offsets")).alias("z")
    packed = grouped.join(best, "block").select("block", zipped)
    packed = packed.select("z.items.*", (F.col("block") * (1 << 20) + F.col("z.labels")).alias("sequence_id"), F.col("z.offsets").alias("offset"))
    return full.unionByName(packed)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir), model_path()))


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left."""
    return pack(pieces(docs, model_path()))
