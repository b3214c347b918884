"""Near-duplicate classes: DartMinHash signatures, banded joining, exact Jaccard checks, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from capturelake.llm.common import components, cut, documents
from capturelake.llm.hashing import distinct, mix, shingles, unit
from capturelake.llm.tokens import slices

WIDTH = 5
SIMILARITY = 0.8
#: 32 bands of 6 coordinates: of pairs at 0.8 all but 6 in 100,000 share a band, at 0.9 all but 3 in 10**11.
BANDS, ROWS = 32, 6
#: Characters that a worker hashes at once; its arrays take about 60 bytes for each.
SLICE = 1_500_000


def dart_minhash(index: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """DartMinHash signatures, uint64 [n, k], of n weighted sets given as rows (index of set, element, weight > 0).

    Every element has a region of unit-rate darts over weight and rank, the same in all sets. The weight axis is cut at
    2**v - 1, so an element of weight w has floor(log2(w)) + 1 cells; a cell's darts come in order of their rank, with
    gaps, weights and coordinates from hashes. A set throws the darts up to the rank at which it expects k ln k + 2 k of
    them; those above its weight miss, and each coordinate keeps the earliest. A set with an empty coordinate
    throws up to twice the rank. Two coordinates agree with the probability of the weighted Jaccard similarity.
    Large sets mostly throw no dart at an element, so the work is rows + darts.
    """
    out = np.full((n, k), np.iinfo(np.uint64).max, np.uint64)
    if not len(index):
        return out
    total = np.bincount(index, weight, n)
    reach = np.zeros(n)
    reach[total > 0] = (k * np.log(k) + 2 * k) / total[total > 0]
    depth = int(np.log2(weight.max())) + 1 if weight.max() >= 1 else 1
    todo = np.flatnonzero(total > 0)
    while len(todo):
        mine = np.zeros(n, bool)
        mine[todo] = True
        for v in range(depth):
            rows = np.flatnonzero(mine[index] & (weight > 2.0**v - 1))
            rank, throw = np.zeros(len(rows)), 0
            seed = mix(value[rows] + np.uint64(v * 0x51ED2701 + 1))
            while len(rows):
                throw += 1
                dart = mix(seed + np.uint64(throw * 0x2545F491))
                rank = rank - np.log(unit(dart)) / 2.0**v
                near = rank <= reach[index[rows]]
                rows, rank, seed, dart = rows[near], rank[near], seed[near], dart[near]
                other = mix(dart + np.uint64(0x632BE5AB))
                hit = 2.0**v - 1 + unit(other) * 2.0**v <= weight[rows]
                slot = index[rows[hit]] * k + (mix(other[hit]) % np.uint64(k)).astype(np.int64)
                mark = rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
                np.minimum.at(out.reshape(-1), slot, mark | (dart[hit] & np.uint64(0xFFFFFFFF)))
        todo = todo[(out[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        reach[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One long a band."""
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def elements(texts: list[str], weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, weight) of the texts' distinct shingles, and (index, value) of their elements.

    ``weights``: 'set' gives every shingle weight 1. 'count' gives it its count, and one element for each time it occurs, so
    that the Jaccard similarity of the elements is the weighted one of the counts.
    """
    index, value, count = distinct(*shingles([t.encode() for t in texts], WIDTH))
    if weights != "count":
        return index, value, np.ones(len(index)), index, value
    row = np.repeat(np.arange(len(index)), count)
    time = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    each = np.where(time == 0, value[row], mix(value[row] + time.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return index, value, count.astype(float), index[row], each


def fingerprints(index: np.ndarray, value: np.ndarray, n: int) -> list[pa.Array]:
    """Two independent sums of hashes over each text's elements."""
    out = []
    for salt in (1, 2):
        total = np.zeros(n, np.uint64)
        np.add.at(total, index, mix(value * np.uint64(2 * salt + 1) + np.uint64(salt)))
        out.append(pa.array(total.view(np.int64)))
    return out


def signatures(docs: DataFrame, weights: str = "set") -> DataFrame:
    """(doc_id, n, print_a, print_b, bands): number and fingerprint of a row's elements (:func:`elements`), and the band keys.

    Null texts have no elements, null ids stay null, rows that repeat come again, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, SLICE):
                m = b - a
                index, value, weight, at, each = elements(texts[a:b], weights)
                bands = band_keys(dart_minhash(index, value, weight, m, BANDS * ROWS))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, m * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, m), pa.array(np.bincount(at, minlength=m)), *fingerprints(at, each, m), flat], names=["doc_id", "n", "print_a", "print_b", "bands"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, print_a long, print_b long, bands array<long>")


def shingle_sets(docs: DataFrame, weights: str = "set") -> DataFrame:
    """(doc_id, n, print_a, print_b, shingles): the elements of each row's whole text beside its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, SLICE):
                m = b - a
                *_, at, each = elements(texts[a:b], weights)
                ends = np.searchsorted(at, np.arange(m + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, m), pa.array(np.diff(ends).astype(np.int64)), *fingerprints(at, each, m), pa.ListArray.from_arrays(pa.array(ends), pa.array(each.view(np.int64)))],
                    names=["doc_id", "n", "print_a", "print_b", "shingles"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, print_a long, print_b long, shingles array<long>")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that Jaccard similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("s"), (F.size("x") + F.size("y")).alias("t"))
    return both.where(F.col("s") >= similarity * (F.col("t") - F.col("s"))).select("a", "b")


def prefix_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of members (rep, n, root, aside) of different roots that may be similar, one of each ``aside``.

    Shingles are ordered by how many members have them, rarest first. Two sets of n and m shingles that are similar share
    s >= (n + m) t / (1 + t) of them, so the first shared one is among the first n - s + 1 of the one and m - s + 1 of the
    other: the join on shingles needs those alone, and a member with more text of its own than that joins nobody by
    the text that a whole group has.
    """
    # the order needs all shingles of the members; only the rare heads are joined
    rows = members.join(sets, members["rep"] == sets["doc_id"]).select("rep", "n", "root", "aside", "shingles")
    each = rows.select("rep", F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    ranked = each.join(often, "s").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("r"))
    head = F.slice("r", F.lit(1), F.col("n").cast("int") - F.ceil(F.lit(similarity) * F.col("n")).cast("int") + 1)
    heads = ranked.join(members, "rep").select("rep", "n", "root", "aside", F.posexplode(head).alias("at", "x")).where("x.c > 1")
    heads = cut(heads.select("rep", "n", "root", "aside", "at", "x.s"))
    x = heads.where("aside").select("s", F.col("rep").alias("a"), F.col("n").alias("n1"), F.col("root").alias("r1"), F.col("at").alias("p1"))
    y = heads.select("s", F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("root").alias("r2"), F.col("at").alias("p2"))
    need = F.ceil((F.col("n1") + F.col("n2")) * (similarity / (1 + similarity)) - 1e-9)
    fits = (F.col("r1") != F.col("r2")) & (F.col("p1") <= F.col("n1") - need) & (F.col("p2") <= F.col("n2") - need)
    return x.join(y, "s").where(fits).select("a", "b").distinct()


SAME = ["print_a", "print_b", "n"]


def _one_id(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): representatives of the different sets that rows of one doc_id have."""
    mine = F.struct(*SAME)
    several = rows.groupBy("doc_id").agg(F.min(mine).alias("lo"), F.max(mine).alias("hi")).where("lo <> hi").select("doc_id")
    known = cut(rows.join(several, "doc_id", "left_semi").select("doc_id", *SAME).distinct().join(reps.select(*SAME, "rep"), SAME).select("doc_id", "rep"))
    first = known.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return known.join(first, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, weights: str = "set") -> DataFrame:
    """(doc_id, class_id) for every row of ``docs(doc_id, text)``; class_id is the least doc_id of the class.

    A class is a component of the links: equal sets of elements (:func:`elements`, by ``weights``), and pairs of different sets of
    at least that similarity that share a band. Equal sets become one representative first. In each band bucket the representative
    with the largest share of elements found elsewhere leads: every member is checked against it, so a bucket of many near
    copies of one text closes after one check a member. Members of buckets that still hold several components are
    then joined on their rarest elements (:func:`prefix_pairs`), which no similar pair escapes, and checked too. No link
    is dropped by a cap.

    Rows that repeat a doc_id are one document, whatever their texts: each text's links are the document's. Texts without words
    are equal to each other. Null ids are dropped from linking and form a class of their own row. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    rows = cut(signatures(known, weights))
    reps = rows.groupBy(*SAME).agg(F.min("doc_id").alias("first_id"), F.min_by("bands", "doc_id").alias("bands"))
    # a number for each set: an id may stand for several
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    member = reps.where("n > 0").select("rep", "n", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    member = cut(member.join(shared, "bucket"))

    wanted = cut(reps.join(member.select("rep").distinct(), "rep", "left_semi").select(F.col("first_id").alias("doc_id"), *SAME, "rep"))
    found = shingle_sets(known.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), weights)
    sets = found.groupBy("doc_id", *SAME).agg(F.first("shingles").alias("shingles")).join(wanted, ["doc_id", *SAME])
    sets = cut(sets.select(F.col("rep").alias("doc_id"), "shingles"))
    alone = sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("rep"))
    alone = cut(alone.where("c = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("alone")))
    # a member's elements that some other candidate has: what a partner can share at most
    member = member.join(alone, "rep", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
    member = cut(member.where(F.col("common") >= similarity * F.col("n")).select("bucket", "rep", "n", "common"))

    best = F.max_by("rep", F.struct(F.col("common") / F.col("n"), -F.col("rep")))
    leaders = member.groupBy("bucket").agg(best.alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket", "a")
    first = member.join(leaders, "bucket").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    links = cut(similar(first, sets, similarity))
    part = cut(components(links))

    # buckets that still hold several components: prefix joins between the members of smaller ones and all members
    rooted = member.join(part, member["rep"] == part["node"], "left").select("bucket", "rep", "n", F.coalesce("root", "rep").alias("root"))
    by_root = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m"))
    largest = by_root.groupBy("bucket").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    rooted = cut(rooted.join(largest, "bucket").groupBy("rep", "n", "root").agg(F.bool_or(F.col("root") != F.col("main")).alias("aside")))
    pairs = prefix_pairs(rooted, sets, similarity)
    more = similar(pairs.join(first.union(first.select("b", "a")), ["a", "b"], "left_anti"), sets, similarity)
    part = cut(components(links.union(more).union(_one_id(rows, reps))))

    linked = reps.join(part, reps["rep"] == part["node"], "left").select(*SAME, "first_id", "root")
    least = linked.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least"))
    named = linked.join(least, "root", "left").select(*SAME, F.coalesce("least", "first_id").alias("class_id"))
    out = rows.select("doc_id", *SAME).join(named, SAME).select("doc_id", "class_id")
    return out.unionByName(docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id")))


def op1_near_dup(spark, sf_dir: str) -> DataFrame:
    """Every document with its class; nulls, repeats and ties as in :func:`classes`."""
    return classes(documents(spark, sf_dir))


def _has_map(kind: DataType) -> bool:
    return isinstance(kind, (MapType, VariantType)) or any(map(_has_map, [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []))


def near_dup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the least doc_id. Of rows that repeat an id the least by their columns in
    order stays (maps are not compared). Rows without an id stay."""
    keep = classes(docs).where("doc_id = class_id").select("doc_id").distinct()
    others = [F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]
    key = F.struct(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not _has_map(f.dataType)])
    first = docs.join(keep, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*others), key).alias("_row"))
    rest = docs.where("doc_id is null")
    return first.select("doc_id", "_row.*").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(rest)
