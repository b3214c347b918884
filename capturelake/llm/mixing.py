"""Mixing sources to target weights with Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.llm.common import cut, documents, free_names, unit_hash, word_count

#: Sources up to this number are joined as a broadcast table; beyond it the join shuffles.
BROADCAST_SOURCES = 10_000
#: Ranks of a source are summed in this many slices, and those of its edge slice in as many again, before single documents are looked at.
SLICES = 4096
SEED = "mix-2:"
#: Documents of each size class, the best-ranked ones left, that may close a source's target.
OFFERS = 8


def size_class(size: Column) -> Column:
    """Number of binary digits of a size, 0 for 0."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("long")


def draw_weight(size: Column) -> Column:
    """How likely a document is drawn against others of its source: 8 and one more for each doubling of its size."""
    return F.lit(8).cast("long") + size_class(size)


def _levels(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Adds ``level`` to rows (total, cap, w): the level at which the rows of one ``by`` share their total, each level x w
    but at most its cap. Rows sorted by cap / w fill up one after the other: the level rises up to the first
    row that takes it whole and falls from there on, so it is the largest of the prefixes' levels."""
    every = Window.partitionBy(*by)
    by_ratio = every.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), *order)
    filled = F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1))
    left = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("total").cast("double") - F.coalesce(filled, F.lit(0)).cast("double")) / left.cast("double")
    return rows.withColumn("level", level).withColumn("level", F.max("level").over(every))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...], max_copies: int) -> DataFrame:
    """(source, source_size, target) for rows (source, size).

    The sources in code-point order, null last, weigh ``cycle`` repeated. They share the sum of all
    sizes by weight; none gets more than ``max_copies`` times its own size, and what is above goes to the
    others by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (at % len(cycle) + 1).cast("int")).cast("long")
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_copies).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    per = _levels(per, [], [F.col("source").isNull(), F.col("source")])
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def inclusion(units: DataFrame, per: DataFrame, max_copies: int) -> DataFrame:
    """(source, weight, source_size, target, rest, whole, p): expected copies of the documents of one source and weight.

    A document is expected in level x weight copies, at most ``max_copies``, so that a source's expected words are its
    target. ``whole`` of them are certain, ``p`` is the chance of one more, ``rest`` the words that a source draws by chance.
    """
    cells = units.groupBy("source", "weight").agg(F.sum("size").alias("n"))
    rows = cells.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumns({"total": F.col("target"), "cap": F.col("n") * max_copies, "w": F.col("n") * F.col("weight")}).where("n > 0")
    rows = _levels(rows, ["source"], [F.col("weight")])
    expected = F.least(F.lit(float(max_copies)), F.col("level") * F.col("weight").cast("double"))
    rows = rows.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long"))
    sure = F.sum(F.col("whole") * F.col("n")).over(Window.partitionBy("source"))
    rows = rows.withColumn("rest", F.greatest(F.col("target") - sure.cast("double"), F.lit(0.0)))
    return rows.select("source", "weight", "rest", "whole", (F.col("expected") - F.col("whole").cast("double")).alias("p"))


def _with_sources(df: DataFrame, per: DataFrame, few: bool) -> DataFrame:
    """``df`` with the columns of ``per``, whose source column is ``s``."""
    side = F.broadcast(per) if few else per
    return df.join(side, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _edge(rows: DataFrame, slice_: str, rest: str) -> DataFrame:
    """(s, edge, before): by source, the slice in which the running words of rows (source, slice, size) pass the rest."""
    sums = rows.groupBy("source", slice_).agg(F.sum("size").alias("n"), F.first(rest).alias("r"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy(slice_))
    over = F.when(F.col("upto") > F.col("r"), F.struct(F.col(slice_).alias("edge"), (F.col("upto") - F.col("n")).alias("before")))
    return sums.withColumn("upto", upto).groupBy(F.col("source").alias("s")).agg(F.min(over).alias("e")).select("s", "e.edge", "e.before")


def _closing(offers: Column, missing: Column) -> Column:
    """Keys of the offers (key, size) that are taken one after the other while they fit, and then of the one that brings
    the words nearest, if one does."""
    none = F.array().cast("array<struct<rank: double, nid: boolean, doc_id: bigint>>")

    def fit(state: Column, x: Column) -> Column:
        return F.when(x["size"] <= state["m"], F.struct((state["m"] - x["size"]).alias("m"), F.concat(state["y"], F.array(x["key"])).alias("y"))).otherwise(state)

    def nearest(state: Column) -> Column:
        open_ = F.filter(offers, lambda x: ~F.array_contains(state["y"], x["key"]) & (F.abs(state["m"] - x["size"]) < state["m"]))
        gaps = F.transform(open_, lambda x: F.struct(F.abs(state["m"] - x["size"]).alias("gap"), x["key"].alias("key")))
        return F.when(F.size(gaps) > 0, F.concat(state["y"], F.array(F.array_min(gaps)["key"]))).otherwise(state["y"])

    return F.aggregate(offers, F.struct(missing.alias("m"), none.alias("y")), fit, nearest)


def copies(units: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """How often the mix takes each row of ``units(doc_id, source, size)``.

    Returns (doc_id, size, source_size, target, p, copies) in the rows' own number. ``weight`` (of the row's columns, positive
    long; :func:`draw_weight` of the size unless given) says how the documents of a source differ: each is expected in level x
    weight copies (:func:`inclusion`). The whole ones are certain. The rest of a target is filled by Pareto order sampling:
    a document with chance p of one more copy has the rank u / (1 - u) : p / (1 - p), u from its id's hash, and
    documents are taken in ascending rank while their words fit. So that a long document at the edge leaves no gap, the
    OFFERS best-ranked ones left of each size class, largest class first, are taken where they still fit, and then the one of them that
    brings the words nearest, if one does.

    Rows with one doc_id, source and weight are taken or left together. Null ids have one hash, null sources are a
    source of their own (last), null sizes count as 0, documents without words are not drawn, sources without words have
    target 0, and an empty table gives no rows. Equal ranks go by doc_id.
    """
    size = F.coalesce("size", F.lit(0)).cast("long")
    units = cut(units.withColumn("size", size).select("doc_id", "source", "size", (draw_weight(F.col("size")) if weight is None else weight).cast("long").alias("weight")))
    per = cut(source_targets(units, cycle, max_copies))
    few = per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    chance = cut(inclusion(units, per, max_copies))
    u = unit_hash(seed, F.col("doc_id"))
    rank = F.when((F.col("p") > 0) & (F.col("size") > 0), (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    side = chance.withColumnsRenamed({"source": "s", "weight": "sw"})
    # at most a row for each source and weight
    small = few and chance.limit(64 * BROADCAST_SOURCES + 1).count() <= 64 * BROADCAST_SOURCES
    rows = units.withColumn("u", u).join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("s")) & (F.col("weight") == F.col("sw")), "left").drop("s", "sw")
    rows = rows.withColumn("rank", rank)
    groups = rows.where("rank is not null").groupBy("source", "rank", "doc_id").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    at = F.col("rank") / (1 + F.col("rank")) * SLICES
    groups = cut(groups.withColumns({"slice": F.floor(at), "part": F.floor((at - F.floor(at)) * SLICES)}))

    # where the running words of a source pass its rest: the slice, its part, then the document
    edge = cut(_edge(groups, "slice", "rest"))
    inner = _with_sources(groups, edge, few).where("slice = edge").withColumn("rest", F.col("rest") - F.col("before").cast("double"))
    inner = cut(inner.drop("edge", "before"))
    part = cut(_edge(inner, "part", "rest"))
    order = Window.partitionBy("source").orderBy("rank", F.col("doc_id").isNull(), "doc_id")
    last = _with_sources(inner, part, few).where("part = edge").withColumn("upto", F.sum("size").over(order) + F.col("before")).where("upto <= rest")
    key = F.struct("rank", F.col("doc_id").isNull().alias("nid"), "doc_id")
    last = last.groupBy(F.col("source").alias("s3")).agg(F.max(key).alias("c"), F.max("upto").alias("upto"))
    both = edge.select("s", F.col("edge").alias("slice_at"), "before").join(part.select(F.col("s").alias("s2"), F.col("edge").alias("part_at"), F.col("before").alias("inside")), F.col("s").eqNullSafe(F.col("s2")), "left")
    both = both.join(last, F.col("s").eqNullSafe(F.col("s3")), "left")
    # the words that the ranks take, and up to where they take them; no edge: all
    both = cut(both.select("s", "slice_at", "part_at", "c", (F.col("before") + F.coalesce("upto", "inside")).alias("drawn")))
    here, there = F.struct("slice", "part"), F.struct("slice_at", "part_at")
    drawn = F.col("slice_at").isNull() | F.coalesce(here < there, F.lit(False)) | F.coalesce((here == there) & (key <= F.col("c")), F.lit(False))

    left = _with_sources(groups, both, few).where(F.col("slice_at").isNotNull() & ~drawn).withColumn("k", size_class(F.col("size")))
    place = F.row_number().over(Window.partitionBy("source", "k").orderBy("rank", F.col("doc_id").isNull(), "doc_id"))
    offers = left.withColumn("n", place).where(F.col("n") <= OFFERS)
    closing = offers.groupBy(F.col("source").alias("s4")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), key.alias("key"), "size"))).alias("x"), F.first(F.col("rest") - F.col("drawn").cast("double")).alias("missing")
    ).select("s4", _closing(F.col("x"), F.col("missing")).alias("closing"))
    chosen = both.join(closing, F.col("s").eqNullSafe(F.col("s4")), "left").drop("s4", "drawn").withColumn("known", F.lit(True))
    chosen = cut(chosen)
    rows = _with_sources(rows, chosen, few).withColumns({"slice": F.floor(at), "part": F.floor((at - F.floor(at)) * SLICES)})
    extra = F.when(F.col("rank").isNotNull() & F.coalesce(F.col("known") & (drawn | F.coalesce(F.array_contains("closing", key), F.lit(False))), F.lit(False)), 1).otherwise(0)
    rows = _with_sources(rows, per.withColumnRenamed("source", "s"), few)
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("p", F.lit(0.0)).alias("p"), (F.coalesce("whole", F.lit(0)) + extra).cast("long").alias("copies"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it; rules as in :func:`copies`."""
    docs = documents(spark, sf_dir)
    mix = copies(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix takes it. Documents without words are not taken; other columns stay as they are."""
    mix = copies(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    key, group, n, copy = free_names(docs.columns, "id", "of", "copies", "copy")
    times = mix.groupBy(F.col("doc_id").alias(key), F.col("source").alias(group)).agg(F.max("copies").alias(n))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(group))
    out = docs.join(times, same).where(F.col(n) > 0)
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


MIX_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
e AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS k FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM e GROUP BY source),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(w) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev
  FROM s),
t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * w) AS target
  FROM (SELECT *, max(lev) OVER () AS level FROM l)),
c AS (
  SELECT source, 8 + k AS weight, CAST(sum(size) AS BIGINT) AS n, any_value(target) AS target
  FROM (SELECT e.*, target FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source) GROUP BY source, k HAVING sum(size) > 0),
cl AS (
  SELECT *, (target - CAST(coalesce(sum(3 * n) OVER (PARTITION BY source ORDER BY CAST(3 * n AS DOUBLE) / CAST(n * weight AS DOUBLE), weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(n * weight) OVER (PARTITION BY source ORDER BY CAST(3 * n AS DOUBLE) / CAST(n * weight AS DOUBLE), weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev
  FROM c),
ce AS (SELECT *, least(CAST(3 AS DOUBLE), level * CAST(weight AS DOUBLE)) AS expected FROM (SELECT *, max(lev) OVER (PARTITION BY source) AS level FROM cl)),
cw AS (SELECT *, CAST(floor(expected) AS BIGINT) AS whole FROM ce),
i AS (SELECT source, weight, whole, expected - CAST(whole AS DOUBLE) AS p,
             greatest(target - CAST(sum(whole * n) OVER (PARTITION BY source) AS DOUBLE), 0) AS rest FROM cw),
j AS (
  SELECT e.*, source_size, target, coalesce(whole, 0) AS whole, rest, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds
  FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source LEFT JOIN i ON e.source IS NOT DISTINCT FROM i.source AND 8 + e.k = i.weight),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM j WHERE odds IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k DESC, odds, doc_id NULLS LAST) AS at
      FROM (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY odds, doc_id NULLS LAST) AS n FROM r WHERE upto > rest) WHERE n <= {OFFERS}),
m AS (
  SELECT source, CAST(0 AS BIGINT) AS at, max(rest) - max(CASE WHEN upto <= rest THEN upto ELSE 0 END) AS missing, false AS take, CAST(NULL AS BIGINT) AS doc_id FROM r GROUP BY source
  UNION ALL
  SELECT m.source, b.at, m.missing - CASE WHEN b.size <= m.missing THEN b.size ELSE 0 END, b.size <= m.missing, b.doc_id
  FROM m JOIN b ON m.source IS NOT DISTINCT FROM b.source AND b.at = m.at + 1),
g AS (SELECT source, min(missing) AS missing FROM m GROUP BY source),
h AS (SELECT doc_id, row_number() OVER (PARTITION BY b.source ORDER BY abs(missing - size), odds, doc_id NULLS LAST) AS n
      FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source WHERE abs(missing - size) < missing AND doc_id NOT IN (SELECT doc_id FROM m WHERE take)),
f AS (SELECT doc_id FROM m WHERE take UNION ALL SELECT doc_id FROM h WHERE n = 1)
SELECT j.doc_id, j.size, j.source_size, j.target,
       CAST(j.size * (j.whole + CASE WHEN j.odds IS NOT NULL AND (r.upto <= r.rest OR f.doc_id IS NOT NULL) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM j LEFT JOIN r ON j.doc_id = r.doc_id LEFT JOIN f ON f.doc_id = j.doc_id
"""
