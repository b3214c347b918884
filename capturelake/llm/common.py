"""Pieces shared by the training-data operators: words, scratch tables, components."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word, as a regular-expression class body and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one; on a
    cluster, whose machines would not share it, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="capturelake-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Spark's setting that a query's shuffle files go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder and continues from there, with its lineage cut. What the work shuffled is removed
    when it has been written, so a chain of steps holds the files of one."""
    spark = df.sparkSession
    scratch_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        # the setting counts when a frame is made, so the frame is made anew
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(CLEANUP, before)


#: Rows of a partition of what :func:`few` gives.
FEW = 50_000


def few(df: DataFrame) -> DataFrame:
    """``df`` as :func:`cut` leaves it, in a partition for each ``FEW`` rows where it has more partitions than that. For small tables that many
    steps read: with a task a partition, and shuffle files for each, the steps would cost what the partitions do, not what the rows do."""
    done = cut(df)
    wanted = max(1, -(-done.count() // FEW))
    return cut(done.coalesce(wanted)) if wanted < done.rdd.getNumPartitions() else done


def words_of(text: Column) -> Column:
    """The array of words of a text; empty for a null or blank one."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(
        F.coalesce(trimmed, F.lit("")) != "", F.split(trimmed, SPACE_CLASS)
    ).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from the columns, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit_hash(prefix: str, key: Column) -> Column:
    """A number in (0, 1) from the md5 of a prefix and a key; a null key counts as the text 'null'."""
    text = F.concat(F.lit(prefix), F.coalesce(key.cast("string"), F.lit("null")))
    digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (digits.cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long ids): rows (node, root), root the least id of the component.

    Alternates large-star and small-star steps, each a grouped minimum and a join on the node,
    until every edge points at a node that has no smaller neighbour itself. An edge table without
    rows gives none. Each step is written to the checkpoint folder, in as many partitions as its rows need.
    """
    turned = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
    now = few(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        both = now.select(turned).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        inner = now.select(F.col("v").alias("u")).distinct()
        if now.join(inner, "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
