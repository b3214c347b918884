"""Steps over small tables take few tasks, and written steps leave no shuffle files, however many partitions a shuffle has."""

import time

import pytest
from pyspark.sql import functions as F

from capturelake.llm import common, quality


@pytest.fixture
def many(spark):
    """Shuffles into 40 partitions that are not made fewer, as on large inputs."""
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_cut_leaves_no_shuffle_files(many):
    before = shuffle_files(many)
    rows = common.cut(many.range(1000).groupBy((F.col("id") % 70).alias("k")).count())
    for _ in range(50):
        if not (left := shuffle_files(many) - before):
            break
        time.sleep(0.1)
    assert not left and rows.count() == 70


def test_few(many, monkeypatch):
    rows = many.range(1000).groupBy((F.col("id") % 100).alias("k")).count()
    one = common.few(rows)
    assert one.rdd.getNumPartitions() == 1 and sorted(map(tuple, one.collect())) == [(k, 10) for k in range(100)]
    monkeypatch.setattr(common, "FEW", 10)
    assert common.few(rows).rdd.getNumPartitions() == 10
    monkeypatch.setattr(common, "FEW", 1)
    assert common.few(rows).rdd.getNumPartitions() == 40
    assert common.few(rows.where("k < 0")).collect() == []


def test_learning_reads_few_partitions(many, monkeypatch):
    seen, plain = [], quality._histogram
    monkeypatch.setattr(quality, "_histogram", lambda cells, where: seen.append(cells.rdd.getNumPartitions()) or plain(cells, where))
    texts = many.range(400).select(F.col("id").alias("key"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("word "), 60)).otherwise(F.concat_ws(" ", F.sequence(F.lit(1), F.lit(80)).cast("array<string>"))).alias("text"))
    rules = quality.fit(quality.with_statistics(texts).withColumn("label", F.col("key") % 2))
    assert rules.rules and set(seen) == {1}
