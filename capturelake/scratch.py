"""The shared folder for checkpoints and tables that a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder set for checkpoints. A local session without either gets a temporary
    one; on a cluster, whose machines would not share it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="capturelake-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there, with its lineage cut."""
    folder(df.sparkSession)
    return df.checkpoint()


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder. Unlike a checkpoint it carries no constraints along, which in a loop of joins and coalesced columns
    grow with each turn until planning takes longer than the work."""
    spark = df.sparkSession
    path = fresh(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
