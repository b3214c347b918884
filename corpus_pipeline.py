"""The corpus pipeline: documents to packed training sequences, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from capturelake.llm.common import scratch_dir
from capturelake.llm.mixing import mix_stage
from capturelake.llm.near_dup import near_dup_stage
from capturelake.llm.packing import pack_stage
from capturelake.llm.quality import quality_stage
from capturelake.llm.secrets import secrets_stage

STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_dup_stage),
    ("secret scans", secrets_stage),
    ("source mix", mix_stage),
    ("packing", pack_stage),
]
#: SQL can express neither the learned rules nor the signatures, models and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
