"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidegraph.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        ensure_checkpoint_dir(spark)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


class Scratch:
    """Tables written once and read back, so that a lost executor costs one task
    and not the plan behind it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = shared_folder(spark)
        self._saved = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self._saved}"
        self._saved += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
