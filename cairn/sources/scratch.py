"""Tables in the folder that all executors share (spark.checkpoint.dir), for loops that must cut their lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + os.path.join(tempfile.gettempdir(), "cairn-checkpoints")
        self.spark, self.path = spark, f"{root.rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{label}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{label}")


def measured(df: DataFrame, name: str) -> DataFrame:
    """The rows, written: Spark then knows their size when it plans a join, and sends a small side to all tasks instead of dealing out the other one."""
    return Scratch(df.sparkSession, name).save(df, name)
