"""Steps of a run, written down: plans stay small, and a lost executor costs no more than a read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def step_path(spark: SparkSession, label: str) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir); a local one only where all is local."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared = shared or f"file://{os.path.join(tempfile.gettempdir(), 'parcelflow-shared')}"
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = step_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df for a join by shuffles; where both sides grow with the input, a plan that takes one for small would broadcast it from the driver."""
    return df.hint("merge")
