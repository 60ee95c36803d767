"""Events that arrive over time: each batch is merged by the events' own ids, so replays change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from parcelflow.operators.events import events, keep_last
from parcelflow.sources.tables import EVENTS


def merge(spark: SparkSession, table: str, batch: DataFrame, run: int) -> str:
    """Writes the events known before and those of the batch as a new version of the table; the path of that version."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(conf)
    before = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName() < f"v={run:012d}") if fs.exists(root) else []
    found = events(batch)
    out = keep_last(spark.read.parquet(f"{table}/{before[-1]}"), found, ["event_id"]) if before else found.dropDuplicates(["event_id"])
    path = f"{table}/v={run:012d}"
    out.write.mode("overwrite").parquet(path)
    return path


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Reads raw event files as they appear, until there are no more, and keeps versions of the event table."""
    raw = spark.readStream.schema(EVENTS).option("header", True).csv(source)
    return raw.writeStream.foreachBatch(lambda batch, run: merge(spark, table, batch, run) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
