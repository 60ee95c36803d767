"""Bounded training samples of labelled documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm.common import held_out


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def training(docs: DataFrame, marks: DataFrame, column: str, rows_a_class: int, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """place, doc_id, text and label of at most rows_a_class documents of each class, none of them held out.

    The sample is the same for the same labels: those whose ids have the smallest hashes.  It is bounded, so it may be
    broadcast to the documents and collected.  Null ids and labels other than 0 and 1 are left out.  prepare may turn
    the texts into something smaller, row by row, where they are read; it keeps the columns place, doc_id, label, tie.
    """
    own = marks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    own = own.filter(~held_out(F.col("doc_id"))).withColumn("place", F.xxhash64("doc_id"))
    classes = [own.filter(F.col("label") == k).orderBy("place", "doc_id").limit(rows_a_class) for k in (0, 1)]
    chosen = F.broadcast(classes[0].unionByName(classes[1]))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    found = found.select("place", "doc_id", "label", F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    # an id that several documents have could multiply the rows, so the bound is applied once more
    return (prepare(found) if prepare else found).orderBy("place", "doc_id", "label", "tie").limit(2 * rows_a_class)
