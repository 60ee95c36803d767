"""Tables in and out: explicit schemas, manifests, quarantine, snapshots, upserts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.config import LayerSource

EVENTS = "event_type STRING, parent_district STRING, child_district STRING, state STRING, effective_year INT, source STRING"
ALIASES = "raw_name STRING, canonical_name STRING, from_state STRING, to_state STRING, alias_type STRING, evidence_type STRING, provenance STRING, approval_status STRING, created_by STRING, created_at STRING, event_year INT"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays joined by semicolons; the one conversion that a flat file needs."""
    flat = [F.concat_ws(";", c).alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def read_layers(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet layers, one folder for each vintage, of which only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_layers(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("source_year").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def key_check(df: DataFrame, key: str) -> DataFrame:
    """Whether a column can be a primary key: counts of all, distinct and missing values."""
    k = F.col(key)
    return df.agg(F.count("*").alias("total"), F.countDistinct(k).alias("n_unique"), F.count_if(k.isNull()).alias("n_null")).withColumn("is_valid", (F.col("total") == F.col("n_unique")) & (F.col("n_null") == 0))


def routed(found: list[str], source: LayerSource) -> tuple[list[str], list[tuple[str, str]]]:
    """Layers of a file that are used, and those set aside with the reason."""
    use = [x for x in found if source.primary_layer is None or x == source.primary_layer]
    return [x for x in use if x not in source.quarantine_layers], [(x, "QUARANTINED" if x in source.quarantine_layers else "UNKNOWN_LAYER") for x in found if x not in use or x in source.quarantine_layers]


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """df as it was when it was first written there; later calls read that."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def report(df: DataFrame, path: str, order: list[str], form: str = "json") -> None:
    """A small ordered table as lines of JSON, or as a Markdown table."""
    rows = df.orderBy(*order)
    if form == "json":
        rows.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
        return
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    line = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |")).alias("value"))
    head = df.sparkSession.createDataFrame([(f"| {' | '.join(df.columns)} |",), ("|" + "---|" * len(df.columns),)], "value string")
    head.unionByName(line).coalesce(1).write.mode("overwrite").text(path)
