"""What the operators of this package share: the shared folder, materialised steps, batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled at once by a Python worker; bounds its memory whatever the size of Spark's batches.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20
#: The same where each word of a text becomes an object.
WORDY_BYTES = 1 << 20
#: Rows and bytes of Spark's batches to and from Python while a step is written; both sides hold several of them.
BATCH = {"maxRecordsPerBatch": "2048", "maxBytesPerBatch": str(8 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one where it is unset and all is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"file://{os.path.join(tempfile.gettempdir(), 'parcelflow-shared')}"


def step_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives the loss of any executor.

    A path that is given is overwritten, so loops need two folders.
    """
    spark = df.sparkSession
    path = path or step_path(spark, label)
    with contextlib.ExitStack() as held:
        held.enter_context(setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"))
        for name, value in BATCH.items():
            held.enter_context(setting(spark, f"spark.sql.execution.arrow.{name}", value))
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df for a join by shuffles: blobs from Python have no size in a plan, which would broadcast them from the driver."""
    return df.hint("merge")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session while a step is written; here, that Spark drops the step's shuffle files at its end."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: What the operators keep in a worker process between tasks, by operator: how to drop it.
CACHES: dict[str, Callable[[], None]] = {}


def only(operator: str) -> None:
    """Drops what other operators keep in this worker, which serves one stage after the other, and free memory with it."""
    for name, clear in CACHES.items():
        if name != operator:
            clear()
    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())  # gives large blocks back as soon as they are free
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what it has freed otherwise
    if trim:
        trim(0)


def fresh(taken: list[str], name: str) -> str:
    """A column name like `name` that is not taken, whatever the case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; those rows never train a model."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into slices of at most so many rows and, but for single rows, `size` bytes of text."""
    sizes = [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > size or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
