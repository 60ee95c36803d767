"""Whole texts to token ids and back, by `bpe.WordBpe` in the workers.

A null text counts as empty: no tokens, and an empty decoded text.  Rows keep their number and their ids, repeated or
null ids included; only `doc_id` and `text` are read, so other columns of any name are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import bpe
from parcelflow.llm.common import WORDY_BYTES, documents, slices

VOCABULARY = "word_bpe_49k.json"


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers, as binary) and decoded text, for each row of docs."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        for batch in batches:
            for part in slices(batch, size=WORDY_BYTES):
                packed = model.encode_packed([t or "" for t in part.column("text").to_pylist()])
                text = model.text.__getitem__
                decoded = [" ".join(map(text, np.frombuffer(x, "<u4").tolist())) for x in packed]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, ids binary, decoded string")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and decoded text of a frame with doc_id and packed ids; null ids give an empty text."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        for batch in batches:
            for part in slices(batch, "ids"):
                out = [model.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(work, "doc_id long, decoded string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The same as encode(), reduced in the workers to counts and digests, so that no text travels back."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch, size=WORDY_BYTES):
                counts, ids, decoded = [], [], []
                text = model.text.__getitem__
                for x in model.encode_packed([t or "" for t in part.column("text").to_pylist()]):
                    numbers = np.frombuffer(x, "<u4").tolist()
                    counts.append(len(numbers))
                    ids.append(sha(" ".join(map(str, numbers)).encode()).hexdigest())
                    decoded.append(sha(" ".join(map(text, numbers)).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
