"""Quality by regularised quadratic discriminant analysis of document statistics.

A document becomes STATISTICS transformed figures (logarithms of counts and rates).  Each class has a mean and a
covariance shrunk twice: towards the pooled covariance (POOL) and towards a multiple of the identity (ROUND).  The
score is the logistic function of the difference of the classes' log densities and log frequencies; both Mahalanobis
distances come from triangular solves with Cholesky factors that are computed once.

The model is fitted on at most TRAIN_A_CLASS labelled documents of each class (a documented bound); every document is
scored over its whole text.  Null texts count as empty and get the score of an empty document.  With no labelled rows
of a class, the score is the known class's frequency, or 0.5.  Rows keep their number and ids, repeated and null ones
too; an empty table gives an empty result; equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.llm.common import documents, fresh, held_out, only, slices
from parcelflow.llm.learning import labels, training

TRAIN_A_CLASS = 6000
POOL, ROUND = 0.2, 0.05
THRESHOLD = 0.3
#: Words added to each document's when rates are taken, so that those of very short texts stay near the usual.
STEADY = 20

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
UPPER, LOWER, DIGITS = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)


def statistics(text: str) -> list[float]:
    bytes_ = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, total = len(words), len(text)
    rate = lambda k: float(np.log1p(100 * k / (n + STEADY)))
    letters = int(bytes_[UPPER].sum() + bytes_[LOWER].sum())
    kinds = len(set(words))
    return [
        float(np.log1p(n)),
        float(np.log1p(total / max(n, 1))),
        rate(int(bytes_[SYMBOLS].sum())),
        rate(int(bytes_[33])),
        rate(int(bytes_[46])),
        rate(int(bytes_[44])),
        rate(int(bytes_[DIGITS].sum())),
        rate(len(lines)),
        float(np.log((int(bytes_[UPPER].sum()) + 2) / (letters + 4 * STEADY))),
        float(np.log((kinds + 1) / (n + 1)) + 0.15 * np.log1p(n)),
    ]


def solved(low: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each row r the solution y of low @ y = r, by forward substitution; the sum of its squares is a squared distance."""
    y = np.empty_like(rows)
    for i in range(len(low)):
        y[:, i] = (rows[:, i] - y[:, :i] @ low[i, :i]) / low[i, i]
    return y


class Discriminant:
    """Fitted on figures x (rows by statistics) and labels y of 0 and 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.constant = None
        if len(np.unique(y)) < 2:
            self.constant = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
            return
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.centre) / self.scale
        groups = [z[y == k] for k in (0, 1)]
        within = [np.cov(g.T, bias=True) if len(g) > 1 else np.eye(z.shape[1]) for g in groups]
        pooled = sum(len(g) * c for g, c in zip(groups, within, strict=True)) / len(z)
        self.means = [g.mean(0) for g in groups]
        self.factors, self.offsets = [], []
        for g, c in zip(groups, within, strict=True):
            c = (1 - POOL) * c + POOL * pooled
            c = (1 - ROUND) * c + ROUND * max(np.trace(c) / len(c), 1e-6) * np.eye(len(c))
            low = np.linalg.cholesky(c)
            self.factors.append(low)
            self.offsets.append(np.log(len(g) / len(z)) - np.log(np.diag(low)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        log = [o - 0.5 * (solved(f, z - m) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -700, 700)))


def fit(docs: DataFrame, marks: DataFrame, column: str = "quality", rows_a_class: int = TRAIN_A_CLASS) -> Discriminant:
    """The model of at most rows_a_class documents a class; a document becomes its figures where it is read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in batches:
            for part in slices(batch):
                figures = [statistics(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(figures, pa.list_(pa.float64()))], [*names, "figures"])

    names = ["place", "doc_id", "label", "tie"]
    prepare = lambda rows: rows.select(*names, "text").mapInArrow(work, "place long, doc_id long, label int, tie long, figures array<double>")
    rows = training(docs, marks, column, rows_a_class, prepare).select("figures", "label").collect()  # bounded: 2 * rows_a_class
    return Discriminant(np.array([r["figures"] for r in rows], dtype=float), np.array([r["label"] for r in rows], dtype=int))


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of every row; other columns are not read."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(scorer(model, ["doc_id"], "score"), "doc_id long, score double")


def keep(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose score reaches the threshold."""
    names = docs.columns
    extra = fresh(names, "score")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField(extra, T.DoubleType())])
    return docs.mapInArrow(scorer(model, names, extra), schema).filter(F.col(extra) >= threshold).select(*names)


def scorer(model: Discriminant, names: list[str], extra: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in batches:
            for part in slices(batch):
                got = model.score(np.array([statistics(t or "") for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(got)], [*names, extra])

    return work


def op10_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, labels(spark, sf_dir)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
