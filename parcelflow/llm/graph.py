"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import materialise, step_path

ROUNDS = 60


#: Edges that are turned into stars at once; a task holds no more.
TOGETHER = 1 << 20
#: Edges for which a round has one partition, up to as many as shuffles have.
EACH = 4096
#: Edges of a node from which it is a hub, at least, and as a share of all edges; the share bounds the number of hubs.
HUB, SHARE = 64, 1024


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node and the least node of its component, but for those least nodes."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:  # hook every root to the least neighbour, then shorten the paths
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            short = new[new]
            if (short == new).all():
                break
            new = short
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def forest(edges: DataFrame) -> DataFrame:
    """Of each TOGETHER edges (u, v) of a partition a spanning forest of stars; fewer edges with the same components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("u", "v")])
            if sum(len(x[0]) for x in held) >= TOGETHER:
                held = [list(stars(*(np.concatenate(c) for c in zip(*held, strict=True))))]
                if 2 * len(held[0][0]) >= TOGETHER:
                    yield made(held)
                    held = []
        if held:
            yield made([list(stars(*(np.concatenate(c) for c in zip(*held, strict=True))))])

    def made(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["u", "v"])

    return edges.mapInArrow(work, "u long, v long")


def beside(rows: DataFrame, table: DataFrame, total: int, key: list[str], count: str) -> DataFrame:
    """rows joined by key with table, which has one row for each key and, in `count`, the number of rows with it.

    Both are read more than once, so they should be written before.

    The rows of a hub stay where they are: hubs have at least 1 / SHARE of the total, so there are few, and they are
    broadcast.  All others are joined by shuffles, in which no key has more than that share.
    """
    least = max(HUB, total // SHARE)
    hubs = F.broadcast(table.filter(F.col(count) >= least).drop(count))
    rest = rows.join(hubs.select(*key), key, "left_anti").join(table.filter(F.col(count) < least).drop(count), key)
    return rows.join(hubs, key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node that has an edge (u, v) to another."""
    paths = [step_path(edges.sparkSession, label) for label in ("edges", "edges", "least", "large", "lower")]
    current = materialise(forest(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()), "edges", paths[0])
    before = None
    for k in range(ROUNDS):
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        parts = -(-state[0] // EACH)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written one by one: a plan of a whole round reads the edges dozens of times, which the driver has to hold
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")).coalesce(parts), "least", paths[2])
        large = materialise(beside(both.filter("v > u"), least, 2 * state[0], ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct().coalesce(parts), "large", paths[3])
        lower = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).coalesce(parts), "lower", paths[4])
        small = beside(large, lower, 2 * state[0], ["u"], "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialise(forest(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct().coalesce(parts)), "edges", paths[(k + 1) % 2])
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
