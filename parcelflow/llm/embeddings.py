"""Near-duplicate vectors by an exact metric range join.

Cosine of at least `least` is a Euclidean distance of at most r = sqrt(2 - 2 least) between unit vectors.  Pivots,
spread over a bounded sample, partition the vectors into cells by the nearest pivot, and the vectors of a cell into blocks
of at most CELL; a block is one row.  Two blocks are joined unless the triangle inequality leaves no room for a pair: the
distance of their centres must be at most both radii plus r.  Blocks meet in a Cartesian product that reads them where they
are written, so nothing is sent for a pair of blocks, however many there are, and what is written grows with the vectors.
Single precision leaves out what is surely below the bound; what decides is double.

Equal vectors are one class first.  A task reports the number of links of each vector and a spanning forest of them, not
the links, so a group of near copies costs memory in proportion to its vectors.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of different
lengths don't link.  Rows keep their number and ids; repeated rows are linked copies; an empty table gives an empty
result; only vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm.common import materialise
from parcelflow.llm.graph import components, stars

LEAST = 0.9
#: Vectors of a block, pivots at most, their bytes at most, sampled vectors a pivot; bytes of a block's vectors.
CELL, PIVOTS, PIVOT_BYTES, SAMPLED, BLOCK_BYTES = 2048, 1024, 8 << 20, 8, 2 << 20
#: Files of blocks, and files for each so many blocks; a task has a pair of parts of files.
FILES, BLOCKS_EACH = 8, 8
TILE = 1024
#: Vectors that are compared with the pivots together; links that a task holds before it sums them up.
TOGETHER, SUMMED = 2048, 1 << 20
SLACK = 1e-9  # on distances, so that rounding never loses a pair


def unit(values: list | None) -> np.ndarray | None:
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, dtype=np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / math.sqrt(float(x @ x))


def raw(values: list) -> bytes:
    """The components in single precision if they are such, else in double."""
    x = np.array(values, dtype=np.float64)
    with np.errstate(over="ignore", under="ignore"):
        short = x.astype(np.float32)
    return (short if (short == x).all() else x).tobytes()


def unpacked(values: list[bytes], widths: list[int], width: int) -> np.ndarray:
    """Unit vectors of what raw() made, filled up to a width."""
    x = np.zeros((len(values), width))
    for k, (v, n) in enumerate(zip(values, widths, strict=True)):
        x[k, :n] = np.frombuffer(v, np.float32 if len(v) == 4 * n else np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def units(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    return [unit(v) for v in batch.column("embedding").to_pylist()]


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))


class Part:
    """A part's own vectors, the links that they have and the trees that these make."""

    def __init__(self, least: float, inner: bool = True) -> None:
        self.least, self.inner = least, inner
        self.held: list[tuple[np.ndarray, ...]] = []
        self.ready = False

    def add(self, *rows: np.ndarray) -> None:
        self.held.append(rows)

    def some(self) -> bool:
        """Whether there are own vectors; once all of them are there, they are joined with one another, if that is asked for."""
        if not self.ready and self.held:
            self.node, self.copies, self.wide, self.x = (np.concatenate(c) for c in zip(*self.held, strict=True))
            self.held, self.ready = [], True
            self.short = self.x.astype(np.float32)
            self.links, self.root = np.zeros(len(self.node), np.int64), np.arange(len(self.node))
            for i in range(0, len(self.node) if self.inner else 0, TILE):
                for j in range(i, len(self.node), TILE):
                    hit = self.near(i, self.x[j : j + TILE], self.wide[j : j + TILE])
                    if j == i:  # each pair once: above the diagonal
                        hit = np.triu(hit, 1)
                    if hit.any():
                        self.links[i : i + TILE] += hit @ self.copies[j : j + TILE]
                        self.links[j : j + TILE] += self.copies[i : i + TILE] @ hit
                        for a in np.flatnonzero(hit.any(1)).tolist():
                            self.unite(i + a, j + np.flatnonzero(hit[a]))
        return self.ready

    def near(self, i: int, x: np.ndarray, wide: np.ndarray) -> np.ndarray:
        # rounding of components and sums in single precision is less than what is left here
        hit = self.short[i : i + TILE] @ x.T.astype(np.float32) >= np.float32(self.least - (x.shape[1] + 16) * 1.2e-7)
        some, others = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if len(some):
            hit[np.ix_(some, others)] = (self.x[i + some] @ x[others].T >= self.least) & (self.wide[i + some, None] == wide[None, others])
        return hit

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return int(k)

    def unite(self, one: int, others: np.ndarray) -> None:
        for b in others[self.root[others] != self.find(one)].tolist():
            ra, rb = self.find(one), self.find(b)
            self.root[max(ra, rb)] = min(ra, rb)

    def visited(self, node: np.ndarray, copies: np.ndarray, wide: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        """The visitors that have links here, how many, and an own vector that each is linked with."""
        links, first = np.zeros(len(node), np.int64), np.full(len(node), -1)
        for j in range(0, len(node), TILE):
            for i in range(0, len(self.node), TILE):
                hit = self.near(i, x[j : j + TILE], wide[j : j + TILE])
                if not hit.any():
                    continue
                self.links[i : i + TILE] += hit @ copies[j : j + TILE]
                links[j : j + TILE] += self.copies[i : i + TILE] @ hit
                for b in np.flatnonzero(hit.any(0)).tolist():
                    with_ = i + np.flatnonzero(hit[:, b])
                    if first[j + b] < 0:
                        first[j + b] = with_[0]
                    self.unite(int(first[j + b]), with_)
        kept = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(links[kept]), pa.array(self.node[first[kept]])], ["node", "links", "root"])

    def done(self) -> pa.RecordBatch:
        if not self.some():
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["node", "links", "root"])
        top = np.array([self.find(k) for k in range(len(self.node))])
        kept = np.flatnonzero((self.links > 0) | (top != np.arange(len(self.node))))
        return pa.RecordBatch.from_arrays([pa.array(self.node[kept]), pa.array(self.links[kept]), pa.array(self.node[top[kept]])], ["node", "links", "root"])


class Tally:
    """Links of nodes summed up, and the trees that connect them."""

    def __init__(self) -> None:
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.trees: list[tuple[np.ndarray, np.ndarray]] = []
        self.more = 0

    def add(self, found: pa.RecordBatch) -> None:
        node, links, root = (found.column(c).to_numpy() for c in ("node", "links", "root"))
        self.links.append((node, links))
        self.trees.append((node, root))
        self.more += len(node)
        if self.more > SUMMED:
            self.sum()

    def sum(self) -> None:
        node, links = (np.concatenate([x[k] for x in self.links] or [np.zeros(0, np.int64)]) for k in (0, 1))
        node, at = np.unique(node, return_inverse=True)
        total = np.zeros(len(node), np.int64)
        np.add.at(total, at, links)
        self.links, self.trees, self.more = [(node, total)], [stars(*(np.concatenate([x[k] for x in self.trees] or [np.zeros(0, np.int64)]) for k in (0, 1)))], 0

    def done(self) -> pa.RecordBatch:
        self.sum()
        (node, links), (below, top) = self.links[0], self.trees[0]
        root = node.copy()
        root[np.searchsorted(node, below)] = top
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], ["node", "links", "root"])


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding)."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    radius = math.sqrt(max(0.0, 2 - 2 * least))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [None if u is None else hashlib.md5(u.tobytes()).digest() for u in units(batch)]
            h = [[None if x is None else int.from_bytes(x[k : k + 8], "little", signed=True) for x in d] for k in (0, 8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array(x, pa.int64()) for x in h)], ["vec_id", "h1", "h2"])

    rows = materialise(own.mapInArrow(classify, "vec_id long, h1 long, h2 long"), "vectors")
    classes = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, value = [], []
            for k, (v, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("embedding", "h1", "h2")), strict=True)):
                if (u := unit(v)) is not None:
                    d = hashlib.md5(u.tobytes()).digest()
                    if (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)) == (a, b):
                        keep.append(k)
                        value.append(v)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("copies"), pa.array([len(v) for v in value], pa.int32()), pa.array([raw(v) for v in value], pa.binary())], ["node", "copies", "width", "value"])

    # one row stands for a class; repeated rows of its first id would do so too
    stands = own.join(classes, F.col("vec_id").eqNullSafe(F.col("first"))).select("node", "copies", "h1", "h2", "embedding")
    reps = materialise(stands.mapInArrow(stand, "node long, copies long, width int, value binary").dropDuplicates(["node"]), "units")
    count, width = reps.agg(F.count("*"), F.max("width")).first()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    cells = max(1, min(PIVOTS, PIVOT_BYTES // (8 * width), -(-count // CELL)))
    sample = reps.orderBy(F.xxhash64("node"), "node").limit(SAMPLED * cells).collect()  # bounded
    points = unpacked([r["value"] for r in sample], [r["width"] for r in sample], width)
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < min(cells, len(points)):  # the farthest of the sample from those chosen
        far = np.minimum(far, apart(points, points[chosen[-1:]])[:, 0])
        chosen.append(int(far.argmax()))
    pivots = points[chosen]

    def home(batch: pa.RecordBatch) -> np.ndarray:
        """The nearest pivots of the rows, TOGETHER at a time."""
        parts = (batch.slice(k, TOGETHER) for k in range(0, batch.num_rows, TOGETHER))
        return np.concatenate([apart(unpacked(p.column("value").to_pylist(), p.column("width").to_pylist(), width), pivots).argmin(1) for p in parts])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(pivots), np.int64)
        for batch in batches:
            if batch.num_rows:
                n += np.bincount(home(batch), minlength=len(pivots))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(n)], ["cell", "n"])

    known = {r["cell"]: r["n"] for r in reps.mapInArrow(homes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    together = max(1, min(CELL, BLOCK_BYTES // (8 * width)))
    parts = np.array([max(1, -(-known[k] // together)) for k in range(len(pivots))])
    base = np.r_[0, np.cumsum(parts)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = home(batch)
                spot = (batch.column("node").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((base[cell] + spot % parts[cell]).astype(np.int32)), *batch.columns], ["part", *batch.schema.names])

    fixed = ["node", "copies", "width", "value"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("part", *fixed)), strict=True):
                if held and (p != part or len(held) == 2 * together):
                    yield block(held)
                    held = []
                part = p
                held.append(row)
        if held:
            yield block(held)

    def block(held: list[list]) -> pa.RecordBatch:
        node, copies, wide, value = zip(*held, strict=True)
        x = unpacked(list(value), list(wide), width)
        centre = x.mean(0)
        single = all(len(v) == 4 * n for v, n in zip(value, wide, strict=True))
        whole = np.zeros((len(x), width), np.float32 if single else np.float64)
        for k, (v, n) in enumerate(zip(value, wide, strict=True)):
            whole[k, :n] = np.frombuffer(v, np.float32 if len(v) == 4 * n else np.float64)
        blobs = [np.array(c, np.int64).tobytes() for c in (node, copies, wide)]
        columns = [pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float(apart(x, centre[None]).max())]), *(pa.array([v], pa.binary()) for v in (*blobs, whole.tobytes()))]
        return pa.RecordBatch.from_arrays(columns, ["centre", "reach", *fixed])

    files = max(min(len(pivots), FILES), int(base[-1]) // BLOCKS_EACH)
    dealt = reps.mapInArrow(deal, "part int, node long, copies long, width int, value binary").repartition(files, "part").sortWithinPartitions("part")
    blocks = dealt.mapInArrow(gather, "centre array<double>, reach double, node binary, copies binary, width binary, value binary")
    blocks = materialise(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")

    def opened(row: list[pa.Scalar]) -> tuple[np.ndarray, ...]:
        node, copies, wide = (np.frombuffer(b.as_buffer(), np.int64) for b in row[:3])
        value = row[3].as_buffer()
        x = np.frombuffer(value, np.float32 if value.size == 4 * width * len(node) else np.float64).reshape(-1, width).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        return node, copies, wide, x / np.sqrt((x * x).sum(1, keepdims=True))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks, all of a block one after the other; a block is joined with itself where it meets itself."""
        own, tally, last = None, Tally(), None
        for batch in batches:
            for a, b, *blobs in zip(*(batch.column(c) for c in ("block", "other", *fixed, *(f"{c}_" for c in fixed))), strict=True):
                if a.as_py() != last:
                    if own:
                        tally.add(own.done())
                    last, mine, own = a.as_py(), opened(blobs[:4]), Part(least, False)
                    own.add(*mine)
                    own.some()
                if b.as_py() == last:
                    self_ = Part(least)
                    self_.add(*mine)
                    tally.add(self_.done())
                else:
                    tally.add(own.visited(*opened(blobs[4:])))
        if own:
            tally.add(own.done())
        yield tally.done()

    others = blocks.withColumnsRenamed({"block": "other", **{c: f"{c}_" for c in ("centre", "reach", *fixed)}})
    one, two = F.col("block"), F.col("other")
    turn = F.when((one + two) % 2 == 0, one <= two).otherwise(one > two)  # each pair once, and no block all of its own
    between = F.sqrt(F.aggregate(F.zip_with("centre", "centre_", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda x, y: x + y))
    pairs = blocks.join(others.hint("shuffle_replicate_nl"), turn & (between <= F.col("reach") + F.col("reach_") + radius + SLACK))
    found = materialise(pairs.drop("centre", "centre_", "reach", "reach_").mapInArrow(join, "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    state = classes.join(links, "node", "left").join(comps, "node", "left").select("h1", "h2", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    ids = state.groupBy("component").agg(F.min("first").alias("component_id"))
    named = state.join(ids, "component").select("h1", "h2", "n_links", "component_id")
    out = rows.join(named, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
