"""Hard negatives by inverted lists of k-means, visited in the order of Cauchy-Schwarz bounds.

Centroids are fitted on a bounded sample (SAMPLED rows a list, by the hash of their ids) and every row is put into the
list of its nearest one; a list keeps its radius, the greatest distance from the centroid c.  For an anchor a no row of
the list scores above a . c + |a| radius, nor below a . c - |a| radius.  Lists are stored in segments of at most SEGMENT
rows, so a list that holds a third of all rows is as many tasks as its rows need.

A search goes over the lists in two waves.  The first visits, of each anchor's lists in the order of their upper bounds,
the AHEAD first; what they yield gives each anchor a kth score.  The second visits the others, but for those whose bound
is strictly below that score: there the search stops, as all later bounds are lower still.  Equal bounds are visited, so
ties by the smaller id come out right.  Positives are searched so, then negatives, for which lists wholly outside the
window between two shares of the positive's score are skipped in both waves.  Anchors travel to the segments they visit, in
batches that are neighbours in the index; scores are made by blocks, a task gives the first k rows of each search among all its blocks away.

Scores are exact: components become integers, and sums are made in doubles only where all of them fit 53 bits.  Sums that
may not fit 64 bits raise an error.  Rows with a null id or label, a null vector or any null or non-finite component take
no part; missing components of shorter vectors count as 0; a row is no positive of an anchor with its own id; repeated
rows count each, repeated anchors once; an anchor without positives or negatives in the window has no rows; an empty
table gives an empty result; only vec_id, label and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.llm.common import materialise, merged

#: Rows a list should have, lists and bytes of their centroids at most, sampled rows a list, rounds of k-means.
LIST, LISTS, LIST_BYTES, SAMPLED, ROUNDS = 512, 1024, 8 << 20, 16, 8
#: Rows of a segment, lists of the first wave, anchors that are scored at once, bytes of vectors sent at once, results that a
#: task holds before it takes the first of each search.
SEGMENT, AHEAD, AT_ONCE, SENT, HELD = 2048, 4, 256, 4 << 20, 1 << 17
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Least and most of a negative's score, in hundredths of the positive's.
SHARE = (50, 95)


def integers(embedding: Column) -> Column:
    """floor(SCALE * x) of each component, null where a component is null or not finite."""
    e = embedding.cast("array<double>")
    whole = F.forall(e, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.when(whole, F.transform(e, lambda x: F.floor(SCALE * x).cast("long")))


class Index:
    """Centroids, radii and segments of the lists: bounded, whatever the number of rows."""

    def __init__(self, centroids: np.ndarray, kind: str, exact: bool) -> None:
        self.centroids, self.kind, self.exact = centroids, kind, exact
        self.radius = np.zeros(len(centroids))
        self.segments = np.ones(len(centroids), np.int64)

    def rows(self, q: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(q), self.centroids.shape[1]), self.kind)
        for k, x in enumerate(q):
            out[k, : len(x)] = x
        return out

    def read(self, blob: bytes) -> np.ndarray:
        """Rows of a blob, for scores."""
        return np.frombuffer(blob, self.kind).reshape(-1, self.centroids.shape[1]).astype(np.float64 if self.exact else np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x.astype(np.float64)
        d = (x * x).sum(1)[:, None] + (self.centroids**2).sum(1)[None] - 2 * x @ self.centroids.T
        own = d.argmin(1)
        return own, np.sqrt(((x - self.centroids[own]) ** 2).sum(1))

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each list may hold for each anchor."""
        a = a.astype(np.float64)
        middle, size = a @ self.centroids.T, np.sqrt((a * a).sum(1))[:, None]
        slack = 1e-9 * size * (np.sqrt((self.centroids**2).sum(1)) + self.radius)[None] + 1e-6
        return middle - size * self.radius[None] - slack, middle + size * self.radius[None] + slack


def kmeans(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of a sample; those left without rows keep their place."""
    x = sample.astype(np.float64)
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(ROUNDS):
        own = ((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def fitted(rows: DataFrame) -> Index | None:
    count, width, top = rows.agg(F.count("*"), F.max(F.size("q")), F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))).first()
    if not count:
        return None
    width, top = max(width, 1), top or 0
    if top * top * width >= 1 << 63:
        raise ValueError(f"components up to {top} make scores that 64 bits don't hold")
    lists = max(1, min(LISTS, LIST_BYTES // (8 * width), -(-count // LIST)))
    sample = [r["q"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(SAMPLED * lists).select("q").collect()]  # bounded
    how = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8", top * top * width < 1 << 53
    return Index(kmeans(Index(np.zeros((1, width)), *how).rows(sample), lists), *how)


def listed(rows: DataFrame, index: Index) -> DataFrame:
    """vec_id, label, value, list, far: each row in the list of its nearest centroid, with the distance from it."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = index.rows(batch.column("q").to_pylist())
            own, far = index.nearest(x) if len(x) else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(own, pa.int32()), pa.array(far)], ["vec_id", "label", "value", "list", "far"])

    return rows.mapInArrow(put, "vec_id long, label long, value binary, list int, far double")


def segments(lists: DataFrame, index: Index) -> DataFrame:
    """segment, ids, labels, rows: the stored lists, each segment in the order of ids."""
    base = np.r_[0, np.cumsum(index.segments)]
    known = F.array(*(F.lit(int(b)) for b in base[:-1])), F.array(*(F.lit(int(n)) for n in index.segments))
    first, n = (F.get(a, F.col("list")) for a in known)
    dealt = lists.select((first + F.pmod(F.xxhash64("vec_id", "value"), n)).cast("int").alias("segment"), "vec_id", "label", "value")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            s = batch.column("segment").to_numpy()
            cuts = np.r_[np.flatnonzero(np.r_[True, s[1:] != s[:-1]]), len(s)] if len(s) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if s[a] != at or sum(x.num_rows for x in held) >= 2 * SEGMENT:  # repeated rows may fill one
                    yield from one(at, held)
                    at, held = int(s[a]), []
                held += [batch.slice(k, min(SEGMENT, b - k)) for k in range(a, b, SEGMENT)]
        yield from one(at, held)

    def one(at: int | None, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            ids, labels = (np.concatenate([x.column(c).to_numpy() for x in held]).tobytes() for c in ("vec_id", "label"))
            rows = b"".join(v for x in held for v in x.column("value").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids, labels, rows))], ["segment", "ids", "labels", "rows"])

    return dealt.repartition("segment").sortWithinPartitions("segment", "vec_id").mapInArrow(store, "segment int, ids binary, labels binary, rows binary")


def limits(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest score from low to high hundredths of a score."""
    return -(-low * score // 100), high * score // 100


def visits(anchors: DataFrame, index: Index, first: bool, share: tuple[int, int] | None) -> DataFrame:
    """segment, anchors, ids, own, low, high, vectors: which anchors visit a segment in one of the two waves.

    Anchors (anchor, vec_id, label, value) have an array `scores` with a number for each of their searches; where shares
    of it limit a search, it is the positive's score.  `kth` holds the scores below which the searches stop; the first
    wave doesn't read it.
    """
    base = np.r_[0, np.cumsum(index.segments)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            value = batch.column("value").to_pylist()
            lower, upper = index.bounds(index.read(b"".join(value)))
            spans = [[limits(s, *share) if share else (0, 0) for s in x] for x in batch.column("scores").to_pylist()]
            inside = [[(upper[i] >= a) & (lower[i] <= b) if share else np.ones(upper.shape[1], bool) for a, b in x] for i, x in enumerate(spans)]
            wanted = np.stack([np.any(x, axis=0) for x in inside])
            place = np.argsort(np.argsort(np.where(wanted, -upper, np.inf), axis=1, kind="stable"), axis=1)  # in the order of bounds
            if first:
                go = wanted & (place < AHEAD)
            else:  # a search stops at bounds strictly below its kth score
                kth = batch.column("kth").to_pylist()
                on = [np.any([x & (upper[i] >= (-np.inf if stop is None else stop)) for x, stop in zip(inside[i], kth[i], strict=True)], axis=0) for i in range(n)]
                go = np.stack(on) & (place >= AHEAD)
            fixed = [batch.column(c).to_numpy() for c in ("anchor", "vec_id", "label")]
            most = max(map(len, spans))
            fixed += [np.array([[x[k] for x in xs] + [none] * (most - len(xs)) for xs in spans], np.int64) for k, none in ((0, 1), (1, 0))]  # from 1 to 0: nothing
            for c in np.flatnonzero(go.any(0)).tolist():
                who = np.flatnonzero(go[:, c])
                row = [*(x[who].tobytes() for x in fixed), b"".join(value[i] for i in who)]
                step = max(1, SENT // len(row[-1]))
                for k in range(base[c], base[c + 1], step):
                    to = np.arange(k, min(k + step, base[c + 1]))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(pa.array([x] * len(to), pa.binary()) for x in row)], ["segment", *names])

    names = ("anchors", "own_ids", "own", "low", "high", "vectors")
    return anchors.mapInArrow(send, "segment int, " + ", ".join(f"{c} binary" for c in names))


def first_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest finite scores of each row, of equal ones those further left."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def scored(met: DataFrame, index: Index, k: int, within: bool) -> DataFrame:
    """anchor, search, score, id: of each anchor's searches in a segment the first k rows."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows_held = 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in names), strict=True):
                numbers = [np.frombuffer(x.as_buffer(), np.int64) for x in row[:-2]]
                ids, labels, anchors, own_ids, own = numbers[:5]
                low, high = (x.reshape(len(anchors), -1) for x in numbers[5:])
                x, a = (index.read(x.as_buffer()) for x in row[-2:])
                for i in range(0, len(a), AT_ONCE):
                    e = min(i + AT_ONCE, len(a))
                    s = a[i:e] @ x.T
                    same = own[i:e, None] == labels[None]
                    for search in range(low.shape[1]):
                        ok = ~same & (s >= low[i:e, search, None]) & (s <= high[i:e, search, None]) if within else same & (own_ids[i:e, None] != ids[None])
                        r, c = first_of(np.where(ok, s if index.exact else ranks(s), -np.inf), k)
                        held.append([anchors[i + r], np.full(len(r), search, np.int32), s[r, c].astype(np.int64), ids[c]])
                        rows_held += len(r)
                if rows_held >= HELD:  # of the segments that a task has read
                    held = [merged(held)]
                    rows_held = len(held[0][0])
                    if 2 * rows_held >= HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], out)
                        held, rows_held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], out)

    def merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        """The first k of each search."""
        anchor, search, score_, id_ = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((id_, -score_, search, anchor))
        anchor, search, score_, id_ = (x[order] for x in (anchor, search, score_, id_))
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (search[1:] != search[:-1])][: len(anchor)])
        keep = np.arange(len(anchor)) - np.repeat(first, np.diff(np.r_[first, len(anchor)])) < k
        return [x[keep] for x in (anchor, search, score_, id_)]

    def ranks(s: np.ndarray) -> np.ndarray:
        """Doubles in the order of scores that doubles don't hold."""
        return np.unique(s, return_inverse=True)[1].reshape(s.shape).astype(np.float64)

    names, out = ("ids", "labels", "anchors", "own_ids", "own", "low", "high", "rows", "vectors"), ["anchor", "search", "score", "id"]
    return met.mapInArrow(score, "anchor long, search int, score long, id long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each search, with their rank."""
    order = Window.partitionBy("anchor", "search").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def searched(anchors: DataFrame, stored: DataFrame, index: Index, k: int, share: tuple[int, int] | None) -> DataFrame:
    """anchor, search, score, id, rank of each search's first k rows, by two waves over the lists."""
    wave = lambda a, first: scored(visits(a, index, first, share).join(merged(stored), "segment"), index, k, share is not None)
    one = materialise(best(wave(anchors, True), k), "first-wave")
    last = one.filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("search", "score"))).alias("last"))  # an entry a search
    kth = F.transform("scores", lambda _, i: F.try_element_at("last", i))
    two = wave(anchors.join(merged(last), "anchor", "left").withColumn("kth", kth).drop("last"), False)
    return materialise(best(one.drop("rank").unionByName(two), k), "second-wave")


def mined(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = SHARE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, q); anchor: which of them to mine for."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "q")
    rows = materialise(rows.filter("vec_id is not null and label is not null and q is not null"), "vectors")
    index = fitted(rows)
    if index is None:
        return rows.select("vec_id").withColumns({"positive_id": F.col("vec_id"), "rank": F.lit(1), "negative_id": F.col("vec_id"), "positive_score": F.col("vec_id"), "negative_score": F.col("vec_id")}).withColumnRenamed("vec_id", "anchor_id")
    lists = materialise(listed(rows, index), "lists")
    for r in lists.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # one row a list
        index.radius[r["list"]], index.segments[r["list"]] = r["far"], -(-r["n"] // SEGMENT)
    stored = materialise(segments(lists, index), "segments")

    # anchors of one list are neighbours, so that those of a batch visit the same lists
    asked = lists.filter(anchor).select("vec_id", "label", "value", "list").distinct().repartitionByRange("list", "vec_id").sortWithinPartitions("list", "vec_id")
    asked = materialise(asked.select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "value"), "anchors")
    near = searched(asked.withColumn("scores", F.array(F.lit(0).cast("long"))), stored, index, positives, None)
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])  # as many as there are positives
    hard = searched(asked.join(merged(near.groupBy("anchor").agg(ranked.alias("scores"))), "anchor"), stored, index, negatives, share)
    pairs = near.select("anchor", (F.col("rank") - 1).alias("search"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = hard.select("anchor", "search", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = asked.select("anchor", F.col("vec_id").alias("anchor_id"))
    return found.join(merged(pairs), ["anchor", "search"]).join(merged(named), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of embeddings whose vec_id is divisible by 50.

    Where vec_id is divisible by 7, the label is another one; awkward rows as in the module's description.
    """
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(v.select("vec_id", label.alias("label"), integers(F.col("embedding")).alias("q")), F.col("vec_id") % 50 == 0)
