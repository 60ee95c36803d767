"""Repeated passages of `window` words across documents, found by anchors at the positions of a difference cover.

A difference cover of a period holds, for any two places, positions at one common distance after both: for words i and j
there is a k below the period with (i + k) and (j + k) both in the cover, modulo the period.  So the hashes of the GRAM
words after each position of the cover, a fifth of all positions, are enough to meet any two equal windows of
PERIOD - 1 + GRAM words or more: they share an aligned anchor.

1. anchors: each text sends the hashes at its cover positions; those that several texts have are sent back;
2. extension: only windows around shared anchors are compared whole, by 128-bit digests of their words.  The smallest
   doc_id of a digest keeps its window; the starts in other documents are sent back;
3. removal: each document drops the words that its starts cover.

Each step combines what a task has read before anything travels: of a window that many documents have, a task sends the
smallest doc_id's alone and settles the others at once, so a passage in all documents is a few rows a task.  What meets
at a key is sorted by Spark and scanned in a stream, so no group is held in memory; texts and the messages for them are
put side by side in the same way.  Whole copies are told by their md5: the smallest doc_id of equal texts stands for them.

A null text has no words; texts of fewer words than a window lose nothing; rows with equal doc_ids never take from one
another; rows without one neither take nor lose; repeated rows get equal results; an empty table gives an empty result;
other columns are left alone.  A text is held whole by one task, with some 40 bytes for each of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.llm.common import documents, materialise, only, slices

WINDOW, PERIOD, GRAM = 50, 31, 20
#: A perfect difference set, with every distance modulo 31 once.
PERFECT = {31: (1, 5, 11, 24, 25, 27)}
#: Bytes of text that are hashed at once, bytes of a word from which it is hashed alone, windows combined before they travel.
PIECE, LONG, TOGETHER = 1 << 20, 1 << 12, 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
RANDOM = np.random.Generator(np.random.PCG64(13))
#: For each of two hashes a random number for each byte, 0 for blanks, and powers of its base.
BYTES = RANDOM.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTES[:, [9, 10, 11, 12, 13, 32]] = 0
POWERS = np.stack([np.cumprod(np.full(LONG, b, np.uint64)) for b in BASES])
FIRST, HIT, TEXT = 0, 1, 2  # a row says that this text is the first of its copies, holds a message for it, or the text


def cover(period: int) -> np.ndarray:
    """Positions such that each distance modulo the period lies between two of them."""
    if period in PERFECT:
        return np.array(PERFECT[period])
    root = int(np.ceil(np.sqrt(period)))
    return np.unique(np.r_[np.arange(root), np.arange(0, period + root, root)] % period)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def of_word(word: bytes, lane: int) -> int:
    if len(word) > LONG:
        return xxhash.xxh3_64_intdigest(word, seed=lane)
    return int((BYTES[lane][np.frombuffer(word, np.uint8)] * POWERS[lane][: len(word)]).sum())


class Texts:
    """The words of several texts: `start`, the place of each in the bytes, and `first`, that of each text among the words."""

    def __init__(self, column: pa.Array) -> None:
        column = pc.fill_null(column, "")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        self.bytes = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        begin = np.zeros(len(self.bytes) + 1, bool)
        begin[at - at[0]] = True
        solid = BYTES[0][self.bytes] != 0
        self.start = np.flatnonzero(solid & (begin[:-1] | np.r_[True, ~solid[:-1]][: len(solid)]))
        self.first = np.searchsorted(self.start, at - at[0])

    def hashes(self, lane: int) -> np.ndarray:
        """A hash of each word."""
        out = np.zeros(len(self.start), np.uint64)
        end = np.r_[self.start[1:], len(self.bytes)]
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + PIECE)))
            a = self.start[i]
            s, size = self.start[i:j] - a, end[i:j] - self.start[i:j]
            if end[j - 1] - a <= 2 * PIECE:
                x = self.bytes[a : end[j - 1]]
                out[i:j] = np.add.reduceat(BYTES[lane][x] * POWERS[lane][np.minimum(np.arange(len(x)) - np.repeat(s, size), LONG - 1)], s)
            for k in np.flatnonzero(size >= LONG).tolist():  # long words, or many blanks after a word
                out[i + k] = of_word(self.bytes[a + s[k] : a + s[k] + size[k]].tobytes().split()[0], lane)
            i = j
        return mixed(out)


def sums(x: np.ndarray, n: int, base: int) -> np.ndarray:
    """Mixed polynomials of all n neighbouring hashes, by doubling."""
    m = max(len(x) - n + 1, 0)
    if not m:
        return np.zeros(0, np.uint64)
    out, at, k, part = np.zeros(m, np.uint64), 0, 1, x
    while True:
        if n & k:
            out = out * np.uint64(pow(base, k, 1 << 64)) + part[at : at + m]
            at += k
        if 2 * k > n:
            return mixed(out)
        part = part[:-k] * np.uint64(pow(base, k, 1 << 64)) + part[k:]
        k *= 2


class Shape:
    """A window's length, and the period and the words of an anchor that follow from it."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.period = PERIOD if window >= PERIOD + GRAM - 1 else max(1, window // 2)
        self.gram = window - self.period + 1 if window < PERIOD + GRAM - 1 else GRAM
        self.inside = np.isin(np.arange(self.period), cover(self.period))

    def anchors(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor the text, the word and the hash."""
        h = sums(texts.hashes(0), self.gram, BASES[0])
        n = np.diff(texts.first)
        which = np.repeat(np.arange(len(n)), n)[: len(h)]
        within = np.arange(len(h)) - texts.first[which]
        at = np.flatnonzero(self.inside[within % self.period] & (n[which] >= self.window) & (within + self.gram <= n[which]))
        return which[at], at, h[at]

    def around(self, texts: Texts, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Starts of the windows with one of the anchors."""
        reach = np.zeros(len(texts.start) + 1, np.int64)
        np.add.at(reach, np.maximum(at - (self.window - self.gram), texts.first[which]), 1)
        np.add.at(reach, np.minimum(at, texts.first[which + 1] - self.window) + 1, -1)
        return np.flatnonzero(np.cumsum(reach) > 0)

    def digests(self, texts: Texts, starts: np.ndarray) -> list[np.ndarray]:
        return [sums(texts.hashes(k), self.window, BASES[k])[starts] for k in (0, 1)]


def table(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def anchors(texts: DataFrame, shape: Shape) -> DataFrame:
    """doc, uid and a: the anchors of each text that other texts have too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("passages")
        for batch in batches:
            for part in slices(batch, rows=4096, size=PIECE):
                which, _, h = shape.anchors(Texts(part.column("text")))
                doc, uid = (part.column(c).to_numpy()[which] for c in ("doc", "uid"))
                order = np.lexsort((doc, uid, h))
                h, doc, uid = h[order], doc[order], uid[order]
                new_hash = np.r_[True, h[1:] != h[:-1]][: len(h)]
                new = new_hash | np.r_[True, uid[1:] != uid[:-1]][: len(h)]  # of copies the smallest doc_id asks
                h, doc, uid, new_hash = h[new], doc[new], uid[new], new_hash[new]
                first = np.flatnonzero(new_hash)
                many = np.diff(np.r_[first, len(h)])
                known = np.repeat(many, many) > 1
                # what several of these texts have is known; two of them ask on, so that others learn of it
                ask = np.union1d(first, first[many > 1] + 1)
                spot = np.r_[h[ask], mixed(h[known] ^ uid[known].view(np.uint64))].view(np.int64)
                told = np.r_[np.zeros(len(ask), bool), np.ones(int(known.sum()), bool)]
                take = np.r_[ask, np.flatnonzero(known)]
                yield table({"known": (told, pa.bool_()), "spot": (spot, pa.int64()), "doc": (doc[take], pa.int64()), "uid": (uid[take], pa.int64()), "a": (h[take].view(np.int64), pa.int64())})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last text of the hash that was read last, and whether it was told
        for batch in batches:
            known, doc, uid, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("known", "doc", "uid", "a"))
            yield table({c: (batch.column(c).to_numpy()[known], pa.int64()) for c in names})
            h, uid, doc = h[~known], uid[~known], doc[~known]
            told = np.zeros(len(h), bool)
            if held is not None:
                h, uid, doc, told = (np.r_[x, y] for x, y in zip(held, (h, uid, doc, told), strict=True))
            if not len(h):
                continue
            new = np.r_[True, (h[1:] != h[:-1]) | (uid[1:] != uid[:-1])]
            h, uid, doc, told = h[new], uid[new], doc[new], told[new]
            same = h[1:] == h[:-1]
            shared = np.r_[False, same] | np.r_[same, False]
            shared[0] |= told[0]
            out = shared & ~told
            yield table({"doc": (doc[out], pa.int64()), "uid": (uid[out], pa.int64()), "a": (h[out], pa.int64())})
            held = h[-1:], uid[-1:], doc[-1:], shared[-1:]

    names = ("doc", "uid", "a")
    sent = texts.mapInArrow(send, "known boolean, spot long, doc long, uid long, a long")
    return sent.repartition("spot").sortWithinPartitions("known", "spot", "uid", "doc").mapInArrow(scan, "doc long, uid long, a long")


def beside(texts: DataFrame, messages: DataFrame) -> DataFrame:
    """Texts and the messages for them: in a partition those for a text stand before its rows."""
    both = texts.withColumn("kind", F.lit(TEXT)).unionByName(messages, allowMissingColumns=True)
    return both.repartition("doc", "uid").sortWithinPartitions("doc", "uid", "kind")


def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[bool, list]]]]:
    """The rows with texts of each batch; for each of them, whether it is the first of its copies, and its messages (a, b)."""
    held: list = [None, False, []]
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, uid, kind = (batch.column(c).to_numpy() for c in ("doc", "uid", "kind"))
        a, b = (pc.fill_null(batch.column(c), 0).to_numpy() for c in ("a", "b"))
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (uid[1:] != uid[:-1])])
        found: list[tuple[bool, list]] = []
        for s, e in zip(new.tolist(), [*new[1:].tolist(), len(doc)], strict=True):
            if held[0] != (doc[s], uid[s]):
                held = [(doc[s], uid[s]), False, []]
            hits, text = (s + int(np.searchsorted(kind[s:e], k)) for k in (HIT, TEXT))
            held[1] |= hits > s
            if text > hits:
                held[2].append((a[hits:text], b[hits:text]))
            found += [(held[1], held[2])] * (e - text)
        rows = batch.filter(pa.array(kind == TEXT))
        if rows.num_rows:
            yield rows, found


def starts(both: DataFrame, shape: Shape) -> DataFrame:
    """doc, uid, a, b: the runs of starts of windows that a smaller doc_id has too."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("passages")
        held: list[list[np.ndarray]] = []
        for rows, messages in told(batches):
            doc, uid = (rows.column(c).to_numpy() for c in ("doc", "uid"))
            keep = [i for i, (first, hits) in enumerate(messages) if first and hits and (i == 0 or (doc[i], uid[i]) != (doc[i - 1], uid[i - 1]))]
            chosen = rows.take(pa.array(keep, pa.int64()))
            done = 0
            for part in slices(chosen, rows=4096, size=PIECE):
                texts = Texts(part.column("text"))
                which, at, h = shape.anchors(texts)
                own = [np.concatenate([x for x, _ in messages[i][1]]) for i in keep[done : done + part.num_rows]]
                done += part.num_rows
                salt = mixed(np.arange(1, len(own) + 1, dtype=np.uint64))
                wanted = np.concatenate(own).view(np.uint64) ^ np.repeat(salt, [len(x) for x in own])
                hit = np.isin(h ^ salt[which], wanted)
                start = shape.around(texts, which[hit], at[hit])
                text = np.searchsorted(texts.first, start, side="right") - 1
                held.append([*shape.digests(texts, start), part.column("doc").to_numpy()[text], part.column("uid").to_numpy()[text], start - texts.first[text]])
                if sum(len(x[0]) for x in held) >= TOGETHER:
                    yield combined(held)
                    held = []
        if held:
            yield combined(held)

    def combined(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        w1, w2, doc, uid, at = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((at, doc, w2, w1))
        w1, w2, doc, uid, at = (x[order] for x in (w1, w2, doc, uid, at))
        first = np.flatnonzero(np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])][: len(w1)])
        gone = doc > np.repeat(doc[first], np.diff(np.r_[first, len(w1)]))
        d, u, a, b = runs(doc[gone], uid[gone], at[gone])
        ask = ~gone
        n, m = int(ask.sum()), len(d)
        spot = np.r_[w1[ask].view(np.int64), mixed(u.view(np.uint64) ^ a.astype(np.uint64)).view(np.int64)]
        columns = [(np.r_[np.zeros(n, bool), np.ones(m, bool)], pa.bool_()), (spot, pa.int64()), (np.r_[w2[ask].view(np.int64), np.zeros(m, np.int64)], pa.int64())]
        columns += [(np.r_[x[ask], y], pa.int64()) for x, y in ((doc, d), (uid, u), (at, a), (at, b))]
        return table(dict(zip(("known", "spot", "w2", "doc", "uid", "a", "b"), columns, strict=True)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # a digest and its smallest doc_id
        for batch in batches:
            known, w1, w2, doc, uid, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("known", "spot", "w2", "doc", "uid", "a", "b"))
            ask = np.flatnonzero(~known)
            gone = known.copy()
            if len(ask):
                x, y, d = w1[ask], w2[ask], doc[ask]
                first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                least = d[first]
                if last is not None and last[:2] == (x[0], y[0]):
                    least[0] = last[2]
                gone[ask] = d > np.repeat(least, np.diff(np.r_[first, len(d)]))
                last = x[-1], y[-1], least[-1]
            yield table({"doc": (doc[gone], pa.int64()), "uid": (uid[gone], pa.int64()), "a": (a[gone], pa.int64()), "b": (b[gone], pa.int64())})

    sent = both.mapInArrow(extend, "known boolean, spot long, w2 long, doc long, uid long, a long, b long")
    return sent.repartition("spot", "w2").sortWithinPartitions("known", "spot", "w2", "doc").mapInArrow(scan, "doc long, uid long, a long, b long")


def runs(doc: np.ndarray, uid: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (doc, uid, first, last) of neighbouring places."""
    order = np.lexsort((at, uid, doc))
    doc, uid, at = doc[order], uid[order], at[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (uid[1:] != uid[:-1]) | (at[1:] > at[:-1] + 1)][: len(at)])
    return doc[new], uid[new], at[new], at[np.r_[new[1:], len(at)][: len(new)] - 1]


def removed(n: int, first: bool, messages: list, window: int) -> np.ndarray:
    """Which of a text's n words go."""
    if n < window:
        return np.zeros(n, bool)
    if not first:  # the whole text is that of a smaller doc_id too
        return np.ones(n, bool)
    reach = np.zeros(n + window + 1, np.int64)
    for a, b in messages:
        np.add.at(reach, a, 1)
        np.add.at(reach, b + window, -1)
    return np.cumsum(reach)[:n] > 0


def dedup(docs: DataFrame, window: int = WINDOW, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs; if text is asked for, also kept: the words left, joined by blanks."""
    shape = Shape(window)
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).withColumn("uid", F.xxhash64(F.coalesce("text", F.lit(""))))
    named = own.filter("doc is not null")
    long = named.filter(F.octet_length("text") >= 2 * window - 1)  # others have too few words
    firsts = long.groupBy(F.md5(F.col("text").cast("binary")).alias("md5"), "uid").agg(F.min("doc").alias("doc")).select("doc", "uid", F.lit(FIRST).alias("kind"))
    firsts = materialise(firsts, "firsts")
    hits = materialise(anchors(long, shape), "anchors")
    hits = firsts.unionByName(hits.withColumn("kind", F.lit(HIT)), allowMissingColumns=True).withColumn("b", F.lit(0).cast("long"))
    gone = materialise(starts(beside(long, hits), shape), "starts")
    messages = firsts.unionByName(gone.withColumn("kind", F.lit(HIT)), allowMissingColumns=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("passages")
        for rows, found in told(batches):
            yield result(rows, found)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield result(rows, [(True, [])] * rows.num_rows)

    def result(rows: pa.RecordBatch, found: list[tuple[bool, list]]) -> pa.RecordBatch:
        out = []
        for value, (first, hits_) in zip(rows.column("text"), found, strict=True):
            words = value.as_buffer().to_pybytes().split() if value.is_valid else []
            if first and not hits_:
                n, left = 0, words
            else:
                cut = removed(len(words), first, hits_, window)
                n = int(cut.sum())
                left = words if not n else [] if n == len(words) else [w for w, x in zip(words, cut.tolist(), strict=True) if not x]
            kept = b" ".join(left)
            out.append((len(words), n, hashlib.sha256(kept).hexdigest(), kept.decode() if text else None))
        columns = list(zip(*out, strict=True)) or [()] * 4
        return table({"doc_id": (rows.column("doc"), pa.int64()), **{c: (v, t) for c, v, t in zip(("n_words", "n_removed", "kept_sha256", "kept"), columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)}})

    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    done = beside(named, messages).mapInArrow(finish, schema).unionByName(own.filter("doc is null").mapInArrow(alone, schema))
    done = materialise(done, "passages")
    return done if text else done.drop("kept")


def op13_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of documents; awkward rows as in the module's description."""
    return dedup(documents(spark, sf_dir))
