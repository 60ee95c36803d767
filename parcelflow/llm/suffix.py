"""Repeated strings of LENGTH bytes across documents, by blockwise suffix sorting with a difference cover.

Two equal suffix prefixes must meet in one bucket, and long ties must be resolved without comparing them byte by byte.
Both rest on a cover: a sample of positions such that any two equal prefixes of LENGTH bytes have sampled positions at a
common offset.  A periodic difference cover has this property for all pairs at a density of about 1 / sqrt(period); as
only equal prefixes matter here, positions sampled by content have it at half that: the position in every window of
LENGTH - GRAM + 1 positions whose GRAM bytes hash lowest, the leftmost of equals.  Suffixes fall into buckets by the
hash at their sample.  Buckets are sorted one block at a time:

1. seeds: the hashes at the samples of each text are dealt into buckets; those that distinct texts share are sent back
   to the documents, so that suffixes without a possible equal never travel;
2. suffixes: for each shared seed a document sends the stretch of text that its suffixes there cover;
3. sorting: in a block, the text after each sample and the reversed text before it are sorted once and ranked; the
   prefix of a suffix that starts `a` bytes before its sample is then the pair of the rank class of `a` bytes to the
   left and that of LENGTH - a bytes to the right, so ties of any length are decided by two numbers.  The smallest
   doc_id of each class keeps its string; the other starts are sent back;
4. removal: each document drops the union of the strings at its starts.

Whole copies are settled before by 128-bit digests: the smallest doc_id of equal texts stands for them in steps 1 to 3.
Hashes choose buckets and candidates only; equality is decided on bytes.

Blocks have a bounded number of bytes (BLOCK), dealt by hashes, so memory does not depend on the input's size.  A null
text counts as empty; texts below LENGTH bytes lose nothing; rows with equal doc_ids never take from one another, and
rows without one neither take nor lose; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parcelflow.llm.common import documents, materialise, only, slices

LENGTH, GRAM = 50, 26
#: Bytes of text of a block, and the bytes of a document that are hashed at once.
BLOCK, PIECE = 5 << 20, 1 << 20
#: Rows that ask for seeds together, and buckets of seeds that a task has one after the other.
SENT, STREAM = 2048, 4
PLACE = np.uint64((1 << 21) - 1)  # bits of a hash that make room for a position of a piece
TABLE = np.random.Generator(np.random.PCG64(50)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def gram_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all strings of n bytes, by doubling."""
    parts, k = {1: TABLE[x]}, 1
    while 2 * k <= n:
        a = parts[k]
        parts[2 * k] = a[:-k] * np.uint64(pow(BASE, k, 1 << 64)) + a[k:]
        k *= 2
    out, at, m = np.zeros(len(x) - n + 1, np.uint64), 0, len(x) - n + 1
    for k in sorted(parts, reverse=True):
        if n - at >= k:
            out = out * np.uint64(pow(BASE, k, 1 << 64)) + parts[k][at : at + m]
            at += k
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def least(a: np.ndarray, width: int) -> np.ndarray:
    """The least value of every `width` neighbours."""
    n, k = len(a) - width + 1, 1
    while 2 * k <= width:
        a = np.minimum(a[:-k], a[k:])
        k *= 2
    return np.minimum(a[:n], a[width - k : width - k + n])


def samples(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each sampled position with suffixes of its own: its hash, place, first suffix and number of suffixes."""
    found = []
    for start in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
        x = np.frombuffer(text, np.uint8, min(len(text) - start, PIECE + LENGTH - 1), start)
        h = gram_hashes(x, GRAM)
        low = least((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1) & PLACE
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        at = low[first].astype(np.int64)
        found.append((h[at], at + start, first + start, np.diff(np.r_[first, len(low)])))
    if not found:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))  # type: ignore[return-value]


def utf8(t: str | None) -> bytes:
    return (t or "").encode("utf-8", "surrogatepass")


def uid_of(text: bytes) -> int:
    """Half of the digest, which tells texts apart among the rows of one doc_id."""
    return int.from_bytes(hashlib.md5(text).digest()[:8], "little", signed=True)


def key_of(doc: np.ndarray, uid: np.ndarray) -> np.ndarray:
    """A number for each row's id and text, by which it is dealt; a row without an id has that of its text."""
    x = (doc.astype(np.int64).view(np.uint64) * np.uint64(BASE)) ^ uid.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(BASE)
    return x ^ (x >> np.uint64(29))


def place_of(key: np.ndarray, blocks: int) -> np.ndarray:
    return (key % np.uint64(blocks)).astype(np.int64)


def rows(*columns) -> pa.RecordBatch:  # noqa: ANN002
    return pa.RecordBatch.from_arrays([pa.array(c, t) for _, c, t in columns], [n for n, _, _ in columns])


def blobs(key: np.ndarray, name: str, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each key, with the arrays' values of that key as binary."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    ends = np.r_[first[1:], len(key)][: len(first)]
    columns = [(name, key[first].astype(np.int32), pa.int32())]
    for k, v in arrays.items():
        v = v[order]
        columns.append((k, [v[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()))
    return rows(*columns)


def from_blob(column: pa.Array, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)])


def asked(rows_: list[tuple[int, bytes]], buckets: int, blocks: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """What some texts (doc_id, bytes) ask of each bucket of seeds, and the answers that are known among them.

    A seed that several of the texts have is answered here; two of them ask on, so that others learn of it.  So a
    passage that all documents have asks twice for each of these calls, and a seed takes the same bytes for any number
    of buckets.
    """
    seen: dict[int, tuple[int, bytes]] = {}
    for d, b in rows_:
        u = uid_of(b)
        if u not in seen or d < seen[u][0]:
            seen[u] = (d, b)  # the smallest doc_id of equal texts speaks for them
    h, doc, uid = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for u, (d, b) in seen.items():
        h.append(np.unique(samples(b)[0]))
        doc.append(np.full(len(h[-1]), d))
        uid.append(np.full(len(h[-1]), u))
    h, doc, uid = (np.concatenate(c) for c in (h, doc, uid))
    bucket = (h >> np.uint64(32)) % np.uint64(buckets)
    name = bucket << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
    order = np.argsort(name, kind="stable")
    name, bucket, doc, uid = name[order], bucket[order], doc[order], uid[order]
    first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.zeros(0, int)
    many = np.diff(np.r_[first, len(name)])
    several = np.repeat(many, many) > 1
    key = key_of(doc, uid)
    answers = blobs(place_of(key[several], blocks), "block", {"key": key[several], "hash": name[several]})
    ask = np.union1d(first, first[many > 1] + 1)
    return blobs(bucket[ask], "bucket", {"hash": name[ask].astype(np.uint32), "doc": doc[ask], "uid": uid[ask]}), answers


def seeds(docs: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """Step 1: block, key, hash of every seed that distinct texts share."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffix")
        for batch in batches:
            for part in slices(batch, rows=SENT):
                got = [(d, utf8(t)) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) if d is not None and t and len(t) * 4 >= LENGTH]
                ask, answers = asked(got, buckets, blocks)
                n = ask.num_rows
                if n:
                    yield pa.RecordBatch.from_arrays([ask.column(0), pa.nulls(n, pa.int32()), *ask.columns[1:], pa.nulls(n, pa.binary())], names)
                n = answers.num_rows
                if n:  # they pass through any task
                    block, key, name = answers.columns
                    yield pa.RecordBatch.from_arrays([block, block, name, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), key], names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffix")
        at, held = None, []
        for batch in batches:
            known = batch.filter(batch.column("block").is_valid())
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(c) for c in ("block", "key", "hash")], ["block", "key", "hash"])
            for k, block, *sent in zip(*(batch.column(c) for c in ("bucket", "block", "hash", "doc", "uid")), strict=True):
                if not block.is_valid:
                    if k.as_py() != at:
                        yield from one(at, held)
                        at, held = k.as_py(), []
                    held.append([np.frombuffer(x.as_py(), kind) for x, kind in zip(sent, (np.uint32, np.int64, np.int64), strict=True)])
        yield from one(at, held)

    def one(k: int | None, held: list) -> Iterator[pa.RecordBatch]:
        if held:
            h, doc, uid = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, doc, uid = h[order], doc[order], uid[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            several = np.minimum.reduceat(uid, first) != np.maximum.reduceat(uid, first)  # copies are one text
            hit = np.repeat(several, np.diff(np.r_[first, len(h)]))
            key = key_of(doc[hit], uid[hit])
            yield blobs(place_of(key, blocks), "block", {"key": key, "hash": h[hit].astype(np.uint64) | (np.uint64(k) << np.uint64(32))})

    names = ["bucket", "block", "hash", "doc", "uid", "key"]
    sent = docs.mapInArrow(send, "bucket int, block int, hash binary, doc binary, uid binary, key binary")
    return sent.repartition(max(1, buckets // STREAM), "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "block int, key binary, hash binary")


def stretches(docs: DataFrame, shared: DataFrame, firsts: DataFrame, buckets: int, seed_buckets: int, blocks: int) -> DataFrame:
    """Step 2: the texts around shared seeds, by the bucket of the seed."""

    def send(key: tuple, texts: Iterator[pa.RecordBatch], messages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: list[tuple] = []
        own: set[tuple[int, int]] = set()
        for batch in messages:
            for k, x, d, u in zip(*(batch.column(c) for c in ("key", "hash", "doc", "uid")), strict=True):
                if x.is_valid:
                    wanted.append((np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(x.as_buffer(), np.uint64)))
                else:
                    own.add((d.as_py(), u.as_py()))
        if not wanted:
            return
        keys, h = (np.concatenate(c) for c in zip(*wanted, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, h = keys[order], h[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        where = dict(zip(keys[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True), strict=True))
        out: list[bytes] = []
        got: list[tuple] = []
        for batch in texts:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                b = utf8(t)
                if d is None or len(b) < LENGTH or (k := (d, uid_of(b))) not in own:
                    continue
                own.discard(k)  # repeated rows
                a, e = where.get(int(key_of(np.array([d]), np.array([k[1]]))[0]), (0, 0))
                if a == e:
                    continue
                hashes, at, start, n = samples(b)
                names = ((hashes >> np.uint64(32)) % np.uint64(seed_buckets)) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
                hit = np.isin(names, h[a:e])
                for s, m in zip(start[hit].tolist(), n[hit].tolist(), strict=True):
                    out.append(b[s : s + m + LENGTH - 1])
                m = int(hit.sum())
                got.append((hashes[hit], np.full(m, d), np.full(m, k[1]), start[hit], n[hit], at[hit] - start[hit]))
        if not out:
            return
        hashes, docs_, uids, start, n, offset = (np.concatenate(c) for c in zip(*got, strict=True))
        # equal stretches of this block: those of larger doc_ids are gone, whatever others have, and don't travel
        least: dict[bytes, int] = {}
        ids = docs_.tolist()
        for b, d in zip(out, ids, strict=True):
            if least.setdefault(b, d) > d:
                least[b] = d
        gone = np.fromiter((least[b] < d for b, d in zip(out, ids, strict=True)), bool, len(out))
        if gone.any():
            d, u, a, e = runs(docs_[gone], uids[gone], start[gone], start[gone] + n[gone] - 1)
            made = blobs(place_of(key_of(d, u), blocks), "block", {"doc": d, "uid": u, "from": a, "to": e})
            block, *columns = made.columns
            null = pa.nulls(made.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([block, block, *columns, null, null, null], sent_names)
        kept = np.flatnonzero(~gone)
        hashes, docs_, uids, start, n, offset = (x[kept] for x in (hashes, docs_, uids, start, n, offset))
        bucket = (hashes >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        made = blobs(bucket, "bucket", {"doc": docs_.astype(np.int64), "uid": uids.astype(np.int64), "start": start.astype(np.int64), "n": n.astype(np.uint8), "offset": offset.astype(np.uint8)})
        ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))[np.asarray(made.column(0))]
        begins = np.r_[0, ends[:-1]]
        text = pa.array([b"".join(out[i] for i in kept[order[a:e]].tolist()) for a, e in zip(begins, ends, strict=True)], pa.binary())
        key_, doc_, uid_, start_, n_, offset_ = made.columns
        null = pa.nulls(made.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([key_, pa.nulls(made.num_rows, pa.int32()), doc_, uid_, start_, null, n_, offset_, text], sent_names)

    sent_names = ["bucket", "block", "doc", "uid", "from", "to", "n", "offset", "bytes"]
    schema = T.StructType.fromDDL("bucket int, block int, doc binary, uid binary, `from` binary, `to` binary, n binary, offset binary, bytes binary")
    messages = shared.select("block", "key", "hash", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("uid"))
    own_rows = firsts.select("block", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("hash"), "doc", "uid")
    return cogrouped(docs, messages.unionByName(own_rows), blocks, send, schema)


def runs(doc: np.ndarray, uid: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts (doc, uid, from, to) with neighbours put together."""
    order = np.lexsort((first, uid, doc))
    doc, uid, first, last = doc[order], uid[order], first[order], last[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (uid[1:] != uid[:-1]) | (first[1:] > last[:-1] + 1)])
    return doc[new], uid[new], first[new], np.maximum.reduceat(last, new)


def cogrouped(docs: DataFrame, messages: DataFrame, blocks: int, work, schema: T.StructType) -> DataFrame:  # noqa: ANN001
    """work() for each block: the rows of docs that belong to it, and the messages for it."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = np.array([i if x is None else x for i, x in enumerate(batch.column("doc_id").to_pylist())], dtype=np.int64)  # rows without an id go anywhere
            uid = np.array([uid_of(utf8(t)) for t in batch.column("text").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place_of(key_of(doc, uid), blocks), pa.int32()), *batch.columns], ["block", *batch.schema.names])

    def tables(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        only("suffix")
        made = list(work(key, left.to_batches(), right.to_batches()))
        return pa.Table.from_batches(made) if made else empty

    empty = to_arrow_schema(schema).empty_table()
    dealt = docs.mapInArrow(placed, T.StructType([T.StructField("block", T.IntegerType()), *(T.StructField(f.name, f.dataType) for f in docs.schema)]))
    return dealt.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(tables, schema)


def sort_block(doc: np.ndarray, n: np.ndarray, offset: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step 3: (stretch, suffix within it) of every string that a smaller doc has too."""
    size = n.astype(np.int64) + LENGTH - 1
    begin = np.r_[0, np.cumsum(size)[:-1]]
    at = begin + offset
    padded = np.r_[np.zeros(LENGTH, np.uint8), text, np.zeros(LENGTH, np.uint8)]
    right_size, left_size = begin + size - at, offset.astype(np.int64)

    def ranked(width: int, step: int, shift: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the texts on one side of the samples, and what each shares with its predecessor."""
        words = -(-width // 8)
        m = np.zeros((len(at), words * 8), np.uint8)
        for k in range(width):  # column by column: no index matrix
            m[:, k] = np.where(k < sizes, padded[np.clip(at + LENGTH + shift + step * k, 0, len(padded) - 1)], 0)
        keys = m.view(">u8").astype(np.uint64)
        order = np.lexsort(keys.T[::-1])
        same = m[order[1:]] == m[order[:-1]]
        return order, np.r_[0, np.where(same.all(1), words * 8, same.argmin(1))]

    reach = LENGTH - GRAM
    right, right_lcp = ranked(LENGTH, 1, 0, right_size)
    left, left_lcp = ranked(reach, -1, -1, left_size)
    classes = np.empty(len(at), np.int64)
    other = np.empty(len(at), np.int64)
    found = [], []
    for a in range(reach + 1):
        classes[right] = np.cumsum(right_lcp < LENGTH - a)
        other[left] = np.cumsum(left_lcp < a)
        j = left_size - a
        who = np.flatnonzero((j >= 0) & (j < n))
        key = classes[who] * (len(at) + 1) + other[who]
        order = np.argsort(key, kind="stable")
        k = key[order]
        if not len(k):
            continue
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        d = doc[who[order]]
        later = d > np.repeat(np.minimum.reduceat(d, first), np.diff(np.r_[first, len(k)]))
        found[0].append(who[order][later])
        found[1].append(j[who[order][later]])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)  # type: ignore[return-value]


def removals(sent: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """Steps 3: block, doc, uid, from, to (starts of removed strings, as runs) for the documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffix")
        at, held = None, []
        for batch in batches:
            known = batch.filter(batch.column("block").is_valid())
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(c) for c in out], out)
            for i, (k, block) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                if block is None:
                    if k != at:
                        yield from one(held)
                        at, held = k, []
                    held.append(batch.slice(i, 1))
        yield from one(held)

    def one(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if part:
            doc, uid, start, n, offset, text = (np.concatenate([from_blob(b.column(c), t) for b in part]) for c, t in (("doc", "i8"), ("uid", "i8"), ("from", "i8"), ("n", "u1"), ("offset", "u1"), ("bytes", "u1")))
            which, j = sort_block(doc, n, offset, text)
            if len(which):
                at = start[which] + j
                d, u, a, e = runs(doc[which], uid[which], at, at)
                yield blobs(place_of(key_of(d, u), blocks), "block", {"doc": d, "uid": u, "from": a, "to": e})

    out = ["block", "doc", "uid", "from", "to"]
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(work, "block int, doc binary, uid binary, `from` binary, `to` binary")


def spans_of(starts: np.ndarray, lasts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes, from runs of starts."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), (lasts + LENGTH).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, digest: bool = True, carry: Column | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (of removed bytes, packed pairs of 64-bit numbers) and kept_sha256, or else kept (the text).

    carry: a struct of each row that comes back beside its result, as `rest`.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    carried = carry is not None
    rest = [] if carry is None else [carry.alias("rest")]
    last = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    seed_buckets = max(1, -(-total // BLOCK))
    stretch_buckets = max(1, -(-total // BLOCK))

    # the smallest doc_id of each text
    digests = own.filter("doc_id is not null").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"))
    firsts = digests.groupBy("md5").agg(F.min("doc_id").alias("first"))

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("first").to_numpy()
            uid = np.array([int.from_bytes(bytes.fromhex(x)[:8], "little", signed=True) for x in batch.column("md5").to_pylist()], dtype=np.int64)
            yield rows(("block", place_of(key_of(first, uid), blocks), pa.int32()), ("doc", first, pa.int64()), ("uid", uid, pa.int64()))

    told = firsts.mapInArrow(half, "block int, doc long, uid long")
    shared = materialise(seeds(own, seed_buckets, blocks), "seeds")
    gone = materialise(removals(stretches(own, shared, told, stretch_buckets, seed_buckets, blocks), stretch_buckets, blocks), "starts")
    none = F.lit(None).cast("binary")
    mine = told.select("block", *(none.alias(c) for c in ("doc", "uid", "from", "to")), F.col("doc").alias("own_doc"), F.col("uid").alias("own_uid"))
    gone = gone.withColumns({"own_doc": F.lit(None).cast("long"), "own_uid": F.lit(None).cast("long")})

    def finish(key: tuple, texts: list[pa.RecordBatch], messages: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_: set[tuple[int, int]] = set()
        found: list[tuple] = []
        for batch in messages:
            for d, u, a, b, own_doc, own_uid in zip(*(batch.column(c) for c in ("doc", "uid", "from", "to", "own_doc", "own_uid")), strict=True):
                if a.is_valid:
                    found.append(tuple(np.frombuffer(x.as_buffer(), np.int64) for x in (d, u, a, b)))
                else:
                    own_.add((own_doc.as_py(), own_uid.as_py()))
        where: dict[tuple[int, int], tuple[int, int]] = {}
        if found:
            doc, uid, start, last = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((uid, doc))
            doc, uid, start, last = doc[order], uid[order], start[order], last[order]
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (uid[1:] != uid[:-1])])
            where = {(d, u): (a, b) for d, u, a, b in zip(doc[first].tolist(), uid[first].tolist(), first.tolist(), [*first[1:].tolist(), len(doc)], strict=True)}
        for batch in texts:
            out: list[tuple] = []
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                b = utf8(t)
                k = (d, uid_of(b))
                if d is None or len(b) < LENGTH:
                    cut = []
                elif k in own_:
                    a, e = where.get(k, (0, 0))
                    cut = spans_of(start[a:e], last[a:e]) if e else []
                else:  # the whole text is also that of a smaller doc_id
                    cut = [(0, len(b))]
                rest, at = [], 0
                for x, y in cut:
                    rest.append(b[at:x])
                    at = y
                rest.append(b[at:])
                left = b"".join(rest)
                out.append((d, len(b), np.array(cut, np.int64).tobytes(), hashlib.sha256(left).hexdigest() if digest else None, None if digest or t is None else left.decode("utf-8", "ignore")))
            c = list(zip(*out, strict=True)) or [()] * 5
            made = rows(("doc_id", c[0], pa.int64()), ("n_bytes", c[1], pa.int64()), ("spans", c[2], pa.binary()), ("kept_sha256", c[3], pa.string()), ("kept", c[4], pa.string()))
            yield made if not carried else pa.RecordBatch.from_arrays([*made.columns, batch.column("rest")], [*made.schema.names, "rest"])

    schema = T.StructType.fromDDL("doc_id long, n_bytes long, spans binary, kept_sha256 string, kept string")
    if carry is not None:
        schema.add("rest", last.schema["rest"].dataType)
    return cogrouped(last, gone.unionByName(mine), blocks, finish, schema)


def rewrite(docs: DataFrame) -> DataFrame:
    """docs with the removed bytes gone from each text, and n_chars, where there is one, put right.

    Bytes of a character that is cut through are dropped with it.  Null texts stay null.
    """
    names = [n for n in docs.columns if n not in ("doc_id", "text")]
    rest = F.struct(*(F.col(n) for n in names)) if names else F.struct(F.lit(0).alias("_"))
    found = dedup(docs, digest=False, carry=rest)
    out = found.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("kept").alias("text"), *(F.col(f"rest.{n}").alias(n) for n in names)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(documents(spark, sf_dir))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()), pa.array([len(s) for s in spans], pa.int64()), batch.column("kept_sha256")],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return found.select("doc_id", "n_bytes", "spans", "kept_sha256").mapInArrow(counts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
