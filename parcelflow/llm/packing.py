"""Best-fit packing of whole documents into sequences of bounded length, after Martello-Toth reduction.

Pieces of equal length are interchangeable, so the packing problem is that of a histogram with at most `size` entries,
whatever the number of documents.  The driver solves it on the histogram:

1. reduction: for a free length L, the set {L, K} dominates every other set with L if K is the longest length that fits
   beside it and no set of free pieces that fits there is together longer than K, as whatever is beside L in an optimum
   can change places with K; such sets are fixed for good, as many as there are pieces for.  All lengths are tested,
   longest first, until none is fixed any more;
2. the remainder is packed best-fit, longest first, whole groups of equally filled sequences at a time.

The result is a list of runs "the pieces of length L with ranks a to b go to sequences s, s+1, ..., q to each, from
offset o", whose number depends on `size` only.  Pieces get their ranks in groups of a length and a hash of their id,
so a length that a third of the pieces have is spread over many tasks.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.llm import bpe
from parcelflow.llm.common import WORDY_BYTES, documents, materialise, slices
from parcelflow.llm.encode import VOCABULARY

SIZE = 2048
#: Groups into which the pieces of one length are dealt for their ranks, at least; one more for each so many pieces.
SALTS, PIECES_A_SALT = 64, 100_000
END = 0


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; a null text is empty and has the end id alone."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path, bpe.LibraryBpe)
        for batch in batches:
            for part in slices(batch, size=WORDY_BYTES):
                rows: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), model.encode_packed([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    ids += END.to_bytes(4, "little")
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        x = ids[at : at + 4 * size]
                        rows.append((doc, k, at // 4, len(x) // 4, zlib.crc32(x)))
                cols = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Sequences of equal content, as runs of lengths: which pieces go where."""

    def __init__(self, counts: dict[int, int], size: int) -> None:
        self.size, self.sequences, self.fixed = size, 0, 0
        self.free = {n: c for n, c in counts.items() if c}
        self.taken: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, pieces, sequence, each, offset
        self.reduce()
        self.fixed = self.sequences
        self.best_fit()

    def put(self, length: int, each: int, sequence: int, sequences: int, offset: int) -> None:
        n = each * sequences
        self.runs.append((length, self.taken[length], n, sequence, each, offset))
        self.taken[length] += n
        self.free[length] -= n
        if not self.free[length]:
            del self.free[length]

    def fix(self, lengths: list[int], n: int) -> None:
        at = 0
        for x in lengths:
            self.put(x, 1, self.sequences, n, at)
            at += x
        self.sequences += n

    def reduce(self) -> None:
        # two pieces that fill a sequence dominate every other set with either of them
        for x in sorted(self.free, reverse=True):
            y = self.size - x
            if x == self.size:
                self.fix([x], self.free[x])
            elif x > y and x in self.free and y in self.free:
                self.fix([x, y], min(self.free[x], self.free[y]))
            elif x == y and self.free[x] > 1:
                n = self.free[x] // 2
                self.put(x, 2, self.sequences, n, 0)
                self.sequences += n
        while any([self.dominated(x) for x in sorted(self.free, reverse=True)]):
            pass

    def dominated(self, x: int) -> bool:
        """Fixes the sets {x, K} that dominate all others with x, or x alone where nothing fits beside it."""
        own, room = self.free.get(x, 0), self.size - x
        if not own:
            return False
        lengths = np.array(sorted(self.free), dtype=np.int64)
        others = lengths[: np.searchsorted(lengths, room, "right")]
        if own == 1:
            others = others[others != x]
        if not len(others):
            self.fix([x], own)
            return True
        k = int(others[-1])
        if k < room:
            # two pieces: for each the longest that fits beside it, which may be its equal if there is another one
            beside = np.searchsorted(others, room - others, "right") - 1
            alone = np.array([self.free[n] - (n == x) == 1 for n in others.tolist()])
            beside -= (beside == np.arange(len(others))) & alone
            pair = np.where(beside >= 0, others + others[beside], 0)
            if pair.max() > k or self.fills(others.tolist(), x, k, room):
                return False
        n = min(own, self.free[k]) if k != x else own // 2
        if k == x:
            self.put(x, 2, self.sequences, n, 0)
            self.sequences += n
        else:
            self.fix([x, k], n)
        return True

    def fills(self, others: list[int], x: int, k: int, room: int) -> bool:
        """Whether some of the other free pieces are together longer than k and fit into the room beside x."""
        sums, within, over = 1, (1 << (room + 1)) - 1, (1 << (room + 1)) - (1 << (k + 1))  # bit n: n can be reached
        for n in others:
            left, part = min(self.free[n] - (n == x), room // n), 1
            while left:
                part = min(part, left)
                sums |= sums << (n * part) & within
                left, part = left - part, 2 * part
            if sums & over:
                return True
        return False

    def best_fit(self) -> None:
        groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: first sequence, sequences
        rooms: list[int] = []

        def add(room: int, first: int, n: int) -> None:
            if n and room:
                if not groups[room]:
                    bisect.insort(rooms, room)
                heapq.heappush(groups[room], (first, n))

        for x in sorted(self.free, reverse=True):
            while (left := self.free.get(x, 0)) > 0:
                at = bisect.bisect_left(rooms, x)
                if at == len(rooms):
                    each = self.size // x
                    full, rest = divmod(left, each)
                    if full:
                        self.put(x, each, self.sequences, full, 0)
                        add(self.size - each * x, self.sequences, full)
                        self.sequences += full
                    if rest:
                        self.put(x, rest, self.sequences, 1, 0)
                        add(self.size - rest * x, self.sequences, 1)
                        self.sequences += 1
                    continue
                room = rooms[at]
                first, n = heapq.heappop(groups[room])
                if not groups[room]:
                    rooms.pop(at)
                each = room // x
                full = min(n, left // each)
                offset = self.size - room
                if full:
                    self.put(x, each, first, full, offset)
                    add(room - each * x, first, full)
                if full < n:  # what is left of x goes into one more sequence
                    rest = left - full * each
                    if rest:
                        self.put(x, rest, first + full, 1, offset)
                        add(room - rest * x, first + full, 1)
                    add(room, first + full + bool(rest), n - full - bool(rest))


def pack(found: DataFrame, size: int = SIZE) -> DataFrame:
    """found with sequence_id and offset; found has doc_id, piece and length and is read more than once."""
    salts = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.col("salts"))
    counts = found.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `size` rows
    plan = Plan({r["length"]: r["n"] for r in counts}, size)
    most = max([r["n"] for r in counts], default=0)
    dealt = found.withColumn("salts", F.lit(max(SALTS, most // PIECES_A_SALT))).withColumn("salt", salts)
    # ranks: within a length and salt, after all of the smaller salts
    groups = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = groups.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = dealt.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    runs: dict[int, np.ndarray] = {}
    for length in {r[0] for r in plan.runs}:
        runs[length] = np.array(sorted(r[1:] for r in plan.runs if r[0] == length), dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(lengths):
                at = np.flatnonzero(lengths == x)
                table = runs[int(x)]
                run = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                within = rank[at] - run[:, 0]
                sequence[at] = run[:, 2] + within // run[:, 3]
                offset[at] = run[:, 4] + within % run[:, 3] * x
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """Packs docs (doc_id, text): one row for each piece.

    Null and empty texts are pieces of one id; repeated ids and rows are packed like any others; an empty table gives
    an empty result; columns other than doc_id and text are not read.
    """
    return pack(materialise(pieces(docs, size, vocabulary), "pieces"), size)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(documents(spark, sf_dir))
