"""Spelling variants of words: pairs that one inserted, deleted or replaced letter tells apart, and the frequent form of each.

One edit leaves a half intact.  For a pair whose longer word has m letters, the edited letter is the longer word's first
that differs from the other's; if it lies in the second half, both share their first m // 2 letters and stand in one
block of the forward dictionary, sorted by words; otherwise both share their last m - m // 2 letters and stand in one
block of the reversed dictionary.  So a word has four places: as one of the longer and one of the shorter words of
either dictionary.  Keys are sorted by Spark, and a task scans the range of each block.

A block is known by what all its words share: `head` first letters and `tail` last ones.  Skewed blocks are subdivided in
the same way, by halves of the letters between, until a block is small or one letter is left between, of which there are
as many as the alphabet has: once for all by counts of blocks, where a block holds a notable share of all words, and for
the rest by the task that scans it.  Each pair is verified letter by letter and is counted in the one block that holds
the place of its edit, so nothing is counted twice.

A null text has no words; a row without an id counts as if its id were the empty text; repeated rows count each time; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm.common import documents, materialise

LETTERS, OTHERS = "abcdefghijklmnopqrstuvwxyz", "À-ÿ"
#: Runs that lose a letter: those whose hash is divisible by DROPPED; letters of a word and its occurrences, at least.
DROPPED, LEAST_LETTERS, LEAST_COUNT = 31, 7, 2
#: How many times as frequent a word's form is.
TIMES = 10
#: Words of a block from which it is subdivided, within a task and before; in the latter case also as a share of all
#: places, so that at most SHARE blocks are told to all tasks.
FEW, LARGE, SHARE = 16, 4096, 1 << 14
#: Words with results that a task holds before it gives them away.
HELD = 8192


def counted(docs: DataFrame, least_letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """word and n: runs of letters with A-Z lower-cased, some of them, by a hash of id and run, without one letter."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.translate(F.col("text").cast("string"), LETTERS.upper(), LETTERS)
    # a run with too few letters has too few without one of them as well
    run = docs.select(doc_id.alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"[a-z{OTHERS}]{{{least_letters},}}"), 0)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    size = F.length("run")
    at = (F.col("h") % size).cast("int")
    less = F.concat(F.left("run", at), F.right("run", size - at - 1))
    word = run.withColumn("h", h).select(F.when(F.col("h") % DROPPED == 0, less).otherwise(F.col("run")).alias("word"))
    return word.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def places(words: DataFrame) -> DataFrame:
    """word, n and its blocks: size (of the longer words), head, tail and key."""
    size = F.length("word")
    half = lambda m: (m / 2).cast("int")
    block = lambda m, a, b: F.struct(m.alias("size"), a.alias("head"), b.alias("tail"))
    none = F.lit(0)
    blocks = [x for m in (size, size + 1) for x in (block(m, half(m), none), block(m, none, m - half(m)))]
    return keyed(words.select("word", "n", F.inline(F.array(*blocks))))


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.xxhash64("size", "head", "tail", F.left("word", F.col("head")), F.right("word", F.col("tail"))))


def subdivided(rows: DataFrame) -> DataFrame:
    """The two blocks of each place, by halves of the letters between head and tail."""
    between = F.col("size") - F.col("head") - F.col("tail")
    half = (between / 2).cast("int")
    block = lambda a, b: F.struct("size", a.alias("head"), b.alias("tail"))
    return keyed(rows.select("word", "n", F.inline(F.array(block(F.col("head") + half, F.col("tail")), block(F.col("head"), F.col("tail") + between - half)))))


def edited(u: str, v: str, size: int, head: int, tail: int) -> bool:
    """Whether one edit between head and tail makes one of the words the other."""
    if len(u) < len(v):
        u, v = v, u
    if len(u) != size or u == v:
        return False  # two of the shorter words meet where they are the longer ones
    k = 0
    for x, y in zip(u, v, strict=False):
        if x != y:
            break
        k += 1
    return head <= k < size - tail and u[k + 1 :] == v[k + (len(v) == size) :]


def pairs(run: list[tuple[str, int]], size: int, head: int, tail: int) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    """Pairs of a block's words (with their counts) that one edit between head and tail tells apart."""
    between = size - head - tail
    if len(run) <= FEW or between < 2:
        for i, x in enumerate(run):
            for y in run[:i]:
                if edited(x[0], y[0], size, head, tail):
                    yield x, y
        return
    half = between // 2
    for a, b in ((head + half, tail), (head, tail + between - half)):
        parts = defaultdict(list)
        for x in run:
            w = x[0]
            parts[w[head:a], w[len(w) - b : len(w) - tail]].append(x)
        for part in parts.values():
            if len(part) > 1:
                yield from pairs(part, size, a, b)


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near and best (least_n, the count with a minus, and form) of the words that have near ones."""
    total = words.count()
    waiting, blocks = places(words), []
    while True:
        least = max(LARGE, 4 * total // SHARE)
        hot = materialise(waiting.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") >= least).select("key"), "blocks")
        if hot.isEmpty():
            blocks.append(waiting)
            break
        blocks.append(waiting.join(F.broadcast(hot), "key", "left_anti"))
        # one letter between is never so many words
        waiting = materialise(subdivided(waiting.join(F.broadcast(hot), "key", "left_semi")), "halves")
        total = -(-waiting.count() // 4)
    rows = blocks[0]
    for more in blocks[1:]:
        rows = rows.unionByName(more)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "size", "head", "tail", "word", "n")
        read = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        found: dict[str, tuple[int, int, str]] = {}
        for (_, size, head, tail), run in groupby(read, lambda r: r[:4]):
            for x, y in pairs([r[4:] for r in run], size, head, tail):
                for (word, _), (other, n) in ((x, y), (y, x)):
                    near, *best = found.get(word, (0, 1, ""))
                    found[word] = (near + 1, *min(tuple(best), (-n, other)))
            if len(found) > HELD:
                yield given(found)
                found.clear()
        yield given(found)

    def given(found: dict[str, tuple[int, int, str]]) -> pa.RecordBatch:
        near, n, form = zip(*found.values(), strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(near, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string())], ["word", "near", "less", "form"])

    scanned = rows.select("key", "size", "head", "tail", "word", "n").repartition("key").sortWithinPartitions("key", "size", "head", "tail").mapInArrow(scan, "word string, near long, less long, form string")
    return scanned.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the last form from each word (word, form), by doubling steps; forms grow tenfold, so steps end soon."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    words = materialise(counted(docs, least_letters, least), "words")
    near = words.join(neighbours(words), "word", "left")
    form = lambda c: F.when(-F.col("best.less") >= times * F.col("n"), c)  # noqa: E731  that of the largest n, ties by the smallest
    state = materialise(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form(F.col("best.form")).alias("form"), form(-F.col("best.less")).alias("form_n")), "near")
    ends = roots(materialise(state.filter("form is not null").select("word", "form"), "forms"))
    return state.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of documents; awkward rows as in the module's description."""
    return variants(documents(spark, sf_dir))

