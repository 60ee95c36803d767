"""Repeated passages against brute force, on awkward rows and small windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parcelflow.llm import passages

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """doc_id, n_words, n_removed, kept_sha256 by comparing windows as they are."""
    least = {}
    for d, t in rows:
        w = SPACE.findall(t or "")
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                least[k] = min(least.get(k, d), d)
    out = Counter()
    for d, t in rows:
        w = SPACE.findall(t or "")
        cut = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                cut[i : i + window] = [True] * window
        kept = " ".join(x for x, c in zip(w, cut, strict=True) if not c)
        out[d, len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def made(seed, n=60, window=50):
    """Prose, copies, passages at every place, long words, repeated rows and ids, rows without text or id."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "the", "ö", "re", "×", "li"]) for _ in range(rng.randint(1, 4))) for _ in range(400)] + ["x" * 5000, "y" * 5000, "y" * 5000 + "z"]
    blank = lambda: rng.choice([" ", " ", " ", "\n", "\t ", "  \r\n", "\x0b"])
    prose = lambda k: [rng.choice(words) for _ in range(k)]
    join = lambda ws: "".join(w + blank() for w in ws)
    shared = [prose(window + k) for k in (-1, 0, 1, 9, 70)]
    rows = [(i, join(prose(rng.randint(0, 40)) + rng.choice(shared) + prose(rng.randint(0, 40)) + rng.choice(shared))) for i in range(n)]
    rows += [(100 + i, rows[3][1]) for i in range(4)] + [(200, join(rows[3][1].split()))]
    rows += [(300, ""), (301, None), (302, " \n "), (303, "a " * 200), (304, "a " * 500), (305, join(shared[4] * 3))]
    rows += [(3, rows[3][1]), (7, join(shared[4])), (None, join(shared[4])), (None, None), (-5, join(shared[4]) + " own words"), (400, "x" * 20000 + " " + join(shared[4]))]
    # the same words by the blanks that Python's str.split() would take too
    return rows + [(500, join(shared[4]).replace("\t ", " ")), (501, "\x1c".join(shared[4]))]


@pytest.mark.parametrize("window", [50, 7, 2, 1])
def test_passages_as_brute_force(spark, window):
    rows = made(window, window=window)
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, uid int, kind string").repartition(3)
    assert Counter(tuple(r) for r in passages.dedup(docs, window).collect()) == brute(rows, window)


def test_passages_of_no_rows_and_kept_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert passages.dedup(none).count() == 0
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x a b c y")], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept) for r in passages.dedup(docs, 3, text=True).collect()) == [(1, "a b c d"), (2, "x y")]


def test_one_passage_in_every_document_is_few_rows(spark):
    """A passage that all texts have: a task sends it for its smallest doc_id alone."""
    rng = random.Random(2)
    passage = " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(80))
    rows = [(i, f"w{i} {passage} v{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert Counter(tuple(r) for r in passages.dedup(docs).collect()) == brute(rows, 50)
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in rows]})
    shape = passages.Shape(50)
    _, _, h = shape.anchors(passages.Texts(batch.column("text")))
    assert len(np.unique(h)) < 40 < len(h)


def test_covers_have_every_distance():
    for period in [*range(1, 60), 31]:
        c = passages.cover(period)
        assert {int(a - b) % period for a in c for b in c} == set(range(period))
    assert len(passages.cover(31)) == 6
    for window in range(1, 120):
        s = passages.Shape(window)
        assert s.period - 1 + s.gram <= window and s.gram >= 1


def test_hashes_are_those_of_the_words():
    texts = ["a bb  ccc", "", None, "  d\ne ", "f" * 4095, "g" * 4096, "h" * 4097 + " i", "j " + " " * 9000 + "k", " ", "bb"]
    t = passages.Texts(pa.array(texts))
    words = [w for x in texts for w in SPACE.findall(x or "")]
    assert t.first.tolist() == np.cumsum([0] + [len(SPACE.findall(x or "")) for x in texts]).tolist()
    for lane in (0, 1):
        want = passages.mixed(np.array([passages.of_word(w.encode(), lane) for w in words], np.uint64))
        assert np.array_equal(t.hashes(lane), want)
    big = passages.Texts(pa.array(["x" * 3_000_000 + " y", "ab cd " * 400_000]))
    assert len(set(big.hashes(0).tolist())) == 4
    assert passages.Texts(pa.array([], pa.string())).first.tolist() == [0]
    assert passages.Texts(pa.array(["q r", "s t", "u"])[1:]).first.tolist() == [0, 2, 3]
