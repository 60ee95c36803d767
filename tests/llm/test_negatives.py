"""Hard negatives against brute force: ties, awkward rows, skewed lists, scores beyond doubles."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from parcelflow.llm import negatives


def brute(rows, every=50):
    known = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in known if i % every == 0}:
        all_ = sorted(((-score(v, w), j, k) for j, k, w in known), key=lambda t: t[:2])
        for p, j, _ in [t for t in all_ if t[2] == lab and t[1] != i][:5]:
            hard = [t for t in all_ if t[2] != lab and 50 * -p <= 100 * -t[0] <= 95 * -p][:3]
            out += [(i, j, r + 1, t[1], -p, -t[0]) for r, t in enumerate(hard)]
    return sorted(out)


def made(seed, n=500, width=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(width)] for _ in range(12)]
    rows = [(i, rng.randrange(10), [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(n)]
    rows += [(1000 + i, i % 3, centres[0]) for i in range(200)]  # a third of the rows in one place
    rows += [(2000, None, centres[0]), (2050, 3, None), (2100, 3, [0.1, None, 0.2]), (2150, 3, [float("nan")] * width), (2200, 3, [float("inf")] + [0.0] * 5), (2250, 3, []), (2300, 4, [0.0] * width), (2350, 4, centres[1][:3]), (None, 3, centres[0])]
    return rows + [rows[50], rows[100], (150, 9, centres[2]), (2401, 77, centres[1]), (2500, -5, centres[3])]


def run(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, q string, list int").repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.mined(docs.select("vec_id", label.alias("label"), negatives.integers(F.col("embedding")).alias("q")), F.col("vec_id") % 50 == 0)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("lists, segment, ahead", [(512, 2048, 4), (16, 20, 2), (4, 7, 1)])
def test_negatives_as_brute_force(spark, monkeypatch, lists, segment, ahead):
    for name, value in (("LIST", lists), ("SEGMENT", segment), ("AHEAD", ahead), ("AT_ONCE", 3), ("HELD", segment)):
        monkeypatch.setattr(negatives, name, value)
    rows = made(lists)
    assert run(spark, rows) == brute(rows)


def test_scores_beyond_doubles(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, [float(np.float32(rng.randint(-3, 3) * 2.0**20 + rng.randint(0, 9))) for _ in range(3)]) for i in range(120)]
    assert run(spark, rows) == brute(rows)
    with pytest.raises(ValueError, match="64 bits"):
        run(spark, [(i, 1, [1e15, 1.0]) for i in range(3)])


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, 1, [0.5])]) == []


def test_bounds_hold_and_searches_stop():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 5)) * 300
    x = np.rint(centres[rng.integers(0, 8, 400)] + rng.normal(size=(400, 5)) * 9)
    index = negatives.Index(negatives.kmeans(x, 8), "<i2", True)
    own, far = index.nearest(x)
    np.maximum.at(index.radius, own, far)
    low, high = index.bounds(x)
    s = x @ x.T
    assert all((s[:, own == c] >= low[:, [c]]).all() and (s[:, own == c] <= high[:, [c]]).all() for c in range(8))
    fifth = np.sort(s, axis=1)[:, -5]
    assert (high < fifth[:, None]).mean() > 0.5  # most lists are below the kth score


def test_first_of_ties():
    s = np.array([[1, 3, 3, 3, 2], [-np.inf, 0, -np.inf, -np.inf, -np.inf], [-np.inf] * 5])
    assert [x.tolist() for x in negatives.first_of(s, 2)] == [[0, 0, 1], [1, 2, 1]]
    assert negatives.limits(-7, 50, 95) == (-3, -7) and negatives.limits(7, 50, 95) == (4, 6) and negatives.limits(0, 50, 95) == (0, 0)
