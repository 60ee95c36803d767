"""Shapes against counting on a fine grid: repair, remainders, unions, common boundaries, overlays."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import arrangement as A
from parcelflow.functions import geometry as G
from parcelflow.operators import shapes as S


def polygon(*rings):
    """Points of (part, ring, corners)."""
    return [(p, r, float(x), float(y)) for p, r, corners in rings for x, y in corners]


def frame(spark, rows, key="geom_obs_id"):
    return spark.createDataFrame(rows, f"{key} string, points {G.POINTS}")


def inside(points, x, y):
    """By winding numbers: some part's outer ring winds around the point and no hole of that part does."""
    rings = {}
    for p, r, a, b in points:
        rings.setdefault((p, r), []).append((a, b))
    wound = {}
    for k, ring in rings.items():
        n = 0
        for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (a <= x) != (c <= x) and b + (x - a) * (d - b) / (c - a) < y:
                n += 1 if a < c else -1
        wound[k] = n != 0
    return any(v and not any(wound[q, h] for q, h in rings if q == p and h) for (p, r), v in wound.items() if r == 0)


def measured(test, n=80, size=16):
    """Area by counting the middles of a fine grid."""
    step = size / n
    return sum(test((i + 0.4999) * step, (j + 0.5001) * step) for i in range(n) for j in range(n)) * step * step


SQUARE = [(2, 2), (10, 2), (10, 10), (2, 10)]
ODD = {
    "square": polygon((0, 0, SQUARE)),
    "bow": polygon((0, 0, [(2, 2), (10, 10), (10, 2), (2, 10)])),
    "spike": polygon((0, 0, [(2, 2), (10, 2), (10, 6), (15, 6), (10, 6), (10, 10), (2, 10)])),
    "holes": polygon((0, 0, SQUARE), (0, 1, [(3, 3), (6, 3), (6, 6), (3, 6)]), (0, 2, [(5, 5), (8, 4), (8, 8), (5, 8)])),
    "twice": polygon((0, 0, SQUARE + SQUARE)),
    "backwards": polygon((0, 0, SQUARE[::-1])),
    "star": polygon((0, 0, [(8 + 7 * math.sin(k * 4 * math.pi / 5), 8 + 7 * math.cos(k * 4 * math.pi / 5)) for k in range(5)])),
    "parts": polygon((0, 0, SQUARE), (1, 0, [(6, 6), (14, 7), (13, 14)]), (1, 1, [(9, 8), (11, 8), (11, 10)])),
    "outside": polygon((0, 0, SQUARE), (0, 1, [(8, 8), (14, 8), (14, 14), (8, 14)])),
    "line": polygon((0, 0, [(2, 2), (10, 10), (2, 2)])),
    "touching": polygon((0, 0, SQUARE), (0, 1, [(2, 6), (6, 4), (6, 8)])),
}


def test_repair(spark):
    layer = frame(spark, [*ODD.items(), ("none", []), ("null", None)])
    got = {r.geom_obs_id: r for r in S.repaired(layer).collect()}
    assert set(got) == {*ODD, "none", "null"}
    # a hole may touch its ring with a corner, but here its edge doesn't end there
    assert {k for k, r in got.items() if r.was_repaired} == {"bow", "spike", "holes", "twice", "star", "parts", "outside", "line", "touching"}
    for k, drawn in ODD.items():
        points = [tuple(p) for p in got[k].points]
        assert math.isclose(measured(lambda x, y: inside(points, x, y)), measured(lambda x, y: inside(drawn, x, y)), abs_tol=1e-9), k
        area = sum(r.area for r in frame(spark, [(k, points)]).select(G.area(F.col("points")).alias("area")).collect())
        assert abs(area - measured(lambda x, y: inside(drawn, x, y))) < 1.5, k
    assert got["bow"].repair_area_delta_pct is None and round(got["twice"].repair_area_delta_pct) == -50 and got["square"].repair_area_delta_pct == 0
    again = S.repaired(frame(spark, [(k, [tuple(p) for p in r.points]) for k, r in got.items() if r.points]))
    assert {r.geom_obs_id for r in again.filter("was_repaired").collect()} <= {"touching"}
    exact = {r.geom_obs_id: r.area for r in S.repaired(layer).select("geom_obs_id", G.area(F.col("points")).alias("area")).collect()}
    assert math.isclose(exact["bow"], 32) and math.isclose(exact["holes"], 64 - 9 - (9 + 3 / 2) + 1, abs_tol=0.5)


def blob(rng):
    """A star-shaped polygon with a hole."""
    x, y, n = rng.uniform(5, 11), rng.uniform(5, 11), rng.randint(5, 9)
    at = [(k + rng.uniform(-0.2, 0.2)) * 2 * math.pi / n for k in range(n)]
    ring = [(x + rng.uniform(2, 5) * math.cos(t), y + rng.uniform(2, 5) * math.sin(t)) for t in at]
    hole = [(x + 0.4 * math.cos(t), y + 0.4 * math.sin(t)) for t in (0.1, 2.2, 4.3)]
    return polygon((0, 0, ring), (0, 1, hole))


@pytest.fixture(scope="module", params=[(16, 64), (2, 3)])
def layers(spark, request):
    A.PER_STRIP, A.CROWDED = request.param
    rng = random.Random(4)
    left = {f"a{k}": blob(rng) for k in range(5)} | {"square": ODD["square"], "alone": polygon((0, 0, [(100, 100), (101, 100), (101, 102)]))}
    right = {f"b{k}": blob(rng) for k in range(4)} | {"same": ODD["square"], "part": polygon((0, 0, [(2, 2), (6, 2), (6, 10), (2, 10)]))}
    yield left, right, frame(spark, list(left.items()), "obs_a"), frame(spark, list(right.items()), "obs_b")
    A.PER_STRIP, A.CROWDED = 16, 64


def test_remainders_and_overlays(layers):
    left, right, a, b = layers
    rest = {r.obs_a: r for r in S.residual_shapes(a, b.filter("obs_b not in ('same', 'b0')")).collect()}
    for k, drawn in left.items():
        if k == "alone":
            assert math.isclose(rest[k].area, 1)
            continue
        want = measured(lambda x, y: inside(drawn, x, y) and not any(inside(right[o], x, y) for o in right if o not in ("same", "b0")))
        assert abs((rest[k].area if k in rest else 0) - want) < 0.6, k
        if k in rest:
            points = [tuple(p) for p in rest[k].points]
            assert math.isclose(measured(lambda x, y: inside(points, x, y)), want, abs_tol=1e-9)
    assert "square" not in {r.obs_a for r in S.residual_shapes(a, b).collect()}  # covered whole
    found = {(r.obs_a, r.obs_b): r.area for r in S.overlay(a, b).collect()}
    cut = {(r.obs_a, r.obs_b): r for r in S.common_boundaries(a, b, G.meeting_boxes(a, b, "obs_a", "obs_b"), "obs_a", "obs_b").collect()}
    assert set(found) == set(cut)
    for p, area in found.items():
        want = measured(lambda x, y: inside(left[p[0]], x, y) and inside(right[p[1]], x, y))
        assert abs(area - want) < 0.6 and math.isclose(area, cut[p].area, abs_tol=1e-5)
    assert math.isclose(cut["square", "part"].boundary, 24) and math.isclose(cut["square", "part"].distance, 2) and math.isclose(cut["square", "same"].boundary, 32)


def test_unions(spark, layers):
    left, right, a, b = layers
    all_ = left | right
    layer = frame(spark, list(all_.items())).withColumn("source_year", F.lit(1951)).unionByName(frame(spark, [("x", ODD["square"])]).withColumn("source_year", F.lit(1961)))
    got = {r.source_year: r.union_area for r in S.union_areas(layer).collect()}
    want = measured(lambda x, y: any(inside(p, x, y) for k, p in all_.items() if k != "alone"))
    assert abs(got[1951] - 1 - want) < 0.8 and math.isclose(got[1961], 64)


def test_boxes_of_all_sizes_meet(spark):
    rng = random.Random(9)
    box = lambda x, y, w, h: polygon((0, 0, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]))
    rows = [(f"{i}", (rng.uniform(-50, 50), rng.uniform(-50, 50), *rng.choice([(0.1, 0.1), (1, 3), (20, 2), (60, 60), (0, 5)]))) for i in range(120)]
    a = frame(spark, [(k, box(*v)) for k, v in rows[:60]], "a")
    b = frame(spark, [(k, box(*v)) for k, v in rows[60:]], "b")
    want = {(k, j) for k, (x, y, w, h) in rows[:60] for j, (p, q, v, g) in rows[60:] if x <= p + v and p <= x + w and y <= q + g and q <= y + h}
    got = [(r.a, r.b) for r in G.meeting_boxes(a, b, "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_strips_stay_small(spark, monkeypatch):
    """A coast with nearly all of its edges in a thousandth of its width: no strip has many more than CROWDED edges."""
    monkeypatch.setattr(A, "PER_STRIP", 16)
    monkeypatch.setattr(A, "CROWDED", 64)
    n = 3000
    coast = [(k / n * 0.1, (k % 2) * 1e-3) for k in range(n)]
    shape = polygon((0, 0, [*coast, (100.0, 0.0), (100.0, 50.0), (0.0, 50.0)]))
    rows = A.edges(frame(spark, [("coast", shape)], "k"), "k", "k", A.KEEP)
    dealt = A.Strips(rows).of(rows, F.least("x0", "x1"), F.greatest("x0", "x1"))
    assert dealt.select("strip", *A.ENDS).distinct().groupBy("strip").count().agg(F.max("count")).first()[0] > 2000
    assert dealt.groupBy("strip", "split").count().agg(F.max("count")).first()[0] <= 2 * A.CROWDED


@pytest.mark.parametrize("small", [(0, 0), (12, 20)])
def test_small_groups_are_arranged_where_they_are_as_by_strips(spark, monkeypatch, small):
    """By strips alone, by either as groups have few edges or few pieces, and in place alone: one result, and no strips written for it."""
    rng = random.Random(11)
    left = {f"a{k}": blob(rng) for k in range(6)} | ODD
    right = {f"b{k}": blob(rng) for k in range(5)} | {"same": ODD["square"], "bow": ODD["bow"], "star": ODD["star"]}
    a, b = frame(spark, [*left.items(), ("none", []), ("null", None)], "obs_a"), frame(spark, list(right.items()), "obs_b")

    def results():
        pairs = G.meeting_boxes(a, b, "obs_a", "obs_b")
        cut = {(r.obs_a, r.obs_b): (round(r.area, 6), round(r.boundary, 6), round(r.distance, 6)) for r in S.common_boundaries(a, b, pairs, "obs_a", "obs_b").collect()}
        whole = lambda points: F.array_sort(F.transform(points, lambda p: F.struct(F.round(p["x"], 6), F.round(p["y"], 6))))
        rest = {r.obs_a: r[1:] for r in S.residual_shapes(a, b).select("obs_a", F.round("area", 6), G.n_parts(F.col("points")), whole(F.col("points"))).collect()}
        fixed = {r.obs_a: r[1:] for r in S.repaired(a, "obs_a").select("obs_a", "was_repaired", F.round("repair_area_delta_pct", 6), whole(F.col("points"))).collect()}
        return cut, rest, fixed

    written, settle = [], A.settle
    monkeypatch.setattr(A, "settle", lambda df, label: (written.append(label), settle(df, label))[1])
    want = results()
    assert set(written) == {"arranged"} and all(want)
    monkeypatch.setattr(A, "arranged", by_limits(A.arranged, small))
    got = results()
    assert got == want and "strips" in written


def by_limits(arranged, limits):
    """arranged() with other limits, which its tasks get by value."""

    def work(shapes, inside, walk=None):
        return arranged(shapes, inside, walk, limits)

    return work


def test_a_group_over_many_batches_is_only_named(spark):
    n = 500
    box = lambda k: polygon((0, 0, [(k, 0), (k + 1.5, 0), (k + 1.5, 1), (k, 1)]))
    wide = polygon((0, 0, [(-1, -1), (n + 2, -1), (n + 2, 2), (-1, 2)]))
    a = frame(spark, [("before", box(3)), ("wide", wide), ("x", box(5))], "obs_a")
    b = frame(spark, [(f"b{k}", box(k)) for k in range(n)], "obs_b")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rest = {r.obs_a: r.area for r in S.residual_shapes(a, b).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(rest) == {"wide"} and math.isclose(rest["wide"], 3 * (n + 3) - (n + 0.5), abs_tol=1e-4)
