"""Polygons in built-in functions: equal-area coordinates, signed edges, areas and overlaps.

A polygon is an array of points (part, ring, x, y) in drawing order; ring 0 of a part is its outer ring.  Edges are
functions over an interval of x with a sign, so areas and overlaps are sums of closed forms: no clipping, no UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.sources.steps import merged

# The WGS84 ellipsoid, in kilometres.
AXIS, FLATTENING = 6378.137, 1 / 298.257223563
ECC2 = FLATTENING * (2 - FLATTENING)
ECC = math.sqrt(ECC2)
#: Cancellation leaves areas of this size where there is none.
NOTHING = 1e-6

POINTS = "array<struct<part:int,ring:int,x:double,y:double>>"


def authalic(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Equal-area coordinates in kilometres of degrees on the ellipsoid."""
    s = F.sin(F.radians(lat))
    q = (1 - ECC2) * (s / (1 - ECC2 * s * s) - F.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))
    return F.radians(lon) * AXIS, q * (AXIS / 2)


def lambert_inverse(x: Column, y: Column, lat1: float, lat2: float, lat0: float, lon0: float, east: float = 0.0, north: float = 0.0) -> tuple[Column, Column]:
    """Degrees of a Lambert conformal conic projection with two standard parallels (metres)."""
    m = lambda p: math.cos(p) / math.sqrt(1 - ECC2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - ECC * math.sin(p)) / (1 + ECC * math.sin(p))) ** (ECC / 2)
    a, b, c = (math.radians(v) for v in (lat1, lat2, lat0))
    n = (math.log(m(a)) - math.log(m(b))) / (math.log(t(a)) - math.log(t(b))) if lat1 != lat2 else math.sin(a)
    f = m(a) / (n * t(a) ** n)
    r0 = AXIS * 1000 * f * t(c) ** n
    dx, dy = x - east, F.lit(r0) - (y - north)
    sign = 1.0 if n > 0 else -1.0
    r = sign * F.sqrt(dx * dx + dy * dy)
    tt = F.pow(r / (AXIS * 1000 * f), F.lit(1 / n))
    lat = F.lit(math.pi / 2) - 2 * F.atan(tt)
    for _ in range(5):
        s = ECC * F.sin(lat)
        lat = F.lit(math.pi / 2) - 2 * F.atan(tt * F.pow((1 - s) / (1 + s), F.lit(ECC / 2)))
    return F.degrees(F.atan2(sign * dx, sign * dy) / n) + lon0, F.degrees(lat)


def project(points: Column) -> Column:
    """Points in degrees as points in equal-area kilometres."""

    def one(p: Column) -> Column:
        x, y = authalic(p["x"], p["y"])
        return F.struct(p["part"].alias("part"), p["ring"].alias("ring"), x.alias("x"), y.alias("y"))

    return F.transform(points, one)


def segments(points: Column) -> Column:
    """Edges of all rings: part, ring, x0, y0, x1, y1.  Rings close by themselves; the points of a ring stand together."""
    following = F.transform(points, lambda p, i: F.get(points, i + 1))
    same = lambda p, q: (q["part"] == p["part"]) & (q["ring"] == p["ring"])
    firsts = F.filter(points, lambda p, i: ~F.coalesce(same(p, F.get(points, i - 1)), F.lit(False)))

    def closed(starts: Column) -> Column:
        def one(p: Column, q: Column) -> Column:
            nxt = F.when(q.isNotNull() & same(p, q), q).otherwise(F.get(F.filter(starts, lambda f: same(p, f)), F.lit(0)))
            return F.struct(p["part"].alias("part"), p["ring"].alias("ring"), p["x"].alias("x0"), p["y"].alias("y0"), nxt["x"].alias("x1"), nxt["y"].alias("y1"))

        return F.filter(F.zip_with(points, following, one), lambda e: (e["x0"] != e["x1"]) | (e["y0"] != e["y1"]))

    # a variable stands for the first points, which are found once and not for each ring
    return F.get(F.transform(F.array(firsts), closed), F.lit(0))


def edge_table(polygons: DataFrame, key: str, points: str = "points") -> DataFrame:
    """key, part, ring, x0, y0, x1, y1, sign: one row for each edge that is not upright.

    sign is +1 where the polygon lies below the edge and -1 where it lies above, whatever way the rings were drawn:
    outer rings count as counter-clockwise, holes as clockwise.
    """
    e = polygons.select(F.col(key).alias(key), F.inline(segments(F.col(points))))
    turned = F.sum((F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).over(Window.partitionBy(key, "part", "ring"))
    own = e.withColumn("signed", turned)
    wanted = F.when(F.col("ring") == 0, 1).otherwise(-1)
    facing = F.when(F.col("x1") < F.col("x0"), 1).otherwise(-1) * F.when(F.col("signed") < 0, -1).otherwise(1) * wanted
    left = F.col("x0") < F.col("x1")
    pick = lambda a, b: F.when(left, F.col(a)).otherwise(F.col(b))
    return own.filter("x0 <> x1").select(key, "part", "ring", pick("x0", "x1").alias("x0"), pick("y0", "y1").alias("y0"), pick("x1", "x0").alias("x1"), pick("y1", "y0").alias("y1"), facing.cast("double").alias("sign"))


def area(points: Column) -> Column:
    """Area of a polygon: outer rings less holes, in one pass over the edges."""
    ring = lambda a: F.abs(a["sum"]) * F.when(a["ring"] == 0, 1.0).otherwise(-1.0)

    def add(a: Column, s: Column) -> Column:
        own = (s["x0"] * s["y1"] - s["x1"] * s["y0"]) / 2
        same = (a["part"] == s["part"]) & (a["ring"] == s["ring"])
        return F.struct(F.when(same, a["done"]).otherwise(a["done"] + ring(a)).alias("done"), s["part"].alias("part"), s["ring"].alias("ring"), F.when(same, a["sum"] + own).otherwise(own).alias("sum"))

    start = F.struct(F.lit(0.0).alias("done"), F.lit(-1).alias("part"), F.lit(0).alias("ring"), F.lit(0.0).alias("sum"))
    return F.when(F.size(points) > 0, F.aggregate(segments(points), start, add, lambda a: a["done"] + ring(a))).otherwise(0.0)


def perimeter(points: Column) -> Column:
    return F.aggregate(segments(points), F.lit(0.0), lambda a, s: a + F.sqrt((s["x1"] - s["x0"]) * (s["x1"] - s["x0"]) + (s["y1"] - s["y0"]) * (s["y1"] - s["y0"])))


def thinness(points: Column) -> Column:
    """4 pi area / perimeter squared: 1 for a circle, near 0 for a sliver."""
    p = perimeter(points)
    return F.when(p > 0, 4 * math.pi * area(points) / (p * p))


def n_parts(points: Column) -> Column:
    return F.size(F.array_distinct(F.transform(points, lambda p: p["part"])))


def snapped(points: Column, grid: float) -> Column:
    """Points on a grid."""
    return F.transform(points, lambda p: F.struct(p["part"].alias("part"), p["ring"].alias("ring"), (F.round(p["x"] / grid) * grid).alias("x"), (F.round(p["y"] / grid) * grid).alias("y")))


def bounds(points: Column) -> Column:
    low = lambda c: F.array_min(F.transform(points, lambda p: p[c]))
    high = lambda c: F.array_max(F.transform(points, lambda p: p[c]))
    return F.struct(low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))


def centroids(edges: DataFrame, key: str) -> DataFrame:
    """key, cx, cy from the moments of signed edges."""
    w = F.col("x1") - F.col("x0")
    a = F.col("sign") * w * (F.col("y0") + F.col("y1")) / 2
    mx = F.col("sign") * w * (F.col("x0") * (2 * F.col("y0") + F.col("y1")) + F.col("x1") * (F.col("y0") + 2 * F.col("y1"))) / 6
    my = F.col("sign") * w * (F.col("y0") * F.col("y0") + F.col("y0") * F.col("y1") + F.col("y1") * F.col("y1")) / 6
    sums = edges.groupBy(key).agg(F.sum(a).alias("a"), F.sum(mx).alias("mx"), F.sum(my).alias("my"))
    return sums.filter(F.abs("a") > 0).select(key, (F.col("mx") / F.col("a")).alias("cx"), (F.col("my") / F.col("a")).alias("cy"), F.abs("a").alias("area"))


def candidate_pairs(a: DataFrame, b: DataFrame, key_a: str, key_b: str, cell: float, points: str = "points") -> DataFrame:
    """Pairs whose bounding boxes meet, by an equi-join on the grid cells that the boxes touch."""

    def cells(d: DataFrame, key: str, tag: str) -> DataFrame:
        box = d.select(F.col(key), bounds(F.col(points)).alias(f"__box_{tag}"))
        span = lambda lo, hi: F.sequence(F.floor(F.col(f"__box_{tag}.{lo}") / cell), F.floor(F.col(f"__box_{tag}.{hi}") / cell))
        return box.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))

    met = cells(a, key_a, "a").join(merged(cells(b, key_b, "b")), ["cx", "cy"])
    low = lambda c: F.greatest(F.col(f"__box_a.{c}0"), F.col(f"__box_b.{c}0"))
    high = lambda c: F.least(F.col(f"__box_a.{c}1"), F.col(f"__box_b.{c}1"))
    # a pair is taken in the cell of its boxes' common lower corner only, so no distinct is needed
    here = (F.floor(low("x") / cell) == F.col("cx")) & (F.floor(low("y") / cell) == F.col("cy"))
    return met.filter((low("x") <= high("x")) & (low("y") <= high("y")) & here).select(key_a, key_b)


def _cut(edges: DataFrame, key: str, width: float, tag: str) -> DataFrame:
    """Edges in strips of x, each clipped to its strip."""
    at = F.explode(F.sequence(F.floor(F.col("x0") / width), F.floor(F.col("x1") / width)))
    strip = edges.withColumn("strip", at)
    lo, hi = F.greatest(F.col("x0"), F.col("strip") * width), F.least(F.col("x1"), (F.col("strip") + 1) * width)
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    return strip.filter(lo < hi).select(F.col(key), "strip", lo.alias(f"l{tag}"), hi.alias(f"h{tag}"), slope.alias(f"m{tag}"), (F.col("y0") - slope * F.col("x0")).alias(f"c{tag}"), F.col("sign").alias(f"s{tag}"))


def below_both() -> Column:
    """The signed integral below both of two edges, a and b, over the x that they share (l, h, slope m, offset c, sign s)."""
    lo, hi = F.greatest("la", "lb"), F.least("ha", "hb")
    fb = F.col("mb") * (lo + hi) / 2 + F.col("cb")
    d0 = (F.col("ma") - F.col("mb")) * lo + F.col("ca") - F.col("cb")
    d1 = (F.col("ma") - F.col("mb")) * hi + F.col("ca") - F.col("cb")
    both_down = (d0 <= 0) & (d1 <= 0)
    below = F.when(both_down, (d0 + d1) / 2).when((d0 >= 0) & (d1 >= 0), 0.0).when(d0 < 0, d0 * d0 / (2 * (d0 - d1))).otherwise(d1 * d1 / (2 * (d1 - d0)))
    return F.col("sa") * F.col("sb") * (hi - lo) * (fb + below)


def overlaps(edges_a: DataFrame, edges_b: DataFrame, pairs: DataFrame, key_a: str, key_b: str, width: float) -> DataFrame:
    """Area of the intersection of each pair: the sum over pairs of edges of the integral of the lower one.

    Edges meet by an equi-join on the pair and the strip of x, so rows grow with the edges, not with their square.
    """
    a = pairs.join(merged(_cut(edges_a, key_a, width, "a")), key_a)
    both = a.join(merged(_cut(edges_b, key_b, width, "b")), [key_b, "strip"])
    total = both.filter(F.greatest("la", "lb") < F.least("ha", "hb")).groupBy(key_a, key_b).agg(F.sum(below_both()).alias("area"))
    return total.filter(F.col("area") > NOTHING)


def meeting_boxes(a: DataFrame, b: DataFrame, key_a: str, key_b: str, points: str = "points") -> DataFrame:
    """Pairs whose bounding boxes meet, by grids of all sizes that the boxes have.

    A box lies in at most four cells of its own level, whose cells are as large as it or up to twice that; so a cell holds
    few boxes that don't overlap, whatever the sizes.  A pair meets at the level of its larger box.
    """

    def boxes(d: DataFrame, key: str, tag: str) -> DataFrame:
        box = d.filter(F.size(points) > 0).select(F.col(key), bounds(F.col(points)).alias(f"__box_{tag}"))
        size = F.greatest(F.col(f"__box_{tag}.x1") - F.col(f"__box_{tag}.x0"), F.col(f"__box_{tag}.y1") - F.col(f"__box_{tag}.y0"), F.lit(1e-9))
        return box.withColumn(f"__own_{tag}", F.ceil(F.log2(size)).cast("int"))

    one, two = boxes(a, key_a, "a"), boxes(b, key_b, "b")
    top = one.select(F.col("__own_a").alias("l")).unionByName(two.select(F.col("__own_b").alias("l"))).agg(F.coalesce(F.max("l"), F.lit(0)).alias("__top"))

    def cells(d: DataFrame, tag: str) -> DataFrame:
        levels = d.crossJoin(F.broadcast(top)).withColumn("level", F.explode(F.sequence(F.col(f"__own_{tag}"), F.col("__top")))).drop("__top")  # one row
        cell = F.pow(F.lit(2.0), F.col("level"))
        span = lambda lo, hi: F.sequence(F.floor(F.col(f"__box_{tag}.{lo}") / cell), F.floor(F.col(f"__box_{tag}.{hi}") / cell))
        return levels.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))

    # levels of the larger box only, and there the cell of the boxes' common lower corner: no distinct is needed
    met = cells(one, "a").join(merged(cells(two, "b")), ["level", "cx", "cy"]).filter(F.col("level") == F.greatest("__own_a", "__own_b"))
    cell = F.pow(F.lit(2.0), F.col("level"))
    low = lambda c: F.greatest(F.col(f"__box_a.{c}0"), F.col(f"__box_b.{c}0"))
    high = lambda c: F.least(F.col(f"__box_a.{c}1"), F.col(f"__box_b.{c}1"))
    here = (F.floor(low("x") / cell) == F.col("cx")) & (F.floor(low("y") / cell) == F.col("cy"))
    return met.filter((low("x") <= high("x")) & (low("y") <= high("y")) & here).select(key_a, key_b)


def self_crossings(polygons: DataFrame, key: str, points: str = "points") -> DataFrame:
    """key and number of pairs of edges of one ring that cross inside; edges meet by strips of x."""
    e = polygons.select(F.col(key).alias(key), F.posexplode(segments(F.col(points)))).select(key, "pos", "col.*")
    of = Window.partitionBy(key)
    spread = e.withColumns({"hi": F.max(F.greatest("x0", "x1")).over(of), "lo": F.min(F.least("x0", "x1")).over(of), "n": F.count("*").over(of)})
    width = F.greatest((F.col("hi") - F.col("lo")) * 2 / F.col("n"), F.lit(1e-9))
    own = spread.withColumn("strip", F.explode(F.sequence(F.floor((F.least("x0", "x1") - F.col("lo")) / width), F.floor((F.greatest("x0", "x1") - F.col("lo")) / width))))
    a = own.select(key, "strip", "part", "ring", F.col("pos").alias("i"), *(F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")))
    b = own.select(key, "strip", "part", "ring", F.col("pos").alias("j"), *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    side = lambda o, d, p: F.signum((F.col(f"{d}x1") - F.col(f"{d}x0")) * (F.col(f"{o}y{p}") - F.col(f"{d}y0")) - (F.col(f"{d}y1") - F.col(f"{d}y0")) * (F.col(f"{o}x{p}") - F.col(f"{d}x0")))
    cross = (side("a", "b", 0) * side("a", "b", 1) < 0) & (side("b", "a", 0) * side("b", "a", 1) < 0)
    return a.join(merged(b), [key, "strip", "part", "ring"]).filter("i < j").filter(cross).select(key, "i", "j").distinct().groupBy(key).agg(F.count("*").alias("n_crossings"))
