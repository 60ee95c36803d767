"""Polygons cut by one another: edges split where they meet, what lies on either side of each piece, and new rings from those.

The edges of a group (a feature alone, a feature and what is cut out of it, or a pair) are split at all points where they
cross or touch, so that pieces meet at their ends only and equal pieces are one.  The winding number of every ring on the
right of a piece is the sum of the pieces below its middle, and that on its left includes the piece itself; so for any rule
of what is inside, the pieces with the inside on one side only are the boundary of the result.

Edges meet by strips of x within their group, as many as its edges call for; strips with too many of them are split again.
All of that is joins and sums.  Only the last step, from the boundary of one feature to its rings, walks along them: it
holds one feature, which is one row before and after.

Groups of few edges, which most are, need no strips: `arranged` takes many of them at once in the task that their shapes
were sent to (`local`), with the same rules.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import geometry as G
from parcelflow.functions import local
from parcelflow.sources.steps import merged, settle

#: Digits of coordinates that are kept; points nearer than that are one.
DIGITS = 7
NEAR = 10.0**-DIGITS
#: Edges a strip should have, and edges from which a strip is split again.
PER_STRIP, CROWDED = 16, 64
ENDS = ("x0", "y0", "x1", "y1")
RING = ("role", "owner", "part", "ring")
KEEP, CUT = 0, 1


def edges(polygons: DataFrame, group: str, owner: str, role: int, points: str = "points") -> DataFrame:
    """g, role, owner, part, ring and ends of all edges, as they are drawn."""
    return _edges(shapes(polygons, group, owner, role, points))


def shapes(polygons: DataFrame, group: str, owner: str, role: int, points: str = "points") -> DataFrame:
    """g, role, owner and points of polygons that are arranged together."""
    return polygons.select(F.col(group).alias("g"), F.lit(role).alias("role"), F.col(owner).cast("string").alias("owner"), F.col(points).alias("points"))


def _edges(drawn: DataFrame) -> DataFrame:
    exact = lambda c: (F.rint(F.col(c) * 10**DIGITS) / 10**DIGITS).alias(c)
    e = drawn.select("g", "role", "owner", F.inline(G.segments(F.col("points"))))
    return e.select("g", *RING, *(exact(c) for c in ENDS)).filter("x0 <> x1 or y0 <> y1")


class Strips:
    """Strips of x for each group, from its edges."""

    def __init__(self, rows: DataFrame) -> None:
        low, high = F.min(F.least("x0", "x1")), F.max(F.greatest("x0", "x1"))
        per = rows.groupBy("g").agg(low.alias("low"), high.alias("high"), F.count("*").alias("n"))
        strips = F.ceil(F.col("n") / PER_STRIP)
        self.groups = per.select("g", "low", F.greatest((F.col("high") - F.col("low")) / strips, F.lit(NEAR)).alias("width"), (strips - 1).alias("last"))
        first = self._dealt(rows.select("g", F.least("x0", "x1").alias("from"), F.greatest("x0", "x1").alias("to")))
        self.crowded = first.groupBy("g", "strip").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select("g", "strip", F.ceil(F.col("n") / PER_STRIP).alias("splits"))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        place = lambda c: F.least(F.greatest(F.floor((F.col(c) - F.col("low")) / F.col("width")), F.lit(0)), F.col("last"))
        return rows.join(merged(self.groups), "g").withColumn("strip", F.explode(F.sequence(place("from"), place("to"))))

    def of(self, rows: DataFrame, low: Column, high: Column) -> DataFrame:
        """rows once for each strip (strip, split, from `begins` to `ends`) that [low, high] touches."""
        dealt = self._dealt(rows.withColumns({"from": low, "to": high})).join(merged(self.crowded), ["g", "strip"], "left")
        fine = F.col("width") / F.coalesce("splits", F.lit(1))
        begin = F.col("low") + F.col("strip") * F.col("width")
        place = lambda c: F.least(F.greatest(F.floor((F.col(c) - begin) / fine), F.lit(0)), F.coalesce("splits", F.lit(1)) - 1)
        split = dealt.withColumn("split", F.explode(F.sequence(place("from"), place("to"))))
        bounds = {"begins": begin + F.col("split") * fine, "ends": begin + (F.col("split") + 1) * fine}
        return split.withColumns(bounds).drop("from", "to", "low", "width", "last", "splits")


def _side(o: str, d: str, end: int) -> Column:
    """How far an end of edge d lies to the left of edge o, times o's length."""
    c = lambda n: F.col(f"{o}{n}")
    return (c("x1") - c("x0")) * (F.col(f"{d}y{end}") - c("y0")) - (c("y1") - c("y0")) * (F.col(f"{d}x{end}") - c("x0"))


def _touches(o: str, d: str, end: int) -> Column:
    """Whether an end of edge d lies on edge o, whose _side is there."""
    c = lambda n: F.col(f"{o}{n}")
    dx, dy = c("x1") - c("x0"), c("y1") - c("y0")
    along = dx * (F.col(f"{d}x{end}") - c("x0")) + dy * (F.col(f"{d}y{end}") - c("y0"))
    return (F.abs(F.col(f"s{o}{end}")) <= NEAR * F.sqrt(dx * dx + dy * dy)) & (along >= 0) & (along <= dx * dx + dy * dy)


def pieces(rows: DataFrame) -> DataFrame:
    """g, RING, ends and w: the edges split where they meet, from the lesser end to the greater, w times more in that direction.

    Pieces that a ring goes along as often as back are gone.
    """
    rows = settle(rows.withColumn("id", F.xxhash64(*RING, *ENDS)), "edges")  # equal edges of a ring are split alike
    dealt = settle(Strips(rows).of(rows.dropDuplicates(["g", "id"]), F.least("x0", "x1"), F.greatest("x0", "x1")).select("g", "strip", "split", "id", *ENDS), "strips")
    side = lambda t: dealt.select("g", "strip", "split", F.col("id").alias(f"{t}id"), *(F.col(c).alias(f"{t}{c}") for c in ENDS))
    low = lambda t: F.least(f"{t}y0", f"{t}y1")
    high = lambda t: F.greatest(f"{t}y0", f"{t}y1")
    met = side("a").join(merged(side("b")), ["g", "strip", "split"]).filter((F.col("aid") < F.col("bid")) & (low("a") <= high("b") + NEAR) & (low("b") <= high("a") + NEAR))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    end = lambda t, k: point(F.col(f"{t}x{k}"), F.col(f"{t}y{k}"))
    # columns of their own, so that each is made once
    met = met.withColumns({f"s{o}{k}": _side(o, d, k) for o, d in ("ab", "ba") for k in (0, 1)})
    met = met.withColumns({f"t{o}{k}": _touches(o, d, k) for o, d in ("ab", "ba") for k in (0, 1)})
    s0, s1 = F.col("sa0"), F.col("sa1")
    touching = F.col("ta0") | F.col("ta1") | F.col("tb0") | F.col("tb1")
    met = met.withColumn("crossed", ~touching & (s0 * s1 < 0) & (F.col("sb0") * F.col("sb1") < 0)).withColumn("touching", touching).filter("crossed or touching")
    on = lambda o, d: F.filter(F.array(*(F.when(F.col(f"t{o}{k}"), end(d, k)) for k in (0, 1))), lambda p: p.isNotNull())
    t = s0 / (s0 - s1)
    at = lambda c: F.rint((F.col(f"b{c}0") + t * (F.col(f"b{c}1") - F.col(f"b{c}0"))) * 10**DIGITS) / 10**DIGITS
    here = F.array(point(at("x"), at("y")))
    cuts = met.select("g", "aid", "bid", F.when(F.col("crossed"), here).otherwise(on("a", "b")).alias("a"), F.when(F.col("crossed"), here).otherwise(on("b", "a")).alias("b"))
    one = lambda t: cuts.select("g", F.col(f"{t}id").alias("id"), F.explode(t).alias("p"))
    cut = one("a").unionByName(one("b")).groupBy("g", "id").agg(F.collect_set("p").alias("cuts"))  # those on one edge

    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ends = F.array(point(F.col("x0"), F.col("y0")), point(F.col("x1"), F.col("y1")))
    place = lambda p: F.struct(((p["x"] - F.col("x0")) * dx + (p["y"] - F.col("y0")) * dy).alias("at"), p["x"].alias("x"), p["y"].alias("y"))
    whole = rows.join(merged(cut), ["g", "id"], "left").withColumn("stops", F.array_sort(F.transform(F.array_distinct(F.concat(ends, F.coalesce("cuts", F.array().cast("array<struct<x:double,y:double>>")))), place)))
    split = whole.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("stops") - 2)))
    p, n = F.get("stops", F.col("k")), F.get("stops", F.col("k") + 1)
    run = split.select("g", *RING, p["x"].alias("x0"), p["y"].alias("y0"), n["x"].alias("x1"), n["y"].alias("y1"))
    right = (F.col("x0") < F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") < F.col("y1")))
    pick = lambda a, b: F.when(right, F.col(a)).otherwise(F.col(b))
    turned = run.select("g", *RING, pick("x0", "x1").alias("x0"), pick("y0", "y1").alias("y0"), pick("x1", "x0").alias("x1"), pick("y1", "y0").alias("y1"), F.when(right, 1).otherwise(-1).alias("w"))
    return turned.groupBy("g", *RING, *ENDS).agg(F.sum("w").alias("w"), F.count("*").alias("times")).filter("w <> 0")


def boundary(parts: DataFrame, inside: Callable[[Column, Column], Column]) -> DataFrame:
    """g and ends of the pieces with the inside on one side only, drawn with it on their left.

    inside(kept, cut) says whether a point is inside that is in some KEEP and in some CUT polygon.  A point is in a polygon
    if the outer ring of one of its parts winds around it and no hole of that part does.
    """
    strips = Strips(parts)
    places = parts.select("g", *ENDS).distinct().withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2})
    middle = strips.of(places, F.col("mx"), F.col("mx"))
    f = parts.filter("x0 < x1").select("g", *RING, "w", *(F.col(c).alias(f"f{c}") for c in ENDS))
    below = strips.of(f, F.col("fx0"), F.col("fx1")).drop("begins", "ends")
    y = F.col("fy0") + (F.col("mx") - F.col("fx0")) * (F.col("fy1") - F.col("fy0")) / (F.col("fx1") - F.col("fx0"))
    same = (F.col("fx0") == F.col("x0")) & (F.col("fy0") == F.col("y0")) & (F.col("fx1") == F.col("x1")) & (F.col("fy1") == F.col("y1"))
    upright = F.col("x0") == F.col("x1")
    lower = (y < F.col("my")) & ~same
    met = middle.join(merged(below), ["g", "strip", "split"]).filter((F.col("fx0") <= F.col("mx")) & (F.col("mx") <= F.col("fx1")) & (lower | same))
    # what lies east of an upright piece is on its right, what lies west of it on its left
    right = F.when(lower & (F.col("mx") < F.col("fx1")), F.col("w")).otherwise(0)
    left = F.when(upright, F.when(lower & (F.col("fx0") < F.col("mx")), F.col("w")).otherwise(0)).when(same | (lower & (F.col("mx") < F.col("fx1"))), F.col("w")).otherwise(0)
    wound = met.groupBy("g", *ENDS, *RING).agg(F.sum(right).alias("right"), F.sum(left).alias("left"))
    hole = F.col("ring") > 0
    part = [(F.max(F.when(~hole, F.col(s) != 0)) & ~F.coalesce(F.max(F.when(hole, F.col(s) != 0)), F.lit(False))).alias(s) for s in ("right", "left")]
    owned = wound.groupBy("g", *ENDS, "role", "owner", "part").agg(*part)
    of = lambda s, role: F.coalesce(F.max(F.when(F.col("role") == role, F.col(s))), F.lit(False)).alias(f"{s}{role}")
    both = owned.groupBy("g", *ENDS).agg(*(of(s, r) for s in ("right", "left") for r in (KEEP, CUT)))
    now = both.withColumns({s: inside(F.col(f"{s}{KEEP}"), F.col(f"{s}{CUT}")) for s in ("right", "left")}).filter("right <> left")
    pick = lambda a, b: F.when(F.col("left"), F.col(a)).otherwise(F.col(b))
    return now.select("g", pick("x0", "x1").alias("x0"), pick("y0", "y1").alias("y0"), pick("x1", "x0").alias("x1"), pick("y1", "y0").alias("y1"))


def measures(drawn: DataFrame) -> DataFrame:
    """g, area and length of boundaries."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return drawn.groupBy("g").agg(F.sum((F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area"), F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"))


def rings(drawn: DataFrame) -> DataFrame:
    """g and points of the polygons that boundaries enclose, whose inside is on their left."""
    kind = dict(drawn.dtypes)["g"]

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        points = _points([tuple(r) for r in zip(*(rows.column(c).to_pylist() for c in ENDS), strict=True)])
        return pa.table({"g": rows.column("g")[:1], "points": pa.array([points], pa.list_(pa.struct([("part", pa.int32()), ("ring", pa.int32()), ("x", pa.float64()), ("y", pa.float64())])))})

    return drawn.groupBy("g").applyInArrow(work, f"g {kind}, points {G.POINTS}")


def arranged(shapes: DataFrame, inside: Callable[[Column, Column], Column], walk: str | None = None, limits: tuple[int, int] = (local.SMALL, local.PIECES)) -> DataFrame:
    """g, changed, area, length and points of each group of shapes (g, role, owner, points) that encloses something or has changed.

    changed says whether the boundary is other than the edges as drawn; points are there for all groups, for the changed
    ones or for none (walk: all, changed or None).  Groups are brought together once, by their key, and small ones are
    arranged where they are, many at a time; those that are not small (by their edges and pieces) go by strips.
    """
    kind, every = dict(shapes.dtypes)["g"], walk == "all"
    digits, tour = DIGITS, (lambda rows: _points(rows)) if walk else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return local.stream(batches, inside, digits, tour, every, limits)

    columns = f"g {kind}, big boolean, changed boolean, limits long, area double, length double, points {G.POINTS}"
    rows = shapes.select("g", "role", F.col("owner").cast("string").alias("owner"), "points")
    found = settle(rows.repartition("g").sortWithinPartitions("g", "role", "owner").mapInArrow(work, columns), "arranged")
    out = found.filter("not big and (limits > 0 or changed)").select("g", "changed", "area", "length", "points")
    big = found.filter("big").select("g")
    if big.isEmpty():
        return out
    drawn = _edges(rows.join(merged(big), "g", "left_semi"))
    parts = settle(pieces(drawn), "pieces")
    around = settle(boundary(parts, inside), "boundary")
    n = drawn.groupBy("g").agg(F.count("*").alias("edges"))
    cut = parts.groupBy("g").agg(F.sum("times").alias("pieces"))
    now = around.groupBy("g").agg(F.count("*").alias("limits"))
    same = F.col("edges").eqNullSafe(F.col("pieces")) & F.col("edges").eqNullSafe(F.col("limits"))
    flags = n.join(merged(cut), "g", "left").join(merged(now), "g", "left").select("g", (~same).alias("changed"), F.coalesce("limits", F.lit(0)).alias("limits")).filter("limits > 0 or changed")
    flags = flags.join(merged(measures(around)), "g", "left").select("g", "changed", F.coalesce("area", F.lit(0.0)).alias("area"), F.coalesce("length", F.lit(0.0)).alias("length"))
    if not walk:
        return out.unionByName(flags.withColumn("points", F.lit(None).cast(G.POINTS)))
    wanted = around if every else around.join(merged(flags.filter("changed").select("g")), "g", "left_semi")
    return out.unionByName(flags.join(merged(rings(wanted)), "g", "left"))


def _points(drawn: list[tuple]) -> list[dict]:
    return [{"part": p, "ring": r, "x": x, "y": y} for p, r, ring in _parts(list(_walked(drawn))) for x, y in ring]


def _walked(drawn: list[tuple]) -> Iterator[list[tuple[float, float]]]:
    """Rings along edges; where several go on from a point, the one first met clockwise keeps to the same face."""
    out = defaultdict(list)
    for x0, y0, x1, y1 in sorted(drawn):
        out[x0, y0].append((x1, y1))
    for start in list(out):
        while out[start]:
            ring, at = [start], out[start].pop(0)
            while at != start:
                last = ring[-1]
                ring.append(at)
                back = math.atan2(last[1] - at[1], last[0] - at[0])
                turn = lambda q, p=at, b=back: (b - math.atan2(q[1] - p[1], q[0] - p[0])) % (2 * math.pi) or 2 * math.pi
                if not out[at]:
                    break  # rounding has left an open end
                following = min(out[at], key=turn)
                out[at].remove(following)
                at = following
            yield ring


def _signed(ring: list[tuple[float, float]]) -> float:
    x, y = ring[0]
    return sum((a - x) * (d - y) - (c - x) * (b - y) for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def _parts(walked: list[list[tuple[float, float]]]) -> Iterator[tuple[int, int, list]]:
    """part, ring and points: rings drawn counter-clockwise are parts, each other one is a hole of the least part around it."""
    outer = sorted((r for r in walked if _signed(r) > 0), key=_signed)
    holes = defaultdict(list)
    for h in (r for r in walked if _signed(r) < 0):
        x, y = (h[0][0] + h[1][0]) / 2, (h[0][1] + h[1][1]) / 2
        around = [k for k, ring in enumerate(outer) if _signed(ring) > -_signed(h) and sum((a > x) != (c > x) and y < b + (x - a) * (d - b) / (c - a) for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]], strict=True)) % 2]
        holes[around[0] if around else len(outer) - 1].append(h)
    for k, ring in enumerate(outer):
        yield k, 0, ring
        for n, h in enumerate(holes[k]):
            yield k, n + 1, h


def in_common(edges_a: DataFrame, edges_b: DataFrame, pairs: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """key_a, key_b and the area that each pair has in common, from signed edges (geometry.edge_table).

    As geometry.overlaps, in strips of each pair's own: as many as its edges call for, and more where they crowd.
    """
    g = F.struct(key_a, key_b)
    a, b = (pairs.join(merged(e), k).select(g.alias("g"), *ENDS, "sign") for e, k in ((edges_a, key_a), (edges_b, key_b)))
    strips = Strips(a.unionByName(b))

    def cut(rows: DataFrame, tag: str) -> DataFrame:
        low, high = F.greatest("x0", "begins"), F.least("x1", "ends")
        slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
        return strips.of(rows, F.col("x0"), F.col("x1")).filter(low < high).select("g", "strip", "split", low.alias(f"l{tag}"), high.alias(f"h{tag}"), slope.alias(f"m{tag}"), (F.col("y0") - slope * F.col("x0")).alias(f"c{tag}"), F.col("sign").alias(f"s{tag}"))

    both = cut(a, "a").join(merged(cut(b, "b")), ["g", "strip", "split"])
    total = both.filter(F.greatest("la", "lb") < F.least("ha", "hb")).groupBy("g").agg(F.sum(G.below_both()).alias("area"))
    return total.filter(F.col("area") > G.NOTHING).select("g.*", "area")
