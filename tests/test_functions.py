import hashlib
import math
import random
import re
import unicodedata

from pyspark.sql import functions as F

from parcelflow.config import Settings, load
from parcelflow.functions import geometry as G
from parcelflow.functions import numbers as N
from parcelflow.functions import text as X


def values(spark, rows, schema, *columns):
    return spark.createDataFrame(rows, schema).select("id", *columns).orderBy("id").collect()


def test_names(spark):
    raw = ["  Cooch-Behar District ", "O’Neil & Söhne", "East_Sikkim", None, "", "A/B\tC.", "DADRA and NAGAR", "Ñandú–x"]

    def expected(v):
        t = unicodedata.normalize("NFKD", v or "").encode("ascii", "ignore").decode().strip().lower().replace("&", " and ")
        t = re.sub(r"\s+", " ", re.sub(r"[-–—/]", " ", re.sub(r"[.’'`]", "", t))).strip()
        return re.sub(r"\s+", " ", re.sub(r"\bdistrict\b", "", t)).strip()

    rows = values(spark, list(enumerate(raw)), "id int, v string", X.normalize_name(F.col("v")).alias("n"), X.display_name(F.col("v")).alias("d"))
    assert [r.n for r in rows] == [expected(v) for v in raw]
    assert [r.d for r in rows] == [re.sub(r"\s+", " ", (v or "").strip()).title() for v in raw]


def test_ids_and_lists(spark):
    rows = values(spark, [(0, None, 1961), (1, "x", None)], "id int, a string, b int", X.stable_id(F.lit("GEOM"), F.col("a"), F.col("b")).alias("s"), X.parse_multi_name(F.lit("Nalbari, Barpeta, Kamrup, And Darrang.")).alias("l"), X.is_unnamed(F.col("a")).alias("u"))
    assert [r.s for r in rows] == [hashlib.sha256(t.encode()).hexdigest()[:32] for t in ("GEOM||1961", "GEOM|x|")]
    assert rows[0].l == ["Nalbari", "Barpeta", "Kamrup", "Darrang"] and rows[0].u and not rows[1].u


def jaro_by_definition(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, pairs = set(range(len(b))), []
    for i, x in enumerate(a):
        j = next((j for j in sorted(free) if abs(i - j) <= reach and b[j] == x), None)
        if j is not None:
            free.discard(j)
            pairs.append((i, j))
    if not pairs:
        return 0.0
    m = len(pairs)
    other = sorted(j for _, j in pairs)
    t = sum(a[i] != b[j] for (i, _), j in zip(pairs, other, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def test_name_similarity(spark):
    rng = random.Random(1)
    pairs = [("martha", "marhta"), ("", "x"), ("same", "same"), ("kangra", "kagnra")] + [("".join(rng.choice("abcd") for _ in range(rng.randint(0, 8))), "".join(rng.choice("abcd") for _ in range(rng.randint(0, 8)))) for _ in range(60)]
    rows = values(spark, [(i, *p) for i, p in enumerate(pairs)], "id int, a string, b string", X.name_similarity(F.col("a"), F.col("b")).alias("s"))
    for r, (a, b) in zip(rows, pairs, strict=True):
        j = jaro_by_definition(a, b)
        assert math.isclose(r.s, j + 0.1 * (1 - j) * sum(x == y for x, y in zip(a[:4], b[:4])), abs_tol=1e-12)  # noqa: B905


def test_numbers(spark):
    pre, post = N.bracket(F.col("y"), [1951, 1961, 1971])
    rows = values(spark, [(0, 1950), (1, 1951), (2, 1961), (3, 1965), (4, 2025)], "id int, y int", pre.alias("pre"), post.alias("post"), N.within_tolerance(F.lit(None).cast("double"), F.lit(1.0), 1, 1).alias("w"), N.sliver_threshold(F.lit(0.0), F.lit(20000.0)).alias("t"), N.ratio(F.lit(1.0), F.lit(0.0)).alias("r"))
    assert [(r.pre, r.post) for r in rows] == [(None, 1951), (None, 1961), (1951, 1971), (1961, 1971), (1971, None)]
    assert rows[0].w is False and rows[0].t == 2.0 and rows[0].r is None


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("continuity: 0.8\n")
    assert load(tmp_path / "s.yaml") == Settings(continuity=0.8)


def ring(*xy, part=0, hole=0):
    return [(part, hole, float(x), float(y)) for x, y in xy]


SQUARE = ring((0, 0), (4, 0), (4, 4), (0, 4))
HOLED = SQUARE + ring((1, 1), (3, 1), (3, 3), (1, 3), hole=1)
ELL = ring((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3))
TWO = ring((0, 0), (1, 0), (1, 1), (0, 1)) + ring((5, 5), (7, 5), (7, 7), (5, 7), part=1)


def polygons(spark, shapes):
    return spark.createDataFrame(list(shapes.items()), f"k string, points {G.POINTS}")


def test_polygon_measures(spark):
    shapes = {"square": SQUARE, "back": SQUARE[::-1], "holed": HOLED, "ell": ELL, "two": TWO, "none": []}
    rows = {r.k: r for r in polygons(spark, shapes).select("k", G.area(F.col("points")).alias("a"), G.n_parts(F.col("points")).alias("n"), G.perimeter(F.col("points")).alias("p")).collect()}
    assert {k: round(r.a, 9) for k, r in rows.items()} == {"square": 16, "back": 16, "holed": 12, "ell": 5, "two": 5, "none": 0}
    assert rows["two"].n == 2 and rows["square"].p == 16


def overlap(spark, a, b):
    left, right = polygons(spark, a).withColumnRenamed("k", "a"), polygons(spark, b).withColumnRenamed("k", "b")
    pairs = G.candidate_pairs(left, right, "a", "b", 3.0)
    found = G.overlaps(G.edge_table(left, "a"), G.edge_table(right, "b"), pairs, "a", "b", 0.7)
    return {(r.a, r.b): r.area for r in found.collect()}


def test_overlaps(spark):
    shapes = {"square": SQUARE, "holed": HOLED, "ell": ELL, "two": TWO, "far": ring((50, 50), (51, 50), (51, 51))}
    found = overlap(spark, shapes, shapes)
    for k, own in (("square", 16), ("holed", 12), ("ell", 5), ("two", 5), ("far", 0.5)):
        assert math.isclose(found[k, k], own, abs_tol=1e-9)  # a polygon overlaps itself wholly
    for (a, b), v in found.items():
        assert math.isclose(v, found[b, a], abs_tol=1e-9)
    assert math.isclose(found["square", "ell"], 5) and math.isclose(found["holed", "ell"], 5) and ("square", "far") not in found
    moved = overlap(spark, {"d": ring((2, 0), (4, 2), (2, 4), (0, 2))}, {"s": ring((2, 0), (6, 0), (6, 4), (2, 4))})
    assert math.isclose(moved["d", "s"], 4)


def test_equal_area(spark):
    x, y = G.authalic(F.lit(180.0), F.lit(90.0))
    r = spark.range(1).select((4 * x * y).alias("surface")).first()
    assert abs(r.surface - 510_065_621.724) < 1
    lon, lat = G.lambert_inverse(F.lit(4_000_000.0), F.lit(4_000_000.0), 12.47, 35.17, 24.0, 80.0, 4_000_000.0, 4_000_000.0)
    r = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert math.isclose(r.lon, 80) and math.isclose(r.lat, 24, abs_tol=1e-9)


def test_rounded_doubles_as_by_decimals(spark):
    rng = random.Random(5)
    values = [rng.random() * 10 ** rng.randint(-9, 12) for _ in range(3000)] + [rng.randint(0, 10**7) / 2000 for _ in range(3000)] + [0.0, -0.0, -0.25, -1.0005, 1.0005, 2.5e-4, 1e300, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 3, 6, 9):
        rows = df.select(N.rounded_double(F.col("v"), digits).alias("got"), F.round("v", digits).alias("want")).collect()
        assert [repr(r.got) for r in rows] == [repr(r.want) for r in rows]
