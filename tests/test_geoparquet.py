"""GeoParquet: footers, boxes, round trips, rows and columns that stay unread."""

import glob
import json

import pyarrow.parquet as pq
import pytest

from parcelflow.functions import geometry as G
from parcelflow.sources import geoparquet as P

SQUARE = [(0, 0, 0.0, 0.0), (0, 0, 4.0, 0.0), (0, 0, 4.0, 4.0), (0, 0, 0.0, 4.0)]
HOLED = SQUARE + [(0, 1, 1.0, 1.0), (0, 1, 2.0, 1.0), (0, 1, 2.0, 2.0)]
MANY = HOLED + [(1, 0, 9.0, 9.0), (1, 0, 9.5, 9.0), (1, 0, 9.0, 9.5), (1, 1, 9.1, 9.1), (1, 1, 9.2, 9.1), (1, 1, 9.1, 9.2)]


@pytest.fixture
def path(spark, tmp_path):
    spark.dataSource.register(P.GeoParquet)
    rows = [(1, "a", SQUARE), (2, None, HOLED), (3, "c", MANY), (4, "d", []), (5, "e", None)]
    rows += [(100 + i, "far", [(p, r, x + 1000 + i, y) for p, r, x, y in SQUARE]) for i in range(20)]
    df = spark.createDataFrame(rows, f"id long, name string, points {G.POINTS}")
    where = f"file://{tmp_path}/shapes"
    df.repartition(3).write.format("geoparquet").option("crs", "EPSG:4326").mode("append").save(where)
    return where


def test_round_trip(spark, path):
    got = {r.id: r for r in P.read(spark, path).collect()}
    assert len(got) == 25 and got[2].name is None
    for k, want in ((1, SQUARE), (2, HOLED), (3, MANY)):
        assert [tuple(p) for p in got[k].points] == want
    assert got[4].points is None and got[5].points is None
    assert P.read(spark, path, columns=["id"]).columns == ["id", "points"]


def test_footers(path):
    files = glob.glob(f"{path.removeprefix('file://')}/*.parquet")
    assert len(files) == 3
    kinds, low, high = set(), [], []
    for f in files:
        geo = json.loads(pq.ParquetFile(f).metadata.metadata[b"geo"])
        column = geo["columns"]["geometry"]
        assert geo["version"] == "1.1.0" and geo["primary_column"] == "geometry" and column["encoding"] == "WKB" and column["crs"]["id"] == {"authority": "EPSG", "code": "4326"} and column["covering"]["bbox"]["xmin"] == ["bbox", "xmin"]
        kinds |= set(column["geometry_types"])
        low.append(column["bbox"][:2])
        high.append(column["bbox"][2:])
    assert kinds == {"Polygon", "MultiPolygon"} and min(x for x, _ in low) == 0 and max(x for x, _ in high) == 1023


def test_boxes_and_columns_are_pushed_down(spark, path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    near = P.read(spark, path, box=(-1, -1, 20, 20), columns=["id"])
    assert {r.id for r in near.collect()} == {1, 2, 3}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(bbox.xmin,20.0)" in plan
    scan = next(x for x in plan.split("\n") if "ReadSchema" in x or "FileScan parquet" in x)
    assert "name" not in scan
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_overwrite_and_nothing(spark, path):
    df = spark.createDataFrame([(7, SQUARE)], f"id long, points {G.POINTS}")
    df.coalesce(1).write.format("geoparquet").mode("overwrite").save(path)
    assert [r.id for r in P.read(spark, path).collect()] == [7]
    geo = json.loads(pq.ParquetFile(glob.glob(f"{path.removeprefix('file://')}/*.parquet")[0]).metadata.metadata[b"geo"])
    assert geo["columns"]["geometry"]["crs"] is None
