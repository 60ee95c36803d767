"""Joins of two sides that both grow with the input are made by shuffles, however small a plan takes a side to be."""

from pathlib import Path

import pytest

from parcelflow.functions.geometry import POINTS
from parcelflow.operators import matching
from parcelflow.plans.catalogue import QUERIES


@pytest.mark.parametrize(
    ("name", "fixed"),
    # joins with what has a fixed size: in union_area the areas of vintages
    [("box_overlap_polygon", 0), ("validity_bowties", 0), ("transition_from_polygons", 0), ("polygon_residuals", 0), ("union_area", 1)],
)
def test_no_broadcast_of_what_grows(spark, sf, name, fixed):
    plan = QUERIES[name](spark, str(Path(sf).parent / "sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= fixed and "SortMergeJoin" in plan


@pytest.mark.parametrize("few", [0, 1000])
def test_a_search_for_the_nearest_deals_many_units_and_sends_few(spark, monkeypatch, few):
    plans, settle = [], matching.settle

    def seen(df, label):
        if label == "nearest":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, label)

    monkeypatch.setattr(matching, "settle", seen)
    monkeypatch.setattr(matching, "FEW", few, raising=False)
    at = lambda k: (k * 37 % 101 * 3.0 + (5000 if k == 7 else 0), k * 53 % 97 * 3.0)
    rows = lambda ks: [(k, [(0, 0, *at(k)), (0, 0, at(k)[0] + 1, at(k)[1] + 1)], 1950 + k % 9, 1955 + k % 9) for k in ks]
    frame = lambda key, ks: spark.createDataFrame(rows(ks), f"{key} long, points {POINTS}, from_year int, to_year int")
    found = {r["unit"]: r["candidate"] for r in matching.nearest(frame("unit", range(90)), frame("candidate", range(90, 120))).collect()}
    gap = lambda a, b: max(abs(at(a)[0] - at(b)[0]) - 1, 0) ** 2 + max(abs(at(a)[1] - at(b)[1]) - 1, 0) ** 2
    years = lambda a, b: max(abs(a % 9 - b % 9) - 5, 0)
    assert found == {a: min(range(90, 120), key=lambda b: (gap(a, b), years(a, b), b)) for a in range(90)}
    assert all(("BroadcastHashJoin" in p) == bool(few) for p in plans)
