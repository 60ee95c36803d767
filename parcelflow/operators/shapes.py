"""Polygons repaired, cut out of one another and measured together, on any shapes: slanted, with holes, in several parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import arrangement as A
from parcelflow.functions import geometry as G
from parcelflow.sources.steps import merged, settle


def repaired(layer: DataFrame, key: str = "geom_obs_id") -> DataFrame:
    """layer with valid points, was_repaired and repair_area_delta_pct (of the area as drawn; null where that is 0).

    A point belongs to a feature if the outer ring of one of its parts winds around it, in any direction and any number
    of times, and no hole of that part does.  So bow ties become two parts, spikes go, holes that overlap are one and
    rings drawn twice count once.  A feature is left as it is if its edges meet at their ends only and all of them have
    the feature on one side.  Null and empty points stay; rows with equal keys are not told apart.
    """
    changed = A.arranged(A.shapes(layer, key, key, A.KEEP), lambda kept, cut: kept, "changed").filter("changed").select("g", F.lit(True).alias("was_repaired"), F.col("points").alias("made"))
    back = layer.join(merged(changed), F.col(key) == F.col("g"), "left").drop("g")
    none = F.array().cast(G.POINTS)
    back = back.withColumns({"was_repaired": F.coalesce("was_repaired", F.lit(False)), "made": F.when(F.col("was_repaired"), F.coalesce("made", none)).otherwise(F.col("points"))})
    before, after = G.area(F.col("points")), G.area(F.col("made"))
    delta = F.when(~F.col("was_repaired"), 0.0).when(F.abs(before) > 0, 100 * (after - before) / F.abs(before))
    return back.withColumn("repair_area_delta_pct", delta).drop("points").withColumnRenamed("made", "points").select(*layer.columns, "was_repaired", "repair_area_delta_pct")


def remainder(a: DataFrame, b: DataFrame, pairs: DataFrame, key_a: str, key_b: str, walk: str | None = None) -> DataFrame:
    """g (a's key), area, length and, with walk, points of what each feature of a has outside all those of b that it is paired with."""
    cut = pairs.select(F.col(key_a).alias("__g"), key_b).join(merged(b.select(key_b, "points")), key_b)
    rows = A.shapes(a, key_a, key_a, A.KEEP).unionByName(A.shapes(cut, "__g", key_b, A.CUT))
    return A.arranged(rows, lambda kept, cut: kept & ~cut, walk)


def residual_shapes(a: DataFrame, b: DataFrame, key_a: str = "obs_a", key_b: str = "obs_b") -> DataFrame:
    """key_a, points and area of what each feature of a has outside all features of b; those that b covers are absent.

    Features that no box of b meets are left as they are.
    """
    pairs = settle(G.meeting_boxes(a, b, key_a, key_b), "pairs")
    met = pairs.select(key_a).distinct()
    left = remainder(a.join(merged(met), key_a, "left_semi"), b, pairs, key_a, key_b, "all").filter("points is not null").select(F.col("g").alias(key_a), "points")
    return left.unionByName(a.join(merged(met), key_a, "left_anti").select(key_a, "points")).withColumn("area", G.area(F.col("points"))).filter("area > 0")


def union_areas(layer: DataFrame, key: str = "geom_obs_id", by: str = "source_year") -> DataFrame:
    """by and union_area, however many features overlap at a place: each feature counts what those of smaller keys leave of it."""
    own = layer.select(F.col(key), F.col(by), "points")
    other = own.select(F.col(key).alias("__other"), F.col(by).alias("__by"), "points")
    pairs = G.meeting_boxes(own, other, key, "__other").filter(F.col(key) > F.col("__other"))
    same = pairs.join(merged(own.select(key, by)), key).join(merged(other.select("__other", "__by")), "__other").filter(F.col(by).eqNullSafe(F.col("__by")))
    same = settle(same.select(key, "__other"), "pairs")
    met = same.select(key).distinct()
    left = remainder(own.join(merged(met), key, "left_semi"), other, same, key, "__other").select(F.col("g").alias(key), "area")
    rest = own.join(merged(met), key, "left_anti").select(key, by, G.area(F.col("points")).alias("area"))
    return own.select(key, by).join(merged(left), key).unionByName(rest.select(key, by, "area")).groupBy(by).agg(F.sum("area").alias("union_area"))


def common_boundaries(a: DataFrame, b: DataFrame, pairs: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """key_a, key_b, area and boundary (the length of the intersection's boundary) of pairs that have area in common, and the distance of their centroids."""
    one = pairs.join(merged(a.select(key_a, "points")), key_a).withColumn("__g", F.struct(key_a, key_b))
    two = pairs.join(merged(b.select(key_b, "points")), key_b).withColumn("__g", F.struct(key_a, key_b))
    both = A.shapes(one, "__g", key_a, A.KEEP).unionByName(A.shapes(two, "__g", key_b, A.CUT))
    found = A.arranged(both, lambda kept, cut: kept & cut).filter(F.col("area") > G.NOTHING).select("g.*", "area", F.col("length").alias("boundary"))
    middle = lambda d, k, t: G.centroids(G.edge_table(d, k), k).select(k, F.col("cx").alias(f"__x{t}"), F.col("cy").alias(f"__y{t}"))
    dx, dy = F.col("__xa") - F.col("__xb"), F.col("__ya") - F.col("__yb")
    return found.join(merged(middle(a, key_a, "a")), key_a).join(merged(middle(b, key_b, "b")), key_b).select(key_a, key_b, "area", "boundary", F.sqrt(dx * dx + dy * dy).alias("distance"))


def overlay(a: DataFrame, b: DataFrame, key_a: str = "obs_a", key_b: str = "obs_b") -> DataFrame:
    """key_a, key_b and area of all parcels of two layers; cells and strips come from the shapes.

    Areas are rounded to nine digits, so that those that are equal but for the order of sums are ties.
    """
    found = A.in_common(G.edge_table(a, key_a), G.edge_table(b, key_b), settle(G.meeting_boxes(a, b, key_a, key_b), "pairs"), key_a, key_b)
    return found.withColumn("area", F.round("area", 9))
