"""Raw polygon layers to standard ones: names, exclusions, validity, areas, ids and topology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.config import LayerSource, Settings
from parcelflow.functions import geometry as G
from parcelflow.functions.text import canonical_state, display_name, is_unnamed, normalize_name, stable_id, state_of_code
from parcelflow.operators.shapes import repaired, union_areas


def projection(raw: DataFrame, source: LayerSource) -> DataFrame:
    """The layer's own columns under the engine's names."""
    state: Column = F.col(source.state_field) if source.state_field else state_of_code(F.col(source.state_code_field)) if source.state_code_field else F.lit(None).cast("string")
    return raw.select(F.lit(source.dataset).alias("source_dataset"), F.lit(source.year).alias("source_year"), F.col(source.pk_field).cast("string").alias("source_pk"), F.col(source.name_field).alias("district_name_original"), state.alias("state_name_original"), "points", "ordinal")


def with_rejects(layer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Named features, and those without a name with the reason; a null name is no name."""
    flagged = layer.withColumn("unnamed", is_unnamed(F.col("district_name_original")))
    return flagged.filter("not unnamed").drop("unnamed"), flagged.filter("unnamed").drop("unnamed").withColumn("reason", F.lit("UNNAMED"))


def standardised(layer: DataFrame, degrees: bool = True) -> DataFrame:
    """Areas, parts and names of a layer's features; empty geometries are dropped.

    Shapes are repaired; `is_valid` says whether the feature was drawn validly.
    """
    own = layer.filter(F.size("points") > 0).withColumn("geom_obs_id", stable_id(F.lit("GEOM"), F.col("source_dataset"), F.col("source_year"), F.col("source_pk"), F.col("ordinal")))
    flat = own.withColumn("points", G.project(F.col("points"))) if degrees else own
    whole = repaired(flat)
    name, state = F.col("district_name_original"), F.col("state_name_original")
    return whole.select(
        "source_dataset", "source_year", "source_pk", "district_name_original", display_name(name).alias("district_name_std"), normalize_name(name).alias("district_name_norm"), "state_name_original",
        canonical_state(state).alias("state_name_std"), normalize_name(canonical_state(state)).alias("state_name_norm"), G.area(F.col("points")).alias("area_km2"), "was_repaired", "repair_area_delta_pct",
        (~F.col("was_repaired")).alias("is_valid"), (G.n_parts(F.col("points")) > 1).alias("is_multipart"), G.n_parts(F.col("points")).alias("n_parts"), "points", "geom_obs_id", "ordinal",
    )


def snapped(layer: DataFrame, grid: float, least_area: float = 0.0) -> DataFrame:
    """Points on a grid; features that shrink below an area go."""
    moved = layer.withColumn("points", G.snapped(F.col("points"), grid))
    return moved.withColumn("area_km2", G.area(F.col("points"))).filter(F.col("area_km2") > least_area)


def duplicates(layer: DataFrame) -> DataFrame:
    """Features too many, by geometry and by primary key, for each vintage."""
    shape = F.sha2(F.to_json("points"), 256)
    return layer.groupBy("source_dataset", "source_year").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct(shape)).alias("dup_geometry"), (F.count("source_pk") - F.countDistinct("source_pk")).alias("dup_source_pk"))


def topology(layer: DataFrame, settings: Settings = Settings(), key: str = "geom_obs_id") -> DataFrame:
    """Self-overlap of each vintage as a share of its area, with a status; exact however many features overlap at a place."""
    areas = layer.groupBy("source_year").agg(F.count("*").alias("n_districts"), F.sum("area_km2").alias("sum_area"))
    both = areas.join(union_areas(layer, key), "source_year")
    over = F.greatest(F.col("sum_area") - F.col("union_area"), F.lit(0.0))
    share = F.when(F.col("sum_area") > 0, over / F.col("sum_area")).otherwise(0.0)
    status = F.when(share > settings.self_overlap_error, "ERROR").when(share > settings.self_overlap_warn, "WARN").otherwise("PASS")
    return both.select("source_year", "n_districts", "sum_area", "union_area", over.alias("self_overlap"), (share * 100).alias("self_overlap_pct"), status.alias("status"))
