"""From two dated layers to the transition matrix, its residuals and shares.

Layers: year, obs (id of an observed unit), unit, state, area, ordinal.  Assignments: year, atom, unit, weight.
Matrix: year_a, year_b, obs_a, obs_b, area.  A window is a pair of years in the columns, so all windows run at once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.config import Settings
from parcelflow.functions.numbers import ratio, sliver_threshold
from parcelflow.sources.steps import merged


def next_vintage(year: Column, vintages: Iterable[int]) -> Column:
    known = F.array(*(F.lit(int(v)) for v in sorted(vintages)))
    return F.array_min(F.filter(known, lambda v: v > year))


def obs_id(unit: Column, year: Column) -> Column:
    return F.concat_ws("@", unit, year.cast("string"))


def layers_of(assigned: DataFrame) -> DataFrame:
    """One row for each unit of a year: its area and its place in the year's order."""
    sums = assigned.groupBy("year", "unit").agg(F.sum("weight").cast("double").alias("area"))
    own = Window.partitionBy("year").orderBy("unit")
    return sums.select("year", "unit", obs_id(F.col("unit"), F.col("year")).alias("obs"), "area", F.row_number().over(own).cast("long").alias("ordinal"))


def overlay_atoms(assigned: DataFrame, vintages: Iterable[int]) -> DataFrame:
    """Parcels between consecutive vintages: shared atoms, so nothing is lost to rounding.

    One shuffle by atom serves all windows; sums are combined before the second.
    """
    ahead = Window.partitionBy("atom").orderBy("year")
    both = assigned.select("atom", "year", "unit", "weight", F.lead("year").over(ahead).alias("year_b"), F.lead("unit").over(ahead).alias("unit_b"))
    pairs = both.filter(F.col("year_b") == next_vintage(F.col("year"), vintages))
    sums = pairs.groupBy("year", "year_b", "unit", "unit_b").agg(F.sum("weight").cast("double").alias("area"))
    return sums.select(F.col("year").alias("year_a"), "year_b", obs_id(F.col("unit"), F.col("year")).alias("obs_a"), obs_id(F.col("unit_b"), F.col("year_b")).alias("obs_b"), "area").filter("area > 0")


def _areas(layers: DataFrame, side: str) -> DataFrame:
    return layers.select(F.col("year").alias(f"year_{side}"), F.col("obs").alias(f"obs_{side}"), F.col("area").alias(f"area_{side}"))


def flag_slivers(parcels: DataFrame, layers: DataFrame, settings: Settings = Settings()) -> DataFrame:
    both = parcels.join(merged(_areas(layers, "a")), ["year_a", "obs_a"]).join(merged(_areas(layers, "b")), ["year_b", "obs_b"])
    return both.withColumn("is_sliver", F.col("area") < sliver_threshold(F.col("area_a"), F.col("area_b"), settings))


def matrix(flagged: DataFrame) -> DataFrame:
    return flagged.filter("not is_sliver").groupBy("year_a", "year_b", "obs_a", "obs_b").agg(F.sum("area").alias("area"))


def residual(flagged: DataFrame, layers: DataFrame, side: str, vintages: Iterable[int]) -> DataFrame:
    """Per observation what no parcel covers: lost by a source (side a) or gained by a target (side b)."""
    known = sorted(vintages)
    own = layers.filter(F.col("year").isin(known[:-1] if side == "a" else known[1:]))
    covered = flagged.groupBy(F.col(f"year_{side}").alias("year"), F.col(f"obs_{side}").alias("obs")).agg(
        F.sum("area").alias("covered"), F.sum(F.when(F.col("is_sliver"), F.col("area")).otherwise(0.0)).alias("sliver"), F.sum(F.when(F.col("is_sliver"), 0.0).otherwise(F.col("area"))).alias("transition")
    )
    out = own.join(merged(covered), ["year", "obs"], "left")
    name = "lost" if side == "a" else "gained"
    return out.select("year", "obs", "unit", "area", F.greatest(F.col("area") - F.coalesce("covered", F.lit(0.0)), F.lit(0.0)).alias(name), F.coalesce("sliver", F.lit(0.0)).alias("sliver"), F.coalesce("transition", F.lit(0.0)).alias("transition"))


def closure(residuals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Whether what a source became, lost and crumbled adds up to its area."""
    error = F.abs(F.col("transition") + F.col("lost") + F.col("sliver") - F.col("area"))
    return residuals.withColumn("closure_error", error).withColumn("is_violation", error > F.greatest(F.lit(settings.closure_abs), F.col("area") * (settings.closure_pct / 100)))


def shares(m: DataFrame, layers: DataFrame) -> DataFrame:
    both = m.join(merged(_areas(layers, "a")), ["year_a", "obs_a"]).join(merged(_areas(layers, "b")), ["year_b", "obs_b"])
    return both.withColumns({"outflow_share": ratio(F.col("area"), F.col("area_a"), 0.0), "inflow_share": ratio(F.col("area"), F.col("area_b"), 0.0)})


def best_matches(s: DataFrame, side: str) -> DataFrame:
    """The largest part of each source (side a) or target (side b); the least id of equals."""
    other, share = ("b", "outflow_share") if side == "a" else ("a", "inflow_share")
    order = Window.partitionBy("year_a", "year_b", f"obs_{side}").orderBy(F.col(share).desc(), f"obs_{other}")
    return s.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def summary(flagged: DataFrame, source: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each window: counts, totals and the worst closure error."""
    parcels = flagged.groupBy("year_a", "year_b").agg(F.count("*").alias("n_parcels"), F.count_if("is_sliver").alias("n_slivers"))
    closed = closure(source, settings).groupBy(F.col("year").alias("year_a")).agg(
        F.count("*").alias("n_source"), F.sum("area").alias("source_area"), F.sum("transition").alias("transition_area"), F.sum("lost").alias("lost_area"), F.sum("sliver").alias("sliver_area"),
        F.max("closure_error").alias("max_closure_error"), F.count_if("is_violation").alias("n_violations"),
    )
    gained = target.groupBy(F.col("year").alias("year_b")).agg(F.count("*").alias("n_target"), F.sum("gained").alias("gained_area"))
    return parcels.join(F.broadcast(closed), "year_a").join(F.broadcast(gained), "year_b")  # one row for each vintage


def normalised(s: DataFrame, source: DataFrame, target: DataFrame, side: str) -> DataFrame:
    """The matrix with rows (side a) or columns (side b) that sum to one, by an absorbing LOST or GAINED."""
    if side == "a":
        rest = source.filter("area > 0").select(F.col("year").alias("year_a"), F.col("obs").alias("obs_a"), F.lit("LOST").alias("obs_b"), ((F.col("lost") + F.col("sliver")) / F.col("area")).alias("share"))
        return s.select("year_a", "obs_a", "obs_b", F.col("outflow_share").alias("share")).unionByName(rest.filter("share > 0"))
    rest = target.filter("area > 0").select(F.col("year").alias("year_b"), F.lit("GAINED").alias("obs_a"), F.col("obs").alias("obs_b"), ((F.col("gained") + F.col("sliver")) / F.col("area")).alias("share"))
    return s.select("year_b", "obs_a", "obs_b", F.col("inflow_share").alias("share")).unionByName(rest.filter("share > 0"))


def compose(s: DataFrame, vintages: Iterable[int], share: str = "outflow_share") -> DataFrame:
    """Shares between any two vintages: the sums of products along the windows between them."""
    known = sorted(vintages)
    step = s.select("year_a", "year_b", "obs_a", "obs_b", F.col(share).alias("share"))
    found = reach = step
    for _ in range(len(known) - 2):
        nxt = step.select(F.col("year_a").alias("year_b"), F.col("obs_a").alias("obs_b"), F.col("year_b").alias("year_c"), F.col("obs_b").alias("obs_c"), F.col("share").alias("more"))
        reach = reach.join(nxt, ["year_b", "obs_b"]).groupBy("year_a", "obs_a", "year_c", "obs_c").agg(F.sum(F.col("share") * F.col("more")).alias("share"))
        reach = reach.select("year_a", F.col("year_c").alias("year_b"), "obs_a", F.col("obs_c").alias("obs_b"), "share")
        found = found.unionByName(reach)
    return found
