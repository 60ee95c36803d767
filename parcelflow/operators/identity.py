"""Identity by continuity: canonical keys of units through the vintages."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.config import Settings
from parcelflow.operators.transition import best_matches
from parcelflow.sources.steps import settle


def mutual_best(s: DataFrame) -> DataFrame:
    a = best_matches(s, "a").select("year_a", "year_b", "obs_a", "obs_b", "area", "outflow_share", "inflow_share")
    return a.join(best_matches(s, "b").select("year_a", "year_b", "obs_a", "obs_b"), ["year_a", "year_b", "obs_a", "obs_b"])


def continuity(s: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Edges over which a unit stays the same: mutually best, and most of either side."""
    t = settings.continuity
    return mutual_best(s).filter((F.col("inflow_share") >= t) & (F.col("outflow_share") >= t))


def chain_roots(layers: DataFrame, edges: DataFrame, vintages: Iterable[int]) -> DataFrame:
    """year, obs, root of every observation.

    An observation has at most one edge on either side, so edges form paths; pointers to predecessors are doubled until
    they span all vintages, which takes a logarithm of their number of joins.
    """
    came = edges.select(F.col("obs_b").alias("obs"), F.col("obs_a").alias("root"))
    state = layers.select("year", "obs", "ordinal").join(came, "obs", "left").withColumn("root", F.coalesce("root", "obs"))
    for _ in range(math.ceil(math.log2(max(2, len(list(vintages)) - 1)))):
        hop = state.select(F.col("obs").alias("root"), F.col("root").alias("next"))
        state = state.join(hop, "root").select("year", "obs", "ordinal", F.col("next").alias("root"))
    return state


def numbered(roots: DataFrame, start: int = 0) -> DataFrame:
    """root and canonical_key: numbers in the order of vintages and rows, counted within a vintage and then shifted."""
    own = roots.filter("root = obs").select("year", "obs", "ordinal")
    counts = own.groupBy("year").agg(F.count("*").alias("n"))
    before = counts.select("year", (F.coalesce(F.sum("n").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start).alias("before"))
    place = F.row_number().over(Window.partitionBy("year").orderBy("ordinal", "obs"))
    number = (F.col("place") + F.col("before")).cast("int")
    return own.withColumn("place", place).join(F.broadcast(before), "year").select(F.col("obs").alias("root"), F.format_string("IND-%06d", number).alias("canonical_key"), "year")


def obs_keys(roots: DataFrame, keys: DataFrame) -> DataFrame:
    return roots.join(keys.select("root", "canonical_key"), "root").select("year", "obs", "canonical_key")


def registry(layers: DataFrame, edges: DataFrame, roots: DataFrame, keys: DataFrame, vintages: Iterable[int]) -> DataFrame:
    """One row for each key: when and where it began, and when it ended, if it did."""
    known = sorted(vintages)
    following = F.array(*(F.lit(v) for v in known))
    named = roots.join(keys.select("root", "canonical_key"), "root").join(layers.select("obs", "unit", "state"), "obs")
    ends = named.groupBy("canonical_key").agg(F.min_by(F.struct("unit", "state"), "year").alias("first"), F.min("year").alias("established_year"), F.max("year").alias("last"))
    closed = F.when(F.col("last") < known[-1], F.array_min(F.filter(following, lambda v: v > F.col("last"))))
    return ends.select(
        "canonical_key", "established_year", closed.alias("closed_year"), F.col("first.unit").alias("display_name"), F.col("first.state").alias("state_at_creation"), closed.isNull().alias("is_active"),
        F.when(F.col("established_year") == known[0], "ANCHOR").otherwise("NEW").alias("origin_kind"),
    )


def transitions(s: DataFrame, keys: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The matrix between keys, without what is below the absolute sliver size."""
    side = lambda k, name: keys.select(F.col("obs").alias(f"obs_{k}"), F.col("canonical_key").alias(name))
    return s.filter(F.col("area") >= settings.sliver_abs).join(side("a", "from_ck"), "obs_a").join(side("b", "to_ck"), "obs_b").select("year_a", "year_b", "from_ck", "to_ck", "obs_a", "obs_b", "area", "outflow_share", "inflow_share")


def get_or_create(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """natural_key and canonical_key: known ones keep theirs, new ones are numbered after the largest, in their order."""
    top = known.agg(F.coalesce(F.max(F.substring("canonical_key", 5, 12).cast("int")), F.lit(0)).alias("top"))
    new = wanted.select("natural_key").distinct().join(known.select("natural_key"), "natural_key", "left_anti")
    # ranges of the order, cut where a sample says, so that no prefix is one task: numbers within them, shifted by the counts of those before
    spread = settle(new.repartitionByRange("natural_key").withColumn("bucket", F.spark_partition_id()), "ranges")
    counts = spread.groupBy("bucket").agg(F.count("*").alias("n"))
    before = counts.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered_ = spread.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("natural_key"))).join(before, "bucket").join(F.broadcast(top))
    return known.select("natural_key", "canonical_key").unionByName(numbered_.select("natural_key", F.format_string("IND-%06d", (F.col("place") + F.col("before") + F.col("top")).cast("int")).alias("canonical_key")))
