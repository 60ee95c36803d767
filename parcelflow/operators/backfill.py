"""Areas of units before they existed, from their ancestors, and what else follows from shares."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.config import Settings
from parcelflow.sources.steps import settle


def long_areas(wide: DataFrame, years: Iterable[int]) -> DataFrame:
    """canonical_key, year, area from columns area_km2_<year>, without missing ones."""
    names = [f"area_km2_{y}" for y in years]
    long = wide.select("canonical_key", *(F.col(n).cast("double").alias(n) for n in names)).unpivot("canonical_key", names, "column", "area")
    return long.filter("area is not null").select("canonical_key", F.substring("column", 10, 4).cast("int").alias("year"), "area")


def wide_areas(long: DataFrame, years: Iterable[int]) -> DataFrame:
    out = long.groupBy("canonical_key").pivot("year", list(years)).agg(F.max("area"))
    return out.select("canonical_key", *(F.col(str(y)).alias(f"area_km2_{y}") for y in years))


def earliest_ancestor(registry: DataFrame, edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """canonical_key and the least establishment year among its origins: itself, or ancestors without predecessors.

    Each step goes from all keys to their ancestors one edge further back, and is written down; it ends when there are
    none.  If there still are some at the depth of the settings, that is an error: the edges have a cycle or the depth is too small.
    """
    up = edges.select(F.col("to_ck").alias("at"), F.col("from_ck").alias("next")).distinct()
    years = registry.select(F.col("canonical_key").alias("at"), F.col("established_year").alias("earliest"))
    front = registry.select("canonical_key", F.col("canonical_key").alias("at"))
    found = None
    for _ in range(settings.backfill_depth + 1):
        origins = front.join(up.select("at").distinct(), "at", "left_anti").join(years, "at").select("canonical_key", "earliest")
        found = origins if found is None else found.unionByName(origins)
        front = settle(front.join(up, "at").select("canonical_key", F.col("next").alias("at")).distinct(), "ancestors")
        if front.isEmpty():
            break
    else:
        raise ValueError(f"ancestors lie more than {settings.backfill_depth} edges back; look for cycles or raise backfill_depth")
    return found.groupBy("canonical_key").agg(F.min("earliest").alias("earliest"))


def backfilled(areas: DataFrame, edges: DataFrame, registry: DataFrame, years: Iterable[int], settings: Settings = Settings()) -> DataFrame:
    """canonical_key, year, area, fill_method, fill_source, fill_confidence for every key and year.

    A missing area is the sum over the relevant predecessors of their area in that year times the share that came from
    them.  Edges lead forward in time, so one pass for each window, latest ancestors first, reaches every key: state
    holds what is known so far, and each pass fills the keys all of whose relevant predecessors are settled or hopeless.
    """
    known = sorted(years)
    grid = registry.select("canonical_key", "established_year").withColumn("year", F.explode(F.array(*(F.lit(y) for y in known))))
    state = grid.join(areas.select("canonical_key", "year", "area"), ["canonical_key", "year"], "left").withColumns({"fill_method": F.when(F.col("area").isNotNull(), "DIRECT"), "fill_source": F.when(F.col("area").isNotNull(), F.col("canonical_key")).otherwise(""), "fill_confidence": F.when(F.col("area").isNotNull(), 1.0).otherwise(0.0)})
    pairs = grid.select("canonical_key", "year").join(edges.select(F.col("to_ck").alias("canonical_key"), "from_ck", "year_a", "outflow_share", F.col("lineage_confidence").alias("confidence")), "canonical_key")
    of = Window.partitionBy("canonical_key", "year")
    later = F.max(F.when(F.col("year_a") >= F.col("year"), 1).otherwise(0)).over(of) == 1
    relevant = pairs.withColumns({"later": later, "first": F.min("year_a").over(of)}).filter((F.col("later") & (F.col("year_a") >= F.col("year"))) | (~F.col("later") & (F.col("year_a") == F.col("first"))))
    for _ in range(len(known) - 1):
        state = settle(state, "backfill")
        source = state.select(F.col("canonical_key").alias("from_ck"), "year", F.col("area").alias("from_area"), F.col("fill_confidence").alias("from_confidence"))
        use = relevant.join(source, ["from_ck", "year"], "left").withColumn("some", F.col("from_area") > 0)
        sums = use.groupBy("canonical_key", "year").agg(
            F.sum(F.when(F.col("some"), F.col("from_area") * F.col("outflow_share"))).alias("new_area"), F.min(F.when(F.col("some"), F.col("from_confidence") * F.col("confidence"))).alias("new_confidence"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("some"), F.col("from_ck")))), "|").alias("new_source"), F.count("*").alias("n"), F.max("outflow_share").alias("share"),
        )
        direct = (F.col("n") == 1) & (F.col("share") >= settings.direct_share)
        fresh = (F.coalesce("fill_method", F.lit("")) != "DIRECT") & (F.col("new_area") > 0)
        state = state.join(sums, ["canonical_key", "year"], "left").select(
            "canonical_key", "established_year", "year", F.when(fresh, F.col("new_area")).otherwise(F.col("area")).alias("area"),
            F.when(fresh, F.when(direct, "DIRECT_PREDECESSOR").otherwise("LINEAGE_BACKFILL")).otherwise(F.col("fill_method")).alias("fill_method"),
            F.when(fresh, F.col("new_source")).otherwise(F.col("fill_source")).alias("fill_source"), F.when(fresh, F.col("new_confidence")).otherwise(F.col("fill_confidence")).alias("fill_confidence"),
        )
    first = earliest_ancestor(registry, edges, settings)
    out = state.join(first, "canonical_key", "left").withColumn("correct", F.col("year") < F.coalesce("earliest", F.lit(9999)))
    method = F.when(F.col("fill_method") == "DIRECT", "DIRECT").when(F.col("correct"), "NULL_CORRECT").otherwise(F.coalesce("fill_method", F.lit("NULL_UNRESOLVED")))
    blank = method.startswith("NULL")
    return out.select("canonical_key", "year", F.when(~blank, F.round("area", 6)).alias("area"), method.alias("fill_method"), F.when(blank, "").otherwise(F.col("fill_source")).alias("fill_source"), F.round(F.when(blank, 0.0).otherwise(F.col("fill_confidence")), 4).alias("fill_confidence"))


def alias_filled(filled: DataFrame, registry: DataFrame, aliases: DataFrame, named_areas: DataFrame) -> DataFrame:
    """Unresolved years filled from the area that a documented alias of the key's name had then.

    aliases: name_norm, alias_norm.  named_areas: name_norm, year, area, canonical_key.
    """
    other = registry.select("canonical_key", "name_norm").join(aliases, "name_norm").select("canonical_key", "alias_norm")
    hits = other.join(named_areas.select(F.col("name_norm").alias("alias_norm"), "year", F.col("area").alias("alias_area"), F.col("canonical_key").alias("alias_ck")), "alias_norm").groupBy("canonical_key", "year").agg(F.min_by(F.struct("alias_area", "alias_ck"), "alias_ck").alias("hit"))
    fresh = (F.col("fill_method") == "NULL_UNRESOLVED") & F.col("hit").isNotNull()
    return filled.join(hits, ["canonical_key", "year"], "left").select("canonical_key", "year", F.when(fresh, F.col("hit.alias_area")).otherwise(F.col("area")).alias("area"), F.when(fresh, "ALIAS_RESOLVED").otherwise(F.col("fill_method")).alias("fill_method"), F.when(fresh, F.col("hit.alias_ck")).otherwise(F.col("fill_source")).alias("fill_source"), F.when(fresh, 0.75).otherwise(F.col("fill_confidence")).alias("fill_confidence"))


def fill_totals(filled: DataFrame) -> DataFrame:
    m = F.col("fill_method")
    return filled.groupBy("year").agg(F.count_if(m == "DIRECT").alias("n_direct"), F.count_if(m.isin("LINEAGE_BACKFILL", "DIRECT_PREDECESSOR")).alias("n_backfilled"), F.count_if(m.startswith("NULL")).alias("n_null"), F.round(F.sum("area"), 4).alias("total_area"))
