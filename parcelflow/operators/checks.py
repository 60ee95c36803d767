"""Checks as data: one row for each rule, with its severity, what was found and whether the run may go on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.config import Settings


def rule(name: str, severity: str, found: DataFrame, limit: float = 0.0) -> DataFrame:
    """found: one row with the column `value`; the rule holds if it is at most the limit."""
    return found.select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), F.lit(float(limit)).alias("limit")).withColumn("passed", F.col("value") <= F.col("limit"))


def all_rules(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def may_promote(checked: DataFrame) -> DataFrame:
    """One row: whether no rule of severity ERROR failed."""
    return checked.agg(F.coalesce(F.bool_and(F.col("passed") | (F.col("severity") != "ERROR")), F.lit(True)).alias("may_promote"), F.count_if(~F.col("passed")).alias("n_failed"))


def standard(closed: DataFrame, crossed: DataFrame, registry: DataFrame, normalised: DataFrame, backward: DataFrame, audited: DataFrame, events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The engine's own rules over a run's tables."""
    count = lambda d: d.agg(F.count("*").alias("value"))
    sums = normalised.groupBy("year_a", "obs_a").agg(F.sum("share").alias("s"))
    return all_rules(
        rule("closure of the matrix", "ERROR", count(closed.filter("is_violation"))),
        rule("rows of the normalised matrix sum to one", "ERROR", sums.agg(F.max(F.abs(F.col("s") - 1)).alias("value")), 1e-6),
        rule("keys are unique", "ERROR", registry.agg((F.count("*") - F.countDistinct("canonical_key")).alias("value"))),
        rule("edges lead forward", "ERROR", count(backward)),
        rule("no negative areas", "ERROR", count(audited.filter("residual_area < 0"))),
        rule("event ids are unique", "ERROR", events.agg((F.count("*") - F.countDistinct("event_id")).alias("value"))),
        rule("flows stay within shares", "WARN", count(crossed.filter(F.col("outflow_share") > settings.overclaim))),
    )


#: Rules for each vintage or window: severity, how a window's measures are put together, and their limit (none: only told).
WINDOW_RULES = (
    ("V1 features of a layer don't overlap", "ERROR", "sum", 0.001),
    ("V2 a layer covers the whole footprint", "WARN", "sum", 0.01),
    ("V3 what a unit became, lost and crumbled is its area", "ERROR", "max", 1e-6),
    ("V4 stored areas are those of the shapes", "ERROR", "max", 1e-4),
    ("V5 a second run gives the same keys", "ERROR", "sum", 0.0),
    ("V6 events and geometry are classed alike", "INFO", "mean", None),
    ("V7 shares of a unit sum to one", "ERROR", "max", 1e-9),
    ("V8 a measured change has one event", "ERROR", "sum", 0.0),
    ("V9 no lineage edge between units that both continue", "ERROR", "sum", 0.0),
)


def measured(assigned: DataFrame, layers: DataFrame, lost: DataFrame, keys: DataFrame, again: DataFrame, normalised: DataFrame, classes: DataFrame, accounted: DataFrame, identified: DataFrame, edges: DataFrame) -> DataFrame:
    """rule (its first two letters), year and value: what the rules of windows look at, a row for each thing that they measure.

    classes need the year `pre` of the event's window, `again` are the keys of a second run.  Years without anything to
    measure have no row.
    """
    row = lambda d, name, value, year="year": d.select(F.lit(name).alias("rule"), F.col(year).cast("int").alias("year"), value.cast("double").alias("value"))
    atoms = assigned.groupBy("year", "atom").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))
    total = atoms.groupBy("year").agg(F.sum(F.col("n") * F.col("weight")).alias("area"), F.sum((F.col("n") - 1) * F.col("weight")).alias("twice"), F.sum("weight").alias("covered"))
    footprint = assigned.select("atom", "weight").distinct().agg(F.sum("weight").alias("footprint"))
    covered = total.crossJoin(F.broadcast(footprint))  # one row
    drawn = assigned.groupBy("year", "unit").agg(F.sum("weight").alias("shape"))
    stored = layers.join(drawn, ["year", "unit"], "left")
    pair = keys.join(again.select("year", "obs", F.col("canonical_key").alias("other")), ["year", "obs"], "full_outer")
    held = keys.select("canonical_key", "year").distinct()
    stays = lambda k: held.select(F.col("canonical_key").alias(k), F.col("year").alias("year_a")).join(held.select(F.col("canonical_key").alias(k), F.col("year").alias("year_b")), k)
    both = edges.join(stays("from_ck"), ["from_ck", "year_a", "year_b"], "left_semi").join(stays("to_ck"), ["to_ck", "year_a", "year_b"], "left_semi").withColumn("both", F.lit(1))
    checked_edges = edges.select("year_a").distinct().withColumn("both", F.lit(0)).unionByName(both.select("year_a", "both"))
    known = classes.filter("spatial_class <> 'UNKNOWN'")
    joint = accounted.filter("measurement_status = 'MEASURED'").join(identified.select(F.col("canonical_key").alias("predecessor_ck"), F.col("pre").alias("pre_vintage"), F.col("post").alias("post_vintage"), "n_events"), ["predecessor_ck", "pre_vintage", "post_vintage"], "left")
    sums = normalised.groupBy("year_a", "obs_a").agg(F.sum("share").alias("s"))
    error = F.abs(F.col("transition") + F.col("lost") + F.col("sliver") - F.col("area"))
    one = lambda c: F.when(c, 1).otherwise(0)
    found = [
        row(total, "V1", F.col("twice") / F.col("area")),
        row(covered, "V2", 1 - F.col("covered") / F.col("footprint")),
        row(lost.filter("area > 0"), "V3", error / F.col("area")),
        row(stored.filter("area > 0"), "V4", F.abs(F.col("area") - F.coalesce("shape", F.lit(0))) / F.col("area")),
        row(pair, "V5", one(~F.col("canonical_key").eqNullSafe(F.col("other")))),
        row(known, "V6", one(F.col("administrative_class") != F.col("spatial_class")), "pre"),
        row(sums, "V7", F.abs(F.col("s") - 1), "year_a"),
        row(joint, "V8", one(~F.col("n_events").eqNullSafe(1)), "pre_vintage"),
        row(checked_edges, "V9", F.col("both"), "year_a"),
    ]
    return reduce(DataFrame.unionByName, found)


def by_window(measures: DataFrame, rules: tuple = WINDOW_RULES) -> DataFrame:
    """rule, year, severity, value, limit, passed: all rules over all windows in one pass over their measures."""
    known = F.array(*(F.struct(F.lit(n[:2]).alias("rule"), F.lit(n).alias("name"), F.lit(s).alias("severity"), F.lit(h).alias("how"), F.lit(m).cast("double").alias("limit")) for n, s, h, m in rules))
    per = measures.groupBy("rule", "year").agg(F.sum("value").alias("sum"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    of = per.withColumn("of", F.get(F.filter(known, lambda r: r["rule"] == F.col("rule")), F.lit(0)))
    value = F.when(F.col("of.how") == "sum", F.col("sum")).when(F.col("of.how") == "max", F.col("max")).otherwise(F.col("mean"))
    told = of.select(F.col("of.name").alias("rule"), "year", F.col("of.severity").alias("severity"), F.coalesce(value, F.lit(0.0)).alias("value"), F.col("of.limit").alias("limit"))
    return told.withColumn("passed", F.col("limit").isNull() | (F.col("value") <= F.col("limit")))


def recorded(checked: DataFrame, path: str, run: str) -> DataFrame:
    """The results of all runs kept in a folder, this one's with them; a run that is written again replaces its own."""
    spark = checked.sparkSession
    checked.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
    return spark.read.parquet(path)


def promoted(df: DataFrame, checked: DataFrame, path: str) -> None:
    """Writes df to a folder of published tables, unless a rule of severity ERROR failed."""
    failed = [f"{r.rule} ({r.year})" for r in checked.filter("not passed and severity = 'ERROR'").select("rule", "year").orderBy("year", "rule").limit(20).collect()]
    if failed:
        raise ValueError(f"not promoted: {', '.join(failed)}")
    df.write.mode("overwrite").parquet(path)
