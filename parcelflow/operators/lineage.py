"""Typed lineage between keys, its documents, and the area ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.config import Settings
from parcelflow.functions.text import stable_id
from parcelflow.sources.steps import settle


def crossing(transitions: DataFrame, registry: DataFrame) -> DataFrame:
    """Flows between different keys, marked as lineage where the target begins with them and as transfer elsewhere."""
    to = registry.select(F.col("canonical_key").alias("to_ck"), F.col("established_year").alias("to_established"))
    return transitions.filter("from_ck <> to_ck").join(to, "to_ck").withColumn("is_lineage", F.col("to_established") == F.col("year_b"))


def transfers(crossed: DataFrame) -> DataFrame:
    return crossed.filter("not is_lineage").select(stable_id(F.lit("TRANSFER"), F.col("from_ck"), F.col("to_ck"), F.col("year_a"), F.col("year_b")).alias("transfer_id"), "from_ck", "to_ck", "year_a", "year_b", F.col("area").alias("transferred_area"), "outflow_share", "inflow_share")


def typed(crossed: DataFrame, registry: DataFrame) -> DataFrame:
    """Lineage edges with their type, from how many of a target's predecessors end in the window."""
    closes = registry.select(F.col("canonical_key").alias("from_ck"), F.col("closed_year"))
    edges = crossed.filter("is_lineage").join(closes, "from_ck").withColumn("closes", F.coalesce(F.col("closed_year") == F.col("year_b"), F.lit(False)))
    ending = edges.groupBy("to_ck", "year_a", "year_b").agg(F.countDistinct(F.when(F.col("closes"), F.col("from_ck"))).alias("n_closing"))
    kind = F.when(~F.col("closes"), "FORMED_FROM").when(F.col("n_closing") >= 2, "MERGED_INTO").otherwise("SPLIT_FROM")
    return edges.join(ending, ["to_ck", "year_a", "year_b"]).withColumn("relationship_type", kind)


def corroborated(edges: DataFrame, registry: DataFrame, participants: DataFrame, events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The least event that names both sides near the window: with the state, else by names alone, else none.

    participants: event_id, role, name_norm, state_norm; registry has name_norm and state_norm too.
    """
    names = lambda side: registry.select(F.col("canonical_key").alias(f"{side}_ck"), F.col("name_norm").alias(f"{side}_name"), F.col("state_norm").alias(f"{side}_state"))
    own = edges.join(names("from"), "from_ck").join(names("to"), "to_ck")
    role = lambda r, name: participants.filter(F.col("role") == r).select("event_id", F.col("name_norm").alias(name), F.col("state_norm").alias(f"{name}_at"))
    both = role("PREDECESSOR", "from_name").join(role("SUCCESSOR", "to_name"), "event_id").join(events.select("event_id", F.col("effective_year").cast("int").alias("at")), "event_id")
    near = (F.col("at") >= F.col("year_a") - settings.corroboration_before) & (F.col("at") <= F.col("year_b") + settings.corroboration_after)
    key = ["from_ck", "to_ck", "year_a", "year_b"]
    hits = own.select(*key, "from_name", "to_name", "to_state").join(both, ["from_name", "to_name"]).filter(near)
    # the target's state stands for both sides
    strong = F.min(F.when((F.col("from_name_at") == F.col("to_state")) & (F.col("to_name_at") == F.col("to_state")), F.col("event_id")))
    found = hits.groupBy(*key).agg(strong.alias("strong"), F.min("event_id").alias("weak"))
    basis = F.when(F.col("strong").isNotNull(), "GAZETTE_CORROBORATED").when(F.col("weak").isNotNull(), "GAZETTE_CORROBORATED_WEAK").otherwise("SPATIAL_INFERRED")
    out = edges.join(found, key, "left").withColumns({"lineage_basis": basis, "supporting_event_id": F.coalesce("strong", "weak")}).drop("strong", "weak")
    conf = settings.confidence
    return out.withColumn("lineage_confidence", F.when(F.col("lineage_basis") == "GAZETTE_CORROBORATED", conf["GAZETTE_CORROBORATED"]).when(F.col("lineage_basis") == "GAZETTE_CORROBORATED_WEAK", conf["GAZETTE_CORROBORATED_WEAK"]).otherwise(conf["SPATIAL_INFERRED"]))


#: How often keys without edges on one side are peeled off; lineage is as deep as there are windows.
PEELED = 32


def backward_edges(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Edges into a key that began before their source: none in a sound graph."""
    side = lambda k: registry.select(F.col("canonical_key").alias(f"{k}_ck"), F.col("established_year").alias(f"{k}_year"))
    return edges.join(side("from"), "from_ck").join(side("to"), "to_ck").filter("to_year < from_year")


def cycles(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Keys that reach themselves, by however many edges.

    Keys that nothing leads to or from are on no cycle; they are peeled off first, up to PEELED times, and take their edges
    with them, so of a sound graph nothing is left.  Of what is left, pairs of keys that reach each other are joined with
    themselves until there are no new ones; the length covered doubles each time.
    """
    reach = settle(edges.select(F.col("from_ck").alias("start"), F.col("to_ck").alias("at")).dropna().distinct(), "reach")
    n = reach.count()
    for _ in range(PEELED):
        starts, ends = reach.select(F.col("start").alias("at")).distinct(), reach.select(F.col("at").alias("start")).distinct()
        reach = settle(reach.join(starts, "at", "left_semi").join(ends, "start", "left_semi").select("start", "at"), "reach")
        before, n = n, reach.count()
        if n in (0, before):
            break
    before, now = -1, reach.count()
    while now > before:
        step = reach.select(F.col("start").alias("at"), F.col("at").alias("next"))
        reach = settle(reach.union(reach.join(step, "at").select("start", "next")).distinct(), "reach")
        before, now = now, reach.count()
    return reach.filter("start = at").select(F.col("start").alias("canonical_key"))


def ledger(transitions: DataFrame, crossed: DataFrame, residual_a: DataFrame, residual_b: DataFrame, keys: DataFrame, registry: DataFrame) -> DataFrame:
    """Outbound rows of all sources and inbound rows of continuing targets that received something."""
    lineage = crossed.select("from_ck", "to_ck", "year_a", "year_b", "is_lineage")
    kinds = transitions.join(lineage, ["from_ck", "to_ck", "year_a", "year_b"], "left").withColumn("kind", F.when(F.col("from_ck") == F.col("to_ck"), "SELF").when(F.col("is_lineage"), "LINEAGE").otherwise("TRANSFER"))
    out = kinds.groupBy(F.col("from_ck").alias("canonical_key"), "year_a", "year_b").pivot("kind", ["SELF", "LINEAGE", "TRANSFER"]).agg(F.sum("area")).na.fill(0.0, ["SELF", "LINEAGE", "TRANSFER"])
    rest = residual_a.join(keys, ["year", "obs"]).select("canonical_key", F.col("year").alias("year_a"), "area", "lost", "sliver")
    total: Column = F.col("SELF") + F.col("LINEAGE") + F.col("TRANSFER") + F.col("lost") + F.col("sliver")
    outbound = rest.join(out, ["canonical_key", "year_a"], "left").na.fill(0.0, ["SELF", "LINEAGE", "TRANSFER"]).select(
        F.lit("OUTBOUND").alias("entry"), "canonical_key", "year_a", F.col("area").alias("area"), F.col("SELF").alias("retained"), F.col("LINEAGE").alias("to_lineage"), F.col("TRANSFER").alias("to_transfer"), "lost", "sliver", F.abs(total - F.col("area")).alias("closure_error"),
    )
    new = registry.select(F.col("canonical_key"), F.col("established_year").alias("year_b"))
    got = kinds.filter("kind = 'TRANSFER'").groupBy(F.col("to_ck").alias("canonical_key"), "year_a", "year_b").agg(F.sum("area").alias("received")).filter("received > 0").join(new, ["canonical_key", "year_b"], "left_anti")
    gained = residual_b.join(keys, ["year", "obs"]).select("canonical_key", F.col("year").alias("year_b"), "area", "gained")
    inbound = got.join(gained, ["canonical_key", "year_b"]).select(F.lit("INBOUND").alias("entry"), "canonical_key", "year_a", "area", "received", "gained")
    return outbound.unionByName(inbound, allowMissingColumns=True)
