"""Administrative events: their grain, participants, names and measured areas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions.numbers import bracket
from parcelflow.functions.text import normalize_name, parse_multi_name, stable_id


def events(raw: DataFrame) -> DataFrame:
    """Raw rows (event_type, parent_district, child_district, state, effective_year, source) at the grain of events."""
    key = ["event_type", "parent_district", "state", "effective_year"]
    plain = raw.filter("event_type in ('SPLIT', 'NEW_DISTRICT')").groupBy(*key).agg(F.array_sort(F.collect_set("child_district")).alias("children"), F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n_csv_rows"))
    own = plain.withColumn("event_id", stable_id(F.lit("EVENT"), *(F.col(k) for k in key)))
    renamed = raw.filter("event_type = 'RENAME'").select(*key, F.array_compact(F.array("child_district")).alias("children"), F.array_compact(F.array("source")).alias("sources"), F.lit(1).cast("long").alias("n_csv_rows"), stable_id(F.lit("EVENT"), *(F.col(k) for k in ("event_type", "parent_district", "child_district", "state", "effective_year"))).alias("event_id"))
    parents = parse_multi_name(F.col("parent_district"))
    return own.unionByName(renamed).withColumn("parents", F.when(F.col("event_type") == "RENAME", F.array_compact(F.array("parent_district"))).otherwise(parents)).select(
        "event_id", "event_type", "state", "parent_district", F.col("effective_year").cast("int").alias("effective_year"), "parents", "children", F.size("parents").alias("n_predecessors"), F.size("children").alias("n_successors"), F.concat_ws(";", "sources").alias("sources_cited"), "n_csv_rows",
    )


def duplicate_ids(found: DataFrame) -> DataFrame:
    """Ids that more than one event has; the caller stops if there are any."""
    return found.groupBy("event_id").agg(F.count("*").alias("n")).filter("n > 1")


def participants(found: DataFrame) -> DataFrame:
    role = lambda r, c: found.select("event_id", F.lit(r).alias("role"), F.explode(c).alias("district_name_raw"), "state")
    return role("PREDECESSOR", "parents").unionByName(role("SUCCESSOR", "children"))


def lost_children(raw: DataFrame, parts: DataFrame) -> DataFrame:
    """Children of the raw rows that no event has as a successor."""
    return raw.select(F.col("child_district").alias("district_name_raw")).filter("district_name_raw is not null").distinct().join(parts.filter("role = 'SUCCESSOR'").select("district_name_raw").distinct(), "district_name_raw", "left_anti")


def name_index(layers: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys by (vintage, state, name), the last of equal names, and by (vintage, name) where only one key has it."""
    named = layers.join(keys, ["year", "obs"]).select(F.col("year").alias("vintage"), normalize_name(F.col("state")).alias("state_norm"), normalize_name(F.col("unit")).alias("name_norm"), "canonical_key", "ordinal")
    by_state = named.groupBy("vintage", "state_norm", "name_norm").agg(F.max_by("canonical_key", "ordinal").alias("state_ck"))
    by_name = named.groupBy("vintage", "name_norm").agg(F.min("canonical_key").alias("name_ck"), F.countDistinct("canonical_key").alias("n")).filter("n = 1").drop("n")
    return by_state, by_name


def resolve(parts: DataFrame, by_state: DataFrame, by_name: DataFrame) -> DataFrame:
    """parts (with vintage, district_name_raw, state) with canonical_key and match_method."""
    own = parts.withColumns({"name_norm": normalize_name(F.col("district_name_raw")), "state_norm": normalize_name(F.col("state"))})
    both = own.join(by_state, ["vintage", "state_norm", "name_norm"], "left").join(by_name, ["vintage", "name_norm"], "left")
    method = F.when(F.col("vintage").isNull(), "NO_VINTAGE").when(F.col("state_ck").isNotNull(), "STATE_SCOPED").when(F.col("name_ck").isNotNull(), "NAME_ONLY").otherwise("UNRESOLVED")
    return both.withColumns({"canonical_key": F.coalesce("state_ck", "name_ck"), "match_method": method}).drop("state_ck", "name_ck")


def resolved(found: DataFrame, parts: DataFrame, by_state: DataFrame, by_name: DataFrame, vintages: Iterable[int], at_event: bool = False) -> DataFrame:
    """Participants with the keys that they have at their side's vintage; at_event: the event's year stands in for a missing one."""
    pre, post = bracket(F.col("effective_year"), vintages)
    dated = found.select("event_id", "event_type", "effective_year", pre.alias("pre"), post.alias("post"))
    side = F.when(F.col("role") == "PREDECESSOR", F.col("pre")).otherwise(F.col("post"))
    own = parts.join(dated, "event_id").withColumn("vintage", F.coalesce(side, F.col("effective_year")) if at_event else side)
    return resolve(own, by_state, by_name)


def accounting(found: DataFrame, named: DataFrame, matrix: DataFrame, keys: DataFrame, vintages: Iterable[int]) -> DataFrame:
    """Areas of the pairs of an event's resolved participants, and why there are none for the other events."""
    pre, post = bracket(F.col("effective_year"), vintages)
    own = found.select("event_id", "event_type", "effective_year", pre.alias("pre_vintage"), post.alias("post_vintage"))
    counts = named.groupBy("event_id").agg(F.count("*").alias("n_total"), F.count("canonical_key").alias("n_resolved"))
    side = lambda r, n: named.filter((F.col("role") == r) & F.col("canonical_key").isNotNull()).select("event_id", F.col("district_name_raw").alias(n), F.col("canonical_key").alias(f"{n}_ck"), F.col("match_method").alias(f"{n}_match_method"))
    pairs = own.filter("pre_vintage is not null and post_vintage is not null").join(side("PREDECESSOR", "predecessor"), "event_id").join(side("SUCCESSOR", "successor"), "event_id")
    flow = between_keys(matrix, keys)
    measured = pairs.join(flow, (F.col("pre_vintage") == F.col("year_a")) & (F.col("post_vintage") == F.col("year_b")) & (F.col("predecessor_ck") == F.col("from_ck")) & (F.col("successor_ck") == F.col("to_ck")), "left")
    pair_status = F.when(F.col("flow_area") > 0, "MEASURED").otherwise("RESOLVED_NO_OVERLAP")
    status = F.when(F.col("n_resolved") < F.col("n_total"), "PARTIALLY_RESOLVED").otherwise(pair_status)
    columns = ["event_id", "event_type", "effective_year", "pre_vintage", "post_vintage", "predecessor", "successor", "predecessor_ck", "successor_ck", "predecessor_match_method", "successor_match_method"]
    rows = measured.join(counts, "event_id").select(*columns, F.round("flow_area", 4).alias("transferred_area"), status.alias("measurement_status"))
    without = own.join(rows.select("event_id").distinct(), "event_id", "left_anti").join(counts, "event_id", "left")
    listed = lambda r, n: named.filter(F.col("role") == r).groupBy("event_id").agg(F.concat_ws("; ", F.array_sort(F.collect_list("district_name_raw"))).alias(n))
    open_ = F.col("pre_vintage").isNull() | F.col("post_vintage").isNull()
    why = F.when(open_, "NO_BRACKETING_VINTAGE").when(F.coalesce("n_resolved", F.lit(0)) == 0, "UNRESOLVED_NAME").when(F.col("n_resolved") < F.col("n_total"), "PARTIALLY_RESOLVED").otherwise("UNRESOLVED_NAME")
    other = without.join(listed("PREDECESSOR", "predecessor"), "event_id", "left").join(listed("SUCCESSOR", "successor"), "event_id", "left")
    other = other.select("event_id", "event_type", "effective_year", "pre_vintage", "post_vintage", F.when(~open_, F.col("predecessor")).alias("predecessor"), F.when(~open_, F.col("successor")).alias("successor"), why.alias("measurement_status"))
    return rows.unionByName(other, allowMissingColumns=True)


def between_keys(matrix: DataFrame, keys: DataFrame) -> DataFrame:
    side = lambda k, n: keys.select(F.col("obs").alias(f"obs_{k}"), F.col("canonical_key").alias(n))
    return matrix.join(side("a", "from_ck"), "obs_a").join(side("b", "to_ck"), "obs_b").groupBy("year_a", "year_b", "from_ck", "to_ck").agg(F.sum("area").alias("flow_area"))


def identifiability(found: DataFrame, named: DataFrame) -> DataFrame:
    """How many events touch a key in a window: none, one (its change is attributable) or several."""
    own = named.filter("canonical_key is not null").join(found.select("event_id"), "event_id").select("canonical_key", "pre", "post", "event_id").distinct()
    n = own.groupBy("canonical_key", "pre", "post").agg(F.countDistinct("event_id").alias("n_events"))
    return n.withColumn("identifiability", F.when(F.col("n_events") == 1, "ATTRIBUTABLE").otherwise("JOINT"))


def keep_last(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The union of both with one row for each key: the newest run's, and of a run the last in its order."""
    both = old.withColumn("__run", F.lit(0)).unionByName(new.withColumn("__run", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "__run")]
    last = Window.partitionBy(*key).orderBy(F.col("__run").desc(), *(F.col(c).desc_nulls_last() for c in rest))
    return both.withColumn("__place", F.row_number().over(last)).filter("__place = 1").drop("__place", "__run")
