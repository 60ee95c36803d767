"""Event-level conservation: classes, contributions, residuals, recovery and status.

named: participants with event_id, role, canonical_key, pre, post.  flow: year_a, year_b, from_ck, to_ck, flow_area.
areas: canonical_key, year, area.  registry: canonical_key, established_year, closed_year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.config import Settings
from parcelflow.functions.numbers import ratio


def sides(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct resolved predecessors and successors of every event."""
    own = named.filter("canonical_key is not null")
    side = lambda r, n: own.filter(F.col("role") == r).groupBy("event_id", F.col("canonical_key").alias(n)).agg(F.min("pre").alias("pre"), F.min("post").alias("post"), F.min("district_name_raw").alias(f"{n}_name"), F.min("match_method").alias(f"{n}_method"))
    return side("PREDECESSOR", "pred_ck"), side("SUCCESSOR", "succ_ck").drop("pre", "post")


def administrative_class(event_type: Column, n_pred: Column, n_succ: Column) -> Column:
    kind = F.upper(event_type)
    split = F.when(n_succ == 3, "TRIFURCATION").when(n_succ > 3, "MULTIWAY_SPLIT").otherwise("SPLIT")
    return F.when(kind == "RENAME", "RENAME").when(kind == "SPLIT", split).when(kind == "NEW_DISTRICT", F.when(n_pred > 1, "REORGANISATION").otherwise("CARVE_OUT")).when(kind.isin("MERGE", "MERGER"), "MERGER").otherwise("UNKNOWN")


def classes(events: DataFrame, named: DataFrame, registry: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """event_id with both classes: what the documents call it and what the keys did."""
    pred, succ = sides(named)
    known = registry.select("canonical_key", "established_year", "closed_year")
    p = pred.join(known.select(F.col("canonical_key").alias("pred_ck"), "closed_year"), "pred_ck", "left").groupBy("event_id").agg(
        F.collect_set("pred_ck").alias("preds"), F.count("*").alias("n_pred"), F.count_if(F.col("closed_year") == F.col("post")).alias("n_closes"), F.min("pre").alias("pre"), F.min("post").alias("post")
    )
    dated = named.groupBy("event_id").agg(F.min("post").alias("post_"))
    s = succ.join(known.select(F.col("canonical_key").alias("succ_ck"), "established_year"), "succ_ck", "left").join(dated, "event_id").groupBy("event_id").agg(
        F.collect_set("succ_ck").alias("succs"), F.count("*").alias("n_succ"), F.count_if(F.col("established_year") == F.col("post_")).alias("n_new")
    )
    both = events.select("event_id", "event_type").join(p, "event_id", "left").join(s, "event_id", "left").na.fill(0, ["n_pred", "n_succ", "n_closes", "n_new"])
    stays = F.col("n_pred") - F.col("n_closes")
    shared = F.size(F.array_intersect("preds", "succs"))
    renamed = shared == (F.greatest("n_pred", "n_succ") if settings.strict_rename else F.least("n_pred", "n_succ"))
    spatial = (
        F.when((F.col("n_pred") == 0) | (F.col("n_succ") == 0) | F.col("pre").isNull() | F.col("post").isNull(), "UNKNOWN")
        .when(renamed, "RENAME_NO_MATERIAL_CHANGE")
        .when((F.col("n_closes") == 1) & (F.col("n_pred") == 1) & (F.col("n_new") > 0), F.when(F.col("n_succ") == 1, "CLEAN_SPLIT_SINGLE").otherwise(F.concat(F.lit("CLEAN_SPLIT_"), F.col("n_succ"), F.lit("_WAY"))))
        .when((stays > 0) & (F.col("n_new") > 0), F.when(F.col("n_pred") == 1, "CARVE_OUT").otherwise("MULTI_PARENT_CARVE_OUT"))
        .when((F.col("n_closes") >= 2) & (F.col("n_succ") == 1) & (F.col("n_new") > 0), "MERGER")
        .when((stays > 0) & (F.col("n_succ") > F.col("n_new")), "TERRITORIAL_TRANSFER_CONTINUING")
        .otherwise("COMPLEX_REORGANISATION")
    )
    return both.select("event_id", "event_type", "n_pred", "n_succ", administrative_class(F.col("event_type"), F.col("n_pred"), F.col("n_succ")).alias("administrative_class"), spatial.alias("spatial_class"))


def contributions(named: DataFrame, flow: DataFrame, areas: DataFrame) -> DataFrame:
    """Measured area of every pair of an event's distinct predecessors and successors, with its shares of both."""
    pred, succ = sides(named)
    at = lambda n, y, a: areas.select(F.col("canonical_key").alias(n), F.col("year").alias(y), F.col("area").alias(a))
    pairs = pred.join(succ, "event_id").filter("pre is not null and post is not null").join(at("pred_ck", "pre", "source_area"), ["pred_ck", "pre"], "left").join(at("succ_ck", "post", "target_area"), ["succ_ck", "post"], "left")
    moved = flow.select(F.col("year_a").alias("pre"), F.col("year_b").alias("post"), F.col("from_ck").alias("pred_ck"), F.col("to_ck").alias("succ_ck"), "flow_area")
    area = F.coalesce("flow_area", F.lit(0.0))
    return pairs.join(moved, ["pre", "post", "pred_ck", "succ_ck"], "left").select(
        "event_id", "pred_ck", "succ_ck", "pre", "post", F.coalesce("source_area", F.lit(0.0)).alias("source_area"), F.coalesce("target_area", F.lit(0.0)).alias("target_area"), area.alias("area"),
        (ratio(area, F.col("source_area"), 0.0) * 100).alias("pct_of_source"), (ratio(area, F.col("target_area"), 0.0) * 100).alias("pct_of_target"), "pred_ck_name", "succ_ck_name", "pred_ck_method", "succ_ck_method",
    )


def transfer_rows(contributed: DataFrame) -> DataFrame:
    same = F.col("pred_ck") == F.col("succ_ck")
    sure = (F.col("pred_ck_method") == "STATE_SCOPED") & (F.col("succ_ck_method") == "STATE_SCOPED")
    return contributed.select("event_id", "pred_ck", "succ_ck", "pre", "post", "area", F.when(same, "RETAINED").otherwise("CARVED_OUT").alias("transfer_type"), F.lit(None).cast("double").alias("declared_transfer"), F.when(sure, 0.95).otherwise(0.70).alias("confidence"))


def conservation(contributed: DataFrame) -> DataFrame:
    """Per event and predecessor: what its area is, what successors account for, and what is left."""
    own = contributed.groupBy("event_id", "pred_ck", "pre", "post").agg(F.max("source_area").alias("source_area"), F.sum("area").alias("accounted_area"))
    left = F.greatest(F.col("source_area") - F.col("accounted_area"), F.lit(0.0))
    return own.withColumns({"residual_area": left, "residual_pct": ratio(left, F.col("source_area"), 0.0) * 100})


def recovered(kept: DataFrame, contributed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Status, reason and best candidate of every residual: within tolerance, recovered by a successor, or open."""
    w = settings.recovery_weights
    # successors count as adjacent, parental and named, with half a boundary; what tells them apart is the area
    fits = F.when(F.col("target_area") > 0, F.least(F.lit(1.0), F.col("residual_area") / F.col("target_area"))).otherwise(0.0)
    score = F.lit(w["adjacency"] + w["parent"] + 0.5 * w["boundary"] + w["event"]) + w["area"] * fits
    cands = kept.join(contributed.select("event_id", "pred_ck", "succ_ck", "target_area"), ["event_id", "pred_ck"]).withColumn("score", score)
    order = Window.partitionBy("event_id", "pred_ck").orderBy(F.col("score").desc(), "succ_ck")
    best = cands.withColumn("place", F.row_number().over(order)).filter("place = 1").select("event_id", "pred_ck", F.col("succ_ck").alias("candidate_ck"), F.col("score").alias("candidate_score"))
    small = (F.col("source_area") > 0) & (F.col("residual_pct") < settings.residual_pct)
    absent = F.col("source_area") <= 0
    good = F.col("candidate_score") >= settings.recovery_threshold
    status = F.when(small, "IGNORABLE_RESIDUAL").when(absent, "UNRESOLVED_RESIDUAL").when(good, "RECOVERED_BY_ADJACENCY").otherwise("UNRESOLVED_RESIDUAL")
    reason = F.when(small, "BOUNDARY_PRECISION").when(absent, "MISSING_DISTRICT_GEOMETRY").when(F.col("candidate_ck").isNotNull(), "ADJACENT_DISTRICT_CANDIDATE").otherwise("UNRECOVERED_GEOMETRIC_RESIDUAL")
    out = kept.join(best, ["event_id", "pred_ck"], "left").withColumns({"accounting_status": status, "residual_reason": reason})
    none = small | absent
    return out.withColumns({"candidate_ck": F.when(~none, F.col("candidate_ck")), "candidate_score": F.when(none, 0.0).otherwise(F.coalesce("candidate_score", F.lit(0.0)))})


def event_status(events: DataFrame, audited: DataFrame) -> DataFrame:
    s = F.col("accounting_status")
    own = audited.groupBy("event_id").agg(F.bool_and(s.isin("IGNORABLE_RESIDUAL", "MEASURED")).alias("fine"), F.bool_or(s == "UNRESOLVED_RESIDUAL").alias("open"), F.bool_or(s == "RECOVERED_BY_ADJACENCY").alias("found"), F.sum("source_area").alias("source_area"), F.sum("accounted_area").alias("accounted_area"), F.sum("residual_area").alias("residual_area"), F.count("*").alias("n_rows"))
    status = F.when(F.col("fine").isNull(), "NO_GEOMETRY").when(F.col("fine"), "RECONCILED").when(F.col("open"), "UNRESOLVED").when(F.col("found"), "RECOVERED").otherwise("PARTIALLY_RESOLVED")
    return events.select("event_id", "event_type", "effective_year").join(own, "event_id", "left").withColumn("event_status", status).drop("fine", "open", "found").na.fill(0, ["n_rows"]).na.fill(0.0, ["source_area", "accounted_area", "residual_area"])


def event_summary(status: DataFrame, named: DataFrame) -> DataFrame:
    """Event status with its participants' names, sorted and joined by bars."""
    listed = lambda r, n: named.filter(F.col("role") == r).groupBy("event_id").agg(F.concat_ws(" | ", F.array_sort(F.collect_set("district_name_raw"))).alias(n))
    return status.join(listed("PREDECESSOR", "predecessors"), "event_id", "left").join(listed("SUCCESSOR", "successors"), "event_id", "left").na.fill("", ["predecessors", "successors"])


def quality_counters(audited: DataFrame, status: DataFrame, classified: DataFrame) -> DataFrame:
    """name and value of the run's counters; the first three count predecessor rows, the others events."""
    s = F.col("accounting_status")
    rows = audited.agg(F.count_if(s == "IGNORABLE_RESIDUAL").alias("within_tolerance"), F.count_if(s == "RECOVERED_BY_ADJACENCY").alias("recovered"), F.count_if(s == "UNRESOLVED_RESIDUAL").alias("unresolved"), F.count_if(F.col("residual_area") < 0).alias("negative_areas"))
    events = status.agg(F.count("*").alias("events"), F.count_if(F.col("event_status") == "RECONCILED").alias("events_reconciled"), F.count_if(F.col("event_status") == "NO_GEOMETRY").alias("events_without_geometry"))
    labels = classified.agg(F.count_if((F.col("spatial_class") != "UNKNOWN") & (F.col("administrative_class") != F.col("spatial_class"))).alias("labels_differ"))
    wide = rows.join(events).join(labels)  # one row each
    return wide.unpivot([], wide.columns, "name", "value")


def narrative(summary: DataFrame) -> DataFrame:
    """One sentence for each event, for reports."""
    return summary.select("event_id", F.format_string("%s in %d: %s became %s; %.2f of %.2f accounted for, %.2f left (%s).", "event_type", F.col("effective_year"), F.when(F.col("predecessors") == "", "unknown").otherwise(F.col("predecessors")), F.when(F.col("successors") == "", "unknown").otherwise(F.col("successors")), "accounted_area", "source_area", "residual_area", "event_status").alias("narrative"))


def top_residuals(audited: DataFrame, n: int = 20) -> DataFrame:
    return audited.orderBy(F.col("residual_area").desc(), "event_id", "pred_ck").limit(n)


def events_by(status: DataFrame, events: DataFrame, by: str, wanted: str = "UNRESOLVED", n: int | None = 5) -> DataFrame:
    """The n values of a column of events (all, if n is None), such as state or year, with most events of a status; ties go to the least."""
    chosen = status.filter(F.col("event_status") == wanted).select("event_id").join(events.select("event_id", by), "event_id")
    counts = chosen.groupBy(by).agg(F.count("*").alias("n_events"))
    return counts if n is None else counts.orderBy(F.desc("n_events"), by).limit(n)


def reason_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("accounting_status", "residual_reason").agg(F.count("*").alias("n"), F.sum("residual_area").alias("residual_area"))
