"""Successors beyond the documents: aliases, other states, and overlaps, then one ladder of decisions.

Evidence of all levels is joined to every open residual; the ladder is one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.config import Settings
from parcelflow.functions.numbers import ratio
from parcelflow.functions.text import name_similarity, normalize_name


def resolve_at(frame: DataFrame, by_state: DataFrame, by_name: DataFrame, name: str, state: str, out: str) -> DataFrame:
    """frame with the key that (name, state) has at its post vintage, else the only one that the name has."""
    s = by_state.select(F.col("vintage").alias("post"), F.col("state_norm").alias(state), F.col("name_norm").alias(name), F.col("state_ck").alias("__s"))
    n = by_name.select(F.col("vintage").alias("post"), F.col("name_norm").alias(name), F.col("name_ck").alias("__n"))
    return frame.join(s, ["post", state, name], "left").join(n, ["post", name], "left").withColumn(out, F.coalesce("__s", "__n")).drop("__s", "__n")


def alias_hits(open_rows: DataFrame, registry_aliases: DataFrame, manual_aliases: DataFrame, by_state: DataFrame, by_name: DataFrame) -> DataFrame:
    """Level 1: event_id, pred_ck, l1_ck and its evidence; approved aliases go before the manual table.

    Aliases: raw_name, from_state, canonical_name, to_state, alias_type, evidence_type, provenance (and approval_status).
    """
    def named(a: DataFrame, rank: int) -> DataFrame:
        return a.select(normalize_name(F.col("raw_name")).alias("name_norm"), normalize_name(F.col("from_state")).alias("state_norm"), normalize_name(F.col("canonical_name")).alias("t_name"), normalize_name(F.col("to_state")).alias("t_state"), "alias_type", "evidence_type", "provenance", F.lit(rank).alias("rank"))

    approved = registry_aliases.filter("approval_status = 'APPROVED'").withColumns({"alias_type": F.lit("HISTORICAL_NAME"), "evidence_type": F.lit("EXISTING_REGISTRY"), "provenance": F.lit("approved_alias_registry")})
    aliases = named(approved, 1).unionByName(named(manual_aliases, 2))
    found = resolve_at(open_rows.join(aliases, ["name_norm", "state_norm"]), by_state, by_name, "t_name", "t_state", "l1_ck").filter("l1_ck is not null")
    order = Window.partitionBy("event_id", "pred_ck").orderBy("rank", "t_name", "t_state")
    return found.withColumn("place", F.row_number().over(order)).filter("place = 1").select("event_id", "pred_ck", "l1_ck", "alias_type", "evidence_type", "provenance")


def cross_state_hits(open_rows: DataFrame, layers_keys: DataFrame, by_state: DataFrame, by_name: DataFrame, successors: DataFrame, manual_aliases: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Level 2: the name at the post vintage whatever its state; of several, a successor state's, in the table's order.

    layers_keys: vintage, state_norm, name_norm, canonical_key.  successors: state_norm, succ_state, place.
    """
    named = layers_keys.groupBy(F.col("vintage").alias("post"), "name_norm").agg(F.min("canonical_key").alias("any_ck"), F.countDistinct("canonical_key").alias("n"))
    own = open_rows.join(named, ["post", "name_norm"], "left")
    mapped = own.join(successors, "state_norm").join(by_state.select(F.col("vintage").alias("post"), F.col("state_norm").alias("succ_state"), "name_norm", "state_ck"), ["post", "succ_state", "name_norm"])
    order = Window.partitionBy("event_id", "pred_ck").orderBy("place")
    first = mapped.withColumn("p", F.row_number().over(order)).filter("p = 1").select("event_id", "pred_ck", F.col("state_ck").alias("mapped_ck"))
    a = manual_aliases.select(normalize_name(F.col("raw_name")).alias("name_norm"), normalize_name(F.col("canonical_name")).alias("t_name"), normalize_name(F.col("to_state")).alias("t_state"))
    other = resolve_at(open_rows.join(a, "name_norm"), by_state, by_name, "t_name", "t_state", "alias_ck").filter("alias_ck is not null").groupBy("event_id", "pred_ck").agg(F.min("alias_ck").alias("alias_ck"))
    both = own.join(first, ["event_id", "pred_ck"], "left").join(other, ["event_id", "pred_ck"], "left")
    hit = F.when(F.col("n") == 1, F.col("any_ck")).when(F.col("n") > 1, F.coalesce("mapped_ck", "any_ck")).otherwise(F.col("alias_ck"))
    why = F.when(F.col("n") == 1, "NAME_ONLY").when((F.col("n") > 1) & F.col("mapped_ck").isNotNull(), "STATE_SUCCESSOR").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("alias_ck").isNotNull(), "ALIAS").otherwise("EVENT_SUCCESSOR_NOT_RESOLVED")
    if not settings.cross_state:
        hit, why = F.lit(None).cast("string"), F.lit("CROSS_STATE_DISABLED")
    return both.select("event_id", "pred_ck", hit.alias("l2_ck"), why.alias("l2_reason"))


def overlap_candidates(open_rows: DataFrame, overlaps: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Level 3: units of the post vintage that cover enough of an open predecessor.

    overlaps: pre, post, pred_ck, cand_ck, area, cand_area, boundary, distance.
    """
    pct = ratio(F.col("area"), F.col("source_area"), 0.0) * 100
    return open_rows.join(overlaps, ["pre", "post", "pred_ck"]).withColumn("pct_pre", pct).withColumn("pct_cand", ratio(F.col("area"), F.col("cand_area"), 0.0) * 100).filter((F.col("area") >= settings.discovery_min_area) & (F.col("pct_pre") >= settings.discovery_min_pct))


def scored(cands: DataFrame, declared: DataFrame, relations: DataFrame, units: DataFrame, successors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Candidates with spatial, administrative and combined scores, rank and status.

    declared: event_id, succ_ck, succ_name.  relations: parent_ck, child_ck.  units: canonical_key, name_norm, state_norm,
    established_year.
    """
    of = Window.partitionBy("event_id", "pred_ck")
    top = lambda c: F.max(c).over(of)
    guarded = lambda c: F.when(top(c) > 0, F.col(c) / top(c)).otherwise(0.0)
    own = cands.join(units.select(F.col("canonical_key").alias("cand_ck"), F.col("name_norm").alias("cand_name"), F.col("state_norm").alias("cand_state"), "established_year"), "cand_ck", "left")
    own = own.join(declared.select("event_id", F.col("succ_ck").alias("cand_ck")).distinct().withColumn("declared", F.lit(True)), ["event_id", "cand_ck"], "left")
    own = own.join(relations.select(F.col("parent_ck").alias("pred_ck"), F.col("child_ck").alias("cand_ck")).distinct().withColumn("related", F.lit(True)), ["pred_ck", "cand_ck"], "left")
    near = successors.select("state_norm", F.col("succ_state").alias("cand_state")).distinct().withColumn("compatible", F.lit(True))
    own = own.join(near, ["state_norm", "cand_state"], "left").na.fill(False, ["declared", "related", "compatible"])
    names = declared.groupBy("event_id").agg(F.collect_set("succ_name").alias("names"))
    rows = own.join(names, "event_id", "left").withColumn("said", F.explode_outer(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array("name_norm"))))
    sim = rows.withColumn("s", name_similarity(F.coalesce("said", F.lit("")), F.coalesce("cand_name", F.lit("")))).groupBy("event_id", "pred_ck", "cand_ck").agg(F.max("s").alias("name_similarity"))
    own = own.join(sim, ["event_id", "pred_ck", "cand_ck"])
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    parts: dict[str, Column] = {
        "area": guarded("area"), "pct_pre": F.least(F.lit(1.0), F.col("pct_pre") / 100), "pct_cand": F.least(F.lit(1.0), F.col("pct_cand") / 100), "boundary": guarded("boundary"),
        "adjacent": flag(F.col("boundary") > 0), "year": flag(F.coalesce("established_year", F.lit(0)) <= F.col("post")), "parent_child": flag(F.col("related")),
        "state": F.when((F.col("cand_state") == F.col("state_norm")) | F.col("compatible"), 1.0).otherwise(0.5), "name": F.col("name_similarity"), "declared": flag(F.col("declared")),
    }
    close = 1 - F.when(top("distance") > 0, F.col("distance") / top("distance")).otherwise(0.0)
    spatial = 0.30 * parts["pct_pre"] + 0.25 * parts["area"] + 0.20 * parts["pct_cand"] + 0.15 * parts["boundary"] + 0.05 * parts["adjacent"] + 0.05 * close
    admin = 0.30 * parts["declared"] + 0.20 * parts["parent_child"] + 0.20 * parts["name"] + 0.15 * parts["state"] + 0.15 * parts["year"]
    total = sum((settings.candidate_weights[k] * c for k, c in parts.items()), F.lit(0.0))
    out = own.withColumns({"spatial_confidence": F.round(spatial, 6), "administrative_confidence": F.round(admin, 6), "candidate_score": F.round(total, 6)})
    out = out.withColumn("spatial_rank", F.row_number().over(of.orderBy(F.col("candidate_score").desc(), "cand_ck")))
    return out.withColumn("candidate_status", candidate_status(F.col("declared"), F.col("candidate_score"), settings))


def candidate_status(declared: Column, score: Column, settings: Settings = Settings()) -> Column:
    return (
        F.when(declared & (score >= settings.discovery_threshold), "CONFIRMED_ADMINISTRATIVE_SUCCESSOR")
        .when(score >= settings.confirm_threshold, "SPATIALLY_CONFIRMED_BUT_EVENT_UNLISTED")
        .when(score >= settings.possible_threshold, "POSSIBLE_SPATIAL_SUCCESSOR")
        .otherwise("NO_VALID_SPATIAL_SUCCESSOR")
    )


def decide(open_rows: DataFrame, l1: DataFrame, l2: DataFrame, cands: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each open residual: status, reason, level, chosen key and what is left.

    open_rows: event_id, pred_ck, effective_year, pre, post, source_area, residual_area, residual_pct, has_geometry.
    """
    t, tol = settings.discovery_threshold, settings.residual_pct
    best = F.min_by(F.struct("cand_ck", "candidate_score", "candidate_status", "spatial_confidence", "administrative_confidence", "declared"), "spatial_rank")
    child = F.min_by(F.struct("cand_ck", "candidate_score", "spatial_confidence", "administrative_confidence"), F.when(F.col("related") & (F.col("candidate_score") >= t), F.col("spatial_rank")))
    per = cands.groupBy("event_id", "pred_ck").agg(best.alias("best"), child.alias("child"), F.sum("area").alias("discovered"), F.count("*").alias("n_candidates"), F.bool_or("declared").alias("__any"))
    declared_any = open_rows.select("event_id", "pred_ck", "n_declared")
    rows = open_rows.drop("n_declared").join(declared_any, ["event_id", "pred_ck"]).join(l1.select("event_id", "pred_ck", "l1_ck"), ["event_id", "pred_ck"], "left").join(l2.select("event_id", "pred_ck", "l2_ck"), ["event_id", "pred_ck"], "left").join(per, ["event_id", "pred_ck"], "left")
    open_pct = F.greatest(F.lit(0.0), F.when(F.col("source_area") > 0, (F.col("residual_area") - F.col("discovered")) / F.col("source_area") * 100).otherwise(F.col("residual_pct")))
    by_name = F.col("l1_ck").isNotNull() | F.col("l2_ck").isNotNull()
    blind = ~F.col("has_geometry") | F.col("pre").isNull() | F.col("post").isNull()
    none = F.col("n_candidates").isNull()
    recent = F.col("effective_year") >= settings.latest_vintage - settings.recent_gap_years
    b = F.col("best")
    mismatch = (F.col("n_declared") > 0) & ~b["declared"] & b["candidate_status"].isin("CONFIRMED_ADMINISTRATIVE_SUCCESSOR", "SPATIALLY_CONFIRMED_BUT_EVENT_UNLISTED") & (b["administrative_confidence"] < 0.5)
    strong = b["candidate_score"] >= t
    small = open_pct < tol
    child_ok = F.col("child").isNotNull() & F.col("child.cand_ck").isNotNull() & small
    ladder = [
        (F.col("l1_ck").isNotNull(), "RECONCILED_BY_ALIAS", "ALIAS_RESOLUTION", 1),
        (F.col("l2_ck").isNotNull(), "RECONCILED_BY_CROSS_STATE_RESOLUTION", "CROSS_STATE_IDENTITY_DRIFT", 2),
        (blind, "MISSING_SPATIAL_EVIDENCE", "MISSING_GEOMETRIC_EVIDENCE", 6),
        (none & recent, "DATA_VINTAGE_INSUFFICIENT", "VINTAGE_MISMATCH_RECENT", 6),
        (none, "UNRESOLVED_GEOMETRIC_RESIDUAL", "GEOMETRY_NOT_AVAILABLE", 6),
        (mismatch, "EVENT_GEOMETRY_IDENTITY_MISMATCH", "EVENT_GEOMETRY_IDENTITY_MISMATCH", 3),
        (child_ok, "RECONCILED_BY_SPATIAL_DISCOVERY", "PARENT_CHILD_RECOVERY", 4),
        (strong & small, "RECONCILED_BY_SPATIAL_DISCOVERY", "SPATIAL_SUCCESSOR_DISCOVERED", 3),
        (strong, "RECONCILED_BY_SPATIAL_DISCOVERY", "ADJACENCY_RECOVERY", 5),
        (small, "RECONCILED_WITH_IGNORABLE_RESIDUAL", "BOUNDARY_PRECISION", 5),
        (recent, "DATA_VINTAGE_INSUFFICIENT", "VINTAGE_MISMATCH_RECENT", 3),
    ]

    def rung(k: int, last):  # noqa: ANN001, ANN202
        out = None
        for row in ladder:
            out = F.when(row[0], row[k]) if out is None else out.when(row[0], row[k])
        return out.otherwise(last)

    chosen = F.coalesce("l1_ck", "l2_ck", F.when(child_ok & ~mismatch, F.col("child.cand_ck")), b["cand_ck"])
    gone = F.when(by_name, F.col("residual_area")).when(blind | none, 0.0).otherwise(F.least("discovered", "residual_area"))
    return rows.select(
        "event_id", "pred_ck", rung(1, "UNRESOLVED_GEOMETRIC_RESIDUAL").alias("final_status"), rung(2, "GENUINELY_UNRESOLVED").alias("reason"), rung(3, 6).alias("recovery_level"),
        F.when(by_name | ~(blind | none), chosen).alias("chosen_ck"), F.col("residual_pct").alias("initial_residual_pct"),
        F.when(by_name, 0.0).when(blind | none, F.col("residual_pct")).otherwise(open_pct).alias("final_residual_pct"), gone.alias("recovered_area"), (F.col("residual_area") - gone).alias("unresolved_area"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.when(F.col("l1_ck").isNotNull(), 1.0).when(F.col("l2_ck").isNotNull(), 0.9).otherwise(F.coalesce(b["spatial_confidence"], F.lit(0.0))).alias("spatial_confidence"),
        F.when(F.col("l1_ck").isNotNull(), 1.0).when(F.col("l2_ck").isNotNull(), 0.9).when(blind | none, 0.0).otherwise(b["administrative_confidence"]).alias("administrative_confidence"),
        F.when(by_name, "CONFIRMED_ADMINISTRATIVE_SUCCESSOR").when(blind | none, "NO_VALID_SPATIAL_SUCCESSOR").otherwise(b["candidate_status"]).alias("candidate_status"),
        F.when(by_name, F.coalesce("l1_ck", "l2_ck")).when(~(blind | none), b["cand_ck"]).alias("best_candidate_ck"), F.when(by_name | blind | none, 0.0).otherwise(b["candidate_score"]).alias("best_candidate_score"),
    )


def results(decided: DataFrame, audited: DataFrame, units: DataFrame) -> DataFrame:
    """The decisions with what they began from and what they say: one whole row for each open residual.

    audited: event_id, pred_ck, accounting_status, accounted_area.  units: canonical_key, display_name.
    """
    begun = audited.select("event_id", "pred_ck", F.col("accounting_status").alias("initial_status"), F.col("accounted_area").alias("raw_intersection_area"))
    named = units.select(F.col("canonical_key").alias("best_candidate_ck"), F.col("display_name").alias("best_candidate"))
    by_name = F.col("recovery_level") < 3
    return decided.join(begun, ["event_id", "pred_ck"]).join(named, "best_candidate_ck", "left").select(
        "event_id", "pred_ck", "initial_status", "initial_residual_pct", "raw_intersection_area", F.col("final_residual_pct").alias("post_discovery_residual_pct"), "final_status", "reason", "recovery_level",
        F.when(by_name, 0).otherwise(F.col("n_candidates")).alias("candidate_count"), F.coalesce("best_candidate", "best_candidate_ck", F.lit("")).alias("best_candidate"), F.coalesce("best_candidate_ck", F.lit("")).alias("best_candidate_ck"),
        "chosen_ck", "best_candidate_score", "candidate_status", "spatial_confidence", "administrative_confidence", "recovered_area", "unresolved_area",
        (F.col("reason") == "CROSS_STATE_IDENTITY_DRIFT").alias("cross_state_transition"), (F.col("final_status") != "EVENT_GEOMETRY_IDENTITY_MISMATCH").alias("administrative_spatial_agreement"),
        F.concat(F.lit("L"), "recovery_level", F.lit("|"), "reason").alias("provenance"),
    )


def promoted(aliases: DataFrame) -> DataFrame:
    """Alias candidates that documents or people stand behind; overlap alone never promotes one."""
    return aliases.filter(F.col("evidence_type").isin("DOCUMENTARY", "MANUAL_VERIFIED", "EXISTING_REGISTRY"))


def augmented(transfers: DataFrame, decided: DataFrame) -> DataFrame:
    """Transfer rows with the decision on the first of their event's residuals, and the area's name before it."""
    order = Window.partitionBy("event_id").orderBy("pred_ck")
    first = decided.withColumn("place", F.row_number().over(order)).filter("place = 1").select("event_id", F.col("final_status").alias("event_final_status"), F.col("recovery_level").alias("event_recovery_level"), F.col("recovered_area").alias("event_recovered_area"))
    return transfers.withColumnRenamed("area", "measured_area").join(first, "event_id", "left")


def merged_summary(status: DataFrame, decided: DataFrame) -> DataFrame:
    """Event status with what discovery made of the event's residuals."""
    s = F.col("final_status")
    own = decided.groupBy("event_id").agg(
        F.max("recovery_level").alias("recovery_level_found"), F.sum("recovered_area").alias("recovered_area_found"), F.sum("unresolved_area").alias("unresolved_area_found"), F.bool_and(s.startswith("RECONCILED")).alias("all_reconciled_found"),
        F.bool_or(s == "EVENT_GEOMETRY_IDENTITY_MISMATCH").alias("any_mismatch_found"), F.min_by("final_status", "pred_ck").alias("final_status_found"),
    )
    return status.join(own, "event_id", "left")


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("final_status", "reason", "recovery_level").agg(F.count("*").alias("n"), F.sum("recovered_area").alias("recovered_area"))


def by_reason(found: DataFrame, reason: str) -> DataFrame:
    """Report rows of one reason, the largest first: mismatches, resolutions across states."""
    return found.filter(F.col("reason") == reason).select("event_id", "pred_ck", "best_candidate_ck", "recovered_area", "unresolved_area").orderBy(F.col("recovered_area").desc(), "event_id", "pred_ck")


def largest_unresolved(decided: DataFrame, n: int = 20) -> DataFrame:
    return decided.orderBy(F.col("unresolved_area").desc(), "event_id", "pred_ck").limit(n)
