"""Hand-made cases of the operators, sources and the stream."""

import hashlib
import sqlite3

import pytest
from pyspark.sql import functions as F

from parcelflow.config import LayerSource, Settings
from parcelflow.operators import crosswalk as C
from parcelflow.operators import discovery as D
from parcelflow.operators import events as E
from parcelflow.operators import identity as I
from parcelflow.operators import layers as LY
from parcelflow.operators import lineage as L
from parcelflow.operators import reconcile as R
from parcelflow.operators import transition as T
from parcelflow.sources import geopackage as GP
from parcelflow.sources import tables as S
from parcelflow.streaming import incremental

YEARS = (1951, 1961)


def world(spark, rows):
    """rows: atoms as (unit before, unit after, weight)."""
    a = [(1951, i, x, float(w)) for i, (x, _, w) in enumerate(rows) if x] + [(1961, i, y, float(w)) for i, (_, y, w) in enumerate(rows) if y]
    assigned = spark.createDataFrame(a, "year int, atom int, unit string, weight double")
    layers = T.layers_of(assigned).withColumn("state", F.lit("S"))
    flagged = T.flag_slivers(T.overlay_atoms(assigned, YEARS), layers)
    shares = T.shares(T.matrix(flagged), layers)
    edges = I.continuity(shares)
    roots = I.chain_roots(layers, edges, YEARS)
    keys = I.numbered(roots)
    return layers, flagged, shares, roots, keys, I.registry(layers, edges, roots, keys, YEARS)


@pytest.mark.parametrize(
    ("rows", "n_keys", "active"),
    [
        ([("A", "A", 100)], 1, 1),  # the same
        ([("A", "B", 100)], 1, 1),  # another name
        ([("A", "B", 50), ("A", "C", 50)], 3, 2),  # a clean split
        ([("A", "A", 95), ("A", "B", 5)], 2, 2),  # a carve-out that the parent survives
        ([("A", "A", 85), ("A", "B", 15)], 3, 2),  # one that it does not
        ([("A", "A", 90), ("A", "B", 10)], 2, 2),  # exactly at the threshold
        ([("A", "C", 60), ("B", "C", 40)], 3, 1),  # a merger
        ([("A", "A", 50), ("A", None, 50)], 2, 1),  # half of it lost
    ],
)
def test_identity(spark, rows, n_keys, active):
    reg = world(spark, rows)[-1].collect()
    assert len(reg) == n_keys and sum(r.is_active for r in reg) == active
    assert sorted(r.canonical_key for r in reg) == [f"IND-{k + 1:06d}" for k in range(n_keys)]


def test_residuals_close(spark):
    layers, flagged, *_ = world(spark, [("A", "A", 90.0), ("A", "B", 0.3), ("A", None, 9.7), (None, "A", 5.0)])
    lost = {r.obs: r for r in T.closure(T.residual(flagged, layers, "a", YEARS)).collect()}
    r = lost["A@1951"]
    assert (r.area, r.transition, r.lost, r.is_violation) == (100, 90, pytest.approx(9.7), False) and r.sliver == pytest.approx(0.3)
    gained = {r.obs: r.gained for r in T.residual(flagged, layers, "b", YEARS).collect()}
    assert gained["A@1961"] == 5 and gained["B@1961"] == 0


RAW = [
    ("SPLIT", "Old, Older And Oldest", "B", "S", 1955, "g2"),
    ("SPLIT", "Old, Older And Oldest", "A", "S", 1955, "g1"),
    ("SPLIT", "Old, Older And Oldest", "A", "S", 1956, "g1"),
    ("NEW_DISTRICT", None, "C", "S", 1951, None),
    ("RENAME", "X", "Y", "S", 2025, "g3"),
    ("RENAME", "X", "Y", "S", 2025, "g3"),
]


def test_events(spark):
    raw = spark.createDataFrame(RAW, S.EVENTS)
    found = E.events(raw)
    rows = {(r.event_type, r.effective_year): r for r in found.collect()}
    assert len(rows) == 4 and rows["SPLIT", 1955].n_predecessors == 3 and rows["SPLIT", 1955].sources_cited == "g1;g2"
    assert rows["SPLIT", 1955].event_id == hashlib.sha256(b"EVENT|SPLIT|Old, Older And Oldest|S|1955").hexdigest()[:32]
    assert rows["NEW_DISTRICT", 1951].n_predecessors == 0
    assert E.duplicate_ids(found).count() == 1  # the rename that is there twice
    assert E.lost_children(raw, E.participants(found)).count() == 0


@pytest.mark.parametrize(("kind", "pred", "succ", "expected"), [("SPLIT", 1, 3, "TRIFURCATION"), ("SPLIT", 1, 0, "SPLIT"), ("SPLIT", 1, 5, "MULTIWAY_SPLIT"), ("NEW_DISTRICT", 2, 1, "REORGANISATION"), ("rename", 1, 1, "RENAME"), ("merger", 2, 1, "MERGER"), ("else", 1, 1, "UNKNOWN")])
def test_administrative_class(spark, kind, pred, succ, expected):
    assert spark.range(1).select(R.administrative_class(F.lit(kind), F.lit(pred), F.lit(succ))).first()[0] == expected


@pytest.mark.parametrize(("score", "declared", "expected"), [(0.82, True, "CONFIRMED_ADMINISTRATIVE_SUCCESSOR"), (0.60, True, "SPATIALLY_CONFIRMED_BUT_EVENT_UNLISTED"), (0.72, False, "SPATIALLY_CONFIRMED_BUT_EVENT_UNLISTED"), (0.42, False, "POSSIBLE_SPATIAL_SUCCESSOR"), (0.18, False, "NO_VALID_SPATIAL_SUCCESSOR")])
def test_candidate_status(spark, score, declared, expected):
    assert spark.range(1).select(D.candidate_status(F.lit(declared), F.lit(score))).first()[0] == expected


def ladder(spark, year=1954, geometry=True, l1=None, l2=None, cand=None, pct=97.3):
    rows = spark.createDataFrame([("E", "P", year, 1951, 1961, 10000.0, 9730.0, pct, geometry, 1)], "event_id string, pred_ck string, effective_year int, pre int, post int, source_area double, residual_area double, residual_pct double, has_geometry boolean, n_declared int")
    hit = lambda n, v: spark.createDataFrame([("E", "P", v)] if v else [], f"event_id string, pred_ck string, {n} string")
    schema = "event_id string, pred_ck string, cand_ck string, candidate_score double, candidate_status string, spatial_confidence double, administrative_confidence double, declared boolean, related boolean, spatial_rank int, area double"
    return D.decide(rows, hit("l1_ck", l1), hit("l2_ck", l2), spark.createDataFrame(cand or [], schema)).first()


def test_ladder(spark):
    r = ladder(spark, l1="A", l2="B")
    assert (r.final_status, r.recovery_level, r.chosen_ck, r.initial_residual_pct, r.final_residual_pct, r.unresolved_area) == ("RECONCILED_BY_ALIAS", 1, "A", 97.3, 0, 0)
    assert ladder(spark, l2="B").final_status == "RECONCILED_BY_CROSS_STATE_RESOLUTION"
    assert ladder(spark, geometry=False).final_status == "MISSING_SPATIAL_EVIDENCE"
    r = ladder(spark)
    assert (r.final_status, r.recovery_level, r.unresolved_area, r.chosen_ck) == ("UNRESOLVED_GEOMETRIC_RESIDUAL", 6, 9730, None)
    assert ladder(spark, year=2023).final_status == "DATA_VINTAGE_INSUFFICIENT"
    one = lambda score, declared, related, area, admin=0.9: [("E", "P", "C", score, "SPATIALLY_CONFIRMED_BUT_EVENT_UNLISTED", 0.8, admin, declared, related, 1, area)]
    assert ladder(spark, cand=one(0.7, True, False, 9730.0)).reason == "SPATIAL_SUCCESSOR_DISCOVERED"
    assert ladder(spark, cand=one(0.7, True, True, 9730.0)).recovery_level == 4
    assert ladder(spark, cand=one(0.7, True, False, 5000.0)).reason == "ADJACENCY_RECOVERY"
    assert ladder(spark, cand=one(0.6, True, False, 9730.0)).reason == "BOUNDARY_PRECISION"
    assert ladder(spark, cand=one(0.6, False, False, 5000.0, 0.2)).reason == "EVENT_GEOMETRY_IDENTITY_MISMATCH"
    r = ladder(spark, cand=one(0.4, True, False, 5000.0))
    assert (r.reason, r.recovered_area, r.unresolved_area) == ("GENUINELY_UNRESOLVED", 5000, 4730)


def test_cross_state_can_be_off(spark):
    rows = spark.createDataFrame([("E", "P", 1961, "x", "s")], "event_id string, pred_ck string, post int, name_norm string, state_norm string")
    names = spark.createDataFrame([(1961, "t", "x", "K")], "vintage int, state_norm string, name_norm string, canonical_key string")
    by_state = names.withColumnRenamed("canonical_key", "state_ck")
    by_name = names.select("vintage", "name_norm", F.col("canonical_key").alias("name_ck"))
    succ = spark.createDataFrame([], "state_norm string, succ_state string, place int")
    alias = spark.createDataFrame([], S.ALIASES)
    on = D.cross_state_hits(rows, names, by_state, by_name, succ, alias).first()
    off = D.cross_state_hits(rows, names, by_state, by_name, succ, alias, Settings(cross_state=False)).first()
    assert (on.l2_ck, on.l2_reason, off.l2_ck, off.l2_reason) == ("K", "NAME_ONLY", None, "CROSS_STATE_DISABLED")


def test_crosswalk_keeps_totals(spark):
    _, _, shares, *_ = world(spark, [("A", "B", 30.0), ("A", "C", 70.0), ("D", "C", 10.0)])
    values = spark.createDataFrame([(1951, "A@1951", 200.0), (1951, "D@1951", 5.0)], "year_a int, obs_a string, value double")
    out = {r.obs_b: r.value for r in C.harmonised(values, C.crosswalk(shares)).collect()}
    assert out == {"B@1961": pytest.approx(60), "C@1961": pytest.approx(145)}


SQUARE = [(0, 0, 0.0, 0.0), (0, 0, 1.0, 0.0), (0, 0, 1.0, 1.0), (0, 0, 0.0, 1.0)]


def test_geopackage_round_trip(spark, tmp_path):
    spark.dataSource.register(GP.GeoPackage)
    path = str(tmp_path / "map.gpkg")
    df = spark.createDataFrame([("1", "Kangra", "Punjab", SQUARE), ("2", "n/a", None, [(p + 1, r, x + 3, y) for p, r, x, y in SQUARE] + SQUARE), ("3", None, "Goa", None)], f"pk string, NAME string, STATE_UT string, points {LY.G.POINTS}")
    df.coalesce(1).write.format("gpkg").option("layer", "districts").mode("append").save(path)
    assert GP.layers(path) == ["districts"]
    back = spark.read.format("gpkg").option("layer", "districts").option("rows", 2).load(path)
    rows = {r.pk: r for r in back.collect()}
    assert [tuple(p) for p in rows["1"].points] == SQUARE and len(rows["2"].points) == 8 and rows["3"].points == []
    source = LayerSource("made", 1951, path, "pk", "NAME", "STATE_UT")
    good, bad = LY.with_rejects(LY.projection(back, source))
    assert bad.count() == 2
    r = LY.standardised(good, degrees=False).first()
    assert (r.area_km2, r.n_parts, r.is_valid, r.district_name_norm, r.state_name_std) == (1.0, 1, True, "kangra", "Punjab")
    with sqlite3.connect(path) as c, pytest.raises(sqlite3.Error):
        c.execute("SELECT * FROM nothing")


def test_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("abc")
    m = S.manifest(spark, str(tmp_path / "in")).first()
    assert (m.size_bytes, m.sha256) == (3, hashlib.sha256(b"abc").hexdigest())
    assert S.routed(["x", "y", "z"], LayerSource("d", 1, "p", "k", "n", primary_layer="x")) == (["x"], [("y", "UNKNOWN_LAYER"), ("z", "UNKNOWN_LAYER")])
    first = spark.createDataFrame([(1,)], "v int")
    path = f"file://{tmp_path}/snap"
    S.snapshot(first, path)
    assert S.snapshot(spark.createDataFrame([(2,)], "v int"), path).first().v == 1
    S.report(first, f"file://{tmp_path}/report", ["v"], "markdown")
    assert spark.read.text(f"file://{tmp_path}/report").count() == 3


def test_stream_replays_change_nothing(spark, tmp_path):
    source, table = tmp_path / "raw", f"file://{tmp_path}/events"
    source.mkdir()
    line = "SPLIT,P,{},S,1955,g\n"
    (source / "1.csv").write_text("event_type,parent_district,child_district,state,effective_year,source\n" + line.format("A"))
    incremental.ingest(spark, str(source), table, str(tmp_path / "ck")).awaitTermination()
    (source / "2.csv").write_text("event_type,parent_district,child_district,state,effective_year,source\n" + line.format("A") + line.format("B"))
    incremental.ingest(spark, str(source), table, str(tmp_path / "ck")).awaitTermination()
    last = spark.read.parquet(f"{table}/v=000000000001").collect()
    assert len(last) == 1 and last[0].children == ["A", "B"]


def test_documented_aliases(spark):
    from parcelflow.sources import fixed

    aliases, succ = fixed.manual_aliases(spark), fixed.state_successors(spark)
    assert aliases.count() == aliases.select("raw_name", "from_state").distinct().count() > 60 and succ.filter("state_norm = 'madras'").count() == 4
    rows = spark.createDataFrame([("E", "P", 1991, "trichur", "kerala"), ("F", "Q", 1991, "nellore", "madras")], "event_id string, pred_ck string, post int, name_norm string, state_norm string")
    layer = [(1991, "kerala", "thrissur", "T"), (1991, "andhra pradesh", "nellore", "N"), (1991, "goa", "nellore", "M")]
    names = spark.createDataFrame(layer, "vintage int, state_norm string, name_norm string, canonical_key string")
    by_state = names.withColumnRenamed("canonical_key", "state_ck")
    by_name = names.filter("name_norm <> 'nellore'").select("vintage", "name_norm", F.col("canonical_key").alias("name_ck"))
    l1 = D.alias_hits(rows, aliases.filter("false"), aliases, by_state, by_name).collect()
    assert {(r.event_id, r.l1_ck, r.alias_type, r.evidence_type) for r in l1} == {("E", "T", "HISTORICAL_NAME", "DOCUMENTARY"), ("F", "N", "STATE_REORGANISATION", "DOCUMENTARY")}
    l2 = {r.event_id: (r.l2_ck, r.l2_reason) for r in D.cross_state_hits(rows, names, by_state, by_name, succ, aliases).collect()}
    assert l2["F"] == ("N", "STATE_SUCCESSOR")


def test_cycles_of_any_length(spark):
    ring = [(str(i), str((i + 1) % 40)) for i in range(40)]
    chain = [("0", "a"), ("a", "b"), ("b", "c"), ("x", "0"), ("self", "self"), (None, "a")]
    found = L.cycles(spark, spark.createDataFrame(ring + chain, "from_ck string, to_ck string"))
    assert sorted(r.canonical_key for r in found.collect()) == sorted([str(i) for i in range(40)] + ["self"])


def test_rules_are_kept_by_run_and_stop_promotion(spark, tmp_path):
    from parcelflow.operators import checks as K

    rows = spark.createDataFrame([("V1", 1951, 0.0005), ("V1", 1951, 0.0004), ("V1", 1961, 0.002), ("V3", 1951, 1e-9), ("V6", 1951, 1.0), ("V6", 1951, 0.0), ("V2", 1951, 0.5), ("V7", 1951, None)], "rule string, year int, value double")
    checked = K.by_window(rows)
    got = {(r.rule[:2], r.year): (r.value, r.passed, r.severity) for r in checked.collect()}
    assert got == {("V1", 1951): (0.0009, True, "ERROR"), ("V1", 1961): (0.002, False, "ERROR"), ("V3", 1951): (1e-9, True, "ERROR"), ("V6", 1951): (0.5, True, "INFO"), ("V2", 1951): (0.5, False, "WARN"), ("V7", 1951): (0.0, True, "ERROR")}
    path = f"file://{tmp_path}/checks"
    K.recorded(checked, path, "a")
    K.recorded(checked.filter("year = 1951"), path, "b")
    kept = K.recorded(checked.filter("year = 1961"), path, "b")
    assert {(r.run, r.n) for r in kept.groupBy("run").agg(F.count("*").alias("n")).collect()} == {("a", 6), ("b", 1)}
    with pytest.raises(ValueError, match="V1 .* \\(1961\\)"):
        K.promoted(rows, checked, f"file://{tmp_path}/published")
    K.promoted(rows, checked.filter("year = 1951"), f"file://{tmp_path}/published")  # a warning doesn't stop it
    assert spark.read.parquet(f"file://{tmp_path}/published").count() == 8


def test_ancestors_too_deep_are_an_error(spark):
    from parcelflow.operators import backfill as B

    registry = spark.createDataFrame([(f"K{i}", 1900 + i) for i in range(6)], "canonical_key string, established_year int")
    edges = spark.createDataFrame([(f"K{i}", f"K{i + 1}") for i in range(5)], "from_ck string, to_ck string")
    assert {r.earliest for r in B.earliest_ancestor(registry, edges, Settings(backfill_depth=5)).collect()} == {1900}
    with pytest.raises(ValueError, match="backfill_depth"):
        B.earliest_ancestor(registry, edges, Settings(backfill_depth=4))


def test_overlapping_periods_with_ties(spark):
    rows = [(1, k, 10, 20) for k in (5, 3, 9)] + [(1, 1, 0, 5), (2, 4, 7, 8), (2, 2, 7, 7)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "canonical_key int, id int, valid_from int, valid_to int").coalesce(1)
        assert {r["id"] for r in C.overlapping_periods(df, ties=["id"]).collect()} == {5, 9}
