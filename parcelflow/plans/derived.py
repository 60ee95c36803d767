"""Layers, events and polygons derived from the driver's tables, so that every operator can run on them.

Atoms are customers, their weight 1 + key % 50; units are made from nations and change over the vintages by rule: some
split, some lose a part, some merge back, some exchange atoms.  Events follow the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.config import Settings
from parcelflow.functions.text import normalize_name
from parcelflow.operators import events as E
from parcelflow.operators import identity as I
from parcelflow.operators import lineage as L
from parcelflow.operators import reconcile as R
from parcelflow.operators import transition as T
from parcelflow.sources.steps import settle

VINTAGES = (1995, 1997, 1999, 2001)
SETTINGS = Settings(sliver_abs=40.0, latest_vintage=2001)
#: Frames that several others use and that are small beside the atoms; they are written where a stage would end.
SETTLED = frozenset(("layers", "flagged", "shares", "roots", "keys", "registry", "crossed", "edges", "corroborated", "events", "named", "flow", "contributed", "audited", "open_rows"))


def unit_of(n: Column, k: Column, y: Column) -> Column:
    """The unit of an atom in a year."""
    named = lambda x: F.concat(F.lit("N"), x.cast("string"))
    split = (n % 4).isin(0, 2) & (n % 8 != 6) & (y >= 1995 + n % 7) & ~((n % 5 == 0) & (y >= 1997 + n % 7))
    return (
        F.when((n % 4 == 3) & (F.floor(k / 25) % 30 == 0) & (y >= 1998), named((n + 3) % 25))
        .when((n % 4 == 1) & (k % 20 == 0) & (y >= 1997 + n % 3), F.concat(F.lit("C"), n.cast("string")))
        .when(split, F.concat(named(n), F.lit("."), (k % (1 + n % 3)).cast("string")))
        .otherwise(named(n))
    )


class Derived:
    """The frames of one scale, made lazily from each other and each once."""

    def __init__(self, spark: SparkSession, sf_dir: str, observed: bool = False) -> None:
        self.spark, self.sf_dir, self.observed = spark, sf_dir, observed
        self.made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or not hasattr(Derived, f"make_{name}"):
            raise AttributeError(name)
        if name not in self.made:
            made = getattr(self, f"make_{name}")()
            self.made[name] = settle(made, name) if name in SETTLED else made
        return self.made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def make_assigned(self) -> DataFrame:
        c = self.table("customer").select(F.col("c_custkey").alias("atom"), F.col("c_nationkey").alias("n"), (1 + F.col("c_custkey") % 50).alias("weight"))
        years = c.withColumn("year", F.explode(F.array(*(F.lit(y) for y in VINTAGES))))
        out = years.select("atom", "year", unit_of(F.col("n"), F.col("atom"), F.col("year")).alias("unit"), "weight")
        if self.observed:
            seen = self.table("orders").select(F.col("o_custkey").alias("atom"), F.year("o_orderdate").alias("year")).filter(F.col("year").isin(*VINTAGES)).distinct()
            out = out.join(seen, ["atom", "year"], "left_semi")
        return out

    def make_layers(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        states = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("home"), F.col("r_name").alias("state"))  # 25 rows
        home = F.regexp_extract("unit", "[0-9]+", 0).cast("int")
        return T.layers_of(self.assigned).withColumn("home", home).join(F.broadcast(states), "home").drop("home")

    def make_parcels(self) -> DataFrame:
        return T.overlay_atoms(self.assigned, VINTAGES)

    def make_flagged(self) -> DataFrame:
        return T.flag_slivers(self.parcels, self.layers, SETTINGS)

    def make_matrix(self) -> DataFrame:
        return T.matrix(self.flagged)

    def make_lost(self) -> DataFrame:
        return T.residual(self.flagged, self.layers, "a", VINTAGES)

    def make_gained(self) -> DataFrame:
        return T.residual(self.flagged, self.layers, "b", VINTAGES)

    def make_shares(self) -> DataFrame:
        return T.shares(self.matrix, self.layers)

    def make_continuity(self) -> DataFrame:
        return I.continuity(self.shares, SETTINGS)

    def make_roots(self) -> DataFrame:
        return I.chain_roots(self.layers, self.continuity, VINTAGES)

    def make_numbers(self) -> DataFrame:
        return I.numbered(self.roots)

    def make_keys(self) -> DataFrame:
        return I.obs_keys(self.roots, self.numbers)

    def make_registry(self) -> DataFrame:
        return I.registry(self.layers, self.continuity, self.roots, self.numbers, VINTAGES)

    def make_transitions(self) -> DataFrame:
        return I.transitions(self.shares, self.keys, SETTINGS)

    def make_crossed(self) -> DataFrame:
        return L.crossing(self.transitions, self.registry)

    def make_edges(self) -> DataFrame:
        return L.typed(self.crossed, self.registry)

    def make_raw_events(self) -> DataFrame:
        n = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("n"), F.col("r_name").alias("state"))
        unit = lambda x: F.concat(F.lit("N"), x.cast("string"))
        k = F.col("n")
        row = lambda d, kind, parent, child, year, source: d.select(F.lit(kind).alias("event_type"), parent.alias("parent_district"), child.alias("child_district"), "state", year.cast("int").alias("effective_year"), source.alias("source"))
        split = n.filter((k % 4).isin(0, 2) & (k % 8 != 6)).withColumn("j", F.explode(F.sequence(F.lit(0), (k % 3).cast("int"))))
        a = row(split, "SPLIT", unit(k), F.concat(unit(k), F.lit("."), F.col("j").cast("string")), 1995 + k % 7, F.concat(F.lit("gazette "), (k % 3).cast("string")))
        b = row(n.filter(k % 4 == 1), "NEW_DISTRICT", F.when(k % 8 == 5, F.concat(unit(k), F.lit(" and "), unit((k + 1) % 25))).otherwise(unit(k)), F.concat(F.lit("C"), k.cast("string")), 1997 + k % 3, F.lit("notice"))
        c = row(n.filter(k % 5 == 3), "RENAME", unit(k), unit(k), 1996 + k % 4, F.lit("order"))
        return a.unionByName(b).unionByName(c)

    def make_events(self) -> DataFrame:
        return E.events(self.raw_events)

    def make_participants(self) -> DataFrame:
        return E.participants(self.events)

    def make_by_state(self) -> DataFrame:
        return E.name_index(self.layers, self.keys)[0]

    def make_by_name(self) -> DataFrame:
        return E.name_index(self.layers, self.keys)[1]

    def make_named(self) -> DataFrame:
        return E.resolved(self.events, self.participants, self.by_state, self.by_name, VINTAGES)

    def make_flow(self) -> DataFrame:
        return E.between_keys(self.matrix, self.keys)

    def make_areas(self) -> DataFrame:
        return self.layers.join(self.keys, ["year", "obs"]).groupBy("canonical_key", "year").agg(F.sum("area").alias("area"))

    def make_contributed(self) -> DataFrame:
        return R.contributions(self.named, self.flow, self.areas)

    def make_kept(self) -> DataFrame:
        return R.conservation(self.contributed)

    def make_audited(self) -> DataFrame:
        return R.recovered(self.kept, self.contributed, SETTINGS)

    def make_status(self) -> DataFrame:
        return R.event_status(self.events, self.audited)

    def make_named_registry(self) -> DataFrame:
        return self.registry.withColumns({"name_norm": normalize_name(F.col("display_name")), "state_norm": normalize_name(F.col("state_at_creation"))})

    def make_corroborated(self) -> DataFrame:
        parts = self.participants.withColumns({"name_norm": normalize_name(F.col("district_name_raw")), "state_norm": normalize_name(F.col("state"))})
        return L.corroborated(self.edges, self.named_registry, parts, self.events, SETTINGS)

    # --- what discovery needs -----------------------------------------------------------------------------------------

    def make_layer_names(self) -> DataFrame:
        return self.layers.join(self.keys, ["year", "obs"]).select(F.col("year").alias("vintage"), normalize_name(F.col("state")).alias("state_norm"), normalize_name(F.col("unit")).alias("name_norm"), "canonical_key").distinct()

    def make_open_rows(self) -> DataFrame:
        """Every predecessor's row is open to discovery; `n_declared` counts the event's resolved successors."""
        declared = self.contributed.groupBy("event_id").agg(F.countDistinct("succ_ck").alias("n_declared"))
        who = self.named.filter("role = 'PREDECESSOR' and canonical_key is not null").groupBy("event_id", F.col("canonical_key").alias("pred_ck")).agg(F.min("name_norm").alias("name_norm"), F.min("state_norm").alias("state_norm"))
        return self.kept.join(who, ["event_id", "pred_ck"]).join(self.events.select("event_id", "effective_year"), "event_id").join(declared, "event_id").withColumn("has_geometry", F.col("source_area") > 0)

    def make_aliases(self) -> DataFrame:
        """Names of units that a nation with a number divisible by 6 had under the next nation's name."""
        n = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        unit = lambda x: F.concat(F.lit("N"), x.cast("string"))
        k = F.col("n_nationkey")
        return n.filter(k % 6 == 0).select(unit(k).alias("raw_name"), F.col("r_name").alias("from_state"), unit((k + 1) % 25).alias("canonical_name"), F.lit("").alias("to_state"), F.lit("TRANSLITERATION").alias("alias_type"), F.when(k % 4 == 0, "DOCUMENTARY").otherwise("SPATIAL_DISCOVERY").alias("evidence_type"), F.lit("made up").alias("provenance"), F.when(k % 12 == 0, "APPROVED").otherwise("CANDIDATE").alias("approval_status"))

    def make_state_successors(self) -> DataFrame:
        r = self.table("region")
        return r.select(normalize_name(F.col("r_name")).alias("state_norm"), F.explode(F.array(F.col("r_regionkey"), (F.col("r_regionkey") + 1) % 5)).alias("to")).join(r.select(F.col("r_regionkey").alias("to"), normalize_name(F.col("r_name")).alias("succ_state")), "to").select("state_norm", "succ_state", F.row_number().over(Window.partitionBy("state_norm").orderBy("succ_state")).alias("place"))

    def make_overlaps(self) -> DataFrame:
        """What a predecessor has in common with units of the next vintage; boundary and distance are made up from areas."""
        f = self.flow.join(self.areas.select(F.col("canonical_key").alias("to_ck"), F.col("year").alias("year_b"), F.col("area").alias("cand_area")), ["to_ck", "year_b"])
        return f.select(F.col("year_a").alias("pre"), F.col("year_b").alias("post"), F.col("from_ck").alias("pred_ck"), F.col("to_ck").alias("cand_ck"), F.col("flow_area").alias("area"), "cand_area", F.sqrt("flow_area").alias("boundary"), (F.col("cand_area") / 100).alias("distance"))

    def make_declared(self) -> DataFrame:
        return self.named.filter("role = 'SUCCESSOR' and canonical_key is not null").select("event_id", F.col("canonical_key").alias("succ_ck"), F.col("name_norm").alias("succ_name")).distinct()

    def make_relations(self) -> DataFrame:
        return self.edges.select(F.col("from_ck").alias("parent_ck"), F.col("to_ck").alias("child_ck")).distinct()

    def make_units(self) -> DataFrame:
        return self.named_registry.select("canonical_key", "name_norm", "state_norm", "established_year")

    # --- polygons -----------------------------------------------------------------------------------------------------

    def boxes(self, shift: int) -> DataFrame:
        """A box for each part, in a grid of cells of ten, moved by the shift; parts overlap parts of other layers only."""
        k = F.col("p_partkey")
        x = (k % 40) * 10 + 3 * shift
        y = F.floor(k / 40) * 10 + 4 * shift
        w, h = 1 + F.col("p_size") % 9, 1 + (F.col("p_size") + k) % 9
        corner = lambda a, b: F.struct(F.lit(0).alias("part"), F.lit(0).alias("ring"), a.cast("double").alias("x"), b.cast("double").alias("y"))
        return self.table("part").select(k.cast("string").alias("box"), F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h)).alias("points"))
