"""All queries over the driver's tables, each beside the DuckDB SQL that it must equal.

Doubles are rounded in both, so that the order of additions does not show.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.config import LayerSource, Settings
from parcelflow.functions import geometry as G
from parcelflow.functions import numbers as N
from parcelflow.functions import text as X
from parcelflow.operators import backfill as B
from parcelflow.operators import checks as K
from parcelflow.operators import crosswalk as C
from parcelflow.operators import discovery as D
from parcelflow.operators import events as E
from parcelflow.operators import identity as I
from parcelflow.operators import layers as LY
from parcelflow.operators import lineage as L
from parcelflow.operators import reconcile as R
from parcelflow.operators import transition as T
from parcelflow.plans import polygons as polygons
from parcelflow.plans.derived import SETTINGS, VINTAGES, Derived
from parcelflow.plans.oracle import q
from parcelflow.plans.registry import ORACLES as ORACLES
from parcelflow.plans.registry import QUERIES as QUERIES
from parcelflow.plans.registry import query
from parcelflow.sources import tables as S
from parcelflow.sources.steps import merged, step_path

def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scalar functions -------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, left(sha256('CUST|'||c_custkey||'|'||coalesce(c_mktsegment,'')),32) AS id FROM customer")
def stable_id(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.stable_id(F.lit("CUST"), F.col("c_custkey"), F.col("c_mktsegment")).alias("id"))


@query(r"""SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(c_name||' & District / '||c_mktsegment||'-O''Neil.')),'&',' and '),'[.’''`]','','g'),'[-–—/]',' ','g'),'\bdistrict\b','','g'),'\s+',' ','g')) AS name_norm FROM customer""")
def normalize_name(spark, sf):
    raw = F.concat(F.col("c_name"), F.lit(" & District / "), F.col("c_mktsegment"), F.lit("-O'Neil."))
    return table(spark, sf, "customer").select("c_custkey", X.normalize_name(raw).alias("name_norm"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name,' '), lambda x: upper(x[1])||lower(x[2:])),' ') AS name FROM part")
def display_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.display_name(F.col("p_name")).alias("name"))


@query("SELECT n_nationkey, lpad(CAST(n_nationkey+1 AS VARCHAR),2,'0') AS code, CASE n_nationkey%3 WHEN 0 THEN 'Odisha' WHEN 1 THEN 'Tamil Nadu' ELSE array_to_string(list_transform(string_split(n_name,' '), lambda x: upper(x[1])||lower(x[2:])),' ') END AS state FROM nation")
def canonical_state(spark, sf):
    n = F.col("n_nationkey")
    raw = F.when(n % 3 == 0, "ORISSA").when(n % 3 == 1, "Madras").otherwise(F.col("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", F.lpad((n + 1).cast("string"), 2, "0").alias("code"), X.canonical_state(raw).alias("state"))


@query(f"SELECT n_nationkey, state FROM nation LEFT JOIN (VALUES {', '.join(f"({int(k)}, '{v}')" for k, v in X.STATE_CODES.items())}) c(code, state) ON code = n_nationkey + 1")
def state_of_code(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", X.state_of_code(F.col("n_nationkey") + 1).alias("state"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity/8, 2) AS eighths FROM lineitem")
def rounded_eighths(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.rounded(F.col("l_quantity") / 8, 2).alias("eighths"))


#: A quadrangle of the ellipsoid between meridians and parallels, from the closed form of its area.
QUADRANGLE = """WITH c AS (SELECT (1/298.257223563)*(2-1/298.257223563) e2), b AS (SELECT p_partkey k, 70+p_partkey%20 x, 8+p_partkey%25 y, (1+p_size%9)/10.0 w, (1+(p_size+p_partkey)%9)/10.0 h FROM part),
 z AS (SELECT k, radians(w) dl, e2, sqrt(e2) e, sin(radians(y)) s0, sin(radians(y+h)) s1 FROM b, c)
SELECT k::VARCHAR AS box, round(6378.137*6378.137/2*dl*(1-e2)*((s1/(1-e2*s1*s1)-ln((1-e*s1)/(1+e*s1))/(2*e))-(s0/(1-e2*s0*s0)-ln((1-e*s0)/(1+e*s0))/(2*e))),4) AS area_km2 FROM z"""


@query(QUADRANGLE)
def geodesic_area(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    x, y, w, h = 70 + k % 20, 8 + k % 25, (1 + size % 9) / 10, (1 + (size + k) % 9) / 10
    corner = lambda a, b: F.struct(F.lit(0).alias("part"), F.lit(0).alias("ring"), a.cast("double").alias("x"), b.cast("double").alias("y"))
    points = F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h))
    return table(spark, sf, "part").select(k.cast("string").alias("box"), F.round(G.area(G.project(points)), 4).alias("area_km2"))


@query("SELECT p_partkey, (68+p_partkey%29+(p_size%10)/10.0)::DOUBLE AS lon, (7+p_partkey%30+(p_size%7)/7.0)::DOUBLE AS lat FROM part")
def conic_to_degrees(spark, sf):
    """Points projected forward by the conic's formulas, and brought back to degrees."""
    k, size = F.col("p_partkey"), F.col("p_size")
    lon, lat = 68 + k % 29 + (size % 10) / 10, F.radians(7 + k % 30 + (size % 7) / 7)
    e, a, b, c = math.sqrt(G.ECC2), *(math.radians(v) for v in (12.472944, 35.172806, 24.0))
    m = lambda v: math.cos(v) / math.sqrt(1 - G.ECC2 * math.sin(v) ** 2)
    t = lambda v: math.tan(math.pi / 4 - v / 2) * ((1 + e * math.sin(v)) / (1 - e * math.sin(v))) ** (e / 2)
    n = math.log(m(a) / m(b)) / math.log(t(a) / t(b))
    r = lambda v: G.AXIS * 1000 * m(a) / (n * t(a) ** n) * F.pow(v, F.lit(n))
    here = F.tan(F.lit(math.pi / 4) - lat / 2) * F.pow((1 + e * F.sin(lat)) / (1 - e * F.sin(lat)), F.lit(e / 2))
    angle = n * F.radians(lon - 80.0)
    x, y = 4e6 + r(here) * F.sin(angle), 4e6 + r(F.lit(t(c))) - r(here) * F.cos(angle)
    back = G.lambert_inverse(x, y, 12.472944, 35.172806, 24.0, 80.0, 4e6, 4e6)
    return table(spark, sf, "part").select("p_partkey", F.round(back[0], 6).alias("lon"), F.round(back[1], 6).alias("lat"))


@query("SELECT 'SUPP' AS source_dataset, 1961::INT AS source_year, s_suppkey::VARCHAR AS source_pk, s_name AS district_name_original, lpad((s_nationkey+1)::VARCHAR,2,'0') AS code FROM supplier")
def projected_layer(spark, sf):
    source = LayerSource(dataset="SUPP", year=1961, path="", pk_field="s_suppkey", name_field="s_name", state_field="code")
    raw = table(spark, sf, "supplier").withColumns({"code": F.lpad((F.col("s_nationkey") + 1).cast("string"), 2, "0"), "points": F.lit(None).cast(G.POINTS), "ordinal": F.lit(0)})
    return LY.projection(raw, source).select("source_dataset", "source_year", "source_pk", "district_name_original", F.col("state_name_original").alias("code"))


@query("SELECT c_custkey%5 IN (0) AS kept, CASE WHEN c_custkey%5=0 THEN NULL ELSE 'UNNAMED' END AS reason, count(*) AS n FROM customer GROUP BY 1,2")
def named_and_rejected(spark, sf):
    k = F.col("c_custkey") % 5
    raw = F.when(k == 1, " N/A").when(k == 2, "--").when(k == 3, "Data not available").when(k == 4, F.lit(None)).otherwise(F.col("c_name"))
    kept, rejected = LY.with_rejects(table(spark, sf, "customer").select(raw.alias("district_name_original")))
    both = kept.select(F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reason")).unionByName(rejected.select(F.lit(False).alias("kept"), "reason"))
    return both.groupBy("kept", "reason").agg(F.count("*").alias("n"))


@query("SELECT p_partkey%7=0 AS twice, p_partkey FROM part UNION ALL SELECT true, p_partkey FROM part WHERE p_partkey%7=0")
def csv_round_trip(spark, sf):
    """A table written as CSV and read back under a schema."""
    path = step_path(spark, "csv")
    p = table(spark, sf, "part").select((F.col("p_partkey") % 7 == 0).alias("twice"), "p_partkey")
    S.write_csv(p.unionByName(p.filter("twice")), path)
    return S.read_csv(spark, path, "twice BOOLEAN, p_partkey BIGINT")


@query("SELECT p_partkey, string_split(p_name,' ')[1] AS first_name, string_split(p_name,' ')[2] AS second_name, 2::BIGINT AS n FROM part")
def parse_multi_name(spark, sf):
    names = X.parse_multi_name(F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(" And ")), F.lit(". ,, ")))
    return table(spark, sf, "part").select("p_partkey", names.alias("n")).select("p_partkey", F.get("n", F.lit(0)).alias("first_name"), F.get("n", F.lit(1)).alias("second_name"), F.size("n").cast("long").alias("n"))


@query("SELECT c_custkey, (c_custkey%5<>0) AS unnamed FROM customer")
def sentinel_filter(spark, sf):
    k = F.col("c_custkey") % 5
    raw = F.when(k == 1, " N/A").when(k == 2, "--").when(k == 3, "Data not available").when(k == 4, F.lit(None)).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", X.is_unnamed(raw).alias("unnamed"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity*1000>0 AND l_extendedprice>0 THEN greatest(0.5, least(l_quantity*1000,l_extendedprice)*0.0001) ELSE 0.5 END AS threshold FROM lineitem")
def sliver_threshold(spark, sf):
    t = N.sliver_threshold(F.col("l_quantity") * 1000, F.col("l_extendedprice"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", t.alias("threshold"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE abs(l_extendedprice-l_quantity*1500) <= greatest(5.0, abs(l_quantity*1500)*0.1)) AS n_within FROM lineitem GROUP BY 1")
def within_tolerance(spark, sf):
    ok = N.within_tolerance(F.col("l_extendedprice"), F.col("l_quantity") * 1500, 5.0, 10.0)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(ok).alias("n_within"))


@query("""WITH v AS (SELECT unnest([1993,1995,1998,2000]) y) SELECT o_orderkey, year(o_orderdate)::INT AS year, (SELECT max(y) FROM v WHERE y<year(o_orderdate))::INT AS pre, (SELECT min(y) FROM v WHERE y>year(o_orderdate))::INT AS post FROM orders""")
def bracket_asof(spark, sf):
    year = F.year("o_orderdate")
    pre, post = N.bracket(year, (1993, 1995, 1998, 2000))
    return table(spark, sf, "orders").select("o_orderkey", year.alias("year"), pre.alias("pre"), post.alias("post"))


#: The same fold over letters, as DuckDB's Jaro halves transpositions to whole numbers.
JARO = """WITH p AS (SELECT a.p_partkey a, b.p_partkey b, a.p_name x, b.p_name y, length(a.p_name) la, length(b.p_name) lb, greatest(greatest(length(a.p_name),length(b.p_name))//2-1,0) r FROM part a JOIN part b ON b.p_partkey=a.p_partkey+1),
 t AS (SELECT *, list_reduce(list_prepend([]::BIGINT[], list_transform(range(la), lambda i: [i])), lambda m, e: m || coalesce(list_filter(range(greatest(e[1]-r,0), least(e[1]+r,lb-1)+1), lambda j: y[j+1]=x[e[1]+1] AND NOT list_contains(m,j))[1:1], [])) m FROM p),
 j AS (SELECT *, len(list_filter(range(1,len(m)+1), lambda i: y[m[i]+1] <> y[list_sort(m)[i]+1]))/2.0 s, (CASE WHEN x[1:1]=y[1:1] THEN 1 ELSE 0 END)+(CASE WHEN x[2]=y[2] AND la>1 AND lb>1 THEN 1 ELSE 0 END)+(CASE WHEN x[3]=y[3] AND la>2 AND lb>2 THEN 1 ELSE 0 END)+(CASE WHEN x[4]=y[4] AND la>3 AND lb>3 THEN 1 ELSE 0 END) same FROM t),
 v AS (SELECT *, CASE WHEN x=y THEN 1.0::DOUBLE WHEN len(m)=0 THEN 0.0::DOUBLE ELSE (len(m)/la+len(m)/lb+(len(m)-s)/len(m))/3 END j FROM j)
 SELECT a, b, round(j+same*0.1*(1-j),6) AS similarity FROM v"""


@query(JARO)
def name_similarity(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"))
    b = a.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(X.name_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


# --- atoms to matrix --------------------------------------------------------------------------------------------------


@query(q("SELECT y AS year, u AS unit, obs, state, area, ordinal FROM lay"), False)
def layers(d):
    return d.layers.select("year", "unit", "obs", "state", "area", "ordinal")


@query(q("SELECT ya AS year_a, yb AS year_b, oa AS obs_a, ob AS obs_b, area FROM parc"), False)
def overlay_atoms(d):
    return d.parcels


@query(q("SELECT oa AS obs_a, ob AS obs_b, area, sl AS is_sliver FROM flag"), False)
def sliver_flags(d):
    return d.flagged.select("obs_a", "obs_b", "area", "is_sliver")


@query(q("SELECT ya AS year_a, yb AS year_b, oa AS obs_a, ob AS obs_b, area FROM m"), False)
def transition_matrix(d):
    return d.matrix


@query(q("SELECT y AS year, obs, u AS unit, area, lost, sliver, trans AS transition FROM lost", True), True)
def residual_source(d):
    return d.lost


@query(q("SELECT y AS year, obs, u AS unit, area, gained, sliver, trans AS transition FROM gained", True), True)
def residual_target(d):
    return d.gained


@query(q("SELECT obs, abs(trans+lost+sliver-area) AS closure_error, abs(trans+lost+sliver-area)>greatest(2.0,area*0.0015) AS is_violation FROM lost", True), True)
def closure_check(d):
    return T.closure(d.lost).select("obs", F.round("closure_error", 6).alias("closure_error"), "is_violation")


@query(q("""SELECT f.ya AS year_a, f.yb AS year_b, n_parcels, n_slivers, n_source, source_area, transition_area, lost_area, sliver_area, 0.0::DOUBLE AS max_closure_error, 0::BIGINT AS n_violations, n_target, gained_area
 FROM (SELECT ya,yb,count(*) n_parcels, count(*) FILTER (WHERE sl) n_slivers FROM flag GROUP BY 1,2) f
 JOIN (SELECT y,count(*) n_source,sum(area) source_area,sum(trans) transition_area,sum(lost) lost_area,sum(sliver) sliver_area FROM lost GROUP BY 1) a ON a.y=f.ya JOIN (SELECT y,count(*) n_target,sum(gained) gained_area FROM gained GROUP BY 1) b ON b.y=f.yb""", True), True)
def transition_summary(d):
    return T.summary(d.flagged, d.lost, d.gained)


@query(q("SELECT oa AS obs_a, ob AS obs_b, round(o,6) AS outflow_share, round(i,6) AS inflow_share FROM sh"), False)
def outflow_inflow_shares(d):
    return d.shares.select("obs_a", "obs_b", *r6("outflow_share", "inflow_share"))


@query(q("SELECT oa AS obs_a, ob AS obs_b, round(o,6) AS outflow_share FROM ba"), False)
def best_match_out(d):
    return T.best_matches(d.shares, "a").select("obs_a", "obs_b", *r6("outflow_share"))


@query(q("SELECT oa AS obs_a, ob AS obs_b, round(i,6) AS inflow_share FROM bb"), False)
def best_match_in(d):
    return T.best_matches(d.shares, "b").select("obs_a", "obs_b", *r6("inflow_share"))


@query(q("SELECT y AS year_a, oa AS obs_a, ob AS obs_b, round(s,6) AS share FROM (SELECT ya y, oa, ob, o s FROM sh UNION ALL SELECT y, obs, 'LOST', (lost+sliver)/area FROM lost WHERE lost+sliver>0)", True), True)
def normalised_rows(d):
    return T.normalised(d.shares, d.lost, d.gained, "a").select("year_a", "obs_a", "obs_b", *r6("share"))


@query(q("SELECT y AS year_b, oa AS obs_a, ob AS obs_b, round(s,6) AS share FROM (SELECT yb y, oa, ob, i s FROM sh UNION ALL SELECT y, 'GAINED', obs, (gained+sliver)/area FROM gained WHERE gained+sliver>0)", True), True)
def normalised_columns(d):
    return T.normalised(d.shares, d.lost, d.gained, "b").select("year_b", "obs_a", "obs_b", *r6("share"))


COMPOSED = """, c1 AS (SELECT ya,yb,oa,ob,o s FROM sh), c2 AS (SELECT a.ya,b.yb,a.oa,b.ob,sum(a.s*b.s) s FROM c1 a JOIN c1 b ON b.oa=a.ob GROUP BY 1,2,3,4), c3 AS (SELECT a.ya,b.yb,a.oa,b.ob,sum(a.s*b.s) s FROM c2 a JOIN c1 b ON b.oa=a.ob GROUP BY 1,2,3,4),
 cc AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3) """


@query(q(COMPOSED + "SELECT ya AS year_a, yb AS year_b, oa AS obs_a, ob AS obs_b, round(s,6) AS share FROM cc"), False)
def matrix_composition(d):
    return T.compose(d.shares, VINTAGES).select("year_a", "year_b", "obs_a", "obs_b", *r6("share"))


@query(q(COMPOSED.replace("o s FROM sh", "i s FROM sh") + "SELECT oa AS ancestor, ob AS obs, round(s,6) AS share FROM cc WHERE ya=1995 AND yb=2001"), False)
def ancestry(d):
    return T.compose(d.shares, VINTAGES, "inflow_share").filter((F.col("year_a") == VINTAGES[0]) & (F.col("year_b") == VINTAGES[-1])).select(F.col("obs_a").alias("ancestor"), F.col("obs_b").alias("obs"), *r6("share"))


# --- identity, lineage, ledger ----------------------------------------------------------------------------------------


@query(q("SELECT oa AS obs_a, ob AS obs_b FROM mut"), False)
def mutual_best(d):
    return I.mutual_best(d.shares).select("obs_a", "obs_b")


@query(q("SELECT oa AS obs_a, ob AS obs_b, round(o,6) AS outflow_share, round(i,6) AS inflow_share FROM cont"), False)
def continuity_edges(d):
    return d.continuity.select("obs_a", "obs_b", *r6("outflow_share", "inflow_share"))


@query(q("SELECT obs, root FROM walk"), False)
def chain_roots(d):
    return d.roots.select("obs", "root")


@query(q("SELECT obs, ck AS canonical_key FROM ok"), False)
def obs_to_key(d):
    return d.keys.select("obs", "canonical_key")


@query(q("SELECT ck AS canonical_key, est AS established_year, closed AS closed_year, nm AS display_name, st AS state_at_creation, closed IS NULL AS is_active, CASE WHEN est=1995 THEN 'ANCHOR' ELSE 'NEW' END AS origin_kind FROM reg"), False)
def ck_registry(d):
    return d.registry


@query(q("SELECT ya AS year_a, f AS from_ck, t AS to_ck, area, round(o,6) AS outflow_share, round(i,6) AS inflow_share FROM tr"), False)
def ck_transitions(d):
    return d.transitions.select("year_a", "from_ck", "to_ck", "area", *r6("outflow_share", "inflow_share"))


@query("""WITH known AS (SELECT DISTINCT c_mktsegment nk FROM customer WHERE c_mktsegment < 'C'), k AS (SELECT nk, row_number() OVER (ORDER BY nk) n FROM known),
 new AS (SELECT c_mktsegment nk, row_number() OVER (ORDER BY c_mktsegment) n FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment >= 'C'))
 SELECT nk AS natural_key, 'IND-'||lpad(n::VARCHAR,6,'0') AS canonical_key FROM k UNION ALL SELECT nk, 'IND-'||lpad((n+(SELECT count(*) FROM k))::VARCHAR,6,'0') FROM new""")
def get_or_create_keys(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("natural_key"))
    old = wanted.filter("natural_key < 'C'").distinct()
    known = old.withColumn("canonical_key", F.format_string("IND-%06d", F.row_number().over(Window.orderBy("natural_key"))))
    return I.get_or_create(known, wanted)


@query(q("SELECT f AS from_ck, t AS to_ck, ya AS year_a, area, lin AS is_lineage FROM cx"), False)
def lineage_vs_transfer(d):
    return d.crossed.select("from_ck", "to_ck", "year_a", "area", "is_lineage")


@query(q("SELECT left(sha256('TRANSFER|'||f||'|'||t||'|'||ya||'|'||yb),32) AS transfer_id, f AS from_ck, t AS to_ck, area AS transferred_area FROM cx WHERE NOT lin"), False)
def measured_transfers(d):
    return L.transfers(d.crossed).select("transfer_id", "from_ck", "to_ck", "transferred_area")


@query(q("SELECT f AS from_ck, t AS to_ck, ya AS year_a, typ AS relationship_type FROM ed"), False)
def relationship_type(d):
    return d.edges.select("from_ck", "to_ck", "year_a", "relationship_type")


CORROBORATED = """, prs AS (SELECT a.id, lower(replace(a.nm,'.','')) p, lower(a.state) ps, lower(replace(b.nm,'.','')) s, lower(b.state) ss, e.yr FROM part a JOIN part b ON a.id=b.id AND a.rl='PREDECESSOR' AND b.rl='SUCCESSOR' JOIN ev e ON e.id=a.id),
 cor AS (SELECT e.f, e.t, e.ya, e.yb, min(CASE WHEN x.ps=lower(b.st) AND x.ss=lower(b.st) THEN x.id END) strong, min(x.id) weak FROM ed e JOIN reg a ON a.ck=e.f JOIN reg b ON b.ck=e.t LEFT JOIN prs x ON x.p=lower(replace(a.nm,'.','')) AND x.s=lower(replace(b.nm,'.','')) AND x.yr BETWEEN e.ya-1 AND e.yb+3 GROUP BY 1,2,3,4) """


@query(q(CORROBORATED + "SELECT f AS from_ck, t AS to_ck, ya AS year_a, CASE WHEN strong IS NOT NULL THEN 'GAZETTE_CORROBORATED' WHEN weak IS NOT NULL THEN 'GAZETTE_CORROBORATED_WEAK' ELSE 'SPATIAL_INFERRED' END AS lineage_basis, coalesce(strong,weak) AS supporting_event_id, CASE WHEN strong IS NOT NULL THEN 0.95 WHEN weak IS NOT NULL THEN 0.85 ELSE 0.7 END::DOUBLE AS lineage_confidence FROM cor"), False)
def corroboration(d):
    return d.corroborated.select("from_ck", "to_ck", "year_a", "lineage_basis", "supporting_event_id", "lineage_confidence")


@query(q("SELECT e.f AS from_ck, e.t AS to_ck FROM ed e JOIN reg a ON a.ck=e.f JOIN reg b ON b.ck=e.t WHERE b.est<a.est"), False)
def dag_check(d):
    return L.backward_edges(d.edges, d.registry).select("from_ck", "to_ck")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey f, (s_nationkey*s_nationkey+1)%25 t FROM supplier), w(s,a,n) AS (SELECT f,t,1 FROM e UNION ALL SELECT w.s,e.t,w.n+1 FROM w JOIN e ON e.f=w.a WHERE w.n<15 AND w.s<>w.a) SELECT DISTINCT s::VARCHAR AS canonical_key FROM w WHERE s=a""")
def lineage_cycles(spark, sf):
    n = F.col("s_nationkey")
    edges = table(spark, sf, "supplier").select(n.cast("string").alias("from_ck"), ((n * n + 1) % 25).cast("string").alias("to_ck"))
    return L.cycles(spark, edges)


LEDGER = """, kd AS (SELECT tr.*, CASE WHEN tr.f=tr.t THEN 'S' WHEN c.lin THEN 'L' ELSE 'T' END kind FROM tr LEFT JOIN cx c ON c.f=tr.f AND c.t=tr.t AND c.ya=tr.ya),
 ob_ AS (SELECT ok.ck, l.y, l.area, l.lost, l.sliver, coalesce(sum(k.area) FILTER (WHERE kind='S'),0) s, coalesce(sum(k.area) FILTER (WHERE kind='L'),0) l_, coalesce(sum(k.area) FILTER (WHERE kind='T'),0) t_ FROM lost l JOIN ok ON ok.obs=l.obs LEFT JOIN kd k ON k.f=ok.ck AND k.ya=l.y GROUP BY 1,2,3,4,5) """


@query(q(LEDGER + "SELECT ck AS canonical_key, y AS year_a, area, s AS retained, l_ AS to_lineage, t_ AS to_transfer, lost, sliver, round(abs(s+l_+t_+lost+sliver-area),6) AS closure_error FROM ob_"), False)
def ledger_outbound(d):
    rows = L.ledger(d.transitions, d.crossed, d.lost, d.gained, d.keys, d.registry).filter("entry = 'OUTBOUND'")
    return rows.select("canonical_key", "year_a", "area", "retained", "to_lineage", "to_transfer", "lost", "sliver", *r6("closure_error"))


@query(q(LEDGER + "SELECT k.t AS canonical_key, k.ya AS year_a, g.area, sum(k.area) AS received, g.gained FROM kd k JOIN reg r ON r.ck=k.t AND r.est<>k.yb JOIN ok ON ok.ck=k.t AND ok.y=k.yb JOIN gained g ON g.obs=ok.obs WHERE kind='T' GROUP BY 1,2,3,5"), False)
def ledger_inbound(d):
    rows = L.ledger(d.transitions, d.crossed, d.lost, d.gained, d.keys, d.registry).filter("entry = 'INBOUND'")
    return rows.select("canonical_key", "year_a", "area", "received", "gained")


@query(q(COMPOSED + ", ci AS (SELECT a.ya,b.yb,a.oa,b.ob,sum(a.i*b.i) s FROM sh a JOIN sh b ON b.oa=a.ob GROUP BY 1,2,3,4) SELECT a.ck AS from_ck, b.ck AS to_ck, c2.ya AS year_a, c2.yb AS year_b FROM c2 JOIN ci USING (ya,yb,oa,ob) JOIN ok a ON a.obs=oa JOIN ok b ON b.obs=ob WHERE c2.s>=0.9 AND ci.s>=0.9 AND a.ck<>b.ck"), False)
def reconstituted(d):
    span = ["year_a", "year_b", "obs_a", "obs_b"]
    far = T.compose(d.shares, VINTAGES).withColumnRenamed("share", "outflow_share").join(T.compose(d.shares, VINTAGES, "inflow_share").withColumnRenamed("share", "inflow_share"), span).filter("year_b - year_a = 4")
    return C.reconstituted(d.layers, d.keys, far, SETTINGS).select("from_ck", "to_ck", "year_a", "year_b")


# --- events -----------------------------------------------------------------------------------------------------------


@query(q("SELECT id AS event_id, et AS event_type, state, par AS parent_district, yr AS effective_year, len(chs)::INT AS n_successors, srcs AS sources_cited, n AS n_csv_rows FROM ev"), False)
def event_grain(d):
    return d.events.select("event_id", "event_type", "state", "parent_district", "effective_year", "n_successors", "sources_cited", "n_csv_rows")


@query("SELECT event_type, user_id, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value),6) AS total, array_to_string(list_sort(list(DISTINCT (event_id%7)::VARCHAR)),';') AS kinds FROM events GROUP BY 1,2,3")
def event_grain_daily(spark, sf):
    kinds = F.concat_ws(";", F.array_sort(F.collect_set((F.col("event_id") % 7).cast("string"))))
    return table(spark, sf, "events").groupBy("event_type", "user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), kinds.alias("kinds"))


@query(q("SELECT id AS event_id, rl AS role, nm AS district_name_raw, state FROM part"), False)
def participants(d):
    return d.participants


@query(q("SELECT id AS event_id, count(*) AS n FROM ev GROUP BY 1 HAVING count(*)>1"), False)
def dup_id_check(d):
    return E.duplicate_ids(d.events)


@query(q("SELECT DISTINCT ch AS district_name_raw FROM raw WHERE ch NOT IN (SELECT nm FROM part WHERE rl='SUCCESSOR')"), False)
def lost_children(d):
    return E.lost_children(d.raw_events, d.participants)


@query(q("SELECT id AS event_id, rl AS role, nm AS district_name_raw, ck AS canonical_key, how AS match_method FROM nmd"), False)
def resolve_two_tier(d):
    return d.named.select("event_id", "role", "district_name_raw", "canonical_key", "match_method")


ACCOUNTED = """, tot AS (SELECT id, count(*) n, count(ck) r FROM nmd GROUP BY 1),
 prs AS (SELECT d.id, d.pre, d.post, a.nm p, b.nm s, a.ck pk, b.ck sk, f.area FROM dated d JOIN nmd a ON a.id=d.id AND a.rl='PREDECESSOR' AND a.ck IS NOT NULL JOIN nmd b ON b.id=d.id AND b.rl='SUCCESSOR' AND b.ck IS NOT NULL LEFT JOIN flow f ON f.ya=d.pre AND f.yb=d.post AND f.f=a.ck AND f.t=b.ck WHERE d.pre IS NOT NULL AND d.post IS NOT NULL),
 acc AS (SELECT p.id, p.p predecessor, p.s successor, p.pk predecessor_ck, p.sk successor_ck, round(area,4) transferred_area, CASE WHEN t.r<t.n THEN 'PARTIALLY_RESOLVED' WHEN area>0 THEN 'MEASURED' ELSE 'RESOLVED_NO_OVERLAP' END st FROM prs p JOIN tot t ON t.id=p.id
 UNION ALL SELECT d.id, CASE WHEN pre IS NOT NULL AND post IS NOT NULL THEN (SELECT string_agg(nm,'; ' ORDER BY nm) FROM nmd WHERE nmd.id=d.id AND rl='PREDECESSOR') END, CASE WHEN pre IS NOT NULL AND post IS NOT NULL THEN (SELECT string_agg(nm,'; ' ORDER BY nm) FROM nmd WHERE nmd.id=d.id AND rl='SUCCESSOR') END, NULL, NULL, NULL,
  CASE WHEN pre IS NULL OR post IS NULL THEN 'NO_BRACKETING_VINTAGE' WHEN t.r=0 THEN 'UNRESOLVED_NAME' WHEN t.r<t.n THEN 'PARTIALLY_RESOLVED' ELSE 'UNRESOLVED_NAME' END FROM dated d JOIN tot t ON t.id=d.id WHERE d.id NOT IN (SELECT id FROM prs)) """


@query(q(ACCOUNTED + "SELECT id AS event_id, predecessor, successor, predecessor_ck, successor_ck, transferred_area, st AS measurement_status FROM acc"), False)
def event_accounting(d):
    out = E.accounting(d.events, d.named, d.matrix, d.keys, VINTAGES)
    return out.select("event_id", "predecessor", "successor", "predecessor_ck", "successor_ck", "transferred_area", "measurement_status")


@query(q("SELECT ck AS canonical_key, pre, post, count(DISTINCT id) AS n_events, CASE WHEN count(DISTINCT id)=1 THEN 'ATTRIBUTABLE' ELSE 'JOINT' END AS identifiability FROM nmd WHERE ck IS NOT NULL GROUP BY 1,2,3"), False)
def identifiability(d):
    return E.identifiability(d.events, d.named)


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey%2) DESC, o_orderstatus DESC, o_orderkey DESC) p FROM orders) WHERE p=1")
def alias_dedup_keep_last(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return E.keep_last(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["o_custkey"])


# --- reconciliation ---------------------------------------------------------------------------------------------------

CLASSES = """, pc AS (SELECT p.id, count(*) np, count(*) FILTER (WHERE r.closed=p.post) nc, min(p.pre) pre, min(p.post) post, list(p.ck) pks FROM prd p LEFT JOIN reg r ON r.ck=p.ck GROUP BY 1),
 sc AS (SELECT s.id, count(*) ns, count(*) FILTER (WHERE r.est=d.post) nn, list(s.ck) sks FROM suc s LEFT JOIN reg r ON r.ck=s.ck JOIN dated d ON d.id=s.id GROUP BY 1),
 cl AS (SELECT e.id, e.et, coalesce(np,0) np, coalesce(ns,0) ns, coalesce(nc,0) nc, coalesce(nn,0) nn, pc.pre, pc.post, (SELECT count(*) FROM prd p JOIN suc s ON s.id=p.id AND s.ck=p.ck WHERE p.id=e.id) shd FROM ev e LEFT JOIN pc ON pc.id=e.id LEFT JOIN sc ON sc.id=e.id),
 cls AS (SELECT *, CASE et WHEN 'RENAME' THEN 'RENAME' WHEN 'SPLIT' THEN CASE WHEN ns=3 THEN 'TRIFURCATION' WHEN ns>3 THEN 'MULTIWAY_SPLIT' ELSE 'SPLIT' END WHEN 'NEW_DISTRICT' THEN CASE WHEN np>1 THEN 'REORGANISATION' ELSE 'CARVE_OUT' END ELSE 'UNKNOWN' END ac,
  CASE WHEN np=0 OR ns=0 OR pre IS NULL OR post IS NULL THEN 'UNKNOWN' WHEN shd=least(np,ns) THEN 'RENAME_NO_MATERIAL_CHANGE' WHEN nc=1 AND np=1 AND nn>0 THEN CASE WHEN ns=1 THEN 'CLEAN_SPLIT_SINGLE' ELSE 'CLEAN_SPLIT_'||ns||'_WAY' END
   WHEN np>nc AND nn>0 THEN CASE WHEN np=1 THEN 'CARVE_OUT' ELSE 'MULTI_PARENT_CARVE_OUT' END WHEN nc>=2 AND ns=1 AND nn>0 THEN 'MERGER' WHEN np>nc AND ns>nn THEN 'TERRITORIAL_TRANSFER_CONTINUING' ELSE 'COMPLEX_REORGANISATION' END sp FROM cl) """


@query(q(CLASSES + "SELECT id AS event_id, np AS n_pred, ns AS n_succ, ac AS administrative_class FROM cls"), False)
def admin_class(d):
    return R.classes(d.events, d.named, d.registry).select("event_id", "n_pred", "n_succ", "administrative_class")


@query(q(CLASSES + "SELECT id AS event_id, sp AS spatial_class FROM cls"), False)
def spatial_class(d):
    return R.classes(d.events, d.named, d.registry).select("event_id", "spatial_class")


@query(q("SELECT id AS event_id, pk AS pred_ck, sk AS succ_ck, sa AS source_area, ta AS target_area, area, round(CASE WHEN sa>0 THEN area/sa*100 ELSE 0 END,6) AS pct_of_source, round(CASE WHEN ta>0 THEN area/ta*100 ELSE 0 END,6) AS pct_of_target FROM ctr"), False)
def contributions(d):
    return d.contributed.select("event_id", "pred_ck", "succ_ck", "source_area", "target_area", "area", *r6("pct_of_source", "pct_of_target"))


@query(q("SELECT id AS event_id, pk AS pred_ck, sk AS succ_ck, area, CASE WHEN pk=sk THEN 'RETAINED' ELSE 'CARVED_OUT' END AS transfer_type, CASE WHEN ph='STATE_SCOPED' AND sho='STATE_SCOPED' THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence FROM ctr"), False)
def transfer_rows(d):
    return R.transfer_rows(d.contributed).select("event_id", "pred_ck", "succ_ck", "area", "transfer_type", "confidence")


@query(q("SELECT id AS event_id, pk AS pred_ck, sa AS source_area, acc AS accounted_area, res AS residual_area, round(pct,6) AS residual_pct FROM kpt"), False)
def conservation(d):
    return d.kept.select("event_id", "pred_ck", "source_area", "accounted_area", "residual_area", *r6("residual_pct"))


@query(q("SELECT id AS event_id, pk AS pred_ck, status AS accounting_status, reason AS residual_reason, ck AS candidate_ck, round(score,6) AS candidate_score FROM aud"), False)
def recovery_score(d):
    return d.audited.select("event_id", "pred_ck", "accounting_status", "residual_reason", "candidate_ck", *r6("candidate_score"))


@query(q("SELECT id AS event_id, status AS event_status, sa AS source_area, acc AS accounted_area, res AS residual_area, n AS n_rows FROM sta"), False)
def event_status(d):
    return d.status.select("event_id", "event_status", "source_area", "accounted_area", "residual_area", "n_rows")


@query(q("SELECT yr AS effective_year, count(*) AS n_events FROM sta WHERE status='RECOVERED' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"), False)
def recovered_events_by_year(d):
    return R.events_by(d.status, d.events, "effective_year", "RECOVERED")


@query(q("SELECT e.state, count(*) AS n_events FROM sta s JOIN ev e ON e.id=s.id WHERE s.status='RECOVERED' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"), False)
def recovered_events_by_state(d):
    return R.events_by(d.status, d.events, "state", "RECOVERED")


@query(q("SELECT s.id AS event_id, s.status AS event_status, coalesce((SELECT string_agg(DISTINCT nm,' | ' ORDER BY nm) FROM part p WHERE p.id=s.id AND rl='PREDECESSOR'),'') AS predecessors, coalesce((SELECT string_agg(DISTINCT nm,' | ' ORDER BY nm) FROM part p WHERE p.id=s.id AND rl='SUCCESSOR'),'') AS successors FROM sta s"), False)
def event_summary(d):
    return R.event_summary(d.status, d.named).select("event_id", "event_status", "predecessors", "successors")


@query(q(CLASSES + """SELECT 'within_tolerance' AS name, count(*) FILTER (WHERE status='IGNORABLE_RESIDUAL') AS value FROM aud UNION ALL SELECT 'recovered', count(*) FILTER (WHERE status='RECOVERED_BY_ADJACENCY') FROM aud UNION ALL SELECT 'unresolved', count(*) FILTER (WHERE status='UNRESOLVED_RESIDUAL') FROM aud UNION ALL SELECT 'negative_areas', count(*) FILTER (WHERE res<0) FROM aud
 UNION ALL SELECT 'events', count(*) FROM sta UNION ALL SELECT 'events_reconciled', count(*) FILTER (WHERE status='RECONCILED') FROM sta UNION ALL SELECT 'events_without_geometry', count(*) FILTER (WHERE status='NO_GEOMETRY') FROM sta UNION ALL SELECT 'labels_differ', count(*) FILTER (WHERE sp<>'UNKNOWN' AND ac<>sp) FROM cls"""), False)
def qc_counters(d):
    return R.quality_counters(d.audited, d.status, R.classes(d.events, d.named, d.registry))


@query(q("SELECT status AS accounting_status, reason AS residual_reason, count(*) AS n, sum(res) AS residual_area FROM aud GROUP BY 1,2"), False)
def residual_reason_counts(d):
    return R.reason_counts(d.audited)


@query(q("SELECT id AS event_id, pk AS pred_ck, res AS residual_area FROM aud ORDER BY res DESC, id, pk LIMIT 20"), False)
def top_residuals(d):
    return R.top_residuals(d.audited).select("event_id", "pred_ck", "residual_area")


@query(q("""SELECT s.id AS event_id, s.et||' in '||s.yr||': '||coalesce((SELECT string_agg(DISTINCT nm,' | ' ORDER BY nm) FROM part p WHERE p.id=s.id AND rl='PREDECESSOR'),'unknown')||' became '||coalesce((SELECT string_agg(DISTINCT nm,' | ' ORDER BY nm) FROM part p WHERE p.id=s.id AND rl='SUCCESSOR'),'unknown')||'; '||
 printf('%.2f',acc)||' of '||printf('%.2f',sa)||' accounted for, '||printf('%.2f',res)||' left ('||status||').' AS narrative FROM sta s"""), False)
def narratives(d):
    return R.narrative(R.event_summary(d.status, d.named))


# --- discovery --------------------------------------------------------------------------------------------------------


def _l1(d: Derived) -> DataFrame:
    return D.alias_hits(d.open_rows, d.aliases, d.aliases, d.by_state, d.by_name)


def _l2(d: Derived) -> DataFrame:
    return D.cross_state_hits(d.open_rows, d.layer_names, d.by_state, d.by_name, d.state_successors, d.aliases, SETTINGS)


def _cands(d: Derived) -> DataFrame:
    found = D.overlap_candidates(d.open_rows.drop("n_declared"), d.overlaps, SETTINGS)
    return D.scored(found, d.declared, d.relations, d.units, d.state_successors, SETTINGS)


@query(q("SELECT id AS event_id, pk AS pred_ck, ck AS l1_ck, ety AS evidence_type FROM l1"), False)
def l1_alias(d):
    return _l1(d).select("event_id", "pred_ck", "l1_ck", "evidence_type")


@query(q("SELECT id AS event_id, pk AS pred_ck, ck AS l2_ck, why AS l2_reason FROM l2"), False)
def l2_cross(d):
    return _l2(d)


@query(q("SELECT id AS event_id, pk AS pred_ck, ck AS cand_ck, area, round(pp,6) AS pct_pre, round(pc,6) AS pct_cand FROM cnd0"), False)
def l3_overlap_candidates(d):
    return D.overlap_candidates(d.open_rows, d.overlaps, SETTINGS).select("event_id", "pred_ck", "cand_ck", "area", *r6("pct_pre", "pct_cand"))


@query(q("SELECT id AS event_id, pk AS pred_ck, ck AS cand_ck, round(sc,5) AS spatial_confidence, round(ac,5) AS administrative_confidence FROM cnd"), False)
def spatial_confidence(d):
    return _cands(d).select("event_id", "pred_ck", "cand_ck", F.round("spatial_confidence", 5).alias("spatial_confidence"), F.round("administrative_confidence", 5).alias("administrative_confidence"))


@query(q("SELECT id AS event_id, pk AS pred_ck, ck AS cand_ck, round(tot,5) AS candidate_score, rk::INT AS spatial_rank, cs AS candidate_status FROM cnd WHERE rk<=30"), False)
def candidate_rank(d):
    return _cands(d).filter(F.col("spatial_rank") <= SETTINGS.candidates_kept).select("event_id", "pred_ck", "cand_ck", F.round("candidate_score", 5).alias("candidate_score"), "spatial_rank", "candidate_status")


def ladder_sql(named: bool) -> str:
    by_name = "WHEN l1.ck IS NOT NULL THEN {a} WHEN l2.ck IS NOT NULL THEN {b}" if named else ""
    rung = lambda a, b, *rest: "CASE " + by_name.format(a=a, b=b) + " " + " ".join(f"WHEN {c} THEN {v}" for c, v in zip(CONDITIONS, rest[:-1], strict=True)) + f" ELSE {rest[-1]} END"
    s = lambda x: f"'{x}'"
    un, sp, v = s("UNRESOLVED_GEOMETRIC_RESIDUAL"), s("RECONCILED_BY_SPATIAL_DISCOVERY"), s("DATA_VINTAGE_INSUFFICIENT")
    status = rung(s("RECONCILED_BY_ALIAS"), s("RECONCILED_BY_CROSS_STATE_RESOLUTION"), s("MISSING_SPATIAL_EVIDENCE"), v, un, s("EVENT_GEOMETRY_IDENTITY_MISMATCH"), sp, sp, sp, s("RECONCILED_WITH_IGNORABLE_RESIDUAL"), v, un)
    level = rung("1", "2", "6", "6", "6", "3", "4", "3", "5", "5", "3", "6")
    return (
        ", per AS (SELECT id, pk, max(tot) FILTER (WHERE rk=1) tot, max(cs) FILTER (WHERE rk=1) cs, max(ac) FILTER (WHERE rk=1) ac, bool_or(dc) FILTER (WHERE rk=1) dc, sum(area) dis, bool_or(pcr AND tot>=0.65) chd FROM cnd GROUP BY 1,2) "
        f"SELECT o.id AS event_id, o.pk AS pred_ck, {status} AS final_status, ({level})::INT AS recovery_level FROM opn o LEFT JOIN l1 ON l1.id=o.id AND l1.pk=o.pk LEFT JOIN l2 ON l2.id=o.id AND l2.pk=o.pk LEFT JOIN per p ON p.id=o.id AND p.pk=o.pk"
    )


CONDITIONS = (
    "o.sa<=0", "p.tot IS NULL AND o.yr>=1997", "p.tot IS NULL", "o.nd>0 AND NOT p.dc AND p.cs IN ('CONFIRMED_ADMINISTRATIVE_SUCCESSOR','SPATIALLY_CONFIRMED_BUT_EVENT_UNLISTED') AND p.ac<0.5",
    "p.chd AND greatest(0,(o.res-p.dis)/o.sa*100)<1", "p.tot>=0.65 AND greatest(0,(o.res-p.dis)/o.sa*100)<1", "p.tot>=0.65", "greatest(0,(o.res-p.dis)/o.sa*100)<1", "o.yr>=1997",
)


@query(q(ladder_sql(True)), False)
def ladder(d):
    return D.decide(d.open_rows, _l1(d), _l2(d), _cands(d), SETTINGS).select("event_id", "pred_ck", "final_status", "recovery_level")


@query(q(ladder_sql(False)), False)
def ladder_spatial(d):
    """The same where no name is known elsewhere, so that the lower rungs decide."""
    none = d.open_rows.filter("false")
    return D.decide(d.open_rows, none.select("event_id", "pred_ck", F.col("pred_ck").alias("l1_ck")), none.select("event_id", "pred_ck", F.col("pred_ck").alias("l2_ck")), _cands(d), SETTINGS).select("event_id", "pred_ck", "final_status", "recovery_level")


@query(q("SELECT rn AS raw_name, cn AS canonical_name FROM ali WHERE ety='DOCUMENTARY'"), False)
def alias_promotion(d):
    return D.promoted(d.aliases).select("raw_name", "canonical_name")


LADDER = ladder_sql(True).replace(" SELECT o.id AS event_id", ", lad AS (SELECT o.id AS event_id", 1) + ")"


def _decided(d: Derived) -> DataFrame:
    return D.decide(d.open_rows, _l1(d), _l2(d), _cands(d), SETTINGS)


@query(q(LADDER + " SELECT final_status, recovery_level, count(*) AS n FROM lad GROUP BY 1,2"), False)
def decision_counts(d):
    return D.decision_counts(_decided(d)).groupBy("final_status", "recovery_level").agg(F.sum("n").alias("n"))


@query(q(LADDER + " SELECT c.id AS event_id, c.pk AS pred_ck, c.sk AS succ_ck, c.area AS measured_area, l.final_status AS event_final_status, l.recovery_level AS event_recovery_level FROM ctr c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pred_ck) p FROM lad) WHERE p=1) l ON l.event_id=c.id"), False)
def matrix_augmented(d):
    return D.augmented(R.transfer_rows(d.contributed), _decided(d)).select("event_id", "pred_ck", "succ_ck", "measured_area", "event_final_status", "event_recovery_level")


@query(q(LADDER + " SELECT s.id AS event_id, s.status AS event_status, l.lv AS recovery_level_found, l.ok AS all_reconciled_found FROM sta s LEFT JOIN (SELECT event_id, max(recovery_level) lv, bool_and(final_status LIKE 'RECONCILED%') ok FROM lad GROUP BY 1) l ON l.event_id=s.id"), False)
def event_summary_merged(d):
    return D.merged_summary(d.status, _decided(d)).select("event_id", "event_status", "recovery_level_found", "all_reconciled_found")


def results_sql() -> str:
    """SQL of the whole rows, as a table `res`."""
    s = lambda x: f"'{x}'"
    why = ("ALIAS_RESOLUTION", "CROSS_STATE_IDENTITY_DRIFT", "MISSING_GEOMETRIC_EVIDENCE", "VINTAGE_MISMATCH_RECENT", "GEOMETRY_NOT_AVAILABLE", "EVENT_GEOMETRY_IDENTITY_MISMATCH", "PARENT_CHILD_RECOVERY", "SPATIAL_SUCCESSOR_DISCOVERED", "ADJACENCY_RECOVERY", "BOUNDARY_PRECISION", "VINTAGE_MISMATCH_RECENT", "GENUINELY_UNRESOLVED")
    reason = "CASE WHEN l1.ck IS NOT NULL THEN {} WHEN l2.ck IS NOT NULL THEN {} ".format(*map(s, why[:2])) + " ".join(f"WHEN {c} THEN {s(v)}" for c, v in zip(CONDITIONS, why[2:-1], strict=True)) + f" ELSE {s(why[-1])} END"
    return LADDER + f""", one AS (SELECT id, pk, max(tot) tot, max(cs) cs, max(ac) ac, max(sc) sc, bool_or(dc) dc, max(ck) ck FROM cnd WHERE rk=1 GROUP BY 1,2),
 summed AS (SELECT id, pk, sum(area) dis, count(*) n, arg_min(ck, rk) FILTER (WHERE pcr AND tot>=0.65) child FROM cnd GROUP BY 1,2),
 ful AS (SELECT o.id, o.pk, o.res, o.pct, o.acc, l1.ck k1, l2.ck k2, p.tot, p.cs, p.ac, p.sc, p.ck, m.dis, m.n, m.child, ({reason}) reason, greatest(0,(o.res-m.dis)/o.sa*100) opn, o.sa<=0 OR p.tot IS NULL blind, (o.nd>0 AND NOT p.dc AND p.cs IN ('CONFIRMED_ADMINISTRATIVE_SUCCESSOR','SPATIALLY_CONFIRMED_BUT_EVENT_UNLISTED') AND p.ac<0.5) mis
  FROM opn o LEFT JOIN l1 ON l1.id=o.id AND l1.pk=o.pk LEFT JOIN l2 ON l2.id=o.id AND l2.pk=o.pk LEFT JOIN (SELECT one.*, s.dis, s.child IS NOT NULL chd FROM one JOIN summed s ON s.id=one.id AND s.pk=one.pk) p ON p.id=o.id AND p.pk=o.pk LEFT JOIN summed m ON m.id=o.id AND m.pk=o.pk),
 rst AS (SELECT f.id AS event_id, f.pk AS pred_ck, a.status AS initial_status, round(f.pct,6) AS initial_residual_pct, round(f.acc,6)::DOUBLE AS raw_intersection_area, round(CASE WHEN coalesce(k1,k2) IS NOT NULL THEN 0 WHEN blind THEN f.pct ELSE opn END,6)::DOUBLE AS post_discovery_residual_pct, l.final_status, f.reason, l.recovery_level,
  (CASE WHEN coalesce(k1,k2) IS NOT NULL THEN 0 ELSE coalesce(f.n,0) END)::BIGINT AS candidate_count, CASE WHEN coalesce(k1,k2) IS NOT NULL THEN coalesce(k1,k2) WHEN blind THEN '' ELSE f.ck END AS best_candidate_ck, CASE WHEN coalesce(k1,k2) IS NULL AND blind THEN NULL ELSE coalesce(k1,k2,CASE WHEN child IS NOT NULL AND opn<1 AND NOT mis THEN child END,f.ck) END AS chosen_ck,
  CASE WHEN coalesce(k1,k2) IS NOT NULL OR blind THEN 0 ELSE f.tot END::DOUBLE AS best_candidate_score, CASE WHEN coalesce(k1,k2) IS NOT NULL THEN 'CONFIRMED_ADMINISTRATIVE_SUCCESSOR' WHEN blind THEN 'NO_VALID_SPATIAL_SUCCESSOR' ELSE f.cs END AS candidate_status,
  (CASE WHEN k1 IS NOT NULL THEN 1 WHEN k2 IS NOT NULL THEN 0.9 ELSE coalesce(f.sc,0) END)::DOUBLE AS spatial_confidence, (CASE WHEN k1 IS NOT NULL THEN 1 WHEN k2 IS NOT NULL THEN 0.9 WHEN blind THEN 0 ELSE f.ac END)::DOUBLE AS administrative_confidence,
  round(CASE WHEN coalesce(k1,k2) IS NOT NULL THEN f.res WHEN blind THEN 0 ELSE least(dis,f.res) END,6)::DOUBLE AS recovered_area, round(f.res-(CASE WHEN coalesce(k1,k2) IS NOT NULL THEN f.res WHEN blind THEN 0 ELSE least(dis,f.res) END),6)::DOUBLE AS unresolved_area
  FROM ful f JOIN lad l ON l.event_id=f.id AND l.pred_ck=f.pk JOIN aud a ON a.id=f.id AND a.pk=f.pk)
"""


def _results(d: Derived) -> DataFrame:
    whole = D.results(_decided(d), d.audited, d.registry)
    return whole.withColumns({c: F.round(c, 6) for c in ("initial_residual_pct", "raw_intersection_area", "post_discovery_residual_pct", "recovered_area", "unresolved_area")})


@query(q(results_sql() + """SELECT r.*, coalesce(g.nm, r.best_candidate_ck) AS best_candidate, reason='CROSS_STATE_IDENTITY_DRIFT' AS cross_state_transition, final_status<>'EVENT_GEOMETRY_IDENTITY_MISMATCH' AS administrative_spatial_agreement, 'L'||recovery_level||'|'||reason AS provenance FROM rst r LEFT JOIN reg g ON g.ck=r.best_candidate_ck"""), False)
def discovery_result(d):
    """The whole row that discovery gives for each open residual."""
    return _results(d)


@query(q(results_sql() + "SELECT event_id, pred_ck, best_candidate_ck, recovered_area, unresolved_area FROM rst WHERE reason='CROSS_STATE_IDENTITY_DRIFT'"), False)
def cross_state_resolutions(d):
    return D.by_reason(_results(d), "CROSS_STATE_IDENTITY_DRIFT")


@query(q(results_sql() + "SELECT event_id, pred_ck, best_candidate_ck, recovered_area, unresolved_area FROM rst ORDER BY unresolved_area DESC, event_id, pred_ck LIMIT 20"), False)
def largest_unresolved(d):
    return D.largest_unresolved(_results(d)).select("event_id", "pred_ck", "best_candidate_ck", "recovered_area", "unresolved_area")


@query(q("SELECT 'state' AS by, e.state AS value, count(*) AS n_events FROM sta s JOIN ev e ON e.id=s.id WHERE s.status='UNRESOLVED' GROUP BY 2 UNION ALL SELECT 'year', yr::VARCHAR, count(*) FROM sta WHERE status='UNRESOLVED' GROUP BY 2").replace("score>=0.65 THEN 'RECOVERED", "score>=0.95 THEN 'RECOVERED"), False)
def unresolved_by_state_and_year(d):
    """Events of each state and of each year that stay unresolved if no successor's area alone recovers them."""
    strict = replace(SETTINGS, recovery_threshold=0.95)
    status = R.event_status(d.events, R.recovered(d.kept, d.contributed, strict))
    one = lambda c: R.events_by(status, d.events, c, "UNRESOLVED", None).select(F.lit(c.removeprefix("effective_")).alias("by"), F.col(c).cast("string").alias("value"), "n_events")
    return one("state").unionByName(one("effective_year"))


# --- backfill, crosswalk, records -------------------------------------------------------------------------------------

ANCESTORS = """, anc(ck, e) AS (SELECT ck, est FROM reg WHERE ck NOT IN (SELECT t FROM ed) UNION SELECT ed.t, a.e FROM anc a JOIN ed ON ed.f=a.ck), ear AS (SELECT ck, min(e) e FROM anc GROUP BY 1) """
#: Edges lead to keys that begin in the window, so an ancestor's areas are known or filled in an earlier pass.
FILLED = ANCESTORS + """, grid AS (SELECT r.ck, y, a.area FROM reg r CROSS JOIN yrs LEFT JOIN ar a USING (ck, y)),
 rel AS (SELECT * FROM (SELECT g.ck, g.y, e.f, e.o, e.ya, max(e.ya>=g.y) OVER w lat, min(e.ya) OVER w fst FROM grid g JOIN ed e ON e.t=g.ck WHERE g.area IS NULL WINDOW w AS (PARTITION BY g.ck,g.y)) WHERE (lat AND ya>=y) OR (NOT lat AND ya=fst)),
 f0 AS (SELECT ck,y,area FROM grid),
 f1 AS (SELECT ck,y,coalesce(f0.area,(SELECT sum(CASE WHEN b.area>0 THEN b.area*r.o END) FROM rel r JOIN f0 b ON b.ck=r.f AND b.y=r.y WHERE r.ck=f0.ck AND r.y=f0.y)) area FROM f0),
 f2 AS (SELECT f0.ck,f0.y,coalesce(f0.area,(SELECT sum(CASE WHEN b.area>0 THEN b.area*r.o END) FROM rel r JOIN f1 b ON b.ck=r.f AND b.y=r.y WHERE r.ck=f0.ck AND r.y=f0.y)) area FROM f0),
 f3 AS (SELECT f0.ck,f0.y,coalesce(f0.area,(SELECT sum(CASE WHEN b.area>0 THEN b.area*r.o END) FROM rel r JOIN f2 b ON b.ck=r.f AND b.y=r.y WHERE r.ck=f0.ck AND r.y=f0.y)) area, f0.area IS NOT NULL dir FROM f0),
 fil AS (SELECT f3.ck, f3.y, CASE WHEN dir THEN 'DIRECT' WHEN f3.y<coalesce(ear.e,9999) THEN 'NULL_CORRECT' WHEN f3.area>0 THEN CASE WHEN (SELECT count(*)=1 AND max(o)>=0.95 FROM rel r WHERE r.ck=f3.ck AND r.y=f3.y) THEN 'DIRECT_PREDECESSOR' ELSE 'LINEAGE_BACKFILL' END ELSE 'NULL_UNRESOLVED' END how, f3.area FROM f3 LEFT JOIN ear ON ear.ck=f3.ck) """


def _filled(d: Derived) -> DataFrame:
    return B.backfilled(d.areas, d.corroborated, d.registry, VINTAGES, SETTINGS)


@query(q(ANCESTORS + "SELECT ck AS canonical_key, e AS earliest FROM ear"), False)
def earliest_ancestor(d):
    return B.earliest_ancestor(d.registry, d.edges, SETTINGS)


@query(q(FILLED + "SELECT ck AS canonical_key, y AS year, round(CASE WHEN how NOT LIKE 'NULL%' THEN area END,4) AS area FROM fil"), False)
def backfill_recursive(d):
    return _filled(d).select("canonical_key", "year", F.round("area", 4).alias("area"))


@query(q(FILLED + "SELECT ck AS canonical_key, y AS year, how AS fill_method FROM fil"), False)
def fill_method(d):
    return _filled(d).select("canonical_key", "year", "fill_method")


@query(q(FILLED + "SELECT y AS year, count(*) FILTER (WHERE how='DIRECT') AS n_direct, count(*) FILTER (WHERE how IN ('LINEAGE_BACKFILL','DIRECT_PREDECESSOR')) AS n_backfilled, count(*) FILTER (WHERE how LIKE 'NULL%') AS n_null, round(sum(CASE WHEN how NOT LIKE 'NULL%' THEN area END),2) AS total_area FROM fil GROUP BY 1"), False)
def fill_totals(d):
    return B.fill_totals(_filled(d)).withColumn("total_area", F.round("total_area", 2))


@query(q("SELECT ck AS canonical_key, max(area) FILTER (WHERE y=1995) AS area_km2_1995, max(area) FILTER (WHERE y=1997) AS area_km2_1997, max(area) FILTER (WHERE y=1999) AS area_km2_1999, max(area) FILTER (WHERE y=2001) AS area_km2_2001 FROM ar GROUP BY 1"), False)
def wide_long_pivot(d):
    return B.wide_areas(B.long_areas(B.wide_areas(d.areas, VINTAGES), VINTAGES), VINTAGES)


@query(q("SELECT oa AS obs_a, ob AS obs_b, round(o,6) AS area_weight, round(sum(o) OVER (PARTITION BY ya,oa),6) AS coverage, CASE WHEN sum(o) OVER (PARTITION BY ya,oa)>1.001 THEN 'OVERCLAIMED' WHEN sum(o) OVER (PARTITION BY ya,oa)<0.85 THEN 'LOW_COVERAGE' ELSE 'OK' END AS coverage_status FROM sh", True), True)
def crosswalk_coverage(d):
    return C.crosswalk(d.shares).select("obs_a", "obs_b", *r6("area_weight", "coverage"), "coverage_status")


@query(q("SELECT sh.yb AS year_b, ob AS obs_b, round(sum(v.v*o),4) AS value FROM sh JOIN (SELECT y, u||'@'||y obs, sum(w)*2.5 v FROM asg GROUP BY 1,2) v ON v.obs=sh.oa GROUP BY 1,2"), False)
def harmonised_value(d):
    values = d.layers.select(F.col("year").alias("year_a"), F.col("obs").alias("obs_a"), (F.col("area") * 2.5).alias("value"))
    return C.harmonised(values, C.crosswalk(d.shares)).select("year_b", "obs_b", F.round("value", 4).alias("value"))


@query("SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE abs(t - t*(1+(o_custkey%3)*0.01)) <= greatest(0.005, CASE WHEN t>0 THEN 1/t ELSE 0.005 END)*t) AS n_conserved FROM (SELECT o_custkey, o_totalprice t FROM orders) GROUP BY 1")
def scaled_conservation(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_totalprice").alias("area"), (F.col("o_totalprice") * (1 + (F.col("o_custkey") % 3) * 0.01)).alias("total"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(C.conserved()).alias("n_conserved"))


@query("""SELECT o_custkey AS canonical_key, o_orderkey FROM (SELECT *, max(t) OVER (PARTITION BY o_custkey ORDER BY f, t, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) mx FROM (SELECT o_custkey, o_orderkey, year(o_orderdate)*400+dayofyear(o_orderdate) f, year(o_orderdate)*400+dayofyear(o_orderdate)+o_orderkey%200 t FROM orders)) WHERE mx>f""")
def overlap_periods(spark, sf):
    day = F.year("o_orderdate") * 400 + F.dayofyear("o_orderdate")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("canonical_key"), "o_orderkey", day.alias("valid_from"), (day + F.col("o_orderkey") % 200).cast("int").alias("valid_to"))
    return C.overlapping_periods(o, ties=["o_orderkey"]).select("canonical_key", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) p FROM orders) WHERE p=1")
def authority_choice(spark, sf):
    rule = [F.col("o_orderpriority"), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return C.preferred(table(spark, sf, "orders"), ["o_custkey"], rule).select("o_custkey", "o_orderkey")


@query("SELECT CASE WHEN s>=0.85 THEN 'ACCEPT' WHEN s>=0.6 THEN 'REVIEW' ELSE 'REJECT' END AS band, count(*) AS n FROM (SELECT c_acctbal/10000 s FROM customer) GROUP BY 1")
def match_bands(spark, sf):
    return table(spark, sf, "customer").select(C.match_band(F.col("c_acctbal") / 10000).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query("SELECT 'customer' AS t, count(*) AS total, count(DISTINCT c_custkey) AS n_unique, count(*) FILTER (WHERE c_custkey IS NULL) AS n_null, count(*)=count(DISTINCT c_custkey) AS is_valid FROM customer UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_orderkey), count(*) FILTER (WHERE l_orderkey IS NULL), count(*)=count(DISTINCT l_orderkey) FROM lineitem")
def pk_validation(spark, sf):
    from parcelflow.sources.tables import key_check

    one = lambda t, k: key_check(table(spark, sf, t), k).withColumn("t", F.lit(t))
    return one("customer", "c_custkey").unionByName(one("lineitem", "l_orderkey"))


@query(q("SELECT 'ok' AS verdict, 0::BIGINT AS n_failed"), False)
def run_checks(d):
    """The standard rules over the derived run; none may fail."""
    rules = K.standard(T.closure(d.lost), d.crossed, d.registry, T.normalised(d.shares, d.lost, d.gained, "a"), L.backward_edges(d.edges, d.registry), d.audited, d.events, SETTINGS)
    return K.may_promote(rules).select(F.when(F.col("may_promote"), "ok").otherwise("failed").alias("verdict"), "n_failed")


def _rules(planted: bool) -> str:
    """SQL of the rules of windows; planted: on tables with faults."""
    asg = "SELECT k, y, w, u FROM asg"
    if planted:
        asg = f"SELECT * FROM ({asg}) WHERE NOT (k%50=49 AND y=1999) UNION ALL SELECT k, y, w, 'N0' FROM asg WHERE k%97=0 AND y=1997"
    stored = "CASE WHEN y=2001 THEN 1.01 ELSE 1 END" if planted else "1"
    more = "CASE WHEN y=1995 THEN 1 ELSE 0 END" if planted else "0"
    again = "CASE WHEN y=1997 THEN 'other' ELSE ck END" if planted else "ck"
    rest = "" if planted else "UNION ALL SELECT y, obs, 'LOST', (lost+sliver)/area FROM lost"
    edges = "SELECT f, t, ya, yb FROM ed" + (" UNION ALL SELECT a.ck, b.ck, 1995, 1997 FROM (SELECT min(x.ck) ck FROM ok x JOIN ok z ON z.ck=x.ck AND z.y=1997 WHERE x.y=1995) a, (SELECT max(x.ck) ck FROM ok x JOIN ok z ON z.ck=x.ck AND z.y=1997 WHERE x.y=1995) b" if planted else "")
    names = "CASE r " + " ".join(f"WHEN '{n[:2]}' THEN '{n.replace(chr(39), chr(39) * 2)}'" for n, *_ in K.WINDOW_RULES) + " END"
    severity = "CASE r " + " ".join(f"WHEN '{n[:2]}' THEN '{s}'" for n, s, *_ in K.WINDOW_RULES) + " END"
    limit = "CASE r " + " ".join(f"WHEN '{n[:2]}' THEN {m}" for n, _, _, m in K.WINDOW_RULES if m is not None) + " END"
    return q(ACCOUNTED + CLASSES + f""", asx AS ({asg}), atm AS (SELECT y, k, count(*) n, max(w) w FROM asx GROUP BY 1,2), edx AS ({edges}),
 v AS (SELECT 'V1' r, y, sum((n-1)*w)/sum(n*w) v FROM atm GROUP BY 2
  UNION ALL SELECT 'V2', y, 1-sum(w)/(SELECT sum(w) FROM (SELECT DISTINCT k, w FROM asx)) FROM atm GROUP BY 2
  UNION ALL SELECT 'V3', y, max(abs(trans+lost+{more}+sliver-area)/area) FROM lost GROUP BY 2
  UNION ALL SELECT 'V4', l.y, max(abs(l.area*s-coalesce(d.a,0))/(l.area*s)) FROM (SELECT *, {stored} s FROM lay) l LEFT JOIN (SELECT y, u, sum(w) a FROM asx GROUP BY 1,2) d ON d.y=l.y AND d.u=l.u GROUP BY 2
  UNION ALL SELECT 'V5', y, count(*) FILTER (WHERE ck<>{again}) FROM ok GROUP BY 2
  UNION ALL SELECT 'V6', c.pre, avg((ac<>sp)::INT) FROM cls c WHERE sp<>'UNKNOWN' GROUP BY 2
  UNION ALL SELECT 'V7', y, max(abs(s-1)) FROM (SELECT y, oa, sum(s) s FROM (SELECT ya y, oa, ob, o s FROM sh {rest}) GROUP BY 1,2) GROUP BY 2
  UNION ALL SELECT 'V8', d.pre, count(*) FILTER (WHERE coalesce(i.n,0)<>1) FROM acc a JOIN dated d ON d.id=a.id LEFT JOIN (SELECT ck, pre, post, count(DISTINCT id) n FROM nmd WHERE ck IS NOT NULL GROUP BY 1,2,3) i ON i.ck=a.predecessor_ck AND i.pre=d.pre AND i.post=d.post WHERE st='MEASURED' GROUP BY 2
  UNION ALL SELECT 'V9', ya, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM ok WHERE ck=f AND y=ya) AND EXISTS (SELECT 1 FROM ok WHERE ck=f AND y=yb) AND EXISTS (SELECT 1 FROM ok WHERE ck=t AND y=ya) AND EXISTS (SELECT 1 FROM ok WHERE ck=t AND y=yb)) FROM edx GROUP BY 2)
 SELECT {names} AS rule, y::INT AS year, {severity} AS severity, round(v,8)::DOUBLE AS value, coalesce(v<={limit},true) AS passed FROM v""")


def _checked(d: Derived, planted: bool) -> DataFrame:
    assigned, layers, lost, again, rows = d.assigned, d.layers, d.lost, Derived(d.spark, d.sf_dir).keys, T.normalised(d.shares, d.lost, d.gained, "a")
    edges = d.edges.select("from_ck", "to_ck", "year_a", "year_b")
    if planted:
        k = F.col("atom")
        assigned = assigned.filter(~((k % 50 == 49) & (F.col("year") == 1999))).unionByName(assigned.filter((k % 97 == 0) & (F.col("year") == 1997)).withColumn("unit", F.lit("N0")))
        layers = layers.withColumn("area", F.col("area") * F.when(F.col("year") == 2001, 1.01).otherwise(1))
        lost = lost.withColumn("lost", F.col("lost") + F.when(F.col("year") == 1995, 1).otherwise(0))
        again = again.withColumn("canonical_key", F.when(F.col("year") == 1997, "other").otherwise(F.col("canonical_key")))
        rows = rows.filter("obs_b <> 'LOST'")
        stay = d.keys.filter("year = 1995").select("canonical_key").intersect(d.keys.filter("year = 1997").select("canonical_key"))
        edges = edges.unionByName(stay.agg(F.min("canonical_key").alias("from_ck"), F.max("canonical_key").alias("to_ck")).withColumns({"year_a": F.lit(1995), "year_b": F.lit(1997)}))
    classes = R.classes(d.events, d.named, d.registry).join(d.named.select("event_id", "pre").distinct(), "event_id")
    accounted = E.accounting(d.events, d.named, d.matrix, d.keys, VINTAGES)
    found = K.measured(assigned, layers, lost, d.keys, again, rows, classes, accounted, E.identifiability(d.events, d.named), edges)
    return K.by_window(found).select("rule", "year", "severity", F.round("value", 8).alias("value"), "passed")


@query(_rules(False), False)
def window_rules(d):
    """All rules over all windows of the derived run."""
    return _checked(d, False)


@query(_rules(True), False)
def window_rules_planted(d):
    """The same with faults: atoms twice and missing, areas and keys that differ, losses too high and left out, an edge between units that stay."""
    return _checked(d, True)


# --- polygons ---------------------------------------------------------------------------------------------------------

BOXES = """WITH b AS (SELECT p_partkey k, (p_partkey%40)*10 x, (p_partkey//40)*10 y, 1+p_size%9 w, 1+(p_size+p_partkey)%9 h FROM part),
 p AS (SELECT a.k ka, b.k kb, greatest(0,least(a.x+a.w,b.x+3+b.w)-greatest(a.x,b.x+3))*greatest(0,least(a.y+a.h,b.y+4+b.h)-greatest(a.y,b.y+4)) area
  FROM b a JOIN b ON b.x BETWEEN a.x-20 AND a.x+10 AND b.y BETWEEN a.y-20 AND a.y+10) """


@query(BOXES + "SELECT ka::VARCHAR AS box_a, kb::VARCHAR AS box_b, area::DOUBLE AS area FROM p WHERE area>0", False)
def box_overlap_polygon(d):
    a, b = (d.boxes(s).withColumnRenamed("box", f"box_{t}") for s, t in ((0, "a"), (1, "b")))
    pairs = G.candidate_pairs(a, b, "box_a", "box_b", 20.0)
    return G.overlaps(G.edge_table(a, "box_a"), G.edge_table(b, "box_b"), pairs, "box_a", "box_b", 5.0).select("box_a", "box_b", F.round("area", 6).alias("area"))


@query(BOXES + "SELECT k::VARCHAR AS box, (w*h)::DOUBLE AS area, (2*(w+h))::DOUBLE AS perimeter, round(4*pi()*w*h/(4.0*(w+h)*(w+h)),6) AS thinness, 1 AS n_parts FROM b", False)
def polygon_measures(d):
    p = F.col("points")
    return d.boxes(0).select("box", F.round(G.area(p), 6).alias("area"), F.round(G.perimeter(p), 6).alias("perimeter"), F.round(G.thinness(p), 6).alias("thinness"), G.n_parts(p).alias("n_parts"))


@query(BOXES + "SELECT k::VARCHAR AS box, (round((x+w)/4.0)-round(x/4.0))*(round((y+h)/4.0)-round(y/4.0))*16 AS area_km2 FROM b WHERE (round((x+w)/4.0)-round(x/4.0))*(round((y+h)/4.0)-round(y/4.0))>0", False)
def snapped_boxes(d):
    return LY.snapped(d.boxes(0), 4.0).select("box", F.round("area_km2", 6).alias("area_km2"))


@query(BOXES + "SELECT 1951::INT AS source_year, 2*count(*) AS n, count(*) AS dup_geometry, count(*) AS dup_source_pk FROM b", False)
def duplicate_shapes(d):
    """Every box stands twice, so each has one shape and one key too many."""
    layer = d.boxes(0).select(F.lit("L").alias("source_dataset"), F.lit(1951).alias("source_year"), F.col("box").alias("source_pk"), "points")
    return LY.duplicates(layer.unionByName(layer)).drop("source_dataset")


@query(BOXES + "SELECT k::VARCHAR AS box, (x+w/2.0)::DOUBLE AS cx, (y+h/2.0)::DOUBLE AS cy FROM b", False)
def polygon_centroids(d):
    return G.centroids(G.edge_table(d.boxes(0), "box"), "box").select("box", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(BOXES + ", c AS (SELECT (SELECT sum(w*h) FROM b)*2 s, (SELECT sum(area) FROM p) o) SELECT 2*(SELECT count(*) FROM b) AS n_districts, s::DOUBLE AS sum_area, (s-o)::DOUBLE AS union_area, o::DOUBLE AS self_overlap, CASE WHEN o/s>0.01 THEN 'ERROR' WHEN o/s>0.001 THEN 'WARN' ELSE 'PASS' END AS status FROM c", False)
def self_overlap_boxes(d):
    both = d.boxes(0).withColumn("box", F.concat(F.lit("a"), "box")).unionByName(d.boxes(1).withColumn("box", F.concat(F.lit("b"), "box")))
    layer = both.select(F.col("box").alias("geom_obs_id"), "points", G.area(F.col("points")).alias("area_km2"), F.lit(1951).alias("source_year"))
    return LY.topology(layer, Settings()).select("n_districts", *(F.round(c, 4).alias(c) for c in ("sum_area", "union_area", "self_overlap")), "status")


@query("SELECT p_partkey%3=0 AS crossed, count(*) AS n FROM part GROUP BY 1", False)
def validity_bowties(d):
    """Every third box is drawn as a bow tie, whose sides cross once."""
    k = F.col("box").cast("long")
    p = F.col("points")
    swapped = d.boxes(0).withColumn("points", F.when(k % 3 == 0, F.array(p[0], p[2], p[1], p[3])).otherwise(p))
    found = G.self_crossings(swapped, "box")
    return swapped.join(merged(found), "box", "left").groupBy((F.coalesce("n_crossings", F.lit(0)) > 0).alias("crossed")).agg(F.count("*").alias("n"))
