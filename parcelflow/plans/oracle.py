"""DuckDB SQL for the derived frames: one chain of common tables, written independently of the operators."""

from __future__ import annotations

UNIT = """CASE
 WHEN c_nationkey%4=3 AND (c_custkey//25)%30=0 AND y>=1998 THEN 'N'||((c_nationkey+3)%25)
 WHEN c_nationkey%4=1 AND c_custkey%20=0 AND y>=1997+c_nationkey%3 THEN 'C'||c_nationkey
 WHEN c_nationkey%4 IN (0,2) AND c_nationkey%8<>6 AND y>=1995+c_nationkey%7
      AND NOT (c_nationkey%5=0 AND y>=1997+c_nationkey%7) THEN 'N'||c_nationkey||'.'||(c_custkey%(1+c_nationkey%3))
 ELSE 'N'||c_nationkey END"""


def chain(observed: bool = False) -> str:
    seen = "JOIN (SELECT DISTINCT o_custkey ok, year(o_orderdate) oy FROM orders) s ON s.ok=c_custkey AND s.oy=y" if observed else ""
    return f"""WITH RECURSIVE
yrs AS (SELECT unnest([1995,1997,1999,2001])::INT y),
asg AS (SELECT c_custkey k, y, 1+c_custkey%50 w, {UNIT} u FROM customer CROSS JOIN yrs {seen}),
states AS (SELECT n_nationkey n, r_name state FROM nation JOIN region ON n_regionkey=r_regionkey),
lay AS (SELECT y, u, u||'@'||y obs, area, row_number() OVER (PARTITION BY y ORDER BY u) ordinal, state
  FROM (SELECT y, u, sum(w)::DOUBLE area FROM asg GROUP BY y, u) JOIN states ON n=CAST(regexp_extract(u,'[0-9]+') AS INT)),
parc AS (SELECT a.y ya, b.y yb, a.u||'@'||a.y oa, b.u||'@'||b.y ob, sum(a.w)::DOUBLE area FROM asg a JOIN asg b ON a.k=b.k AND b.y=a.y+2 GROUP BY 1,2,3,4),
flag AS (SELECT p.*, a.area aa, b.area ab, p.area < greatest(40.0, least(a.area,b.area)*0.0001) sl FROM parc p JOIN lay a ON a.obs=oa JOIN lay b ON b.obs=ob),
m AS (SELECT ya,yb,oa,ob,area,aa,ab FROM flag WHERE NOT sl),
lost AS (SELECT l.y, l.obs, l.u, l.area, greatest(l.area-coalesce(sum(f.area),0),0) lost, coalesce(sum(CASE WHEN f.sl THEN f.area ELSE 0 END),0) sliver,
  coalesce(sum(CASE WHEN f.sl THEN 0 ELSE f.area END),0) trans FROM lay l LEFT JOIN flag f ON f.oa=l.obs WHERE l.y<2001 GROUP BY l.y,l.obs,l.u,l.area),
gained AS (SELECT l.y, l.obs, l.u, l.area, greatest(l.area-coalesce(sum(f.area),0),0) gained, coalesce(sum(CASE WHEN f.sl THEN f.area ELSE 0 END),0) sliver,
  coalesce(sum(CASE WHEN f.sl THEN 0 ELSE f.area END),0) trans FROM lay l LEFT JOIN flag f ON f.ob=l.obs WHERE l.y>1995 GROUP BY l.y,l.obs,l.u,l.area),
sh AS (SELECT *, area/aa o, area/ab i FROM m),
ba AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ya,oa ORDER BY o DESC, ob) p FROM sh) WHERE p=1),
bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ya,ob ORDER BY i DESC, oa) p FROM sh) WHERE p=1),
mut AS (SELECT ba.* FROM ba JOIN bb ON ba.oa=bb.oa AND ba.ob=bb.ob),
cont AS (SELECT * FROM mut WHERE i>=0.9 AND o>=0.9),
walk(obs, root) AS (SELECT obs, obs FROM lay WHERE obs NOT IN (SELECT ob FROM cont) UNION ALL SELECT c.ob, w.root FROM walk w JOIN cont c ON c.oa=w.obs),
keys AS (SELECT obs root, 'IND-'||lpad(CAST(row_number() OVER (ORDER BY y, ordinal) AS VARCHAR),6,'0') ck FROM lay WHERE obs NOT IN (SELECT ob FROM cont)),
ok AS (SELECT l.y, l.obs, l.u, l.state, l.area, l.ordinal, k.ck FROM walk w JOIN keys k ON k.root=w.root JOIN lay l ON l.obs=w.obs),
reg AS (SELECT ck, min(y) est, CASE WHEN max(y)<2001 THEN max(y)+2 END closed, arg_min(u,y) nm, arg_min(state,y) st FROM ok GROUP BY ck),
tr AS (SELECT s.*, a.ck f, b.ck t FROM sh s JOIN ok a ON a.obs=oa JOIN ok b ON b.obs=ob WHERE s.area>=40),
cx AS (SELECT tr.*, r.est=tr.yb lin FROM tr JOIN reg r ON r.ck=tr.t WHERE f<>t),
ed0 AS (SELECT cx.*, coalesce(r.closed=cx.yb,false) cl FROM cx JOIN reg r ON r.ck=cx.f WHERE lin),
ed AS (SELECT e.*, CASE WHEN NOT cl THEN 'FORMED_FROM' WHEN (SELECT count(DISTINCT x.f) FROM ed0 x WHERE x.t=e.t AND x.ya=e.ya AND x.cl)>=2 THEN 'MERGED_INTO' ELSE 'SPLIT_FROM' END typ FROM ed0 e),
raw AS (SELECT 'SPLIT' et, 'N'||n par, 'N'||n||'.'||j ch, state, (1995+n%7)::INT yr, 'gazette '||(n%3) src FROM states, (SELECT unnest([0,1,2]) j) WHERE n%4 IN (0,2) AND n%8<>6 AND j<=n%3
  UNION ALL SELECT 'NEW_DISTRICT', CASE WHEN n%8=5 THEN 'N'||n||' and N'||((n+1)%25) ELSE 'N'||n END, 'C'||n, state, (1997+n%3)::INT, 'notice' FROM states WHERE n%4=1
  UNION ALL SELECT 'RENAME', 'N'||n, 'N'||n, state, (1996+n%4)::INT, 'order' FROM states WHERE n%5=3),
ev AS (SELECT left(sha256('EVENT|'||et||'|'||par||'|'||state||'|'||yr),32) id, et, par, state, yr, list_sort(list(DISTINCT ch)) chs, string_agg(DISTINCT src,';' ORDER BY src) srcs, count(*) n
  FROM raw WHERE et<>'RENAME' GROUP BY et,par,state,yr
  UNION ALL SELECT left(sha256('EVENT|'||et||'|'||par||'|'||ch||'|'||state||'|'||yr),32), et, par, state, yr, [ch], src, 1 FROM raw WHERE et='RENAME'),
part AS (SELECT id, 'PREDECESSOR' rl, unnest(string_split(par,' and ')) nm, state FROM ev UNION ALL SELECT id, 'SUCCESSOR', unnest(chs), state FROM ev),
dated AS (SELECT *, (SELECT max(y) FROM yrs WHERE y<yr) pre, (SELECT min(y) FROM yrs WHERE y>yr) post FROM ev),
bys AS (SELECT y, lower(state) s, lower(replace(u,'.','')) u, arg_max(ck, ordinal) ck FROM ok GROUP BY 1,2,3),
byn AS (SELECT y, lower(replace(u,'.','')) u, min(ck) ck FROM ok GROUP BY 1,2 HAVING count(DISTINCT ck)=1),
nmd AS (SELECT p.id, p.rl, p.nm, p.state, d.et, d.yr, d.pre, d.post, coalesce(s.ck,n.ck) ck,
  CASE WHEN (CASE WHEN p.rl='PREDECESSOR' THEN d.pre ELSE d.post END) IS NULL THEN 'NO_VINTAGE' WHEN s.ck IS NOT NULL THEN 'STATE_SCOPED' WHEN n.ck IS NOT NULL THEN 'NAME_ONLY' ELSE 'UNRESOLVED' END how
  FROM part p JOIN dated d ON d.id=p.id LEFT JOIN bys s ON s.y=(CASE WHEN p.rl='PREDECESSOR' THEN d.pre ELSE d.post END) AND s.s=lower(p.state) AND s.u=lower(replace(p.nm,'.',''))
  LEFT JOIN byn n ON n.y=(CASE WHEN p.rl='PREDECESSOR' THEN d.pre ELSE d.post END) AND n.u=lower(replace(p.nm,'.',''))),
flow AS (SELECT m.ya, m.yb, a.ck f, b.ck t, sum(m.area) area FROM m JOIN ok a ON a.obs=oa JOIN ok b ON b.obs=ob GROUP BY 1,2,3,4),
ar AS (SELECT ck, y, sum(area) area FROM ok GROUP BY 1,2),
prd AS (SELECT id, ck, min(pre) pre, min(post) post, min(how) how FROM nmd WHERE rl='PREDECESSOR' AND ck IS NOT NULL GROUP BY 1,2),
suc AS (SELECT id, ck, min(how) how FROM nmd WHERE rl='SUCCESSOR' AND ck IS NOT NULL GROUP BY 1,2),
ctr AS (SELECT p.id, p.ck pk, s.ck sk, p.pre, p.post, coalesce(a.area,0) sa, coalesce(b.area,0) ta, coalesce(f.area,0) area, p.how ph, s.how sho
  FROM prd p JOIN suc s ON s.id=p.id LEFT JOIN ar a ON a.ck=p.ck AND a.y=p.pre LEFT JOIN ar b ON b.ck=s.ck AND b.y=p.post LEFT JOIN flow f ON f.ya=p.pre AND f.yb=p.post AND f.f=p.ck AND f.t=s.ck
  WHERE p.pre IS NOT NULL AND p.post IS NOT NULL),
kpt AS (SELECT id, pk, pre, post, max(sa) sa, sum(area) acc, greatest(max(sa)-sum(area),0) res, CASE WHEN max(sa)>0 THEN greatest(max(sa)-sum(area),0)/max(sa)*100 ELSE 0 END pct FROM ctr GROUP BY 1,2,3,4),
sco AS (SELECT c.id, c.pk, c.sk, 0.75+0.15*(CASE WHEN c.ta>0 THEN least(1.0,k.res/c.ta) ELSE 0 END) score FROM ctr c JOIN kpt k ON k.id=c.id AND k.pk=c.pk),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id,pk ORDER BY score DESC, sk) p FROM sco) WHERE p=1),
aud AS (SELECT k.*, CASE WHEN sa>0 AND pct<1 THEN 'IGNORABLE_RESIDUAL' WHEN sa<=0 THEN 'UNRESOLVED_RESIDUAL' WHEN score>=0.65 THEN 'RECOVERED_BY_ADJACENCY' ELSE 'UNRESOLVED_RESIDUAL' END status,
  CASE WHEN sa>0 AND pct<1 THEN 'BOUNDARY_PRECISION' WHEN sa<=0 THEN 'MISSING_DISTRICT_GEOMETRY' WHEN sk IS NOT NULL THEN 'ADJACENT_DISTRICT_CANDIDATE' ELSE 'UNRECOVERED_GEOMETRIC_RESIDUAL' END reason,
  CASE WHEN (sa>0 AND pct<1) OR sa<=0 THEN NULL ELSE sk END ck, CASE WHEN (sa>0 AND pct<1) OR sa<=0 THEN 0 ELSE coalesce(score,0) END score FROM kpt k LEFT JOIN top t ON t.id=k.id AND t.pk=k.pk),
sta AS (SELECT e.id, e.et, e.yr, CASE WHEN count(a.pk)=0 THEN 'NO_GEOMETRY' WHEN bool_and(a.status='IGNORABLE_RESIDUAL') THEN 'RECONCILED' WHEN bool_or(a.status='UNRESOLVED_RESIDUAL') THEN 'UNRESOLVED'
  WHEN bool_or(a.status='RECOVERED_BY_ADJACENCY') THEN 'RECOVERED' ELSE 'PARTIALLY_RESOLVED' END status, coalesce(sum(a.sa),0) sa, coalesce(sum(a.acc),0) acc, coalesce(sum(a.res),0) res, count(a.pk) n
  FROM ev e LEFT JOIN aud a ON a.id=e.id GROUP BY 1,2,3),
ali AS (SELECT 'N'||n rn, lower(state) fs, 'N'||((n+1)%25) cn, CASE WHEN n%4=0 THEN 'DOCUMENTARY' ELSE 'SPATIAL_DISCOVERY' END ety, n%12=0 appr FROM states WHERE n%6=0),
opn AS (SELECT k.*, e.yr, (SELECT min(lower(replace(nm,'.',''))) FROM nmd x WHERE x.id=k.id AND x.ck=k.pk AND x.rl='PREDECESSOR') nn, (SELECT min(lower(state)) FROM nmd x WHERE x.id=k.id AND x.ck=k.pk AND x.rl='PREDECESSOR') sn,
  (SELECT count(DISTINCT sk) FROM ctr c WHERE c.id=k.id) nd FROM kpt k JOIN ev e ON e.id=k.id),
l1 AS (SELECT * FROM (SELECT o.id, o.pk, n.ck, CASE WHEN x.rk=1 THEN 'EXISTING_REGISTRY' ELSE x.ety END ety, row_number() OVER (PARTITION BY o.id,o.pk ORDER BY x.rk, x.cn) p
  FROM opn o JOIN (SELECT rn,fs,cn,ety,1 rk FROM ali WHERE appr UNION ALL SELECT rn,fs,cn,ety,2 FROM ali) x ON lower(replace(x.rn,'.',''))=o.nn AND x.fs=o.sn JOIN byn n ON n.y=o.post AND n.u=lower(replace(x.cn,'.',''))) WHERE p=1),
ssu AS (SELECT lower(a.r_name) s, lower(b.r_name) ss FROM region a JOIN region b ON b.r_regionkey IN (a.r_regionkey, (a.r_regionkey+1)%5)),
l2 AS (SELECT o.id, o.pk, CASE WHEN n.c=1 THEN n.ck WHEN n.c>1 THEN coalesce(x.ck,n.ck) ELSE a.ck END ck,
  CASE WHEN n.c=1 THEN 'NAME_ONLY' WHEN n.c>1 AND x.ck IS NOT NULL THEN 'STATE_SUCCESSOR' WHEN n.c>1 THEN 'AMBIGUOUS' WHEN a.ck IS NOT NULL THEN 'ALIAS' ELSE 'EVENT_SUCCESSOR_NOT_RESOLVED' END why
  FROM opn o LEFT JOIN (SELECT y, lower(replace(u,'.','')) u, min(ck) ck, count(DISTINCT ck) c FROM ok GROUP BY 1,2) n ON n.y=o.post AND n.u=o.nn
  LEFT JOIN (SELECT * FROM (SELECT o.id, o.pk, b.ck, row_number() OVER (PARTITION BY o.id,o.pk ORDER BY q.ss) p FROM opn o JOIN ssu q ON q.s=o.sn JOIN bys b ON b.y=o.post AND b.s=q.ss AND b.u=o.nn) WHERE p=1) x ON x.id=o.id AND x.pk=o.pk
  LEFT JOIN (SELECT o.id, o.pk, min(n.ck) ck FROM opn o JOIN ali ON lower(replace(rn,'.',''))=o.nn JOIN byn n ON n.y=o.post AND n.u=lower(replace(cn,'.','')) GROUP BY 1,2) a ON a.id=o.id AND a.pk=o.pk),
cnd0 AS (SELECT o.id, o.pk, o.post, o.nn, o.sn, f.t ck, f.area, a.area ca, o.sa, f.area/o.sa*100 pp, f.area/a.area*100 pc, sqrt(f.area) bd, a.area/100 ds, lower(replace(r.nm,'.','')) cnm, lower(r.st) cst, r.est
  FROM opn o JOIN flow f ON f.ya=o.pre AND f.yb=o.post AND f.f=o.pk JOIN ar a ON a.ck=f.t AND a.y=f.yb JOIN reg r ON r.ck=f.t WHERE f.area>=1 AND f.area/o.sa*100>=0.5),
dec AS (SELECT DISTINCT id, ck, lower(replace(nm,'.','')) nm FROM nmd WHERE rl='SUCCESSOR' AND ck IS NOT NULL),
sim AS (SELECT c.id, c.pk, c.ck, max(jaro_similarity(q.nm,c.cnm)+0.1*(1-jaro_similarity(q.nm,c.cnm))*(
   CASE WHEN length(q.nm)>=1 AND length(c.cnm)>=1 AND q.nm[1]=c.cnm[1] THEN 1 ELSE 0 END + CASE WHEN length(q.nm)>=2 AND length(c.cnm)>=2 AND q.nm[2]=c.cnm[2] THEN 1 ELSE 0 END
  +CASE WHEN length(q.nm)>=3 AND length(c.cnm)>=3 AND q.nm[3]=c.cnm[3] THEN 1 ELSE 0 END + CASE WHEN length(q.nm)>=4 AND length(c.cnm)>=4 AND q.nm[4]=c.cnm[4] THEN 1 ELSE 0 END)) s
  FROM cnd0 c JOIN (SELECT id, nm FROM dec UNION SELECT id, nn FROM opn o WHERE id NOT IN (SELECT id FROM dec)) q ON q.id=c.id GROUP BY 1,2,3),
cnd1 AS (SELECT c.*, s.s, EXISTS (SELECT 1 FROM dec d WHERE d.id=c.id AND d.ck=c.ck) dc, EXISTS (SELECT 1 FROM ed e WHERE e.f=c.pk AND e.t=c.ck) pcr,
  CASE WHEN c.cst=c.sn OR EXISTS (SELECT 1 FROM ssu q WHERE q.s=c.sn AND q.ss=c.cst) THEN 1.0 ELSE 0.5 END stv, CASE WHEN c.est<=c.post THEN 1.0 ELSE 0.0 END yv,
  c.area/max(c.area) OVER w sa_, c.bd/max(c.bd) OVER w sb, c.ds/max(c.ds) OVER w sd FROM cnd0 c JOIN sim s ON s.id=c.id AND s.pk=c.pk AND s.ck=c.ck WINDOW w AS (PARTITION BY c.id,c.pk)),
cnd2 AS (SELECT *, round(0.30*least(1.0,pp/100)+0.25*sa_+0.20*least(1.0,pc/100)+0.15*sb+0.05*(CASE WHEN bd>0 THEN 1 ELSE 0 END)+0.05*(1-sd),6) sc,
  round(0.30*dc::INT+0.20*pcr::INT+0.20*s+0.15*stv+0.15*yv,6) ac,
  round(0.25*sa_+0.20*least(1.0,pp/100)+0.15*least(1.0,pc/100)+0.10*sb+0.05*(CASE WHEN bd>0 THEN 1 ELSE 0 END)+0.05*yv+0.10*pcr::INT+0.05*stv+0.03*s+0.02*dc::INT,6) tot FROM cnd1),
cnd AS (SELECT *, row_number() OVER (PARTITION BY id,pk ORDER BY tot DESC, ck) rk, CASE WHEN dc AND tot>=0.65 THEN 'CONFIRMED_ADMINISTRATIVE_SUCCESSOR' WHEN tot>=0.55 THEN 'SPATIALLY_CONFIRMED_BUT_EVENT_UNLISTED' WHEN tot>=0.30 THEN 'POSSIBLE_SPATIAL_SUCCESSOR' ELSE 'NO_VALID_SPATIAL_SUCCESSOR' END cs FROM cnd2)
"""


def q(select: str, observed: bool = False) -> str:
    return chain(observed) + select
