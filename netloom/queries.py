"""Queries over networks that the warehouse tables hold, and their DuckDB twins."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.network import Network
from netloom.operators.valued import valued_summary
from netloom.plans import combined, constraints, ego, estimation, gof, pseudolikelihood
from netloom.plans.summary import summary_stats
from netloom.sources import tables
from netloom.streaming import ages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- networks in SQL ------------------------------------------------------------------------------------------------------------

_PAIRS = "SELECT c.c_nationkey AS src, s.s_nationkey AS dst, {more} count(*) AS w FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE c.c_nationkey <> s.s_nationkey {where} GROUP BY ALL"
TRADE = f"""p AS ({_PAIRS.format(more="", where="")}), e AS (SELECT src, dst, CAST(w AS DOUBLE) AS w FROM p ORDER BY w DESC, src, dst LIMIT 150),
v AS (SELECT n_nationkey AS vid, n_regionkey AS region FROM nation), m AS (SELECT a.src, a.dst FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src),
d AS (SELECT vid, region, (SELECT count(*) FROM e WHERE src = vid) AS o, (SELECT count(*) FROM e WHERE dst = vid) AS i FROM v),
t AS (SELECT e.*, a.region AS sr, b.region AS dr, a.o AS so, a.i AS si, b.o AS "do", b.i AS di FROM e JOIN d a ON e.src = a.vid JOIN d b ON e.dst = b.vid)"""
COSUPPLY = """l AS (SELECT DISTINCT l_orderkey, l_suppkey AS x FROM lineitem), p AS (SELECT a.x AS src, b.x AS dst, count(*) AS w FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.x < b.x GROUP BY ALL),
e AS (SELECT src, dst, w FROM p ORDER BY w DESC, src, dst LIMIT 400), a AS (SELECT src AS i, dst AS j FROM e UNION ALL SELECT dst, src FROM e),
v AS (SELECT s_suppkey AS vid, s_nationkey AS nation, s_acctbal AS balance, s_nationkey % 3 AS third FROM supplier), c AS (SELECT i, count(*) AS g FROM a GROUP BY i),
d AS (SELECT v.*, coalesce(g, 0) AS deg FROM v LEFT JOIN c ON v.vid = c.i),
sp AS (SELECT x.i AS i, y.i AS j, count(*) AS sp FROM a x JOIN a y ON x.j = y.j AND x.i < y.i GROUP BY ALL),
pe AS (SELECT coalesce(sp.i, e.src) AS i, coalesce(sp.j, e.dst) AS j, coalesce(sp.sp, 0) AS sp, CASE WHEN e.src IS NULL THEN 0 ELSE 1 END AS y FROM sp FULL JOIN e ON sp.i = e.src AND sp.j = e.dst),
tri AS (SELECT count(*) AS n FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst),
t AS (SELECT e.*, x.deg AS sd, y.deg AS dd, x.nation AS sn, y.nation AS dn, x.balance AS sb, y.balance AS db, x.third AS s3, y.third AS d3 FROM e JOIN d x ON e.src = x.vid JOIN d y ON e.dst = y.vid)"""
COPART = """l AS (SELECT DISTINCT l_orderkey, l_partkey AS x FROM lineitem), e AS (SELECT a.x AS src, b.x AS dst, count(*) AS w FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.x < b.x GROUP BY ALL HAVING count(*) >= 2),
v AS (SELECT p_partkey AS vid, p_brand AS brand, p_size AS size, p_type AS type FROM part), t AS (SELECT e.*, a.brand AS sb, b.brand AS db, a.size AS ss, b.size AS ds FROM e JOIN v a ON e.src = a.vid JOIN v b ON e.dst = b.vid),
a AS (SELECT src AS i, dst AS j FROM e UNION ALL SELECT dst, src FROM e), d AS (SELECT vid, (SELECT count(*) FROM a WHERE a.i = v.vid) AS deg FROM v)"""
SUPPLYPART = """e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t FROM lineitem WHERE l_quantity >= 48), v1 AS (SELECT s_suppkey AS vid, s_nationkey % 3 AS grp, CAST(s_acctbal AS DOUBLE) AS x, (SELECT count(*) FROM e WHERE s = s_suppkey) AS deg FROM supplier),
v2 AS (SELECT p_partkey AS vid, p_size % 3 AS grp, CAST(p_size AS DOUBLE) AS x, (SELECT count(*) FROM e WHERE t = p_partkey) AS deg FROM part),
j AS (SELECT e.s, e.t, v1.grp AS g1, v2.grp AS g2, v1.x AS x1, v2.x AS x2, v1.deg AS d1, v2.deg AS d2 FROM e JOIN v1 ON e.s = v1.vid JOIN v2 ON e.t = v2.vid),
p1 AS (SELECT a.s AS i, b.s AS j, count(*) AS sp FROM e a JOIN e b ON a.t = b.t AND a.s < b.s GROUP BY ALL), p2 AS (SELECT a.t AS i, b.t AS j, count(*) AS sp FROM e a JOIN e b ON a.s = b.s AND a.t < b.t GROUP BY ALL)"""
_G = math.exp(0.5)
_R = 1 - math.exp(-0.5)


def gw(x: str) -> str:
    return f"({_G!r} * (1 - power({_R!r}, {x})))"


def add(name: str, make: Callable[[SparkSession, str], DataFrame], ctes: str, rows: list[tuple[str, str]]) -> None:
    """A query of statistics (stat, value) and its SQL: one scalar query for each statistic."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(spark, sf_dir).select("stat", F.round("value", 6).alias("value"))

    QUERIES[name] = run
    selects = " UNION ALL ".join(f"SELECT '{stat}' AS stat, round(CAST(({sql}) AS DOUBLE), 6) AS value" for stat, sql in rows)
    ORACLE_SQL[name] = f"WITH {ctes} {selects}"


def stats(name: str, network: Callable, formula: str, ctes: str, rows: list[tuple[str, str]]) -> None:
    add(name, lambda spark, sf_dir: summary_stats(network(spark, sf_dir), formula), ctes, rows)


# --- statistics -----------------------------------------------------------------------------------------------------------------

stats(
    "trade_dyadic", tables.trade,
    "edges+density+meandeg+mutual+asymmetric+mutual(same='region')+mutual(by='region')+asymmetric('region')+nodematch('region')+nodematch('region',diff=TRUE)+nodefactor('region')+nodeifactor('region')+nodeofactor('region',levels=TRUE)+nodecov('region')+nodeicov('region')+nodeocov('region')+absdiff('region')+absdiffcat('region')+smalldiff('region',1)+diff('region')+diff('region',pow=2,dir='h-t',sign_action='posonly')+mm('region',levels2=TRUE)",
    TRADE,
    [("edges", "SELECT count(*) FROM e"), ("density", "SELECT count(*) / 600.0 FROM e"), ("meandeg", "SELECT count(*) / 25.0 FROM e"), ("mutual", "SELECT count(*) / 2 FROM m"), ("asymmetric", "SELECT (SELECT count(*) FROM e) - (SELECT count(*) FROM m)"),
     ("mutual.region", "SELECT count(*) / 2 FROM m JOIN v a ON m.src = a.vid JOIN v b ON m.dst = b.vid WHERE a.region = b.region")]
    + [(f"mutual.by.region.{k}", f"SELECT count(*) FROM m JOIN v a ON m.src = a.vid WHERE a.region = {k}") for k in range(5)]
    + [("asymmetric.region", "SELECT (SELECT count(*) FROM t WHERE sr = dr) - (SELECT count(*) FROM m JOIN v a ON m.src = a.vid JOIN v b ON m.dst = b.vid WHERE a.region = b.region)"), ("nodematch.region", "SELECT count(*) FROM t WHERE sr = dr")]
    + [(f"nodematch.region.{k}", f"SELECT count(*) FROM t WHERE sr = {k} AND dr = {k}") for k in range(5)]
    + [(f"nodefactor.region.{k}", f"SELECT count(*) FILTER (sr = {k}) + count(*) FILTER (dr = {k}) FROM t") for k in range(1, 5)]
    + [(f"nodeifactor.region.{k}", f"SELECT count(*) FROM t WHERE dr = {k}") for k in range(1, 5)]
    + [(f"nodeofactor.region.{k}", f"SELECT count(*) FROM t WHERE sr = {k}") for k in range(5)]
    + [("nodecov.region", "SELECT sum(sr + dr) FROM t"), ("nodeicov.region", "SELECT sum(dr) FROM t"), ("nodeocov.region", "SELECT sum(sr) FROM t"), ("absdiff.region", "SELECT sum(abs(sr - dr)) FROM t")]
    + [(f"absdiff.region.{k}", f"SELECT count(*) FROM t WHERE abs(sr - dr) = {k}") for k in range(1, 5)]
    + [("smalldiff.region1", "SELECT count(*) FROM t WHERE abs(sr - dr) <= 1"), ("diff.t-h.region", "SELECT sum(sr - dr) FROM t"), ("diff2.posonly.h-t.region", "SELECT sum(power(greatest(dr - sr, 0), 2)) FROM t")]
    + [(f"mm[region={r},region={c}]", f"SELECT count(*) FROM t WHERE sr = {r} AND dr = {c}") for c in range(5) for r in range(5)],
)

_PATH = {"OTP": ("x.src", "y.dst", "x.dst = y.src"), "ITP": ("y.dst", "x.src", "x.dst = y.src"), "OSP": ("x.src", "y.src", "x.dst = y.dst"), "ISP": ("x.dst", "y.dst", "x.src = y.src")}
_SP = ", ".join(f"{k.lower()} AS (SELECT {a} AS i, {b} AS j, count(*) AS sp FROM e x JOIN e y ON {on} WHERE {a} <> {b} GROUP BY ALL)" for k, (a, b, on) in _PATH.items()) + ", rtp AS (SELECT x.src AS i, y.dst AS j, count(*) AS sp FROM m x JOIN m y ON x.dst = y.src WHERE x.src <> y.dst GROUP BY ALL)"
_KINDS = ("OTP", "ITP", "RTP", "OSP", "ISP")
stats(
    "trade_shared_partners", tables.trade,
    "+".join(f"esp(0:2,type='{k}')+dsp(0:2,type='{k}')+nsp(1:2,type='{k}')+gwesp(0.5,fixed=TRUE,type='{k}')+gwdsp(0.5,fixed=TRUE,type='{k}')+gwnsp(0.5,fixed=TRUE,type='{k}')" for k in _KINDS),
    f"{TRADE}, {_SP}",
    [r for k in _KINDS for r in (
        [(f"esp.{k}{x}", f"SELECT count(*) FROM e LEFT JOIN {k.lower()} s ON e.src = s.i AND e.dst = s.j WHERE coalesce(s.sp, 0) = {x}") for x in range(3)]
        + [(f"dsp.{k}0", f"SELECT 600 - count(*) FROM {k.lower()}")] + [(f"dsp.{k}{x}", f"SELECT count(*) FROM {k.lower()} WHERE sp = {x}") for x in (1, 2)]
        + [(f"nsp.{k}{x}", f"SELECT count(*) FROM {k.lower()} s ANTI JOIN e ON e.src = s.i AND e.dst = s.j WHERE sp = {x}") for x in (1, 2)]
        + [(f"gwesp.{k}.fixed.0.5", f"SELECT coalesce(sum({gw('sp')}), 0) FROM {k.lower()} s SEMI JOIN e ON e.src = s.i AND e.dst = s.j"), (f"gwdsp.{k}.fixed.0.5", f"SELECT coalesce(sum({gw('sp')}), 0) FROM {k.lower()}"), (f"gwnsp.{k}.fixed.0.5", f"SELECT coalesce(sum({gw('sp')}), 0) FROM {k.lower()} s ANTI JOIN e ON e.src = s.i AND e.dst = s.j")])],
)

stats(
    "trade_triads", tables.trade,
    "triangle+ttriple+ctriple+ttriple('region')+twopath+threetrail+transitiveties+cyclicalties+simmelianties+cycle(2:4)+istar(2:3)+ostar(2:3)+idegree(0:4)+odegree(0:4)+idegrange(2,6)+odegree1.5+gwidegree(0.5,fixed=TRUE)+gwodegree(0.5,fixed=TRUE)+sender+receiver+nodeocovrange('region')+nodeicovrange('region')+nodeofactordistinct('region')+nodefactordistinct('region')+triadcensus(levels=1:16)+transitive+simmelian+balance",
    TRADE + """, tt AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src AND x.src <> y.dst), st AS (SELECT a.vid AS i, b.vid AS j, (CASE WHEN x.src IS NULL THEN 0 ELSE 1 END) + (CASE WHEN y.src IS NULL THEN 0 ELSE 2 END) AS s FROM v a JOIN v b ON a.vid < b.vid LEFT JOIN e x ON x.src = a.vid AND x.dst = b.vid LEFT JOIN e y ON y.src = b.vid AND y.dst = a.vid),
r AS (SELECT x.s AS ab, y.s AS ac, z.s AS bc FROM st x JOIN st y ON x.i = y.i AND x.j < y.j JOIN st z ON z.i = x.j AND z.j = y.j),
k AS (SELECT ab, ac, bc, (CASE WHEN ab = 3 THEN 1 ELSE 0 END) + (CASE WHEN ac = 3 THEN 1 ELSE 0 END) + (CASE WHEN bc = 3 THEN 1 ELSE 0 END) AS m, (CASE WHEN ab IN (1, 2) THEN 1 ELSE 0 END) + (CASE WHEN ac IN (1, 2) THEN 1 ELSE 0 END) + (CASE WHEN bc IN (1, 2) THEN 1 ELSE 0 END) AS n,
 greatest((CASE WHEN ab = 1 THEN 1 ELSE 0 END) + (CASE WHEN ac = 1 THEN 1 ELSE 0 END), (CASE WHEN ab = 2 THEN 1 ELSE 0 END) + (CASE WHEN bc = 1 THEN 1 ELSE 0 END), (CASE WHEN ac = 2 THEN 1 ELSE 0 END) + (CASE WHEN bc = 2 THEN 1 ELSE 0 END)) AS o,
 greatest((CASE WHEN ab = 2 THEN 1 ELSE 0 END) + (CASE WHEN ac = 2 THEN 1 ELSE 0 END), (CASE WHEN ab = 1 THEN 1 ELSE 0 END) + (CASE WHEN bc = 2 THEN 1 ELSE 0 END), (CASE WHEN ac = 1 THEN 1 ELSE 0 END) + (CASE WHEN bc = 1 THEN 1 ELSE 0 END)) AS i,
 CASE WHEN ab = 0 THEN CASE WHEN ac = 3 THEN bc = 1 WHEN bc = 3 THEN ac = 1 END WHEN ac = 0 THEN CASE WHEN ab = 3 THEN bc = 2 WHEN bc = 3 THEN ab = 1 END WHEN bc = 0 THEN CASE WHEN ab = 3 THEN ac = 2 WHEN ac = 3 THEN ab = 2 END END AS down FROM r),
ty AS (SELECT m || '' || n || '' || (3 - m - n) || CASE WHEN (m, n) IN ((0, 2), (1, 2)) THEN CASE WHEN o = 2 THEN 'D' WHEN i = 2 THEN 'U' ELSE 'C' END WHEN (m, n) = (0, 3) THEN CASE WHEN o = 2 THEN 'T' ELSE 'C' END WHEN (m, n) = (1, 1) THEN CASE WHEN down THEN 'D' ELSE 'U' END ELSE '' END AS ty FROM k)""",
    [("triangle", "SELECT (SELECT count(*) FROM tt SEMI JOIN e ON e.src = a AND e.dst = c) + (SELECT count(*) FROM tt SEMI JOIN e ON e.src = c AND e.dst = a) / 3"), ("ttriple", "SELECT count(*) FROM tt SEMI JOIN e ON e.src = a AND e.dst = c"), ("ctriple", "SELECT count(*) / 3 FROM tt SEMI JOIN e ON e.src = c AND e.dst = a"),
     ("ttriple.region", "SELECT count(*) FROM (SELECT * FROM tt SEMI JOIN e ON e.src = a AND e.dst = c) q JOIN v x ON q.a = x.vid JOIN v y ON q.b = y.vid JOIN v z ON q.c = z.vid WHERE x.region = y.region AND y.region = z.region"), ("twopath", "SELECT count(*) FROM tt"),
     ("threetrail.RRR", "SELECT sum(si * \"do\") - (SELECT count(*) FROM m) FROM t"), ("threetrail.RRL", "SELECT sum(si * (di - 1)) FROM t"), ("threetrail.LRR", "SELECT sum((so - 1) * \"do\") FROM t"), ("threetrail.LRL", "SELECT sum((so - 1) * (di - 1)) FROM t"),
     ("transitiveties", "SELECT count(*) FROM e SEMI JOIN tt ON e.src = a AND e.dst = c"), ("cyclicalties", "SELECT count(*) FROM e SEMI JOIN tt ON e.src = c AND e.dst = a"),
     ("simmelianties", "SELECT count(*) FROM m SEMI JOIN (SELECT x.src AS i, y.dst AS j FROM m x JOIN m y ON x.dst = y.src) q ON m.src = q.i AND m.dst = q.j"),
     ("cycle2", "SELECT count(*) / 2 FROM m"), ("cycle3", "SELECT count(*) / 3 FROM tt SEMI JOIN e ON e.src = c AND e.dst = a"), ("cycle4", "SELECT count(*) / 4 FROM tt x JOIN tt y ON x.c = y.a AND y.c = x.a AND x.b <> y.b")]
    + [(f"{p}star{k}", f"SELECT sum({f}) FROM d") for p, c in (("i", "i"), ("o", "o")) for k, f in ((2, f"{c} * ({c} - 1) / 2"), (3, f"{c} * ({c} - 1) * ({c} - 2) / 6"))]
    + [(f"{p}degree{k}", f"SELECT count(*) FROM d WHERE {p} = {k}") for p in ("i", "o") for k in range(5)]
    + [("ideg2to6", "SELECT count(*) FROM d WHERE i >= 2 AND i < 6"), ("odegree1.5", "SELECT sum(power(o, 1.5)) FROM d"), ("gwideg.fixed.0.5", f"SELECT sum({gw('i')}) FROM d"), ("gwodeg.fixed.0.5", f"SELECT sum({gw('o')}) FROM d")]
    + [(f"sender{k + 1}", f"SELECT o FROM d WHERE vid = {k}") for k in range(1, 25)] + [(f"receiver{k + 1}", f"SELECT i FROM d WHERE vid = {k}") for k in range(1, 25)]
    + [("nodeocovrange.region", "SELECT sum(z) FROM (SELECT max(dr) - min(dr) AS z FROM t GROUP BY src)"), ("nodeicovrange.region", "SELECT sum(z) FROM (SELECT max(sr) - min(sr) AS z FROM t GROUP BY dst)"), ("nodeofactordistinct.region", "SELECT sum(z) FROM (SELECT count(DISTINCT dr) AS z FROM t GROUP BY src)"), ("nodefactordistinct.region", "SELECT sum(z) FROM (SELECT count(DISTINCT x) AS z FROM (SELECT src AS q, dr AS x FROM t UNION ALL SELECT dst, sr FROM t) GROUP BY q)")]
    + [(f"triadcensus.{k}", f"SELECT count(*) FROM ty WHERE ty = '{k}'") for k in ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")]
    + [("transitive", "SELECT count(*) FROM ty WHERE ty IN ('030T', '120D', '120U', '300')"), ("simmelian", "SELECT count(*) FROM ty WHERE ty = '300'"), ("balance", "SELECT count(*) FROM ty WHERE ty IN ('102', '300')")],
)

stats(
    "cosupply_degrees", tables.cosupply,
    "edges+kstar(2:4)+kstar(2,'third')+degree(0:6)+degree(2:3,by='third')+degree(0:2,by='third',homophily=TRUE)+degrange(3,9)+degrange(5)+concurrent+concurrent(by='third')+concurrentties+isolates+isolatededges+degree1.5+gwdegree(0.5,fixed=TRUE)+gwdegree(0.5,attr='third')+altkstar(2,fixed=TRUE)+meandeg+density+degcrossprod+threetrail+sociality(nodes=1:5)+nodecov('balance')+absdiff('balance')+nodecovrange('balance')",
    COSUPPLY + ", hd AS (SELECT d.vid, d.third, (SELECT count(*) FROM a JOIN d z ON a.j = z.vid WHERE a.i = d.vid AND z.third = d.third) AS h FROM d)",
    [("edges", "SELECT count(*) FROM e"), ("kstar2", "SELECT sum(deg * (deg - 1) / 2) FROM d"), ("kstar3", "SELECT sum(deg * (deg - 1) * (deg - 2) / 6) FROM d"), ("kstar4", "SELECT sum(CAST(deg AS DOUBLE) * (deg - 1) * (deg - 2) * (deg - 3) / 24) FROM d"), ("kstar2.third", "SELECT sum(h * (h - 1) / 2) FROM hd")]
    + [(f"degree{k}", f"SELECT count(*) FROM d WHERE deg = {k}") for k in range(7)]
    + [(f"degree{k}.third{g}", f"SELECT count(*) FROM d WHERE deg = {k} AND third = {g}") for g in range(3) for k in (2, 3)]
    + [(f"degree{k}.homophily.third", f"SELECT count(*) FROM hd WHERE h = {k}") for k in range(3)]
    + [("deg3to9", "SELECT count(*) FROM d WHERE deg >= 3 AND deg < 9"), ("deg5+", "SELECT count(*) FROM d WHERE deg >= 5"), ("concurrent", "SELECT count(*) FROM d WHERE deg >= 2")]
    + [(f"concurrent.third{g}", f"SELECT count(*) FROM d WHERE deg >= 2 AND third = {g}") for g in range(3)]
    + [("concurrentties", "SELECT sum(greatest(deg - 1, 0)) FROM d"), ("isolates", "SELECT count(*) FROM d WHERE deg = 0"), ("isolatededges", "SELECT count(*) FROM t WHERE sd = 1 AND dd = 1"), ("degree1.5", "SELECT sum(power(deg, 1.5)) FROM d"), ("gwdeg.fixed.0.5", f"SELECT sum({gw('deg')}) FROM d")]
    + [(f"gwdeg0.5.third.{g}", f"SELECT coalesce(sum({gw('deg')}), 0) FROM d WHERE third = {g}") for g in range(3)]
    + [("altkstar.2", "SELECT sum(4 * (power(0.5, deg) - 1 + deg / 2.0)) FROM d"), ("meandeg", "SELECT 2.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM v)"), ("density", "SELECT (SELECT count(*) FROM e) / (SELECT count(*) * (count(*) - 1) / 2.0 FROM v)"), ("degcrossprod", "SELECT sum(sd * dd) / count(*) FROM t"), ("threetrail", "SELECT sum((sd - 1) * (dd - 1)) FROM t")]
    + [(f"sociality{k}", f"SELECT deg FROM d ORDER BY vid LIMIT 1 OFFSET {k - 1}") for k in range(1, 6)]
    + [("nodecov.balance", "SELECT sum(sb + db) FROM t"), ("absdiff.balance", "SELECT sum(abs(sb - db)) FROM t"), ("nodecovrange.balance", "SELECT sum(z) FROM (SELECT max(x) - min(x) AS z FROM (SELECT src AS q, db AS x FROM t UNION ALL SELECT dst, sb FROM t) GROUP BY q)")],
)

stats(
    "cosupply_shared_partners", tables.cosupply,
    "triangle+triangle('third')+triangle('third',diff=TRUE)+esp(0:4)+dsp(0:3)+nsp(0:3)+gwesp(0.5,fixed=TRUE)+gwdsp(0.5,fixed=TRUE)+gwnsp(0.5,fixed=TRUE)+opentriad+tripercent+transitiveties+transitiveties('third')+cycle(3:4)+triadcensus(levels=1:4)+intransitive2" .replace("+intransitive2", "") + "+nodematch('third')+nodemix('third',levels2=TRUE)+nodefactor('third')",
    COSUPPLY + ", tr AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst), tl AS (SELECT p.third AS g FROM tr JOIN v p ON tr.a = p.vid JOIN v q ON tr.b = q.vid JOIN v r ON tr.c = r.vid WHERE p.third = q.third AND q.third = r.third), e3 AS (SELECT src, dst FROM t WHERE s3 = d3), a3 AS (SELECT src AS i, dst AS j FROM e3 UNION ALL SELECT dst, src FROM e3), nv AS (SELECT count(*) AS n FROM v), ks AS (SELECT sum(deg * (deg - 1) / 2) AS k FROM d)",
    [("triangle", "SELECT n FROM tri"), ("triangle.third", "SELECT count(*) FROM tl")] + [(f"triangle.third.{g}", f"SELECT count(*) FROM tl WHERE g = {g}") for g in range(3)]
    + [(f"esp{k}", f"SELECT count(*) FROM pe WHERE y = 1 AND sp = {k}") for k in range(5)]
    + [("dsp0", "SELECT (SELECT n * (n - 1) / 2 FROM nv) - (SELECT count(*) FROM pe WHERE sp > 0)")] + [(f"dsp{k}", f"SELECT count(*) FROM pe WHERE sp = {k}") for k in range(1, 4)]
    + [("nsp0", "SELECT (SELECT n * (n - 1) / 2 FROM nv) - (SELECT count(*) FROM pe)")] + [(f"nsp{k}", f"SELECT count(*) FROM pe WHERE y = 0 AND sp = {k}") for k in range(1, 4)]
    + [("gwesp.fixed.0.5", f"SELECT sum({gw('sp')}) FROM pe WHERE y = 1"), ("gwdsp.fixed.0.5", f"SELECT sum({gw('sp')}) FROM pe"), ("gwnsp.fixed.0.5", f"SELECT coalesce(sum({gw('sp')}), 0) FROM pe WHERE y = 0"), ("opentriad", "SELECT (SELECT k FROM ks) - 3 * (SELECT n FROM tri)"), ("tripercent", "SELECT 100.0 * (SELECT n FROM tri) / ((SELECT k FROM ks) - 2 * (SELECT n FROM tri))"), ("transitiveties", "SELECT count(*) FROM pe WHERE y = 1 AND sp > 0"),
       ("transitiveties.third", "SELECT count(*) FROM e3 SEMI JOIN (SELECT x.i AS i, y.i AS j FROM a3 x JOIN a3 y ON x.j = y.j AND x.i < y.i) q ON e3.src = q.i AND e3.dst = q.j"), ("cycle3", "SELECT n FROM tri"), ("cycle4", "SELECT sum(sp * (sp - 1) / 2) / 2 FROM sp"),
       ("triadcensus.0", "SELECT (SELECT n * (n - 1) * (n - 2) / 6 FROM nv) - (SELECT n FROM tri) - ((SELECT k FROM ks) - 3 * (SELECT n FROM tri)) - ((SELECT count(*) FROM e) * (SELECT n - 2 FROM nv) - 2 * ((SELECT k FROM ks) - 3 * (SELECT n FROM tri)) - 3 * (SELECT n FROM tri))"), ("triadcensus.1", "SELECT (SELECT count(*) FROM e) * (SELECT n - 2 FROM nv) - 2 * ((SELECT k FROM ks) - 3 * (SELECT n FROM tri)) - 3 * (SELECT n FROM tri)"), ("triadcensus.2", "SELECT (SELECT k FROM ks) - 3 * (SELECT n FROM tri)"), ("triadcensus.3", "SELECT n FROM tri"), ("nodematch.third", "SELECT count(*) FROM t WHERE s3 = d3")]
    + [(f"mix.third.{r}.{c}", f"SELECT count(*) FROM t WHERE least(s3, d3) = {r} AND greatest(s3, d3) = {c}") for c in range(3) for r in range(c + 1)]
    + [(f"nodefactor.third.{k}", f"SELECT count(*) FILTER (s3 = {k}) + count(*) FILTER (d3 = {k}) FROM t") for k in (1, 2)],
)

stats(
    "copart_statistics", tables.copart,
    "edges+nodematch('brand')+absdiff('size')+nodecov('size')+degree(0:5)+kstar(2:3)+triangle+gwesp(0.5,fixed=TRUE)+isolates+smalldiff('size',5)+edges:nodematch('brand')+nodecov('size'):nodematch('brand')",
    COPART + ", sp AS (SELECT x.i AS i, y.i AS j, count(*) AS sp FROM a x JOIN a y ON x.j = y.j AND x.i < y.i GROUP BY ALL), es AS (SELECT coalesce(sp.sp, 0) AS sp FROM e LEFT JOIN sp ON e.src = sp.i AND e.dst = sp.j)",
    [("edges", "SELECT count(*) FROM e"), ("nodematch.brand", "SELECT count(*) FROM t WHERE sb = db"), ("absdiff.size", "SELECT sum(abs(ss - ds)) FROM t"), ("nodecov.size", "SELECT sum(ss + ds) FROM t")]
    + [(f"degree{k}", f"SELECT count(*) FROM d WHERE deg = {k}") for k in range(6)]
    + [("kstar2", "SELECT sum(deg * (deg - 1) / 2) FROM d"), ("kstar3", "SELECT sum(deg * (deg - 1) * (deg - 2) / 6) FROM d"), ("triangle", "SELECT sum(sp) / 3 FROM es"), ("gwesp.fixed.0.5", f"SELECT sum({gw('sp')}) FROM es"), ("isolates", "SELECT count(*) FROM d WHERE deg = 0"), ("smalldiff.size5", "SELECT count(*) FROM t WHERE abs(ss - ds) <= 5"), ("edges:nodematch.brand", "SELECT count(*) FROM t WHERE sb = db"), ("nodecov.size:nodematch.brand", "SELECT sum(ss + ds) FROM t WHERE sb = db")],
)

stats(
    "supplypart_bipartite", tables.supplypart,
    "edges+density+b1star(2:3)+b2star(2)+b1star(2,'grp')+b1degree(20:24)+b2degree(0:4)+b1degrange(20,40)+b2degrange(2)+b1mindegree(30)+b2mindegree(3)+b1concurrent+b2concurrent+gwb1degree(0.5,fixed=TRUE)+gwb2degree(0.5,fixed=TRUE)+b1factor('grp')+b2factor('grp',levels=TRUE)+b1cov('x')+b2cov('x')+b1dsp(0:2)+b2dsp(0:2)+gwb1dsp(0.5,fixed=TRUE)+gwb2dsp(0.5,fixed=TRUE)+b1nodematch('grp')+b2nodematch('grp',diff=TRUE)+b1nodematch('grp',beta=0.5)+b2nodematch('grp',alpha=0.5)+b1starmix(2,'grp')+b2starmix(2,'grp',diff=FALSE)+b1twostar('grp')+b1covrange('x')+b2covrange('x')+b1factordistinct('grp')+b2factordistinct('grp')+nodemix('grp',levels2=TRUE)+nodematch('grp')+Proj1(~edges+triangle)",
    SUPPLYPART + """, n1 AS (SELECT count(*) AS n FROM v1), n2 AS (SELECT count(*) AS n FROM v2), q1 AS (SELECT a.t, a.s AS i, b.s AS j, a.g1 AS g FROM j a JOIN j b ON a.t = b.t AND a.s < b.s AND a.g1 = b.g1), q2 AS (SELECT a.s, a.t AS i, b.t AS j, a.g2 AS g FROM j a JOIN j b ON a.s = b.s AND a.t < b.t AND a.g2 = b.g2),
k1 AS (SELECT s, g1, g2, count(*) AS k FROM j GROUP BY ALL), k2 AS (SELECT t, g2, g1, count(*) AS k FROM j GROUP BY ALL), pe AS (SELECT i AS src, j AS dst FROM p1), tri AS (SELECT count(*) AS n FROM pe x JOIN pe y ON x.dst = y.src JOIN pe z ON z.src = x.src AND z.dst = y.dst)""",
    [("edges", "SELECT count(*) FROM e"), ("density", "SELECT count(*) / ((SELECT n FROM n1) * CAST((SELECT n FROM n2) AS DOUBLE)) FROM e"), ("b1star2", "SELECT sum(deg * (deg - 1) / 2) FROM v1"), ("b1star3", "SELECT sum(deg * (deg - 1) * (deg - 2) / 6) FROM v1"), ("b2star2", "SELECT sum(deg * (deg - 1) / 2) FROM v2"), ("b1star2.grp", "SELECT sum(k * (k - 1) / 2) FROM k1 WHERE g1 = g2")]
    + [(f"b1degree{k}", f"SELECT count(*) FROM v1 WHERE deg = {k}") for k in range(20, 25)] + [(f"b2degree{k}", f"SELECT count(*) FROM v2 WHERE deg = {k}") for k in range(5)]
    + [("b1deg20to40", "SELECT count(*) FROM v1 WHERE deg >= 20 AND deg < 40"), ("b2deg2+", "SELECT count(*) FROM v2 WHERE deg >= 2"), ("b1mindeg30", "SELECT count(*) FROM v1 WHERE deg >= 30"), ("b2mindeg3", "SELECT count(*) FROM v2 WHERE deg >= 3"), ("b1concurrent", "SELECT count(*) FROM v1 WHERE deg >= 2"), ("b2concurrent", "SELECT count(*) FROM v2 WHERE deg >= 2"), ("gwb1deg.fixed.0.5", f"SELECT sum({gw('deg')}) FROM v1"), ("gwb2deg.fixed.0.5", f"SELECT sum({gw('deg')}) FROM v2")]
    + [(f"b1factor.grp.{k}", f"SELECT count(*) FROM j WHERE g1 = {k}") for k in (1, 2)] + [(f"b2factor.grp.{k}", f"SELECT count(*) FROM j WHERE g2 = {k}") for k in range(3)]
    + [("b1cov.x", "SELECT sum(x1) FROM j"), ("b2cov.x", "SELECT sum(x2) FROM j")]
    + [(f"b{m}dsp0", f"SELECT (SELECT CAST(n AS DOUBLE) * (n - 1) / 2 FROM n{m}) - (SELECT count(*) FROM p{m})") for m in (1, 2)] + [(f"b{m}dsp{k}", f"SELECT count(*) FROM p{m} WHERE sp = {k}") for m in (1, 2) for k in (1, 2)]
    + [(f"gwb{m}dsp.fixed.0.5", f"SELECT sum({gw('sp')}) FROM p{m}") for m in (1, 2)]
    + [("b1nodematch.grp", "SELECT count(*) FROM q1")] + [(f"b2nodematch.grp.{g}", f"SELECT count(*) FROM q2 WHERE g = {g}") for g in range(3)]
    + [("b1nodematch.grp.1", "SELECT sum(power(k, 0.5)) / 2 FROM (SELECT t, x, count(*) AS k FROM (SELECT t, i AS x FROM q1 UNION ALL SELECT t, j FROM q1) GROUP BY t, x)"), ("b2nodematch.grp", "SELECT sum(power(k, 0.5)) FROM (SELECT i, j, count(*) AS k FROM q2 GROUP BY i, j)")]
    + [(f"b1starmix.2.grp.{a}.{b}", f"SELECT coalesce(sum(k * (k - 1) / 2), 0) FROM k1 WHERE g1 = {a} AND g2 = {b}") for b in range(3) for a in range(3)]
    + [(f"b2starmix.2.grp.{a}", f"SELECT coalesce(sum(k * (k - 1) / 2), 0) FROM k2 WHERE g2 = {a}") for a in range(3)]
    + [(f"b1twostar.grp.{a}.grp.{x}.{y}", f"SELECT coalesce(sum({'p.k * (p.k - 1) / 2' if x == y else 'p.k * q.k'}), 0) FROM k1 p JOIN k1 q ON p.s = q.s WHERE p.g1 = {a} AND p.g2 = {x} AND q.g2 = {y}") for y in range(3) for x in range(y + 1) for a in range(3)]
    + [("b1covrange.x", "SELECT sum(z) FROM (SELECT max(x2) - min(x2) AS z FROM j GROUP BY s)"), ("b2covrange.x", "SELECT sum(z) FROM (SELECT max(x1) - min(x1) AS z FROM j GROUP BY t)"), ("b1factordistinct.grp", "SELECT sum(z) FROM (SELECT count(DISTINCT g2) AS z FROM j GROUP BY s)"), ("b2factordistinct.grp", "SELECT sum(z) FROM (SELECT count(DISTINCT g1) AS z FROM j GROUP BY t)")]
    + [(f"mix.grp.{a}.{b}", f"SELECT count(*) FROM j WHERE g1 = {a} AND g2 = {b}") for b in range(3) for a in range(3)]
    + [("nodematch.grp", "SELECT count(*) FROM j WHERE g1 = g2"), ("Proj1~edges", "SELECT count(*) FROM p1"), ("Proj1~triangle", "SELECT n FROM tri")],
)

# --- operators ------------------------------------------------------------------------------------------------------------------

stats(
    "trade_operators", tables.trade,
    "F(~edges+mutual,~nodematch('region'))+F(~edges,~absdiff('region')<=1)+S(~edges+mutual+density,~(region==0|region==1))+Symmetrize(~edges+triangle,'weak')+Symmetrize(~edges+triangle,'strong')+Symmetrize(~edges,'upper')+Symmetrize(~edges,'lower')+Sum(~edges+mutual,'both')+Prod(~edges,'e')+Log(~edges)+Exp(~density)+Label(~edges,'ties')+I(~mutual)+offset(asymmetric)+For(~nodeocov(a),a=c('region'))+nodematch('region'):nodeocov('region')",
    TRADE + ", w AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS k FROM e GROUP BY ALL), s AS (SELECT a, b FROM w WHERE k = 2)",
    [('F(nodematch("region"))~edges', "SELECT count(*) FROM t WHERE sr = dr"), ('F(nodematch("region"))~mutual', "SELECT count(*) / 2 FROM m JOIN v a ON m.src = a.vid JOIN v b ON m.dst = b.vid WHERE a.region = b.region"), ('F(absdiff("region")<=1)~edges', "SELECT count(*) FROM t WHERE abs(sr - dr) <= 1"),
     ("S(region==0|region==1)~edges", "SELECT count(*) FROM t WHERE sr IN (0, 1) AND dr IN (0, 1)"), ("S(region==0|region==1)~mutual", "SELECT count(*) / 2 FROM m JOIN v a ON m.src = a.vid JOIN v b ON m.dst = b.vid WHERE a.region IN (0, 1) AND b.region IN (0, 1)"), ("S(region==0|region==1)~density", "SELECT (SELECT count(*) FROM t WHERE sr IN (0, 1) AND dr IN (0, 1)) / (SELECT count(*) * (count(*) - 1.0) FROM v WHERE region IN (0, 1))"),
     ("Symmetrize(weak)~edges", "SELECT count(*) FROM w"), ("Symmetrize(weak)~triangle", "SELECT count(*) FROM w x JOIN w y ON x.b = y.a JOIN w z ON z.a = x.a AND z.b = y.b"), ("Symmetrize(strong)~edges", "SELECT count(*) FROM s"), ("Symmetrize(strong)~triangle", "SELECT count(*) FROM s x JOIN s y ON x.b = y.a JOIN s z ON z.a = x.a AND z.b = y.b"), ("Symmetrize(upper)~edges", "SELECT count(*) FROM e WHERE src < dst"), ("Symmetrize(lower)~edges", "SELECT count(*) FROM e WHERE src > dst"),
     ("Sum~both1", "SELECT count(*) FROM e"), ("Sum~both2", "SELECT count(*) / 2 FROM m"), ("Prod~e", "SELECT count(*) FROM e"), ("Log~edges", "SELECT ln(count(*)) FROM e"), ("Exp~density", "SELECT exp(count(*) / 600.0) FROM e"), ("ties(edges)", "SELECT count(*) FROM e"), ("mutual", "SELECT count(*) / 2 FROM m"), ("offset(asymmetric)", "SELECT (SELECT count(*) FROM e) - (SELECT count(*) FROM m)"), ("nodeocov.region", "SELECT sum(sr) FROM t"), ("nodematch.region:nodeocov.region", "SELECT sum(sr) FROM t WHERE sr = dr")],
)

add(
    "trade_valued", lambda spark, sf_dir: valued_summary(tables.trade(spark, sf_dir), "sum+sum(pow=2)+nonzero+atleast(c(0,5))+atmost(5)+greaterthan(5)+smallerthan(5)+equalto(5,1)+ininterval(2,9,open=c(FALSE,TRUE))+mutual(form='min')+mutual(form='nabsdiff')+mutual(form='product')+mutual(form='geometric')+nodecov('region')+nodematch('region',form='nonzero')+transitiveweights+cyclicalweights('geomean','sum')+nodeocovar+nodeicovar(center=TRUE)"),
    TRADE + ", r AS (SELECT coalesce(x.w, 0) AS a, coalesce(y.w, 0) AS b FROM (SELECT src, dst, w FROM e WHERE src < dst) x FULL JOIN (SELECT dst AS src, src AS dst, w FROM e WHERE src > dst) y ON x.src = y.src AND x.dst = y.dst), p2 AS (SELECT x.src AS i, y.dst AS j, max(least(x.w, y.w)) AS p, sum(sqrt(x.w * y.w)) AS q FROM e x JOIN e y ON x.dst = y.src AND x.src <> y.dst GROUP BY ALL)",
    [("sum", "SELECT sum(w) FROM e"), ("sum2", "SELECT sum(w * w) FROM e"), ("nonzero", "SELECT count(*) FROM e"), ("atleast.0", "SELECT 600"), ("atleast.5", "SELECT count(*) FROM e WHERE w >= 5"), ("atmost.5", "SELECT 600 - (SELECT count(*) FROM e WHERE w > 5)"), ("greaterthan.5", "SELECT count(*) FROM e WHERE w > 5"), ("smallerthan.5", "SELECT 600 - (SELECT count(*) FROM e WHERE w >= 5)"), ("equalto.5.pm.1", "SELECT count(*) FROM e WHERE abs(w - 5) <= 1"), ("ininterval[2,9)", "SELECT count(*) FROM e WHERE w >= 2 AND w < 9"),
     ("mutual.min", "SELECT sum(least(a, b)) FROM r"), ("mutual.nabsdiff", "SELECT -sum(abs(a - b)) FROM r"), ("mutual.product", "SELECT sum(a * b) FROM r"), ("mutual.geometric", "SELECT sum(sqrt(a * b)) FROM r"), ("nodecov.region.sum", "SELECT sum(w * (sr + dr)) FROM t"), ("nodematch.region.nonzero", "SELECT count(*) FROM t WHERE sr = dr"),
     ("transitiveweights.min.max.min", "SELECT coalesce(sum(least(e.w, p2.p)), 0) FROM e JOIN p2 ON e.src = p2.i AND e.dst = p2.j"), ("cyclicalweights.geomean.sum.min", "SELECT coalesce(sum(least(e.w, p2.q)), 0) FROM e JOIN p2 ON e.src = p2.j AND e.dst = p2.i"), ("nodeocovar", "SELECT sum(z * z - q) / 23 FROM (SELECT sum(w) AS z, sum(w * w) AS q FROM e GROUP BY src)"), ("nodeicovar", "SELECT (SELECT sum(z * z - q) / 23 FROM (SELECT sum(w) AS z, sum(w * w) AS q FROM e GROUP BY dst)) - (SELECT sum(w) * sum(w) / 600 FROM e)")],
)

# --- series ---------------------------------------------------------------------------------------------------------------------

SERIES = f"""p AS ({_PAIRS.format(more="year(l.l_shipdate) AS t,", where="AND year(l.l_shipdate) BETWEEN 1995 AND 2001")}), q AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY w DESC, src, dst) AS r FROM p),
e AS (SELECT t, src, dst FROM q WHERE r <= 150), ts AS (SELECT DISTINCT t FROM e), st AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS net FROM ts), n AS (SELECT st.net, e.src, e.dst FROM e JOIN st ON e.t = st.t),
c AS (SELECT * FROM n WHERE net > 0), b AS (SELECT net + 1 AS net, src, dst FROM n WHERE net < (SELECT max(net) FROM n))"""


def trade_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = summary_stats(tables.trade_series(spark, sf_dir), "edges+mutual+Form(~edges+mutual)+Persist(~edges+mutual)+Diss(~edges)+Change(~edges)+Cross(~edges)")
    return got.select("net", "stat", F.round("value", 6).alias("value"))


QUERIES["trade_series"] = trade_series
_MUT = "SELECT x.net, count(*) / 2 AS value FROM {t} x JOIN {t} y ON x.net = y.net AND x.src = y.dst AND x.dst = y.src GROUP BY 1"
ORACLE_SQL["trade_series"] = f"""WITH {SERIES}, f AS (SELECT * FROM c UNION SELECT * FROM b), k AS (SELECT * FROM c INTERSECT SELECT * FROM b), g AS (SELECT DISTINCT net FROM c),
r AS (SELECT net, 'edges' AS stat, count(*) AS value FROM c GROUP BY 1 UNION ALL SELECT net, 'mutual', value FROM ({_MUT.format(t="c")}) UNION ALL SELECT net, 'Form(1)~edges', count(*) FROM f GROUP BY 1 UNION ALL SELECT net, 'Form(1)~mutual', value FROM ({_MUT.format(t="f")})
UNION ALL SELECT net, 'Persist(1)~edges', count(*) FROM k GROUP BY 1 UNION ALL SELECT net, 'Persist(1)~mutual', value FROM ({_MUT.format(t="k")}) UNION ALL SELECT net, 'Diss(1)~edges', -count(*) FROM k GROUP BY 1
UNION ALL SELECT net, 'Change(1)~edges', count(*) FROM ((SELECT * FROM c EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM c)) GROUP BY 1 UNION ALL SELECT net, 'Cross(1)~edges', count(*) FROM c GROUP BY 1),
nm AS (SELECT DISTINCT stat FROM r UNION SELECT unnest(['mutual', 'Form(1)~mutual', 'Persist(1)~mutual', 'Persist(1)~edges', 'Diss(1)~edges', 'Change(1)~edges'])) SELECT CAST(g.net AS BIGINT) AS net, nm.stat, round(CAST(coalesce(r.value, 0) AS DOUBLE), 6) AS value FROM g CROSS JOIN nm LEFT JOIN r ON r.net = g.net AND r.stat = nm.stat"""


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = tables.trade_pairs(spark, sf_dir, "year").where("year between 1995 and 2001")
    return tables.strongest(pairs, 150, "year").select(F.col("year").cast("long").alias("t"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


def trade_tie_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ages.age_stats(ages.tie_ages(_yearly(spark, sf_dir)), intervals=[(1, 2), (2, 4), (4, None)])
    return got.select("t", "stat", F.round("value", 6).alias("value"))


_AGES = "i AS (SELECT t, src, dst, t - row_number() OVER (PARTITION BY src, dst ORDER BY t) AS g FROM e), a AS (SELECT t, src, dst, row_number() OVER (PARTITION BY src, dst, g ORDER BY t) AS age FROM i)"
QUERIES["trade_tie_ages"] = trade_tie_ages
ORACLE_SQL["trade_tie_ages"] = f"""WITH {SERIES}, {_AGES} SELECT CAST(t AS BIGINT) AS t, stat, round(CAST(value AS DOUBLE), 6) AS value FROM (SELECT t, 'edges' AS stat, count(*) AS value FROM a GROUP BY t UNION ALL SELECT t, 'edge.ages', sum(age) FROM a GROUP BY t UNION ALL SELECT t, 'mean.age', avg(age) FROM a GROUP BY t
UNION ALL SELECT t, 'edges.age1to2', count(*) FILTER (age >= 1 AND age < 2) FROM a GROUP BY t UNION ALL SELECT t, 'edges.age2to4', count(*) FILTER (age >= 2 AND age < 4) FROM a GROUP BY t UNION ALL SELECT t, 'edges.age4+', count(*) FILTER (age >= 4) FROM a GROUP BY t)"""


def trade_tie_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ages.spells(_yearly(spark, sf_dir))


QUERIES["trade_tie_spells"] = trade_tie_spells
ORACLE_SQL["trade_tie_spells"] = f"WITH {SERIES}, {_AGES} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(t - age + 1 AS BIGINT) AS onset, CAST(max(t) AS BIGINT) AS last, CAST(max(age) AS BIGINT) AS duration, t - age + 1 = (SELECT min(t) FROM e) AS censored_left, max(t) = (SELECT max(t) FROM e) AS censored_right FROM a GROUP BY src, dst, t - age + 1"


def trade_tie_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ages.changes(_yearly(spark, sf_dir))


QUERIES["trade_tie_changes"] = trade_tie_changes
ORACLE_SQL["trade_tie_changes"] = f"WITH {SERIES}, y AS (SELECT t + 1 AS t, src, dst FROM e), j AS (SELECT coalesce(e.t, y.t) AS t, e.src AS n, y.src AS b FROM e FULL JOIN y ON e.t = y.t AND e.src = y.src AND e.dst = y.dst) SELECT CAST(t AS BIGINT) AS t, count(*) FILTER (b IS NULL) AS formed, count(*) FILTER (n IS NULL) AS dissolved, count(*) FILTER (n IS NOT NULL AND b IS NOT NULL) AS persisted FROM j WHERE t > (SELECT min(t) FROM e) AND t <= (SELECT max(t) FROM e) GROUP BY t"

# --- pseudo-likelihood ------------------------------------------------------------------------------------------------------------


def copart_design_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = pseudolikelihood.table(tables.copart(spark, sf_dir), "edges+nodematch('brand')+absdiff('size')+triangle")
    return rows


QUERIES["copart_design_table"] = copart_design_table
ORACLE_SQL["copart_design_table"] = f"WITH {COPART}, sp AS (SELECT x.i AS i, y.i AS j, count(*) AS sp FROM a x JOIN a y ON x.j = y.j AND x.i < y.i GROUP BY ALL) SELECT CAST(1 AS DOUBLE) AS x0, CAST(CASE WHEN p.brand = q.brand THEN 1 ELSE 0 END AS DOUBLE) AS x1, CAST(abs(p.size - q.size) AS DOUBLE) AS x2, CAST(coalesce(sp.sp, 0) AS DOUBLE) AS x3, CASE WHEN e.src IS NULL THEN 0 ELSE 1 END AS y, count(*) AS n FROM v p JOIN v q ON p.vid < q.vid LEFT JOIN e ON e.src = p.vid AND e.dst = q.vid LEFT JOIN sp ON sp.i = p.vid AND sp.j = q.vid GROUP BY ALL"


def copart_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact maximum likelihood of a saturated model, whose closed form SQL has."""
    got = pseudolikelihood.fit(tables.copart(spark, sf_dir), "edges+nodematch('brand')")
    rows = [(n, round(b, 5), round(e, 5)) for n, b, e, _, _ in got.rows()] + [("loglik", round(got.loglik, 3), 0.0)]
    return spark.createDataFrame(rows, "name string, estimate double, stderr double")


QUERIES["copart_logit"] = copart_logit
ORACLE_SQL["copart_logit"] = f"""WITH {COPART}, dy AS (SELECT p.brand = q.brand AS s, count(*) AS n FROM v p JOIN v q ON p.vid < q.vid GROUP BY ALL), k AS (SELECT sb = db AS s, count(*) AS y FROM t GROUP BY ALL), f AS (SELECT dy.s, CAST(n AS DOUBLE) AS n, CAST(y AS DOUBLE) AS y FROM dy JOIN k ON dy.s = k.s),
z AS (SELECT (SELECT ln(y / (n - y)) FROM f WHERE NOT s) AS b0, (SELECT ln(y / (n - y)) FROM f WHERE s) AS b1, (SELECT 1 / y + 1 / (n - y) FROM f WHERE NOT s) AS v0, (SELECT 1 / y + 1 / (n - y) FROM f WHERE s) AS v1)
SELECT 'edges' AS name, round(b0, 5) AS estimate, round(sqrt(v0), 5) AS stderr FROM z UNION ALL SELECT 'nodematch.brand', round(b1 - b0, 5), round(sqrt(v0 + v1), 5) FROM z UNION ALL SELECT 'loglik', round((SELECT sum(y * ln(y / n) + (n - y) * ln(1 - y / n)) FROM f), 3), 0.0"""


def trade_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pseudolikelihood.predict(tables.trade(spark, sf_dir), "edges+nodematch('region')+mutual", [-1.0, 0.5, 0.75])
    return got.select("src", "dst", "y", F.round("p", 6).alias("p"))


QUERIES["trade_predict"] = trade_predict
ORACLE_SQL["trade_predict"] = f"WITH {TRADE} SELECT CAST(a.vid AS BIGINT) AS src, CAST(b.vid AS BIGINT) AS dst, CASE WHEN x.src IS NULL THEN 0 ELSE 1 END AS y, round(1 / (1 + exp(-(-1.0 + 0.5 * (CASE WHEN a.region = b.region THEN 1 ELSE 0 END) + 0.75 * (CASE WHEN z.src IS NULL THEN 0 ELSE 1 END)))), 6) AS p FROM v a JOIN v b ON a.vid <> b.vid LEFT JOIN e x ON x.src = a.vid AND x.dst = b.vid LEFT JOIN e z ON z.src = b.vid AND z.dst = a.vid"


def cosupply_change_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, _, _ = pseudolikelihood.design(tables.cosupply(spark, sf_dir), "edges+kstar(2)+triangle+gwesp(0.5,fixed=TRUE)")
    return frame.select("src", "dst", "y", *[F.round(f"x{k}", 6).alias(f"x{k}") for k in range(4)])


QUERIES["cosupply_change_statistics"] = cosupply_change_statistics
ORACLE_SQL["cosupply_change_statistics"] = f"""WITH {COSUPPLY}, ord AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS r FROM v), dy AS (SELECT p.vid AS i, q.vid AS j, p.deg AS di, q.deg AS dj, CASE WHEN e.src IS NULL THEN 0 ELSE 1 END AS y FROM d p JOIN d q ON p.vid < q.vid LEFT JOIN e ON e.src = p.vid AND e.dst = q.vid),
bs AS (SELECT i, j, sp FROM sp UNION ALL SELECT j, i, sp FROM sp), te AS (SELECT a.i, a.j, coalesce(bs.sp, 0) AS sp FROM a LEFT JOIN bs ON a.i = bs.i AND a.j = bs.j),
g AS (SELECT dy.i, dy.j, count(*) AS s, sum(power({_R!r}, x.sp - y) + power({_R!r}, z.sp - y)) AS t FROM dy JOIN te x ON x.i = dy.i JOIN te z ON z.i = dy.j AND z.j = x.j GROUP BY dy.i, dy.j)
SELECT CAST(oi.r AS BIGINT) AS src, CAST(oj.r AS BIGINT) AS dst, dy.y, CAST(1 AS DOUBLE) AS x0, CAST(di - y + dj - y AS DOUBLE) AS x1, CAST(coalesce(g.s, 0) AS DOUBLE) AS x2, round(CAST(coalesce({gw('g.s')} + g.t, 0) AS DOUBLE), 6) AS x3 FROM dy JOIN ord oi ON oi.vid = dy.i JOIN ord oj ON oj.vid = dy.j LEFT JOIN g ON g.i = dy.i AND g.j = dy.j"""

# --- goodness of fit ----------------------------------------------------------------------------------------------------------------


def cosupply_gof(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = tables.cosupply(spark, sf_dir)
    parts = [("degree", gof.degree_distribution(net)), ("espartners", gof.shared_partners(net)), ("dspartners", gof.shared_partners(net, pairs=True))]
    out = None
    for name, frame in parts:
        one = frame.select(F.lit(name).alias("stat"), F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["cosupply_gof"] = cosupply_gof
ORACLE_SQL["cosupply_gof"] = f"WITH {COSUPPLY} SELECT 'degree' AS stat, CAST(deg AS BIGINT) AS k, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT 'espartners', CAST(sp AS BIGINT), count(*) FROM pe WHERE y = 1 GROUP BY ALL UNION ALL SELECT 'dspartners', CAST(sp AS BIGINT), count(*) FROM sp GROUP BY ALL UNION ALL SELECT 'dspartners', CAST(0 AS BIGINT), CAST((SELECT count(*) * (count(*) - 1) / 2 FROM v) - (SELECT count(*) FROM sp) AS BIGINT)"


def cosupply_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gof.distances(tables.cosupply(spark, sf_dir)).select(F.coalesce(F.col("k"), F.lit(-1).cast("long")).alias("k"), F.col("n").cast("long").alias("n"))


QUERIES["cosupply_distances"] = cosupply_distances
ORACLE_SQL["cosupply_distances"] = f"WITH RECURSIVE {COSUPPLY}, r AS (SELECT vid AS s, vid AS x, 0 AS k FROM v UNION SELECT r.s, a.j, r.k + 1 FROM r JOIN a ON a.i = r.x WHERE r.k < 12), f AS (SELECT s, x, min(k) AS k FROM r GROUP BY s, x) SELECT CAST(k AS BIGINT) AS k, CAST(count(*) / 2 AS BIGINT) AS n FROM f WHERE k > 0 GROUP BY k UNION ALL SELECT CAST(-1 AS BIGINT), n FROM (SELECT CAST((SELECT count(*) * (count(*) - 1) / 2 FROM v) - (SELECT count(*) / 2 FROM f WHERE k > 0) AS BIGINT) AS n) WHERE n > 0"


# --- levels, layers, many networks, egos ----------------------------------------------------------------------------------------


def _two_levels(spark: SparkSession, sf_dir: str) -> Network:
    """Suppliers tied by common orders, parts tied by common orders, and suppliers with their parts of large lineitems."""
    key = lambda p, c: F.concat(F.lit(p), F.lpad(c, 9, "0"))
    pair = lambda frame, p: frame.select(key(p, "src").alias("src"), key(p, "dst").alias("dst"))
    a = pair(tables.strongest(tables.together(spark, sf_dir, "l_suppkey"), 400), "s")
    b = pair(tables.together(spark, sf_dir, "l_partkey").where("w >= 2"), "t")
    x = tables.table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(key("s", "l_suppkey").alias("src"), key("t", "l_partkey").alias("dst")).distinct()
    v = tables.table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("key"), F.lit("A").alias("level")).union(tables.table(spark, sf_dir, "part").select(key("t", "p_partkey").alias("key"), F.lit("B").alias("level")))
    return Network.from_tables(a.union(b).union(x), v)


_LOG2 = lambda x: f"(2 * (1 - power(0.5, {x})))"
LEVELS = """la AS (SELECT DISTINCT l_orderkey, l_suppkey AS x FROM lineitem), pa AS (SELECT a.x AS u, b.x AS v, count(*) AS w FROM la a JOIN la b ON a.l_orderkey = b.l_orderkey AND a.x < b.x GROUP BY ALL), ea AS (SELECT u, v FROM pa ORDER BY w DESC, u, v LIMIT 400),
lb AS (SELECT DISTINCT l_orderkey, l_partkey AS x FROM lineitem), eb AS (SELECT a.x AS u, b.x AS v FROM lb a JOIN lb b ON a.l_orderkey = b.l_orderkey AND a.x < b.x GROUP BY ALL HAVING count(*) >= 2), ex AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity >= 48),
ga AS (SELECT i, count(*) AS k FROM (SELECT u AS i FROM ea UNION ALL SELECT v FROM ea) GROUP BY i), gb AS (SELECT i, count(*) AS k FROM (SELECT u AS i FROM eb UNION ALL SELECT v FROM eb) GROUP BY i), xa AS (SELECT a AS i, count(*) AS k FROM ex GROUP BY a), xb AS (SELECT b AS i, count(*) AS k FROM ex GROUP BY b),
va AS (SELECT ga.i, ga.k AS d, xa.k AS x FROM ga JOIN xa ON ga.i = xa.i), vb AS (SELECT gb.i, gb.k AS d, xb.k AS x FROM gb JOIN xb ON gb.i = xb.i),
sa AS (SELECT ea.u, ea.v, count(*) AS sp FROM ea JOIN ex p ON p.a = ea.u JOIN ex q ON q.a = ea.v AND q.b = p.b GROUP BY ALL), sb AS (SELECT eb.u, eb.v, count(*) AS sp FROM eb JOIN ex p ON p.b = eb.u JOIN ex q ON q.b = eb.v AND q.a = p.a GROUP BY ALL),
bb AS (SELECT u, v FROM eb UNION ALL SELECT v, u FROM eb)"""
stats(
    "multilevel_statistics", _two_levels,
    "star2ax('level')+star2bx('level')+axs1a('level')+axs1b('level')+aas1x('level')+abs1x('level')+aaaxs('level')+abaxs('level')+txax('level')+txbx('level')+atxax('level')+atxbx('level')+l3xax('level')+l3xbx('level')+l3axb('level')+c4axb('level')+asaxasb('level')",
    LEVELS,
    [(f"Star2{m}X.level", f"SELECT sum(d * x) FROM v{m.lower()}") for m in "AB"] + [(f"AXS1{m}.level.0.693147", f"SELECT sum(d * {_LOG2('x')}) FROM v{m.lower()}") for m in "AB"] + [(f"A{m}S1X.level.0.693147", f"SELECT sum({_LOG2('d')} * x) FROM v{m.lower()}") for m in "AB"] + [(f"A{m}AXS.level.0.693147", f"SELECT sum({_LOG2('d')} * {_LOG2('x')}) FROM v{m.lower()}") for m in "AB"]
    + [(f"TX{m}X.level", f"SELECT coalesce(sum(sp), 0) FROM s{m.lower()}") for m in "AB"] + [(f"ATX{m}X.level.0.693147", f"SELECT coalesce(sum({_LOG2('sp')}), 0) FROM s{m.lower()}") for m in "AB"]
    + [(f"L3X{m}X.level", f"SELECT sum(p.k * q.k) FROM e{m.lower()} e JOIN x{m.lower()} p ON e.u = p.i JOIN x{m.lower()} q ON e.v = q.i") for m in "AB"]
    + [("L3AXB.level", "SELECT sum(p.k * q.k) FROM ex JOIN ga p ON ex.a = p.i JOIN gb q ON ex.b = q.i"), ("C4AXB.level", "SELECT count(*) FROM ea JOIN ex p ON p.a = ea.u JOIN ex q ON q.a = ea.v JOIN bb ON bb.u = p.b AND bb.v = q.b"), ("ASAXASB.level.0.693147", f"SELECT sum({_LOG2('p.k')} * {_LOG2('q.k')}) FROM ex JOIN ga p ON ex.a = p.i JOIN gb q ON ex.b = q.i")],
)


def _regions(spark: SparkSession, sf_dir: str) -> Network:
    """Suppliers tied by common orders inside their region: a network for each region, with its number and name."""
    nation = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("long").alias("net"))
    v = tables.table(spark, sf_dir, "supplier").join(F.broadcast(nation), "s_nationkey").select("net", F.col("s_suppkey").alias("key"))
    e = tables.strongest(tables.together(spark, sf_dir, "l_suppkey"), 400)
    e = e.join(v.select("net", F.col("key").alias("src")), "src").join(v.select(F.col("net").alias("net2"), F.col("key").alias("dst")), "dst").where("net = net2").select("net", "src", "dst")
    got = Network.from_tables(e, v, net="net")
    names = tables.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("net"), F.col("r_name").alias("name"))
    return Network(got.vertices, got.edges, got.graphs.join(names, "net"))


def regional_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combined.network_model(_regions(spark, sf_dir), "edges+degree(0:2)+kstar(2)", "~n+name").select("stat", F.round("value", 6).alias("value"))


QUERIES["regional_models"] = regional_models
_REG = """l AS (SELECT DISTINCT l_orderkey, l_suppkey AS x FROM lineitem), p AS (SELECT a.x AS src, b.x AS dst, count(*) AS w FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.x < b.x GROUP BY ALL), t AS (SELECT src, dst FROM p ORDER BY w DESC, src, dst LIMIT 400),
v AS (SELECT s_suppkey AS vid, n_regionkey AS net, r_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), e AS (SELECT a.net, src, dst FROM t JOIN v a ON src = a.vid JOIN v b ON dst = b.vid WHERE a.net = b.net),
d AS (SELECT v.net, v.vid, (SELECT count(*) FROM e WHERE src = vid OR dst = vid) AS k FROM v), g AS (SELECT net, name, count(*) AS n FROM v GROUP BY ALL),
m AS (SELECT net, 'edges' AS stat, count(*) AS value FROM e GROUP BY net UNION ALL SELECT net, 'degree' || k, count(*) FROM d WHERE k < 3 GROUP BY net, k UNION ALL SELECT net, 'kstar2', sum(k * (k - 1) / 2) FROM d GROUP BY net),
c AS (SELECT net, '1' AS c, 1 AS x FROM g UNION ALL SELECT net, 'n', n FROM g UNION ALL SELECT g.net, 'name' || r.name, CASE WHEN g.name = r.name THEN 1 ELSE 0 END FROM g CROSS JOIN (SELECT name FROM g WHERE name <> (SELECT min(name) FROM g)) r),
s AS (SELECT unnest(['edges', 'degree0', 'degree1', 'degree2', 'kstar2']) AS stat)"""
ORACLE_SQL["regional_models"] = f"WITH {_REG} SELECT 'N(' || c.c || ')~' || s.stat AS stat, round(CAST(sum(c.x * coalesce(m.value, 0)) AS DOUBLE), 6) AS value FROM c CROSS JOIN s LEFT JOIN m ON m.net = c.net AND m.stat = s.stat GROUP BY c.c, s.stat"


def _flag_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = tables.strongest(tables.trade_pairs(spark, sf_dir, "l_returnflag"), 100, "l_returnflag")
    return pairs.select(F.lit(0).cast("long").alias("net"), F.col("l_returnflag").alias("layer"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


def trade_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' trade in a layer for each return flag: logical layers and terms across layers."""
    net, layers = tables.trade(spark, sf_dir), _flag_layers(spark, sf_dir).persist()
    parts = [combined.layer_stats(net, layers, "edges+mutual", logic).select("stat", "value") for logic in ("~A&R", "~A|N", "~A&t(R)", "~xor(A,R)", "~.")]
    named = lambda title, frame: frame.select(F.lit(title).alias("stat"), "value")
    parts += [named("mutualL.A.R", combined.mutual_layers(net, layers, "A", "R")), named("mutualL.A.A", combined.mutual_layers(net, layers, "A", "A")), named("CMBL", combined.conway_maxwell_binomial(net, layers))]
    parts += [named(f"twostarL.{t}", combined.twostar_layers(net, layers, "A", "R", t)) for t in ("out", "in", "path")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("stat", F.round("value", 6).alias("value"))


QUERIES["trade_layers"] = trade_layers
_LAY = f"""p AS ({_PAIRS.format(more="l.l_returnflag AS f,", where="")}), q AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY w DESC, src, dst) AS r FROM p), k AS (SELECT f, src, dst FROM q WHERE r <= 100),
y AS (SELECT src, dst, max(CASE WHEN f = 'A' AND v = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN f = 'R' AND v = 0 THEN 1 ELSE 0 END) AS r, max(CASE WHEN f = 'N' AND v = 0 THEN 1 ELSE 0 END) AS n, max(CASE WHEN f = 'R' AND v = 1 THEN 1 ELSE 0 END) AS tr FROM (SELECT f, src, dst, 0 AS v FROM k UNION ALL SELECT f, dst, src, 1 FROM k) GROUP BY src, dst),
z AS (SELECT 'A&R' AS l, src, dst FROM y WHERE a = 1 AND r = 1 UNION ALL SELECT 'A|N', src, dst FROM y WHERE a = 1 OR n = 1 UNION ALL SELECT 'A&t(R)', src, dst FROM y WHERE a = 1 AND tr = 1 UNION ALL SELECT 'xor(A,R)', src, dst FROM y WHERE a <> r UNION ALL SELECT '.', src, dst FROM y WHERE a + r + n > 0),
o AS (SELECT unnest(['A&R', 'A|N', 'A&t(R)', 'xor(A,R)', '.']) AS l), ka AS (SELECT src, dst FROM k WHERE f = 'A'), kr AS (SELECT src, dst FROM k WHERE f = 'R')"""
ORACLE_SQL["trade_layers"] = f"""WITH {_LAY} SELECT stat, round(CAST(value AS DOUBLE), 6) AS value FROM (SELECT 'L(' || l || ')~edges' AS stat, (SELECT count(*) FROM z WHERE z.l = o.l) AS value FROM o UNION ALL SELECT 'L(' || l || ')~mutual', (SELECT count(*) / 2 FROM z x JOIN z w ON x.l = w.l AND x.src = w.dst AND x.dst = w.src WHERE x.l = o.l) FROM o
UNION ALL SELECT 'mutualL.A.R', (SELECT count(*) FROM ka JOIN kr ON ka.src = kr.dst AND ka.dst = kr.src) UNION ALL SELECT 'mutualL.A.A', (SELECT count(*) / 2 FROM ka x JOIN ka w ON x.src = w.dst AND x.dst = w.src) UNION ALL SELECT 'CMBL', (SELECT sum(CASE WHEN a + r + n IN (1, 2) THEN -ln(3) ELSE 0 END) FROM y WHERE a + r + n > 0)
UNION ALL SELECT 'twostarL.out', (SELECT count(*) FROM ka JOIN kr ON ka.src = kr.src AND ka.dst <> kr.dst) UNION ALL SELECT 'twostarL.in', (SELECT count(*) FROM ka JOIN kr ON ka.dst = kr.dst AND ka.src <> kr.src) UNION ALL SELECT 'twostarL.path', (SELECT count(*) FROM ka JOIN kr ON ka.dst = kr.src AND ka.src <> kr.dst))"""


def supplier_ego_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Egocentric estimates from suppliers weighted by their balance's rank in thirds; standard errors of the survey kind."""
    pairs = tables.strongest(tables.together(spark, sf_dir, "l_suppkey"), 400)
    v = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ego"), (F.col("s_nationkey") % 3).alias("third"), (1 + F.col("s_nationkey") % 2).alias("weight"))
    ends = pairs.select(F.col("src").alias("ego"), F.col("dst").alias("alter")).union(pairs.select("dst", "src"))
    alters = ends.join(v.select(F.col("ego").alias("alter"), "third"), "alter")
    names, value, cov = ego.ego_stats(v, alters, "edges+nodematch('third')+degree(0:2)+concurrent")
    rows = [(n, round(float(x), 6), round(float(c) ** 0.5, 6)) for n, x, c in zip(names, value, cov.diagonal())]
    return spark.createDataFrame(rows, "stat string, value double, stderr double")


QUERIES["supplier_ego_stats"] = supplier_ego_stats
ORACLE_SQL["supplier_ego_stats"] = f"""WITH {COSUPPLY}, h AS (SELECT v.vid, 1 + v.nation % 2 AS w, (SELECT count(*) FROM a WHERE a.i = v.vid) AS g, (SELECT count(*) FROM a JOIN v z ON a.j = z.vid WHERE a.i = v.vid AND z.third = v.third) AS s FROM v),
x AS (SELECT w, unnest(['edges', 'nodematch.third', 'degree0', 'degree1', 'degree2', 'concurrent']) AS stat, unnest([g / 2.0, s / 2.0, CASE WHEN g = 0 THEN 1.0 ELSE 0.0 END, CASE WHEN g = 1 THEN 1.0 ELSE 0.0 END, CASE WHEN g = 2 THEN 1.0 ELSE 0.0 END, CASE WHEN g >= 2 THEN 1.0 ELSE 0.0 END]) AS h FROM h),
m AS (SELECT stat, CAST(sum(w * h) AS DOUBLE) / sum(w) AS mean, CAST(sum(w) AS DOUBLE) AS t, count(*) AS n FROM x GROUP BY stat) SELECT m.stat, round(max(m.mean * m.n), 6) AS value, round(max(m.n) * sqrt(max(m.n) / (max(m.n) - 1.0) * sum(power(x.w * (x.h - m.mean) / m.t, 2))), 6) AS stderr FROM x JOIN m ON x.stat = m.stat GROUP BY m.stat"""


def copart_blockdiag_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact fit where only dyads inside a brand are free: the logit of their density."""
    net = tables.copart(spark, sf_dir)
    got = pseudolikelihood.fit(net, "edges", free=constraints.free_dyads(net.held(), "~blockdiag('brand')"))
    return spark.createDataFrame([("edges", round(float(got.coef[0]), 6), got.dyads)], "name string, estimate double, dyads long")


QUERIES["copart_blockdiag_logit"] = copart_blockdiag_logit
ORACLE_SQL["copart_blockdiag_logit"] = f"WITH {COPART}, z AS (SELECT (SELECT count(*) FROM v p JOIN v q ON p.vid < q.vid AND p.brand = q.brand) AS n, (SELECT count(*) FROM t WHERE sb = db) AS y) SELECT 'edges' AS name, round(ln(CAST(y AS DOUBLE) / (n - y)), 6) AS estimate, CAST(n AS BIGINT) AS dyads FROM z"


def trade_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formation and persistence of trade ties, with the closed form of a density each."""
    formed, kept = estimation.cmle(tables.trade_series(spark, sf_dir), "edges", "edges")
    return spark.createDataFrame([("form", round(float(formed.coef[0]), 6), formed.dyads), ("persist", round(float(kept.coef[0]), 6), kept.dyads)], "model string, estimate double, dyads long")


QUERIES["trade_separable"] = trade_separable
ORACLE_SQL["trade_separable"] = f"WITH {SERIES}, z AS (SELECT (SELECT count(DISTINCT net) * 600 FROM c) - (SELECT count(*) FROM b) AS nf, (SELECT count(*) FROM c ANTI JOIN b ON c.net = b.net AND c.src = b.src AND c.dst = b.dst) AS yf, (SELECT count(*) FROM b) AS np, (SELECT count(*) FROM c SEMI JOIN b ON c.net = b.net AND c.src = b.src AND c.dst = b.dst) AS yp) SELECT 'form' AS model, round(ln(CAST(yf AS DOUBLE) / (nf - yf)), 6) AS estimate, CAST(nf AS BIGINT) AS dyads FROM z UNION ALL SELECT 'persist', round(ln(CAST(yp AS DOUBLE) / (np - yp)), 6), CAST(np AS BIGINT) FROM z"


def trade_degree_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ages.degree_mean_age(ages.tie_ages(_yearly(spark, sf_dir)), list(range(8, 17)))
    return got.select("t", "stat", F.round("value", 6).alias("value"))


QUERIES["trade_degree_ages"] = trade_degree_ages
ORACLE_SQL["trade_degree_ages"] = f"WITH {SERIES}, {_AGES}, u AS (SELECT t, src AS v, age FROM a UNION ALL SELECT t, dst, age FROM a), dg AS (SELECT t, v, count(*) AS k, sum(age) AS s FROM u GROUP BY t, v) SELECT CAST(y.t AS BIGINT) AS t, 'degree' || z.k || '.mean.age' AS stat, round(CAST(coalesce((SELECT sum(s) / CAST(sum(dg.k) AS DOUBLE) FROM dg WHERE dg.t = y.t AND dg.k = z.k), 0) AS DOUBLE), 6) AS value FROM (SELECT DISTINCT t FROM a) y CROSS JOIN (SELECT unnest(range(8, 17)) AS k) z"


def copart_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["copart_statistics"](spark, sf_dir)


# --- terms that no query above names ------------------------------------------------------------------------------------------------


def _covariates(spark: SparkSession, sf_dir: str) -> dict:
    """Dyadic covariates over nations: a number for each ordered pair, and the pairs of one residue. As many rows as pairs of nations."""
    nation = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").alias("r"))
    pairs = nation.join(nation.select(F.col("i").alias("j"), F.col("r").alias("q"))).where("i != j")
    return {"far": pairs.select("i", "j", (F.abs(F.col("r") - F.col("q")) + F.col("i") % 3).cast("double").alias("x")), "near": pairs.where("(i + j) % 4 = 0").select("i", "j", F.lit(1.0).alias("x")), "mat": [[2 * a + b for b in range(5)] for a in range(5)]}


_COVER = f"""{TRADE}, far AS (SELECT a.vid AS i, b.vid AS j, abs(a.region - b.region) + a.vid % 3 AS x FROM v a JOIN v b ON a.vid <> b.vid), near AS (SELECT i, j FROM far WHERE (i + j) % 4 = 0),
pairs AS (SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, x.a IS NOT NULL AS up, y.a IS NOT NULL AS low FROM (SELECT src AS a, dst AS b FROM e WHERE src < dst) x FULL JOIN (SELECT dst AS a, src AS b FROM e WHERE src > dst) y ON x.a = y.a AND x.b = y.b),
local AS (SELECT src, dst FROM e JOIN near ON e.src = i AND e.dst = j), ways AS (SELECT x.src AS a, y.dst AS c FROM local x JOIN local y ON x.dst = y.src AND x.src <> y.dst)"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_stats(tables.trade(spark, sf_dir), "edgecov(far)+dyadcov(far)+hamming(near)+hamming(near,cov=far)+attrcov('region',mat)+localtriangle(near)", _covariates(spark, sf_dir))


add(
    "trade_covariates", _covered, _COVER,
    [("edgecov.far", "SELECT sum(x) FROM e JOIN far ON e.src = i AND e.dst = j")]
    + [(f"dyadcov.far.{kind}", f"SELECT coalesce(sum(x), 0) FROM pairs JOIN far ON a = i AND b = j WHERE {where}") for kind, where in (("mutual", "up AND low"), ("utri", "up AND NOT low"), ("ltri", "low AND NOT up"))]
    + [("hamming.near", "SELECT (SELECT count(*) FROM e) + (SELECT count(*) FROM near) - 2 * (SELECT count(*) FROM local)"), ("hamming.near.far", "SELECT sum(x) FROM far f LEFT JOIN e ON e.src = f.i AND e.dst = f.j WHERE (e.src IS NULL) = ((f.i + f.j) % 4 = 0)")]
    + [("attrcov.region.mat", "SELECT sum(2 * sr + dr) FROM t"), ("localtriangle.near", "SELECT (SELECT count(*) FROM ways SEMI JOIN local ON local.src = a AND local.dst = c) + (SELECT count(*) FROM ways SEMI JOIN local ON local.src = c AND local.dst = a) / 3.0")],
)

stats(
    "trade_directed_names", tables.trade,
    "+".join(f"d{b}(0:2,type='{k}')+dgw{b}(0.5,fixed=TRUE,type='{k}')" for b in ("esp", "dsp", "nsp") for k in ("OTP", "RTP")) + "+odegrange(2,6)+idegrange(1)+idegree1.5+m2star+intransitive+nearsimmelian+nodeifactordistinct('region')",
    f"{TRADE}, {_SP}, ways AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src AND x.src <> y.dst), open AS (SELECT a, b, c, (SELECT count(*) FROM e WHERE src = a AND dst = c) AS t FROM ways)"
    + ", st AS (SELECT a.vid AS i, b.vid AS j, (SELECT count(*) FROM e WHERE src = a.vid AND dst = b.vid) AS f, (SELECT count(*) FROM e WHERE src = b.vid AND dst = a.vid) AS g FROM v a JOIN v b ON a.vid < b.vid)"
    + ", tri AS (SELECT x.f + x.g AS p, y.f + y.g AS q, z.f + z.g AS r, x.f AS ab, x.g AS ba, y.f AS ac, y.g AS ca, z.f AS bc, z.g AS cb FROM st x JOIN st y ON x.i = y.i AND x.j < y.j JOIN st z ON z.i = x.j AND z.j = y.j)"
    # a triad is intransitive when it has two-paths and none of them is closed
    + ", cl AS (SELECT *, ab * bc * ac + ba * ac * bc + ac * cb * ab + ca * ab * cb + bc * ca * ba + cb * ba * ca AS closed, ab * bc + ba * ac + ac * cb + ca * ab + bc * ca + cb * ba AS two FROM tri)",
    [r for b in ("esp", "dsp", "nsp") for k in ("OTP", "RTP") for r in (
        [(f"{b}.{k}{x}", {"esp": f"SELECT count(*) FROM e LEFT JOIN {k.lower()} s ON e.src = s.i AND e.dst = s.j WHERE coalesce(s.sp, 0) = {x}",
                          "dsp": f"SELECT 600 - count(*) FROM {k.lower()}" if x == 0 else f"SELECT count(*) FROM {k.lower()} WHERE sp = {x}",
                          "nsp": f"SELECT 600 - (SELECT count(*) FROM e) - (SELECT count(*) FROM {k.lower()} s ANTI JOIN e ON e.src = s.i AND e.dst = s.j)" if x == 0 else f"SELECT count(*) FROM {k.lower()} s ANTI JOIN e ON e.src = s.i AND e.dst = s.j WHERE sp = {x}"}[b]) for x in range(3)]
        + [(f"gw{b}.{k}.fixed.0.5", f"SELECT coalesce(sum({gw('sp')}), 0) FROM {k.lower()} s " + {"esp": "SEMI JOIN e ON e.src = s.i AND e.dst = s.j", "dsp": "", "nsp": "ANTI JOIN e ON e.src = s.i AND e.dst = s.j"}[b])])]
    + [("odeg2to6", "SELECT count(*) FROM d WHERE o >= 2 AND o < 6"), ("ideg1+", "SELECT count(*) FROM d WHERE i >= 1"), ("idegree1.5", "SELECT sum(power(i, 1.5)) FROM d"), ("m2star", "SELECT count(*) FROM ways"),
       ("intransitive", "SELECT count(*) FROM cl WHERE two > 0 AND closed = 0"),
       ("nearsimmelian", "SELECT count(*) FROM tri WHERE p + q + r = 5"), ("nodeifactordistinct.region", "SELECT sum(z) FROM (SELECT count(DISTINCT sr) AS z FROM t GROUP BY dst)")],
)

stats(
    "cosupply_names", tables.cosupply, "degcor+twopath",
    COSUPPLY, [("degcor", "SELECT CASE WHEN var_pop(x) > 0 THEN corr(x, y) ELSE 0 END FROM (SELECT sd AS x, dd AS y FROM t UNION ALL SELECT dd, sd FROM t)"), ("twopath", "SELECT sum(deg * (deg - 1) / 2) FROM d")],
)

stats(
    "supplypart_names", tables.supplypart, "b1sociality(nodes=1:4)+b2sociality(nodes=2:5)+b2twostar('grp','grp')+coincidence(active=3)",
    SUPPLYPART + ", k2 AS (SELECT t, g2, g1, count(*) AS k FROM j GROUP BY ALL)",
    [],
)
# ids of coincidence and b2sociality follow the data: these statistics are set against whole tables of names and values
_SUPPLY_NAMES = f"""WITH {SUPPLYPART}, k2 AS (SELECT t, g2, g1, count(*) AS k FROM j GROUP BY ALL), o1 AS (SELECT vid, deg, row_number() OVER (ORDER BY vid) AS r FROM v1), o2 AS (SELECT vid, deg, row_number() OVER (ORDER BY vid) AS r FROM v2)
SELECT 'b1sociality' || r AS stat, CAST(deg AS DOUBLE) AS value FROM o1 WHERE r <= 4 UNION ALL SELECT 'b2sociality' || (r + (SELECT count(*) FROM v1)), CAST(deg AS DOUBLE) FROM o2 WHERE r BETWEEN 2 AND 5
UNION ALL SELECT 'coincidence.' || a.r || '.' || b.r, CAST(p2.sp AS DOUBLE) FROM p2 JOIN o2 a ON a.vid = p2.i JOIN o2 b ON b.vid = p2.j WHERE p2.sp >= 3
UNION ALL """ + " UNION ALL ".join(f"SELECT 'b2twostar.grp.{a}.grp.{x}.{y}', CAST(coalesce(sum({'p.k * (p.k - 1) / 2' if x == y else 'p.k * q.k'}), 0) AS DOUBLE) FROM k2 p JOIN k2 q ON p.t = q.t WHERE p.g2 = {a} AND p.g1 = {x} AND q.g1 = {y}" for y in range(3) for x in range(y + 1) for a in range(3))
ORACLE_SQL["supplypart_names"] = _SUPPLY_NAMES

# --- directed networks of two levels ------------------------------------------------------------------------------------------------

_HALVES = f"""{TRADE}, h AS (SELECT vid, region % 2 AS h FROM v), lv AS (SELECT e.src, e.dst, x.h AS p, y.h AS q FROM e JOIN h x ON e.src = x.vid JOIN h y ON e.dst = y.vid),
aa AS (SELECT src, dst FROM lv WHERE p = 0 AND q = 0), bb AS (SELECT src, dst FROM lv WHERE p = 1 AND q = 1), xx AS (SELECT src AS a, dst AS b FROM lv WHERE p = 0 AND q = 1),
va AS (SELECT vid, (SELECT count(*) FROM aa WHERE src = vid) AS o, (SELECT count(*) FROM aa WHERE dst = vid) AS i, (SELECT count(*) FROM xx WHERE a = vid) AS x FROM h WHERE h = 0),
vb AS (SELECT vid, (SELECT count(*) FROM bb WHERE src = vid) AS o, (SELECT count(*) FROM bb WHERE dst = vid) AS i, (SELECT count(*) FROM xx WHERE b = vid) AS x FROM h WHERE h = 1),
ra AS (SELECT x.src, x.dst FROM aa x SEMI JOIN aa y ON x.src = y.dst AND x.dst = y.src), rb AS (SELECT x.src, x.dst FROM bb x SEMI JOIN bb y ON x.src = y.dst AND x.dst = y.src),
sa AS (SELECT p.a AS src, q.a AS dst, count(*) AS sp FROM xx p JOIN xx q ON p.b = q.b AND p.a <> q.a GROUP BY ALL), sb AS (SELECT p.b AS src, q.b AS dst, count(*) AS sp FROM xx p JOIN xx q ON p.a = q.a AND p.b <> q.b GROUP BY ALL),
xd AS (SELECT m.i AS ia, m.o AS oa, n.i AS ib, n.o AS ob FROM xx JOIN va m ON xx.a = m.vid JOIN vb n ON xx.b = n.vid)"""


def _half(x: str) -> str:
    return f"(2 * (1 - power(0.5, {x})))"


def _c4(first: str, second: str, opposed: bool = False) -> str:
    return f"SELECT count(*) FROM {first} t JOIN xx p ON p.a = t.src JOIN xx q ON q.a = t.dst JOIN {second} s ON s.src = {'q.b' if opposed else 'p.b'} AND s.dst = {'p.b' if opposed else 'q.b'}"


_D2 = ".half.0.693147"
_PLAIN = ["in2starax", "in2starbx", "out2starax", "out2starbx", "txaxarc", "txbxarc", "txaxreciprocity", "txbxreciprocity", "l3xax", "l3xbx", "l3xaxreciprocity", "l3xbxreciprocity", "l3axbin", "l3axbout", "l3axbpath", "l3bxapath", "c4axbentrainment", "c4axbexchange", "c4axbexchangeareciprocity", "c4axbexchangebreciprocity", "c4axbreciprocity"]
_WITH_DECAY = ["axs1ain", "axs1bin", "axs1aout", "axs1bout", "aains1x", "abins1x", "aaouts1x", "abouts1x", "atxaxarc", "atxbxarc", "atxaxreciprocity", "atxbxreciprocity", "ainasxainbs", "ainasxaoutbs", "aoutasxainbs", "aoutasxaoutbs"]
stats(
    "multilevel_directed", tables.trade, "+".join(f"{t}('half')" for t in _PLAIN + _WITH_DECAY), _HALVES,
    [r for m, l in (("A", "a"), ("B", "b")) for r in (
        [(f"{w}2Star{m}X.half", f"SELECT sum({c} * x) FROM v{l}") for w, c in (("In", "i"), ("Out", "o"))]
        + [(f"AXS1{m}{w}{_D2}", f"SELECT sum({c} * {_half('x')}) FROM v{l}") for w, c in (("in", "i"), ("out", "o"))] + [(f"A{m}{w}S1X{_D2}", f"SELECT sum({_half(c)} * x) FROM v{l}") for w, c in (("in", "i"), ("out", "o"))]
        + [(f"TX{m}Xarc.half", f"SELECT coalesce(sum(sp), 0) FROM {l}{l} t JOIN s{l} s ON t.src = s.src AND t.dst = s.dst"), (f"TX{m}Xreciprocity.half", f"SELECT coalesce(sum(sp), 0) / 2 FROM r{l} t JOIN s{l} s ON t.src = s.src AND t.dst = s.dst")]
        + [(f"ATX{m}Xarc{_D2}", f"SELECT coalesce(sum({_half('sp')}), 0) FROM {l}{l} t JOIN s{l} s ON t.src = s.src AND t.dst = s.dst"), (f"ATX{m}Xreciprocity{_D2}", f"SELECT coalesce(sum({_half('sp')}), 0) / 2 FROM r{l} t JOIN s{l} s ON t.src = s.src AND t.dst = s.dst")]
        + [(f"L3X{m}X.half", f"SELECT sum(p.x * q.x) FROM {l}{l} t JOIN v{l} p ON t.src = p.vid JOIN v{l} q ON t.dst = q.vid"), (f"L3X{m}Xreciprocity.half", f"SELECT coalesce(sum(p.x * q.x), 0) / 2 FROM r{l} t JOIN v{l} p ON t.src = p.vid JOIN v{l} q ON t.dst = q.vid")])]
    + [("L3AXBin.half", "SELECT sum(ia * ib) FROM xd"), ("L3AXBout.half", "SELECT sum(oa * ob) FROM xd"), ("L3AXBpath.half", "SELECT sum(ia * ob) FROM xd"), ("L3BXApath.half", "SELECT sum(oa * ib) FROM xd")]
    + [("C4AXBentrainment.half", _c4("aa", "bb")), ("C4AXBexchange.half", _c4("aa", "bb", True)), ("C4AXBexchangeAreciprocity.half", _c4("ra", "bb")), ("C4AXBexchangeBreciprocity.half", _c4("aa", "rb")), ("C4AXBreciprocity.half", f"SELECT ({_c4('ra', 'rb')}) / 2")]
    + [(f"A{p}ASXA{q}BS{_D2}", f"SELECT sum({_half(p[0] + 'a')} * {_half(q[0] + 'b')}) FROM xd") for p in ("in", "out") for q in ("in", "out")],
)

stats("multilevel_triangles", _two_levels, "exta('level')+extb('level')", LEVELS, [(f"EXT{m}.level", f"SELECT coalesce(sum(coalesce(a.k, 0) + coalesce(b.k, 0) + coalesce(c.k, 0)), 0) FROM e{l} p JOIN e{l} q ON p.v = q.u JOIN e{l} r ON r.u = p.u AND r.v = q.v LEFT JOIN x{l} a ON a.i = p.u LEFT JOIN x{l} b ON b.i = p.v LEFT JOIN x{l} c ON c.i = q.v") for m, l in (("A", "a"), ("B", "b"))])


# --- ages, layers: the terms that no query above names --------------------------------------------------------------------------------


def trade_age_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages of trade ties against covariates, mixing types, levels, degree ranges and the changes of dyadic terms."""
    net, aged = tables.trade(spark, sf_dir), ages.tie_ages(_yearly(spark, sf_dir))
    far = _covariates(spark, sf_dir)["far"]
    parts = [ages.covariate_ages(aged, far, "far"), ages.covariate_ages(aged, far, "far", log=True).where("stat like 'mean%'"), ages.mixing_mean_age(aged, net.vertices, "half"), ages.mixing_mean_age(aged, net.vertices, "half", log=True), ages.factor_mean_age(aged, net.vertices, "region", levels=[1, 3, 9], empty=-1.0)]
    parts += [ages.degree_range_mean_age(aged, [(0, 10), (10, 14), (14, None), (90, None)]), ages.edge_ages_of(net, aged, "edges+nodematch('region')+absdiff('region')")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("t").cast("long").alias("t"), "stat", F.round("value", 6).alias("value"))


QUERIES["trade_age_terms"] = trade_age_terms
_AGED = {
    "edgecov.ages.far": "SELECT t, sum(x * age) AS value FROM w GROUP BY t", "mean.age.far": "SELECT t, sum(x * age) / CAST(sum(x) AS DOUBLE) FROM w GROUP BY t", "mean.log.age.far": "SELECT t, sum(x * ln(age)) / sum(x) FROM w GROUP BY t",
    **{f"nodemix.mean.{lg}age.half.{r}.{c}": f"SELECT t, coalesce(avg({'ln(age)' if lg else 'age'}) FILTER (p % 2 = {r} AND q % 2 = {c}), 0) FROM w GROUP BY t" for lg in ("", "log.") for r in (0, 1) for c in (0, 1)},
    **{f"nodefactor.mean.age.region.{k}": f"SELECT t, coalesce(avg(age) FILTER (g = {k}), -1) FROM z GROUP BY t" for k in (1, 3, 9)},
    **{f"deg{lo}{f'to{hi}' if hi else '+'}.mean.age": f"SELECT t, coalesce(avg(age) FILTER (k >= {lo} AND k < {hi or 1000}), 0) FROM z GROUP BY t" for lo, hi in ((0, 10), (10, 14), (14, None), (90, None))},
    "EdgeAges~edges": "SELECT t, sum(age) FROM w GROUP BY t", "EdgeAges~nodematch.region": "SELECT t, sum(age * (p = q)::INT) FROM w GROUP BY t", "EdgeAges~absdiff.region": "SELECT t, sum(age * abs(p - q)) FROM w GROUP BY t",
}
ORACLE_SQL["trade_age_terms"] = f"""WITH {SERIES}, {_AGES}, w AS (SELECT a.t, a.src, a.dst, age, m.n_regionkey AS p, n.n_regionkey AS q, abs(m.n_regionkey - n.n_regionkey) + m.n_nationkey % 3 AS x FROM a JOIN nation m ON a.src = m.n_nationkey JOIN nation n ON a.dst = n.n_nationkey),
y AS (SELECT t, src AS vid, p AS g, age FROM w UNION ALL SELECT t, dst, q, age FROM w), z AS (SELECT *, count(*) OVER (PARTITION BY t, vid) AS k FROM y)
SELECT CAST(t AS BIGINT) AS t, stat, round(CAST(value AS DOUBLE), 6) AS value FROM (""" + " UNION ALL ".join(f"SELECT t, '{n}' AS stat, value FROM ({sql.replace(' FROM', ' AS value FROM', 1) if ' AS value' not in sql else sql})" for n, sql in _AGED.items()) + ")"


def trade_layer_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared partners across the layers of return flags."""
    net, layers = tables.trade(spark, sf_dir), _flag_layers(spark, sf_dir)
    parts = [combined.shared_layers(net, layers, kind, [0, 1, 2], type=t, base="N", path=["A", "R"], in_order=o) for kind in ("esp", "dsp", "nsp") for t, o in (("OTP", False), ("OTP", True), ("OSP", False))]
    parts += [combined.shared_layers(net, layers, kind, decay=0.5, type=t, base="N", path=["A"]) for kind in ("esp", "dsp", "nsp") for t in ("ITP", "ISP")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("stat", F.round("value", 6).alias("value"))


QUERIES["trade_layer_partners"] = trade_layer_partners


def _layer_pairs(first: str, second: str, kind: str, in_order: bool) -> str:
    """Pairs with their shared partners: i - k in one layer, k - j in the other."""
    x, y = {"OTP": ("src AS i, dst AS k", "src AS k, dst AS j"), "ITP": ("dst AS i, src AS k", "dst AS k, src AS j"), "OSP": ("src AS i, dst AS k", "dst AS k, src AS j"), "ISP": ("dst AS i, src AS k", "src AS k, dst AS j")}[kind]
    ways = [(first, second)] if in_order or first == second else [(first, second), (second, first)]
    rows = " UNION ".join(f"SELECT x.i, y.j, x.k FROM (SELECT {x} FROM k WHERE f = '{a}') x JOIN (SELECT {y} FROM k WHERE f = '{b}') y ON x.k = y.k WHERE x.i <> y.j" for a, b in ways)
    return f"(SELECT i, j, count(*) AS sp FROM ({rows}) GROUP BY i, j)"


_BASE = "(SELECT src, dst FROM k WHERE f = 'N')"


def _layer_count(kind: str, pairs: str, x: int) -> str:
    if kind == "esp":
        return f"SELECT count(*) FROM {_BASE} e LEFT JOIN {pairs} s ON e.src = s.i AND e.dst = s.j WHERE coalesce(s.sp, 0) = {x}"
    rest = "" if kind == "dsp" else f" ANTI JOIN {_BASE} e ON e.src = s.i AND e.dst = s.j"
    if x:
        return f"SELECT count(*) FROM {pairs} s{rest} WHERE sp = {x}"
    return f"SELECT 600 - {'0' if kind == 'dsp' else f'(SELECT count(*) FROM {_BASE})'} - (SELECT count(*) FROM {pairs} s{rest})"


_LAYER_ROWS = [(f"L(pth=(A,R),bse={'' if kind == 'dsp' else 'N'},inord={'TRUE' if o else 'FALSE'})~{kind}.{t}{x}", _layer_count(kind, _layer_pairs("A", "R", t, o), x)) for kind in ("esp", "dsp", "nsp") for t, o in (("OTP", False), ("OTP", True), ("OSP", False)) for x in (0, 1, 2)]
_LAYER_ROWS += [(f"L(pth=(A),bse={'' if kind == 'dsp' else 'N'},inord=FALSE)~gw{kind}.{t}.fixed.0.5", f"SELECT coalesce(sum({gw('sp')}), 0) FROM {_layer_pairs('A', 'A', t, False)} s" + {"esp": f" SEMI JOIN {_BASE} e ON e.src = s.i AND e.dst = s.j", "dsp": "", "nsp": f" ANTI JOIN {_BASE} e ON e.src = s.i AND e.dst = s.j"}[kind]) for kind in ("esp", "dsp", "nsp") for t in ("ITP", "ISP")]
ORACLE_SQL["trade_layer_partners"] = f"WITH {_LAY} " + " UNION ALL ".join(f"SELECT '{n}' AS stat, round(CAST(({sql}) AS DOUBLE), 6) AS value" for n, sql in _LAYER_ROWS)
