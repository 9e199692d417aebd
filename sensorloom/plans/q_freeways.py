"""Queries of freeway assignment: orders as edges of a map, customers as relations' ways, suppliers as lines of a network."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import freeways as W
from sensorloom.plans.registry import query, table

_XY = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _edges(spark, d):
    o, c = table(spark, d, "orders"), F.col("o_custkey")
    up, right = c % 101 / 1000.0, F.col("o_orderkey") % 103 / 1000.0
    points = F.array(_XY(right, up), _XY(right + 0.002, up + 0.001), _XY(right + 0.003, up + c % 5 / 1000.0))
    urgent = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("edge"), F.when(urgent == "1-URGENT", "motorway").when(urgent == "2-HIGH", "trunk").otherwise("residential").alias("highway"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("US "), c % 30, F.lit("; CA "), c % 7)).when(F.col("o_orderstatus") == "F", F.lit("")).alias("ref"),
        F.when(c % 6 == 0, F.concat(F.lit("CA "), c % 30)).when(c % 6 == 1, "Old Road").alias("unsigned_ref"), F.concat(c, F.lit("; "), c + 1, F.lit(";none")).alias("osmid"),
        F.when(F.col("o_orderkey") % 50 != 7, points).alias("points"),
    )


def _relations(spark, d):
    s = F.col("c_mktsegment")
    ref = F.when(s == "BUILDING", F.concat(F.lit("I "), "c_nationkey")).when(s == "MACHINERY", F.lit("I 80 Bus")).when(s == "FURNITURE", F.lit("")).when(s == "HOUSEHOLD", F.concat(F.lit("US "), F.col("c_nationkey") % 4))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("way"), F.col("c_custkey").alias("relation"), ref.alias("ref"))


_CTE = """
e AS (SELECT o_orderkey AS edge, CASE WHEN o_orderstatus = 'O' THEN 'US ' || o_custkey % 30 || '; CA ' || o_custkey % 7 WHEN o_orderstatus = 'F' THEN '' END AS ref, CASE WHEN o_custkey % 6 = 0 THEN 'CA ' || o_custkey % 30 WHEN o_custkey % 6 = 1 THEN 'Old Road' END AS uref, o_custkey AS c,
 CAST(o_orderkey % 103 AS DOUBLE) / 1000 AS x, CAST(o_custkey % 101 AS DOUBLE) / 1000 AS y, CAST(o_custkey % 5 AS DOUBLE) / 1000 AS u, o_orderkey % 50 <> 7 AS drawn FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
rel AS (SELECT * FROM (SELECT c_custkey AS way, CASE c_mktsegment WHEN 'BUILDING' THEN 'I ' || c_nationkey WHEN 'MACHINERY' THEN 'I 80 Bus' WHEN 'HOUSEHOLD' THEN 'US ' || c_nationkey % 4 END AS ref FROM customer) WHERE ref IS NOT NULL),
w AS (SELECT edge, 0 AS k, i, trim(split_part(ref, ';', i)) AS ref FROM e, (SELECT CAST(range AS INTEGER) AS i FROM range(1, 3)) WHERE ref <> ''),
v AS (SELECT edge, 1 AS k, i, rel.ref FROM (SELECT edge, c + i AS way, i FROM e, (SELECT CAST(range AS INTEGER) AS i FROM range(2))) JOIN rel USING (way)),
r AS (SELECT edge, k, i, ref FROM (FROM w UNION ALL FROM v UNION ALL SELECT edge, 2, 0, uref FROM e WHERE uref IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY edge, ref ORDER BY k, i) = 1),
n AS (SELECT *, CASE WHEN ref = 'I 80 Bus' THEN 51 ELSE TRY_CAST(regexp_extract(ref, '[0-9]+') AS BIGINT) END AS route FROM r),
g AS (SELECT edge, string_agg(ref, ';' ORDER BY k, i) AS refs, count(*) AS many, count(route) AS numbered, bool_or(k = 1) AS by_relation FROM n GROUP BY 1)"""


@query("WITH " + _CTE + """ SELECT e.edge, coalesce(refs, '') AS refs, coalesce((SELECT string_agg(CAST(route AS VARCHAR), ',' ORDER BY route) FROM (SELECT DISTINCT edge, route FROM n WHERE route IS NOT NULL) z WHERE z.edge = e.edge), '') AS routes,
 CASE WHEN ref <> '' AND e.edge IN (SELECT edge FROM v) THEN 'both' WHEN ref <> '' THEN 'way' WHEN e.edge IN (SELECT edge FROM v) THEN 'relation' END AS sources, CASE WHEN many IS NULL THEN 'no_ref' WHEN numbered = 0 THEN 'no_number' END AS issue, coalesce(many, 0) > 1 AS ambiguous FROM e LEFT JOIN g USING (edge)""")
def freeway_references(spark, d):
    r = W.edge_references(_edges(spark, d), _relations(spark, d))
    return r.withColumn("refs", F.array_join("refs", ";")).withColumn("routes", F.array_join(F.col("routes").cast("array<string>"), ","))


@query("WITH " + _CTE + """, q AS (SELECT *, sqrt(0.002 ** 2 + 0.001 ** 2) AS d1, sqrt(0.001 ** 2 + (u - 0.001) ** 2) AS d2 FROM e WHERE drawn),
mid AS (SELECT edge, CASE WHEN d1 >= (d1 + d2) / 2 THEN x + 0.002 * ((d1 + d2) / 2 / d1) ELSE x + 0.002 + 0.001 * (((d1 + d2) / 2 - d1) / d2) END AS px, CASE WHEN d1 >= (d1 + d2) / 2 THEN y + 0.001 * ((d1 + d2) / 2 / d1) ELSE y + 0.001 + (u - 0.001) * (((d1 + d2) / 2 - d1) / d2) END AS py FROM q),
l AS (SELECT s_suppkey AS line, s_nationkey AS route, s_suppkey % 5 AS di, CAST(s_suppkey * 7 % 97 AS DOUBLE) / 1000 AS ax, CAST(s_suppkey * 11 % 97 AS DOUBLE) / 1000 AS ay FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 4),
sg AS (SELECT line, route, di, ax, ay, ax + 0.013 AS bx, ay + 0.0071 AS by_ FROM l UNION ALL SELECT line, route, di, ax + 0.013, ay + 0.0071, ax + 0.011, ay + 0.029 FROM l),
f AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) AS t FROM mid, sg),
di AS (SELECT *, sqrt((ax + t * (bx - ax) - px) ** 2 + (ay + t * (by_ - ay) - py) ** 2) AS dist FROM f),
b AS (SELECT edge, route, di FROM di WHERE dist <= 0.0003 QUALIFY row_number() OVER (PARTITION BY edge, route ORDER BY round(dist, 12), line) = 1),
m AS (SELECT edge, route, ['N', 'S', 'E', 'W'][di + 1] AS dir FROM b WHERE di < 4),
p AS (SELECT DISTINCT edge, route, refs FROM n JOIN g USING (edge) WHERE route IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4))
SELECT edge, CAST(route AS BIGINT) AS route, dir, coalesce(refs, 'SHN:' || route) AS ref, CASE WHEN dir IS NULL THEN CASE WHEN drawn THEN 'too_far' ELSE 'no_geometry' END END AS reason FROM p FULL JOIN m USING (edge, route) JOIN e USING (edge)""")
def freeway_assignment(spark, d):
    nations = table(spark, d, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").alias("route"))
    k = F.col("s_suppkey")
    x, y = k * 7 % 97 / 1000.0, k * 11 % 97 / 1000.0
    direction = F.array(*map(F.lit, ("NB", "SB", "EB", "WB", "both")))[(k % 5).cast("int")]
    network = table(spark, d, "supplier").select(F.col("s_nationkey").alias("route"), k.alias("line"), direction.alias("direction"), F.array(_XY(x, y), _XY(x + 0.013, y + 0.0071), _XY(x + 0.011, y + 0.029)).alias("points"))
    return W.assign_freeways(_edges(spark, d), _relations(spark, d), network, nations)
