"""Queries over positions along lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import lines as L
from sensorloom.plans.registry import query, table

R = lambda c, n=6: F.round(c, n)

_PARTS = "s AS (SELECT p_partkey AS id, p_brand AS fwy, p_retailprice AS pm FROM part WHERE p_type LIKE 'PROMO%'), r AS (SELECT p_partkey AS rid, p_brand AS fwy, p_retailprice AS pm, p_size AS y FROM part WHERE p_type NOT LIKE 'PROMO%')"


def _parts(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("fwy"), F.col("p_retailprice").alias("pm"), F.col("p_size").cast("double").alias("y"), "p_type")
    promo = F.col("p_type").startswith("PROMO")
    return p.where(promo), p.where(~promo)


_BRACKET = _PARTS + """, c AS (SELECT s.id, s.fwy, s.pm, r.rid, r.pm AS rp FROM s LEFT JOIN r USING (fwy)),
 lo AS (SELECT id, max(rp) AS lp FROM c WHERE rp <= pm GROUP BY 1), hi AS (SELECT id, min(rp) AS hp FROM c WHERE rp >= pm GROUP BY 1),
 j AS (SELECT s.*, lp, hp, (SELECT min(rid) FROM r WHERE r.fwy = s.fwy AND r.pm = lp) AS lr, (SELECT max(rid) FROM r WHERE r.fwy = s.fwy AND r.pm = lp) AS lz, (SELECT min(rid) FROM r WHERE r.fwy = s.fwy AND r.pm = hp) AS hr FROM s LEFT JOIN lo USING (id) LEFT JOIN hi USING (id)),
 md AS (SELECT *, coalesce(pm - lp, 'inf'::DOUBLE) AS dl, coalesce(hp - pm, 'inf'::DOUBLE) AS dh, CASE WHEN least(coalesce(pm - lp, 'inf'::DOUBLE), coalesce(hp - pm, 'inf'::DOUBLE)) <= 0.5 THEN 'exact' WHEN lp IS NULL AND hp IS NOT NULL THEN 'before_start' WHEN hp IS NULL AND lp IS NOT NULL THEN 'after_end' WHEN pm - lp <= 5 AND hp - pm <= 5 THEN 'between' END AS mode FROM j),
 k AS (SELECT id, fwy, pm, mode, CASE WHEN mode = 'exact' THEN CASE WHEN dl <= dh THEN lr ELSE hr END END AS match, CASE WHEN mode = 'exact' AND dl <= dh THEN lr WHEN mode IN ('exact', 'before_start') THEN hr WHEN mode IN ('after_end', 'between') THEN lz END AS lower, CASE WHEN mode = 'exact' AND dl <= dh THEN lp WHEN mode IN ('exact', 'before_start') THEN hp WHEN mode IN ('after_end', 'between') THEN lp END AS lower_pos,
 CASE WHEN mode = 'exact' AND dl <= dh THEN lr WHEN mode = 'after_end' THEN lz WHEN mode IS NOT NULL THEN hr END AS upper, CASE WHEN mode = 'exact' AND dl <= dh OR mode = 'after_end' THEN lp WHEN mode IS NOT NULL THEN hp END AS upper_pos, CASE WHEN mode = 'between' THEN greatest(dl, dh) WHEN mode IS NOT NULL THEN least(dl, dh) END AS gap FROM md)"""


@query("WITH " + _BRACKET + " SELECT id, match, lower, round(lower_pos, 4) AS lower_pos, upper, round(upper_pos, 4) AS upper_pos, mode, round(gap, 6) AS gap FROM k")
def postmile_brackets(spark, d):
    s, r = _parts(spark, d)
    b = L.bracket(s.select("id", "fwy", "pm"), r.withColumnRenamed("id", "rid"), ["fwy"], "pm", "rid", 0.5, 5.0)
    return b.select("id", "match", "lower", R("lower_pos", 4).alias("lower_pos"), "upper", R("upper_pos", 4).alias("upper_pos"), "mode", R("gap").alias("gap"))


@query("WITH " + _BRACKET + """, y AS (SELECT k.*, a.y AS y0, b.y AS y1 FROM k LEFT JOIN r a ON a.rid = lower LEFT JOIN r b ON b.rid = upper)
 SELECT id, round(CASE WHEN y0 IS NULL OR y1 IS NULL THEN coalesce(y0, y1) ELSE y0 + CASE WHEN upper_pos = lower_pos THEN 0 ELSE greatest(0, least(1, (pm - lower_pos) / (upper_pos - lower_pos))) END * (y1 - y0) END, 6) AS y FROM y""")
def postmile_interpolation(spark, d):
    s, r = _parts(spark, d)
    b = L.bracket(s.select("id", "fwy", "pm"), r.withColumnRenamed("id", "rid"), ["fwy"], "pm", "rid", 0.5, 5.0)
    at = r.select("id", "y")
    j = b.join(at.select(F.col("id").alias("lower"), F.col("y").alias("y0")), "lower", "left").join(at.select(F.col("id").alias("upper"), F.col("y").alias("y1")), "upper", "left")
    return j.select("id", R(L.interpolate(F.col("pm"), F.col("lower_pos"), F.col("y0"), F.col("upper_pos"), F.col("y1"))).alias("y"))


_LINES = """pt AS (SELECT s_suppkey AS id, s_nationkey % 5 AS k, s_acctbal / 100 AS x, s_suppkey % 90 AS y FROM supplier), ln AS (SELECT n_nationkey AS line, n_nationkey % 4 AS k, [{'x': 0.0, 'y': n_nationkey * 3.0}, {'x': 40.0, 'y': n_nationkey * 2.0}, {'x': 90.0, 'y': 60.0 - n_nationkey}] AS pts FROM nation),
 sg AS (SELECT line, k, i - 1 AS seg, pts[i].x AS ax, pts[i].y AS ay, pts[i + 1].x AS bx, pts[i + 1].y AS yb FROM ln, unnest([1, 2]) u(i)), ft AS (SELECT id, line, seg, x AS px, y AS py, ax, ay, bx, yb, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (yb - ay)) / ((bx - ax) ** 2 + (yb - ay) ** 2))) AS f FROM pt JOIN sg USING (k)),
 fx AS (SELECT *, round(sqrt((ax + f * (bx - ax) - px) ** 2 + (ay + f * (yb - ay) - py) ** 2), 9) AS dist FROM ft)"""


def _lines(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("k"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 90).cast("double").alias("y"))
    at = lambda x, y: F.struct(F.lit(x).alias("x"), y.cast("double").alias("y"))
    n = F.col("n_nationkey")
    return p, table(spark, d, "nation").select(n.alias("line"), (n % 4).alias("k"), F.array(at(0.0, n * 3.0), at(40.0, n * 2.0), at(90.0, 60.0 - n)).alias("pts"))


@query("WITH " + _LINES + " SELECT id, line, round(ax + f * (bx - ax), 5) AS x, round(ay + f * (yb - ay), 5) AS y, round(f * sqrt((bx - ax) ** 2 + (yb - ay) ** 2) + CASE WHEN seg = 1 THEN (SELECT sqrt((g.bx - g.ax) ** 2 + (g.yb - g.ay) ** 2) FROM sg g WHERE g.line = fx.line AND g.seg = 0) ELSE 0 END, 5) AS along, round(dist, 5) AS dist FROM fx QUALIFY row_number() OVER (PARTITION BY id, line ORDER BY dist, seg) = 1")
def line_projection(spark, d):
    p, n = _lines(spark, d)
    return L.project(p, n, ["k"]).select("id", "line", *[R(c, 5).alias(c) for c in ("x", "y", "along", "dist")])


@query("WITH " + _LINES + ", b AS (SELECT id, dist, line FROM fx QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, line) = 1) SELECT pt.id, CASE WHEN dist <= 8 THEN line END AS line, round(dist, 5) AS dist, CASE WHEN dist IS NULL THEN 'no_line' WHEN dist > 8 THEN 'too_far' END AS reason FROM pt LEFT JOIN b USING (id)")
def nearest_line_or_reason(spark, d):
    p, n = _lines(spark, d)
    return L.nearest_line(p, n, ["k"], 8.0).select("id", "line", R("dist", 5).alias("dist"), "reason")


@query("""WITH inc AS (SELECT ps AS link, nd AS node, i AS incidence FROM (SELECT p_partkey AS ps, unnest([p_partkey % 25, p_size % 25]) AS nd, unnest([1, -1]) AS i FROM part)), ml AS (SELECT n_nationkey AS node, n_regionkey AS k, n_nationkey * 2.0 AS x, n_nationkey % 7 * 1.0 AS y FROM nation WHERE n_regionkey < 4),
 rl AS (SELECT link, CASE WHEN incidence = 1 THEN 'on' ELSE 'off' END AS kind, node FROM inc JOIN ml USING (node) QUALIFY row_number() OVER (PARTITION BY link ORDER BY node, incidence) = 1), se AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'on' ELSE 'off' END AS kind, s_nationkey % 5 AS k, s_nationkey * 2.0 AS x, s_suppkey % 11 * 1.0 AS y FROM supplier),
 m AS (SELECT se.id, round(sqrt((se.x - ml.x) ** 2 + (se.y - ml.y) ** 2), 9) AS dist, link FROM se JOIN rl USING (kind) JOIN ml ON ml.node = rl.node AND ml.k = se.k QUALIFY row_number() OVER (PARTITION BY se.id ORDER BY dist, link) = 1)
 SELECT se.id, se.kind, CASE WHEN dist <= 4 THEN link END AS link, round(dist, 5) AS dist, CASE WHEN dist IS NULL THEN 'no_ramp' WHEN dist > 4 THEN 'too_far' END AS reason FROM se LEFT JOIN m USING (id)""")
def ramp_matching(spark, d):
    part = table(spark, d, "part")
    inc = part.select(F.col("p_partkey").alias("link"), F.explode(F.array(F.struct((F.col("p_partkey") % 25).cast("int").alias("node"), F.lit(1).alias("incidence")), F.struct((F.col("p_size") % 25).cast("int").alias("node"), F.lit(-1).alias("incidence")))).alias("i")).select("link", "i.*")
    n = F.col("n_nationkey")
    ml = table(spark, d, "nation").where("n_regionkey < 4").select(n.alias("node"), F.col("n_regionkey").alias("k"), (n * 2.0).cast("double").alias("x"), (n % 7).cast("double").alias("y"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "on").otherwise("off").alias("kind"), (F.col("s_nationkey") % 5).alias("k"), (F.col("s_nationkey") * 2.0).cast("double").alias("x"), (F.col("s_suppkey") % 11).cast("double").alias("y"))
    return L.match_ramps(s, L.ramp_links(inc, ml), ml, ["k"], 4.0).withColumn("dist", R("dist", 5))


@query("""WITH s AS (SELECT p_partkey AS id, p_brand AS fwy, p_size AS dir, p_retailprice AS pm, CASE WHEN p_partkey % 5 = 0 THEN 'HV' WHEN p_partkey % 5 < 3 THEN 'ML' ELSE 'FF' END AS kind FROM part), j AS (SELECT a.id, b.id AS match, abs(a.pm - b.pm) AS dist FROM s a LEFT JOIN s b ON b.fwy = a.fwy AND b.dir = a.dir AND b.kind = 'ML' WHERE a.kind = 'HV' QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY dist, match) = 1)
 SELECT id, match, round(dist, 6) AS dist, coalesce(dist < 20, false) AS colocated FROM j""")
def paired_lane_sensors(spark, d):
    k = F.col("p_partkey") % 5
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("fwy"), F.col("p_size").alias("dir"), F.col("p_retailprice").alias("pm"), F.when(k == 0, "HV").when(k < 3, "ML").otherwise("FF").alias("kind"))
    return L.lane_pairs(s, ["fwy", "dir"], "pm", "kind", "HV", "ML", 20.0).withColumn("dist", R("dist"))


@query("SELECT o_orderpriority AS fwy, count(*) AS n, 'pending_manual' AS status FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def pending_by_line(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("fwy"), F.col("o_orderstatus").alias("kind"))
    return L.pending_sensors(o, "kind", "P", ["fwy"])


@query("""WITH e AS (SELECT n_nationkey AS edge, 'n' || n_nationkey AS src, 'n' || (n_nationkey + 1) AS dst, 100.0 + n_nationkey AS length FROM nation), s AS (SELECT 's' || s_suppkey AS id, s_nationkey AS edge, greatest(0, least(s_acctbal / 50, 100.0 + s_nationkey)) AS pos FROM supplier),
 st AS (SELECT edge, pos, 1 AS k, id AS node FROM s UNION ALL SELECT edge, 0, 0, src FROM e UNION ALL SELECT edge, length, 2, dst FROM e), o AS (SELECT edge, CAST(row_number() OVER w AS INTEGER) AS part, node AS src, lead(node) OVER w AS dst, lead(pos) OVER w - pos AS length FROM st WINDOW w AS (PARTITION BY edge ORDER BY pos, k, node)) SELECT edge, part, src, dst, round(length, 6) AS length FROM o WHERE dst IS NOT NULL""")
def sensors_on_edges(spark, d):
    n = F.col("n_nationkey")
    e = table(spark, d, "nation").select(n.alias("edge"), F.concat(F.lit("n"), n).alias("src"), F.concat(F.lit("n"), n + 1).alias("dst"), (n + 100.0).cast("double").alias("length"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("edge"), (F.col("s_acctbal") / 50).alias("along"))
    return L.embed_sensors(e, s).withColumn("length", R("length"))


@query("""WITH n AS (SELECT CAST(n_nationkey AS INTEGER) AS id, CAST(n_nationkey * 7 % 20 AS INTEGER) AS y, CAST(n_nationkey * 11 % 20 AS INTEGER) AS x FROM nation), g AS (SELECT y.range AS y, x.range AS x, (y.range * 13 + x.range * 29) % 17 AS h FROM range(20) y, range(20) x),
 p AS (SELECT a.id AS src, b.id AS dst, a.y AS y0, a.x AS x0, b.y AS y1, b.x AS x1, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS dist, greatest(abs(a.y - b.y), abs(a.x - b.x)) AS m FROM n a JOIN n b ON a.id <> b.id), c AS (SELECT src, dst, dist, m, i, CAST(floor(y0 + (y1 - y0) * i / m + 0.5) AS INTEGER) AS y, CAST(floor(x0 + (x1 - x0) * i / m + 0.5) AS INTEGER) AS x FROM p, unnest(range(0, m + 1)) u(i) WHERE dist > 0 AND dist <= 9),
 h AS (SELECT src, dst, dist, i, m, h FROM c JOIN g USING (y, x)), a AS (SELECT src, dst, dist, max(h) FILTER (i = 0) AS a, max(h) FILTER (i = m) AS b, list(h) AS hs FROM h GROUP BY ALL) SELECT src, dst, round(dist, 6) AS dist FROM a WHERE len(list_filter(hs, lambda z: z - a > 6)) < 3 AND len(list_filter(hs, lambda z: z - b > 6)) < 3""")
def altitude_filtered_graph(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), (F.col("n_nationkey") * 7 % 20).cast("int").alias("y"), (F.col("n_nationkey") * 11 % 20).cast("int").alias("x"))
    a, b = n.select(F.col("id").alias("src"), F.col("y").alias("y0"), F.col("x").alias("x0")), n.select(F.col("id").alias("dst"), F.col("y").alias("y1"), F.col("x").alias("x1"))
    pairs = a.join(F.broadcast(b), F.col("src") != F.col("dst")).withColumn("dist", F.sqrt((F.col("y0") - F.col("y1")) ** 2 + (F.col("x0") - F.col("x1")) ** 2))
    grid = spark.range(400).select((F.floor(F.col("id") / 20)).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x")).withColumn("altitude", (F.col("y") * 13 + F.col("x") * 29) % 17)
    return L.altitude_graph(pairs, grid, 9.0, 6.0).withColumn("dist", R("dist"))
