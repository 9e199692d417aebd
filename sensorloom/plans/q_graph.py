"""Queries over joins and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import graph as G
from sensorloom.operators import joins as J
from sensorloom.operators import neighbourhoods as H
from sensorloom.operators.nearest import FLAT_KM, HAVERSINE_M, knn, knn_graph
from sensorloom.plans.fixtures import FLOWS_SQL, PANEL, counts, flows
from sensorloom.plans.registry import query, table

R = lambda c, n=6: F.round(c, n)


def sparse(spark, d, k=3):
    return G.top_k(G.strip_self_loops(flows(spark, d)), k)


SPARSE = FLOWS_SQL + """, rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM flows WHERE src <> dst), e AS (SELECT src, dst, weight FROM rk WHERE k <= 3)"""
NODES = ", nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"


def _sorted_edges(df, n=6):
    return df.select("src", "dst", R("weight", n).alias("weight"))


@query(SPARSE + " SELECT src, dst, round(weight, 6) AS weight FROM e")
def graph_top_k(spark, d):
    return _sorted_edges(sparse(spark, d))


@query(FLOWS_SQL + ", o AS (SELECT src, dst, weight FROM flows ORDER BY weight DESC, src, dst LIMIT 40) SELECT f.src, f.dst, round(f.weight, 6) AS weight FROM flows f WHERE weight >= (SELECT min(weight) FROM o)")
def graph_global_top(spark, d):
    return _sorted_edges(G.global_top(flows(spark, d), 40, ties=True))


@query(SPARSE + ", b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) SELECT src, dst, round(max(weight), 6) AS weight FROM b GROUP BY 1, 2")
def graph_bidirectional(spark, d):
    return _sorted_edges(G.symmetrize(sparse(spark, d)))


@query(SPARSE + " SELECT dst AS src, src AS dst, round(weight, 6) AS weight FROM e")
def graph_reverse(spark, d):
    return _sorted_edges(G.reverse(sparse(spark, d)))


@query(SPARSE + """ SELECT 0 AS support, src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS weight FROM e UNION ALL SELECT 1, dst, src, round(weight / sum(weight) OVER (PARTITION BY dst), 6) FROM e""")
def graph_double_transition(spark, d):
    return G.normalize(sparse(spark, d), "doubletransition").select("support", "src", "dst", R("weight").alias("weight"))


_NORM = NODES + """, dg AS (SELECT src AS node, 1 / sqrt(sum(weight)) AS r FROM {e} GROUP BY 1), nrm AS (SELECT x.src, x.dst, x.weight * a.r * b.r AS weight FROM {e} x JOIN dg a ON a.node = x.src JOIN dg b ON b.node = x.dst)"""
_LAP = SPARSE + _NORM.format(e="e") + ", lap AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, -weight AS weight FROM nrm UNION ALL SELECT node, node, 1.0 FROM nd) GROUP BY 1, 2)"
_SCALED = _LAP + ", sl AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM lap UNION ALL SELECT node, node, -1.0 FROM nd) GROUP BY 1, 2)"


@query(_LAP + " SELECT src, dst, round(weight, 6) AS weight FROM lap")
def graph_laplacian(spark, d):
    return _sorted_edges(G.normalize(sparse(spark, d), "normlap"))


@query(_SCALED + " SELECT src, dst, round(weight, 6) + 0.0 AS weight FROM sl")
def graph_scaled_laplacian(spark, d):
    return _sorted_edges(G.normalize(sparse(spark, d), "scalap"))


@query(SPARSE + NODES + ", ei AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM e UNION ALL SELECT node, node, 1.0 FROM nd) GROUP BY 1, 2)" + _NORM.format(e="ei").replace(NODES, "") + " SELECT src, dst, round(weight, 6) AS weight FROM nrm")
def graph_message_passing(spark, d):
    return _sorted_edges(G.normalize(sparse(spark, d), "symnadj"))


@query(_SCALED + """, t2 AS (SELECT src, dst, sum(w) AS weight FROM (SELECT a.src, b.dst, 2 * a.weight * b.weight AS w FROM sl a JOIN sl b ON a.dst = b.src UNION ALL SELECT node, node, -1.0 FROM nd) GROUP BY 1, 2)
 SELECT 0 AS k, node AS src, node AS dst, 1.0 AS weight FROM nd UNION ALL SELECT 1, src, dst, round(weight, 6) + 0.0 FROM sl UNION ALL SELECT 2, src, dst, round(weight, 6) + 0.0 FROM t2""")
def graph_chebyshev(spark, d):
    return G.chebyshev(G.scaled_laplacian(sparse(spark, d)), 3).select("k", "src", "dst", R("weight").alias("weight"))


@query(SPARSE + NODES + """, o AS (SELECT src AS node, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY 1), a AS (SELECT node, count(DISTINCT x) AS n FROM (SELECT src AS node, dst AS x FROM e UNION ALL SELECT dst, src FROM e) GROUP BY 1),
 j AS (SELECT nd.node, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(a.n, 0) AS degree FROM nd LEFT JOIN o USING (node) LEFT JOIN i USING (node) LEFT JOIN a USING (node))
 SELECT *, row_number() OVER (ORDER BY degree DESC, node) <= CASE WHEN max(degree) OVER () > min(degree) OVER () THEN greatest(1, round_even(count(*) OVER () * 0.15, 0)) ELSE 0 END AS is_hub FROM j""")
def graph_degrees_and_hubs(spark, d):
    return G.degrees(sparse(spark, d))


@query(SPARSE + NODES + """ SELECT (SELECT count(*) FROM nd) AS nodes, count(*) AS edges, round(count(*) / (SELECT count(*) FROM nd), 6) AS mean_degree, round(count(*) / ((SELECT count(*) FROM nd) * ((SELECT count(*) FROM nd) - 1)), 6) AS density,
 round(quantile_cont(weight, 0.25), 6) AS q25, round(quantile_cont(weight, 0.5), 6) AS q50, round(quantile_cont(weight, 0.75), 6) AS q75 FROM e""")
def graph_statistics(spark, d):
    return G.stats(sparse(spark, d)).select("nodes", "edges", *[R(c).alias(c) for c in ("mean_degree", "density", "q25", "q50", "q75")])


_HOPS = SPARSE + NODES + """, h1 AS (SELECT DISTINCT src, dst FROM e), h2 AS (SELECT DISTINCT a.src, b.dst FROM h1 a JOIN h1 b ON a.dst = b.src),
 r AS (SELECT src, dst, min(hop) AS hop FROM (SELECT node AS src, node AS dst, 0 AS hop FROM nd UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2)"""


@query(_HOPS + " SELECT src, dst, CAST(hop AS INTEGER) AS hop FROM r")
def graph_two_hop_reach(spark, d):
    return G.reach(sparse(spark, d), 2)


@query(SPARSE + """, a AS (SELECT src, dst FROM e), w AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight / (1 + dst) DESC, dst) AS k FROM flows WHERE src <> dst)
 SELECT a.src, count(w.dst) AS overlap FROM a LEFT JOIN w ON w.src = a.src AND w.dst = a.dst AND w.k <= 3 GROUP BY 1""")
def graph_top_k_overlap(spark, d):
    f = G.strip_self_loops(flows(spark, d))
    return G.top_k_overlap(f, f.withColumn("weight", F.col("weight") / (1 + F.col("dst"))), 3)


@query(FLOWS_SQL + """, s AS (SELECT stddev_pop(1 / weight) AS sg FROM flows) SELECT src, dst, round(exp(-(((1 / weight) / sg) * ((1 / weight) / sg))), 6) AS weight FROM flows, s WHERE exp(-(((1 / weight) / sg) * ((1 / weight) / sg))) >= 0.1""")
def graph_gaussian_threshold(spark, d):
    return _sorted_edges(G.gaussian(flows(spark, d).withColumn("dist", 1 / F.col("weight")).drop("weight"), threshold=0.1))


@query(FLOWS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, m AS (SELECT src, dst FROM flows WHERE src <> dst AND (src + dst) % 5 = 0 AND src % 2 = dst % 2), u AS (SELECT src, dst FROM m UNION SELECT dst, src FROM m),
 c(node, root) AS (SELECT src, src FROM u UNION SELECT u.dst, c.root FROM c JOIN u ON u.src = c.node) SELECT node, min(root) AS component FROM c GROUP BY 1""")
def graph_components(spark, d):
    m = flows(spark, d).where("src <> dst and (src + dst) % 5 = 0 and src % 2 = dst % 2")
    return G.components(m)


@query("WITH " + PANEL.format(value="CAST(count(*) AS DOUBLE)", cell="coalesce(g.value, 0.0)") + """, n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT DISTINCT node FROM panel)), x AS (SELECT n.i AS node, t, value FROM panel JOIN n USING (node)),
 ring AS (SELECT i AS src, (i + 1) % 5 AS dst, 1.0 + i AS weight FROM n), pr AS (SELECT dst AS node, t, sum(weight * value) AS value FROM ring JOIN x ON x.node = src GROUP BY 1, 2)
 SELECT 'step' AS what, node, t, round(value, 6) AS value FROM pr UNION ALL SELECT 'gap', NULL, NULL, round(avg(abs(a.value - b.value)), 6) FROM ring JOIN x a ON a.node = src JOIN x b ON b.node = dst AND b.t = a.t
 UNION ALL SELECT 'energy', NULL, NULL, round(avg(weight * (a.value - b.value) ** 2), 6) FROM ring JOIN x a ON a.node = src JOIN x b ON b.node = dst AND b.t = a.t""")
def graph_signal_operators(spark, d):
    """Convolution step, neighbour gap and Dirichlet energy of counts on a ring."""
    p = counts(spark, d)
    n = p.select("node").distinct().withColumn("i", (F.row_number().over(Window.orderBy("node")) - 1).cast("long"))
    x = p.join(n, "node").select(F.col("i").alias("node"), "t", "value")
    ring = n.select(F.col("i").alias("src"), F.pmod(F.col("i") + 1, F.lit(5)).alias("dst"), (1.0 + F.col("i")).alias("weight"))
    s = G.propagate(ring, x).select(F.lit("step").alias("what"), "node", "t", R("value").alias("value"))
    one = G.edge_differences(ring, x)
    rows = one.select(F.explode(F.array(F.struct(F.lit("gap").alias("what"), F.col("gap").alias("v")), F.struct(F.lit("energy").alias("what"), F.col("energy").alias("v")))).alias("r"))
    return s.unionByName(rows.select("r.what", F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("t"), R("r.v").alias("value")))


@query(SPARSE.replace("WITH ", "WITH RECURSIVE ", 1) + """, le AS (SELECT src, dst, 1 / weight AS w FROM e), p(source, node, dist, n) AS (SELECT 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0 UNION ALL SELECT p.source, le.dst, p.dist + le.w, n + 1 FROM p JOIN le ON le.src = p.node WHERE p.dist + le.w <= 3.0 * (SELECT min(w) FROM le) AND n < 4)
 SELECT source, node, round(min(dist), 6) AS dist FROM p GROUP BY 1, 2""")
def graph_shortest_paths(spark, d):
    e = sparse(spark, d).withColumn("weight", 1 / F.col("weight"))
    G.ensure_checkpoint_dir(spark)
    cutoff = 3.0 * e.agg(F.min("weight")).first()[0]
    return G.shortest_paths(e, spark.range(1).withColumnRenamed("id", "node"), cutoff).withColumn("dist", R("dist"))


@query(SPARSE + """ SELECT src, dst, CAST(k AS INTEGER) AS part, CAST(ceil(weight / 2) AS INTEGER) AS parts, round(weight / ceil(weight / 2), 6) AS length FROM e, unnest(range(1, CAST(ceil(weight / 2) AS BIGINT) + 1)) AS u(k)""")
def graph_split_long_edges(spark, d):
    return G.split_long(sparse(spark, d), 2.0).withColumn("length", R("length"))


@query(SPARSE + """, k AS (SELECT * FROM e WHERE src % 3 = 0 AND dst % 3 = 0), n AS (SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS INTEGER) AS i FROM (SELECT src AS node FROM k UNION SELECT dst FROM k))
 SELECT src, dst, round(weight, 6) AS weight, a.i AS src_idx, b.i AS dst_idx FROM k JOIN n a ON a.node = src JOIN n b ON b.node = dst""")
def graph_induced(spark, d):
    anchors = spark.range(25).where("id % 3 = 0").withColumnRenamed("id", "node")
    return G.induced(sparse(spark, d), anchors).select("src", "dst", R("weight").alias("weight"), "src_idx", "dst_idx")


_SETS = SPARSE + """, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s2 AS (SELECT DISTINCT list_sort([src, dst]) AS s FROM u),
 s3 AS (SELECT DISTINCT list_sort(list_append(s, u.dst)) AS nodes FROM s2 JOIN u ON list_contains(s, u.src) AND NOT list_contains(s, u.dst))"""


@query(_SETS + " SELECT nodes FROM s3")
def subgraphs_of_three(spark, d):
    return G.connected_subgraphs(sparse(spark, d), 3)


@query(_SETS.replace("k <= 3", "k <= 2") + """, sc AS (SELECT src, list_sort(list(DISTINCT dst)) AS sc FROM e GROUP BY 1 HAVING count(DISTINCT dst) >= 2) SELECT src AS node, nodes FROM s3 JOIN sc ON list_contains(nodes, src) AND list_has_all(nodes, sc)""")
def subgraphs_with_confounder(spark, d):
    e = sparse(spark, d, 2)
    return G.confounder_sets(e, G.connected_subgraphs(e, 3))


@query(SPARSE + " SELECT x.dst AS sink, [x.src, y.src] AS causes FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src")
def subgraphs_sinks(spark, d):
    return G.sink_cases(sparse(spark, d))


@query(SPARSE + """, s AS (SELECT node % 4 AS sample, node FROM range(25) t(node)) SELECT a.sample, a.node AS cause, b.node AS effect, CAST(e.src IS NOT NULL AS INTEGER) AS label FROM s a JOIN s b USING (sample) LEFT JOIN e ON e.src = a.node AND e.dst = b.node""")
def causal_label_matrix(spark, d):
    s = spark.range(25).selectExpr("id % 4 AS sample", "id AS node")
    return G.label_matrix(s, sparse(spark, d))


@query(SPARSE + """, ty AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_regionkey < 3 THEN upper(trim(r_name)) END AS type FROM nation JOIN region ON r_regionkey = n_regionkey)
 SELECT src, dst, coalesce(a.type, 'UNK') || '_' || coalesce(b.type, 'UNK') AS edge_type FROM e LEFT JOIN ty a ON a.id = src LEFT JOIN ty b ON b.id = dst""")
def edge_types(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    t = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_regionkey") < 3, F.upper(F.trim("r_name"))).alias("type"))
    return J.add_edge_types(sparse(spark, d), t).select("src", "dst", "edge_type")


# ---- joins

@query("""SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_purchase FROM events e WHERE e.event_type = 'error'""")
def asof_last_purchase(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("last_purchase"))
    return J.asof(left, right, "ts", "since", ["user_id"], "last_purchase").select("event_id", "last_purchase")


@query("""WITH s AS (SELECT user_id, event_id AS snap, ts FROM events WHERE event_type = 'signup'), l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
 SELECT l.event_id, coalesce(max(snap) FILTER (s.ts <= l.ts), min(snap)) AS snap FROM l LEFT JOIN s USING (user_id) GROUP BY l.event_id""")
def asof_snapshot_or_first(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("snap"))
    return J.asof(left, right, "ts", "since", ["user_id"], "snap", fallback=True).select("event_id", "snap")


_POINTS = "pt AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 2 AS lat, CAST(embedding[2] AS DOUBLE) * 2 AS lon FROM embeddings)"
_HAV = "2 * 6371000 * atan2(sqrt(h), sqrt(1 - h))"


def _points(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 2).alias("lat"), (F.col("embedding")[1].cast("double") * 2).alias("lon"))


@query(f"""WITH {_POINTS}, c AS (SELECT x.id AS a, y.id AS b, sin(radians(y.lat - x.lat) / 2) ** 2 + cos(radians(x.lat)) * cos(radians(y.lat)) * sin(radians(y.lon - x.lon) / 2) ** 2 AS h FROM pt x JOIN pt y ON x.id < y.id)
 SELECT a, b, round({_HAV}, 3) AS dist_m FROM c WHERE {_HAV} <= 3000""")
def radius_join(spark, d):
    return J.within_radius(_points(spark, d), 3000.0).withColumn("dist_m", R("dist_m", 3))


@query(f"""WITH {_POINTS}, p AS (SELECT id, lat AS x, lon AS y FROM pt), k AS (SELECT a.id AS src, b.id AS dst, sqrt(((b.y - a.y) * 111.320 * cos(radians((a.x + b.x) / 2))) ** 2 + ((b.x - a.x) * 110.540) ** 2) AS dist FROM p a JOIN p b ON a.id <> b.id)
 SELECT src, dst, round(dist, 6) AS dist, CASE WHEN dist >= 20 THEN 3 WHEN dist >= 10 THEN 2 WHEN dist >= 5 THEN 1 WHEN dist >= 0 THEN 0 END AS bin FROM k QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 4""")
def knn_graph_with_bins(spark, d):
    p = _points(spark, d).select("id", F.col("lat").alias("x"), F.col("lon").alias("y"))
    return J.bins_join(knn(p, 4, FLAT_KM), "dist", [0, 5, 10, 20]).withColumn("dist", R("dist"))


@query(f"""WITH {_POINTS}, h AS (SELECT a.id AS src, b.id AS dst, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2 AS h FROM pt a JOIN pt b ON a.id <> b.id),
 k AS (SELECT src, dst, {_HAV} AS dist FROM h QUALIFY row_number() OVER (PARTITION BY src ORDER BY {_HAV}, dst) <= 5), s AS (SELECT median(dist) FILTER (dist > 0) AS s FROM k), e AS (SELECT src, dst, exp(-((dist / s) ** 2)) AS w FROM k, s), z AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e)
 SELECT src, dst, round(max(w), 6) AS weight FROM z GROUP BY 1, 2""")
def knn_gaussian_graph(spark, d):
    p = _points(spark, d).select("id", F.col("lat").alias("x"), F.col("lon").alias("y"))
    return _sorted_edges(knn_graph(p, 5, HAVERSINE_M))


@query("""WITH p AS (SELECT l_orderkey AS id, l_returnflag AS fwy, l_linestatus AS dir, l_extendedprice AS pm FROM lineitem),
 u AS (SELECT id, fwy, dir, max(pm) AS pm FROM p GROUP BY ALL) SELECT fwy, dir, id AS src, lead(id) OVER w AS dst, round(lead(pm) OVER w - pm, 6) AS gap FROM u WINDOW w AS (PARTITION BY fwy, dir ORDER BY pm, id) QUALIFY dst IS NOT NULL AND lead(pm) OVER w - pm <= 50""")
def consecutive_on_line(spark, d):
    return J.consecutive(_line(spark, d), ["fwy", "dir"], F.col("pm"), "id", 50.0).withColumn("gap", R("gap"))


def _line(spark, d):
    x = table(spark, d, "lineitem")
    return x.groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("fwy"), F.col("l_linestatus").alias("dir")).agg(F.max("l_extendedprice").alias("pm"))


@query("""WITH u AS (SELECT l_orderkey AS id, l_returnflag AS fwy, l_linestatus AS dir, max(l_extendedprice) AS pm FROM lineitem GROUP BY 1, 2, 3),
 n AS (SELECT *, CAST(coalesce(pm - lag(pm) OVER (PARTITION BY fwy, dir ORDER BY pm, id), 21) > 20 AS INTEGER) AS f FROM u) SELECT id, fwy, dir, CAST(sum(f) OVER (PARTITION BY fwy, dir ORDER BY pm, id) AS BIGINT) AS grp FROM n""")
def colocated_groups(spark, d):
    return J.colocated(_line(spark, d), ["fwy", "dir"], "pm", 20.0).select("id", "fwy", "dir", "grp")


@query("""WITH r AS (SELECT p_partkey AS id, p_brand AS fwy, p_retailprice AS pm FROM part WHERE p_type LIKE 'PROMO%'), m AS (SELECT p_partkey AS rid, p_brand AS fwy, p_retailprice AS rp FROM part WHERE p_type NOT LIKE 'PROMO%'),
 b AS (SELECT r.id, rid, abs(pm - rp) AS dist, row_number() OVER (PARTITION BY r.id ORDER BY abs(pm - rp), rid) AS k FROM r JOIN m USING (fwy)) SELECT r.id, b.rid AS match, round(b.dist, 6) AS dist FROM r LEFT JOIN b ON b.id = r.id AND k = 1 AND b.dist <= 5""")
def nearest_on_line(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("fwy"), F.col("p_retailprice").alias("pm"), F.col("p_type").startswith("PROMO").alias("promo"))
    left = p.where("promo")
    right = p.where("not promo").select(F.col("id").alias("rid"), "fwy", F.col("pm").alias("rp"))
    return J.nearest(left, right, ["fwy"], "pm", "rp", "rid", 5.0).select("id", "match", R("dist").alias("dist"))


@query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nat FROM customer WHERE c_custkey % 10 <> 3), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 11 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS nat FROM customer WHERE c_custkey % 10 <> 4)
 SELECT k, 'added' AS status, NULL AS field, NULL AS before, NULL AS after FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'removed', NULL, NULL, NULL FROM a WHERE k NOT IN (SELECT k FROM b)
 UNION ALL SELECT a.k, 'changed', 'seg', a.seg, b.seg FROM a JOIN b USING (k) WHERE a.seg IS DISTINCT FROM b.seg UNION ALL SELECT a.k, 'changed', 'nat', CAST(a.nat AS VARCHAR), CAST(b.nat AS VARCHAR) FROM a JOIN b USING (k) WHERE a.nat IS DISTINCT FROM b.nat""")
def snapshot_difference(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"))
    new = c.where("k % 10 <> 4").withColumn("seg", F.when(F.col("k") % 7 != 0, F.col("seg"))).withColumn("nat", F.when(F.col("k") % 11 == 0, F.col("nat") + 1).otherwise(F.col("nat")))
    return J.snapshot_diff(c.where("k % 10 <> 3"), new, "k", ["seg", "nat"])


@query("SELECT user_id AS id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def common_to_all(spark, d):
    return J.in_all(table(spark, d, "events").withColumnRenamed("user_id", "id"), "id", "event_type")


@query("""SELECT p_partkey, round(sqrt((p_size - 1) ** 2 + (p_retailprice - 900) ** 2) + sqrt(9 + 16), 6) AS length FROM part""")
def polyline_lengths(spark, d):
    pt = lambda x, y: F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "cast") else x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if not hasattr(y, "cast") else y.cast("double").alias("y"))
    p = table(spark, d, "part")
    line = F.array(pt(1, 900), pt(F.col("p_size"), F.col("p_retailprice")), pt(F.col("p_size") + 3, F.col("p_retailprice") + 4))
    return p.select("p_partkey", R(J.polyline_length(line)).alias("length"))


@query("""SELECT n_name, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def catalog_build(spark, d):
    """Dimension catalog with degree counts joined left, each aggregated before its join."""
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return n.join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").select("n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("""WITH a AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS in_degree, coalesce(b.n, 0) AS out_degree FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_degrees(spark, d):
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("in_degree"))
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("out_degree"))
    return a.join(b, "k", "full").select("k", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


@query("""SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def semi_and_anti_joins(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    key = F.col("o_custkey") == F.col("c_custkey")
    return o.join(c.where("c_mktsegment = 'BUILDING'"), key, "left_semi").join(c.where("c_acctbal < 0"), key, "left_anti").agg(F.count("*").alias("n"))


@query(SPARSE + """, b AS (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), dg AS (SELECT a AS node, count(*) AS d FROM b GROUP BY 1), h AS (SELECT a AS c, a AS node, 0 AS hop FROM b UNION SELECT a, b, 1 FROM b UNION SELECT x.a, y.b, 2 FROM b x JOIN b y ON x.b = y.a), m AS (SELECT c, node, min(hop) AS hop FROM h GROUP BY 1, 2),
 r AS (SELECT c, m.node, row_number() OVER (PARTITION BY c ORDER BY hop, d DESC, m.node) AS k FROM m JOIN dg ON dg.node = m.node), g AS (SELECT c, list(node ORDER BY node) AS nodes FROM r WHERE k <= 5 GROUP BY c HAVING count(*) = 5) SELECT DISTINCT nodes FROM g""")
def two_hop_samples(spark, d):
    return H.two_hop_samples(sparse(spark, d), 5)


@query("""WITH s AS (SELECT vec_id // 5 AS sample, vec_id AS node, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[2] AS DOUBLE) AS x FROM embeddings), m AS (SELECT sample, avg(y) AS y, avg(x) AS x, list(node) AS own FROM s GROUP BY 1),
 f AS (SELECT a.sample, a.own, b.own AS more, ((a.y - b.y) ** 2 + (a.x - b.x) ** 2) / 2 AS gap, b.sample AS other FROM m a JOIN m b ON a.sample <> b.sample QUALIFY row_number() OVER (PARTITION BY a.sample ORDER BY gap DESC, other) = 1) SELECT DISTINCT list_sort(list_concat(own, more)) AS nodes FROM f""")
def samples_far_apart(spark, d):
    e = table(spark, d, "embeddings")
    s = e.select(F.floor(F.col("vec_id") / 5).alias("sample"), F.col("vec_id").alias("node"))
    return H.combine_far_apart(s, e.select(F.col("vec_id").alias("node"), F.col("embedding")[0].cast("double").alias("y"), F.col("embedding")[1].cast("double").alias("x")))


@query("SELECT p_partkey, 0 AS pos, CAST(p_size AS INTEGER) AS route, 'N' AS direction FROM part UNION ALL SELECT p_partkey, 1, CAST(p_size + 100 AS INTEGER), CASE WHEN p_partkey % 2 = 0 THEN 'S' ELSE 'E' END FROM part WHERE p_partkey % 3 <> 0")
def connector_route_rows(spark, d):
    """A registered table function in a lateral join; names are made of the parts' sizes."""
    H.register_table_functions(spark)
    p = table(spark, d, "part").selectExpr("p_partkey", "concat(p_size, 'N TO ', CASE WHEN p_partkey % 3 <> 0 THEN concat(p_size + 100, CASE WHEN p_partkey % 2 = 0 THEN ' SB' ELSE '-E' END) ELSE 'CONN' END) AS name")
    return spark.sql("SELECT p_partkey, r.pos, r.route, r.direction FROM {p}, LATERAL connector_routes(name) r", p=p)
