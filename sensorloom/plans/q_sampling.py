"""Queries over subgraph samples, routes, learned graphs and the causal benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import causal as K
from sensorloom.operators import lag as L
from sensorloom.operators import sampling as S
from sensorloom.operators.learned import adaptive_graph, directed_top_k
from sensorloom.plans.fixtures import COUNTS_SQL, counts
from sensorloom.plans.q_graph import SPARSE, sparse
from sensorloom.plans.registry import query, table

R = lambda c, n=6: F.round(c, n)


@query("""WITH s AS (SELECT o_custkey AS sample, l_suppkey AS node FROM orders JOIN lineitem ON l_orderkey = o_orderkey), g AS (SELECT sample FROM s LEFT JOIN supplier ON s_suppkey = node GROUP BY 1 HAVING bool_and(coalesce(s_nationkey < 22, false))) SELECT sample, count(*) AS n FROM s WHERE sample IN (SELECT sample FROM g) GROUP BY 1""")
def samples_of_allowed_origin(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    s = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("sample"), F.col("l_suppkey").alias("node"))
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), "s_nationkey")
    return S.with_properties(s, p, "s_nationkey", list(range(22))).groupBy("sample").agg(F.count("*").alias("n"))


#: Samples: the edges of the sparse graph within each group of five nations.
_SAMPLES = SPARSE + ", se AS (SELECT src % 5 AS sample, src, dst, weight FROM e WHERE src % 5 = dst % 5 UNION ALL SELECT 5 + src % 3, src, dst, CASE WHEN dst <> 4 THEN weight END FROM e WHERE src % 3 = dst % 3)"


def _samples(spark, d):
    e = sparse(spark, d)
    a = e.where("src % 5 = dst % 5").select((F.col("src") % 5).alias("sample"), "src", "dst", "weight")
    return a.unionByName(e.where("src % 3 = dst % 3").select((5 + F.col("src") % 3).alias("sample"), "src", "dst", F.when(F.col("dst") != 4, F.col("weight")).alias("weight")))


@query(_SAMPLES + " SELECT sample, src, dst, round(weight, 6) AS weight FROM se WHERE sample IN (SELECT sample FROM se GROUP BY 1 HAVING bool_and(coalesce(weight < 7, false)))")
def samples_of_small_edges(spark, d):
    return S.edges_all(_samples(spark, d), F.col("weight") < 7).select("sample", "src", "dst", R("weight").alias("weight"))


_PATHS = _SAMPLES.replace("WITH ", "WITH RECURSIVE ", 1) + """, pa(sample, nodes, dst, length, hops) AS (SELECT sample, [src, dst], dst, coalesce(weight, 'inf'::DOUBLE), 1 FROM se WHERE src <> dst UNION ALL SELECT pa.sample, list_append(nodes, se.dst), se.dst, length + coalesce(weight, 'inf'::DOUBLE), hops + 1 FROM pa JOIN se ON se.sample = pa.sample AND se.src = pa.dst AND NOT list_contains(nodes, se.dst) WHERE hops < 4)"""


@query(_PATHS + " SELECT sample, round(max(length), 6) AS length, max(hops) AS hops FROM pa GROUP BY 1")
def longest_weighted_paths(spark, d):
    return S.longest_paths(_samples(spark, d), 4).withColumn("length", R("length"))


@query(_PATHS.replace("hops < 4", "hops < 3") + " SELECT sample FROM pa GROUP BY 1 HAVING max(hops) = 3")
def root_cause_samples(spark, d):
    return S.single_root_chains(_samples(spark, d), 4)


@query()
def samples_with_isolated_node(spark, d):
    """One hash-chosen node more in each sample; tests check that it is new and that samples are kept."""
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_suppkey").alias("node")).distinct()
    return S.add_isolated(o, table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), 12)


_ROUTES = SPARSE.replace("WITH ", "WITH RECURSIVE ", 1) + """, st AS (SELECT s_suppkey % 40 AS route, CASE WHEN s_suppkey % 40 = 7 THEN NULL ELSE s_suppkey END AS pos, CASE WHEN s_suppkey % 31 = 0 THEN NULL WHEN s_suppkey % 37 = 0 THEN 99 ELSE s_nationkey END AS road FROM supplier WHERE s_suppkey % 40 <> 9), sp AS (SELECT *, lead(road) OVER w AS nxt, lead(pos) OVER w IS NOT NULL AS more FROM st WHERE pos IS NOT NULL WINDOW w AS (PARTITION BY route ORDER BY pos)), gp AS (SELECT DISTINCT road AS a, nxt AS b FROM sp WHERE nxt <> road),
 wk(a, b, path) AS (SELECT a::BIGINT, b::BIGINT, [a::BIGINT] FROM gp UNION ALL SELECT wk.a, wk.b, list_append(path, e.dst) FROM wk JOIN e ON e.src = path[-1] AND NOT list_contains(path, e.dst) WHERE len(path) <= 7 AND path[-1] <> wk.b),
 bs AS (SELECT a, b, path FROM wk WHERE path[-1] = b QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY len(path), path) = 1)"""


@query(_ROUTES + """, j AS (SELECT sp.*, path, CASE WHEN NOT more THEN [road::BIGINT] WHEN nxt = road THEN []::BIGINT[] ELSE path[1:len(path) - 1] END AS part FROM sp LEFT JOIN bs ON a = road AND b = nxt),
 g AS (SELECT route, flatten(list(part ORDER BY pos)) AS roads, bool_or(coalesce(road >= 25, true)) AS unknown, bool_or(more AND nxt <> road AND path IS NULL) AS cut, bool_or(len(path) > 2) AS longer FROM j GROUP BY 1), r AS (SELECT DISTINCT st.route, roads, longer, CASE WHEN unknown IS NULL THEN 'empty_or_nonlist_route' WHEN unknown THEN 'unknown_road' WHEN cut THEN 'unreachable_anchor' END AS reason FROM st LEFT JOIN g USING (route))
 SELECT route, CASE WHEN reason IS NULL THEN roads END AS roads, reason, coalesce(reason IS NULL AND longer, false) AS changed FROM r""")
def repaired_routes(spark, d):
    """Routes through the nations of suppliers, some with null, unknown or no stops."""
    s, k = table(spark, d, "supplier").where("s_suppkey % 40 <> 9"), F.col("s_suppkey")
    road = F.when(k % 31 == 0, F.lit(None)).when(k % 37 == 0, 99).otherwise(F.col("s_nationkey")).cast("long")
    stops = s.select((k % 40).alias("route"), F.when(k % 40 != 7, k).alias("pos"), road.alias("road"))
    known = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("road"))
    return S.repair_routes(stops, sparse(spark, d), known)


@query(COUNTS_SQL + """, st AS (SELECT node, avg(value) AS m, stddev_pop(value) AS s FROM panel GROUP BY 1), z AS (SELECT node, t, (value - m) / s AS z FROM panel JOIN st USING (node)), nd AS (SELECT DISTINCT node FROM panel), p AS (SELECT a.node AS src, b.node AS dst, abs(length(a.node) - length(b.node)) AS dist FROM nd a JOIN nd b ON a.node <> b.node QUALIFY row_number() OVER (PARTITION BY a.node ORDER BY dist, b.node) <= 3),
 r AS (SELECT src, dst, avg((x.z - y.z) ** 2) AS roughness FROM p JOIN z x ON x.node = src JOIN z y ON y.node = dst AND y.t = x.t GROUP BY 1, 2) SELECT src, dst, round(roughness, 6) AS roughness FROM r QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(roughness, 9), dst) <= 2""")
def smoothest_neighbours(spark, d):
    p = counts(spark, d)
    e = L.all_pairs(p).withColumn("dist", F.abs(F.length("src") - F.length("dst")))
    return S.roughness_top_k(e, p, 2, 3).withColumn("roughness", R("roughness"))


_COS = "1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


@query(f"""WITH n AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT vec_id AS src, (vec_id * 7 + 1) % n AS dst FROM embeddings, n), pr AS (SELECT DISTINCT vec_id AS src, (vec_id * 11 + k) % n AS dst FROM embeddings, n, unnest(range(1, 5)) u(k)), rw AS (SELECT DISTINCT src, dst, true AS near FROM e WHERE src <> dst UNION ALL SELECT DISTINCT src, dst, false FROM pr WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM e) AND (dst, src) NOT IN (SELECT (src, dst) FROM e)),
 c AS (SELECT near, {_COS} AS d FROM rw JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst) SELECT round(avg(d) FILTER (near), 6) AS near, round(avg(d) FILTER (NOT near), 6) AS far, round(avg(d) FILTER (NOT near) - avg(d) FILTER (near), 6) AS gap FROM c""")
def smoothness_gap(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = v.count()
    edges = v.select(F.col("node").alias("src"), ((F.col("node") * 7 + 1) % n).alias("dst"))
    pairs = v.select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).select("src", ((F.col("src") * 11 + F.col("k")) % n).alias("dst"))
    return S.mad_gap(v, edges, pairs).select(R("near").alias("near"), R("far").alias("far"), R("gap").alias("gap"))


_LEARNED = """WITH em AS (SELECT vec_id AS node, CAST(embedding AS DOUBLE[]) AS v, CAST(list_reverse(embedding) AS DOUBLE[]) AS u FROM embeddings), r AS (SELECT a.node AS src, b.node AS dst, greatest(list_dot_product(a.v, b.u) * 4, 0) AS r FROM em a, em b),
 lw AS (SELECT src, dst, exp(r) / sum(exp(r)) OVER (PARTITION BY src) AS weight FROM r QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(r, 12) DESC, dst) <= {k})"""


def _embedded(spark, d, scale=1.0):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    return e.select("node", F.transform("v", lambda x: x * scale).alias("v"), "label"), e.select("node", F.reverse("v").alias("v"))


@query(_LEARNED.format(k=5) + " SELECT src, dst, round(weight, 6) AS weight FROM lw")
def learned_graph_weights(spark, d):
    """The five strongest of all nodes for each node, with their share of the softmax over all."""
    a, b = _embedded(spark, d, 4.0)
    return adaptive_graph(a, b, 5).withColumn("weight", R("weight"))


@query("""WITH em AS (SELECT vec_id AS node, CAST(embedding AS DOUBLE[]) AS v, CAST(list_concat(embedding[2:], embedding[1:1]) AS DOUBLE[]) AS u FROM embeddings), r AS (SELECT a.node AS src, b.node AS dst, (exp(2 * x) - 1) / (exp(2 * x) + 1) AS w FROM (SELECT a.node AS an, b.node AS bn, 3 * (list_dot_product(a.v, b.u) - list_dot_product(a.u, b.v)) AS x FROM em a, em b) z JOIN em a ON a.node = an JOIN em b ON b.node = bn WHERE x > 0)
 SELECT src, dst, round(w, 6) AS weight FROM r QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(w, 12) DESC, dst) <= 4""")
def learned_directed_graph(spark, d):
    """The second embedding of a node is its first, turned by one place."""
    a, _ = _embedded(spark, d)
    b = a.select("node", F.concat(F.slice("v", F.lit(2), F.size("v") - 1), F.slice("v", 1, 1)).alias("v"))
    return directed_top_k(a, b, 4).withColumn("weight", R("weight"))


@query(_LEARNED.format(k=50) + """, sm AS (SELECT vec_id AS node, vec_id // 25 AS sample, label FROM embeddings), sc AS (SELECT a.sample, round(coalesce(lw.weight, 0), 6) AS score, CAST(a.label = b.label AS INTEGER) AS label FROM sm a JOIN sm b ON a.sample = b.sample AND a.node <> b.node LEFT JOIN lw ON lw.src = a.node AND lw.dst = b.node),
 k AS (SELECT *, rank() OVER (PARTITION BY sample ORDER BY score) + (count(*) OVER (PARTITION BY sample, score) - 1) / 2 AS rk FROM sc) SELECT sample, round((sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) AS auroc FROM k GROUP BY 1""")
def learned_graph_scores(spark, d):
    """A learned graph of all nodes at the pairs of each sample, scored against pairs of one label."""
    a, b = _embedded(spark, d, 4.0)
    samples = a.select((F.floor(F.col("node") / 25)).alias("sample"), "node", "label")
    s = S.sample_graphs(samples, adaptive_graph(a, b, 50)).withColumn("score", R("score"))
    x, y = samples.select("sample", F.col("node").alias("src"), "label"), samples.select("sample", F.col("node").alias("dst"), "label")
    lab = x.join(y, ["sample", "label"]).where("src <> dst").select("sample", "src", "dst")
    return L.auroc(S.with_labels(s, lab), ["sample"]).select("sample", R("auroc").alias("auroc"))


_BENCH = COUNTS_SQL + """, sg AS (SELECT t // 240 AS sample, node, t, value FROM panel), nd AS (SELECT DISTINCT sample, node FROM sg), pr AS (SELECT a.sample, a.node AS src, b.node AS dst FROM nd a JOIN nd b ON a.sample = b.sample AND a.node <> b.node),
 cr AS (SELECT pr.sample, src, dst, k, corr(x.value, y.value) AS c FROM pr JOIN sg x ON x.sample = pr.sample AND x.node = src CROSS JOIN unnest(range(0, 4)) u(k) JOIN sg y ON y.sample = pr.sample AND y.node = dst AND y.t = x.t + k GROUP BY ALL),
 m AS (SELECT sample, node, avg(value) AS m FROM sg GROUP BY 1, 2), lc AS (SELECT sample, src, dst, max(abs(c)) AS score FROM cr WHERE k > 0 GROUP BY 1, 2, 3),
 sc AS (SELECT 'correlation' AS method, sample, src, dst, abs(c) AS score FROM cr WHERE k = 0 UNION ALL SELECT 'lagged_correlation', sample, src, dst, score FROM lc
 UNION ALL SELECT 'stronger_direction', a.sample, a.src, a.dst, CASE WHEN a.score > b.score THEN a.score ELSE 0 END FROM lc a JOIN lc b ON a.sample = b.sample AND a.src = b.dst AND a.dst = b.src UNION ALL SELECT 'mean_difference', pr.sample, src, dst, greatest(y.m - x.m, 0) FROM pr JOIN m x ON x.sample = pr.sample AND x.node = src JOIN m y ON y.sample = pr.sample AND y.node = dst),
 lb AS (SELECT method, round(score, 6) AS score, CAST(length(src) < length(dst) AS INTEGER) AS label FROM sc), rk AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2 AS rk FROM lb),
 a AS (SELECT method, (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auroc, count(*) AS pairs FROM rk GROUP BY 1), th AS (SELECT DISTINCT method, score FROM lb),
 c AS (SELECT th.method, th.score, sum(label) FILTER (lb.score >= th.score) AS tp, count(*) FILTER (lb.score >= th.score) AS said, sum(label) AS pos, count(*) AS n FROM th JOIN lb USING (method) GROUP BY 1, 2),
 f AS (SELECT method, max(2 * tp / (said + pos)) AS max_f1, max(greatest(tp + n - pos - (said - tp), n - pos) / n) AS max_accuracy FROM c GROUP BY 1) SELECT method, round(auroc, 6) AS auroc, round(max_f1, 6) AS max_f1, round(max_accuracy, 6) AS max_accuracy, pairs FROM a JOIN f USING (method)"""


@query(_BENCH)
def causal_benchmark(spark, d):
    """Registered causal methods over the samples of three periods, scored against made-up labels by name length."""
    s = counts(spark, d).select(F.floor(F.col("t") / 240).alias("sample"), "node", "t", "value")
    labels = K.sample_pairs(s).where(F.length("src") < F.length("dst"))
    b = K.benchmark(s, labels, ["correlation", "lagged_correlation", "stronger_direction", "mean_difference"], 6)
    return b.select("method", *[R(c).alias(c) for c in ("auroc", "max_f1", "max_accuracy")], "pairs")
