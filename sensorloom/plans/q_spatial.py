"""Queries of edge summaries and of means by turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import forecast as C
from sensorloom.operators import graph as G
from sensorloom.operators import spatial as S
from sensorloom.plans.fixtures import FACTS_SQL, predictions
from sensorloom.plans.q_graph import NODES, SPARSE, sparse
from sensorloom.plans.registry import query, table

R = lambda c, n=6: F.round(c, n)


@query(FACTS_SQL + """, ed AS (SELECT a.node AS src, b.node AS dst, CAST(length(a.node) AS DOUBLE) AS weight FROM (SELECT DISTINCT node FROM panel) a JOIN (SELECT DISTINCT node FROM panel) b ON a.node < b.node), r AS (SELECT system, horizon, node, t, target - pred AS v FROM facts WHERE target - pred IS NOT NULL),
 o AS (SELECT system, horizon, src, dst, weight, CASE WHEN count(*) >= 3 THEN corr(x.v, y.v) END AS c, avg((x.v - y.v) ** 2) AS d FROM ed JOIN r x ON x.node = src JOIN r y USING (system, horizon, t) WHERE y.node = dst GROUP BY ALL)
 SELECT system, horizon, round(avg(c), 6) AS edge_corr, round(sum(d * weight) / sum(weight), 4) AS dirichlet, (SELECT count(*) FROM ed) AS n_edges FROM o GROUP BY 1, 2""")
def residual_edge_structure(spark, d):
    f = predictions(spark, d)
    n = f.select("node").distinct()
    edges = n.select(F.col("node").alias("src")).join(n.select(F.col("node").alias("dst")), F.col("src") < F.col("dst")).withColumn("weight", F.length("src").cast("double"))
    s = S.edge_structure(f.withColumn("value", F.col("target") - F.col("pred")), edges, ["system", "horizon"])
    return s.withColumn("edge_corr", R("edge_corr")).withColumn("dirichlet", R("dirichlet", 4))


@query("""WITH x AS (SELECT CAST(l_extendedprice AS DOUBLE) / 1000 AS dist, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) % 5 AS best_lag, CASE WHEN l_returnflag <> 'R' THEN date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) % 5 END AS lag, CAST(l_discount AS DOUBLE) * 10 AS score, CASE WHEN l_linenumber > 1 THEN CAST(l_tax AS DOUBLE) END AS gain, l_quantity > 25 AS sure FROM lineitem),
 b AS (SELECT unnest([0, 5, 20, 50, 1000]) AS lo, unnest([5.0, 20.0, 50.0, 1000.0, 'inf'::DOUBLE]) AS hi, unnest(['[0, 5)', '[5, 20)', '[20, 50)', '[50, 1000)', '[1000, inf)']) AS distance)
 SELECT distance, count(dist) AS n_edges, round(avg(CASE WHEN dist IS NOT NULL THEN CAST(best_lag = 0 AS INTEGER) END), 8) AS zero_best_ratio, round(avg(CAST(score < 0.3 AS INTEGER)), 8) AS weak_ratio, round(avg(CASE WHEN dist IS NOT NULL THEN CAST(lag IS NULL AS INTEGER) END), 8) AS no_lag_ratio,
 round(avg(CASE WHEN dist IS NOT NULL THEN CAST(coalesce(lag = 0, false) AS INTEGER) END), 8) AS zero_lag_ratio, round(avg(CASE WHEN dist IS NOT NULL THEN CAST(coalesce(lag = 0, true) AS INTEGER) END), 8) AS zero_or_no_lag_ratio, round(avg(CASE WHEN dist IS NOT NULL THEN CAST(coalesce(best_lag > 0 AND score >= 0.3 AND gain < 0.03, false) AS INTEGER) END), 8) AS low_gain_ratio,
 round(avg(CAST(sure AS INTEGER)), 8) AS sure_ratio, CAST(median(best_lag) AS DOUBLE) AS median_best_lag, CAST(median(lag) AS DOUBLE) AS median_lag, round(median(score), 6) AS median_score, round(median(gain), 6) AS median_gain FROM b LEFT JOIN x ON dist >= lo AND dist < hi GROUP BY 1""")
def delays_by_distance(spark, d):
    days = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")) % 5
    x = table(spark, d, "lineitem").select(
        (F.col("l_extendedprice").cast("double") / 1000).alias("dist"), days.alias("best_lag"), F.when(F.col("l_returnflag") != "R", days).alias("lag"),
        (F.col("l_discount").cast("double") * 10).alias("score"), F.when(F.col("l_linenumber") > 1, F.col("l_tax").cast("double")).alias("gain"), (F.col("l_quantity") > 25).alias("sure"),
    )
    b = S.distance_bins(x, [0, 5, 20, 50, 1000, float("inf")], 0.3, 0.03)
    return b.select("distance", "n_edges", *[R(c, 8).alias(c) for c in b.columns if c.endswith("_ratio")], "median_best_lag", "median_lag", R("median_score").alias("median_score"), R("median_gain").alias("median_gain"))


@query(SPARSE + NODES + """, dg AS (SELECT node, (SELECT count(*) FROM e WHERE dst = node) AS in_degree, (SELECT count(*) FROM e WHERE src = node) AS out_degree, (SELECT count(DISTINCT CASE WHEN src = node THEN dst ELSE src END) FROM e WHERE src = node OR dst = node) AS degree FROM nd),
 st AS (SELECT n_regionkey AS region, n_nationkey AS node, avg(CAST(c_acctbal AS DOUBLE)) AS balance, CAST(count(*) AS DOUBLE) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
 lo AS (SELECT region, node, k.degree_metric, m.metric, CASE k.degree_metric WHEN 'in_degree' THEN in_degree WHEN 'out_degree' THEN out_degree ELSE degree END AS x, CASE m.metric WHEN 'balance' THEN balance ELSE customers END AS y FROM st LEFT JOIN dg USING (node), (SELECT unnest(['in_degree', 'out_degree', 'degree']) AS degree_metric) k, (SELECT unnest(['balance', 'customers']) AS metric) m)
 SELECT region, degree_metric, metric, round(CASE WHEN count(x) >= 3 AND stddev_pop(x) > 1e-8 AND stddev_pop(y) > 1e-8 THEN covar_pop(x, y) / stddev_pop(x) / stddev_pop(y) END, 6) AS corr, count(DISTINCT node) AS n FROM lo GROUP BY 1, 2, 3""")
def degree_statistic_correlations(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    st = c.groupBy(F.col("n_regionkey").alias("region"), F.col("n_nationkey").cast("long").alias("node")).agg(F.avg(F.col("c_acctbal").cast("double")).alias("balance"), F.count("*").cast("double").alias("customers"))
    return S.degree_correlations(st, G.degrees(sparse(spark, d)), ["region"], ["balance", "customers"]).withColumn("corr", R("corr"))


@query("""WITH m AS (SELECT s_suppkey AS node, unnest(['A', 'N', 'R']) AS turn, s_acctbal > 0 AS pos FROM supplier), k AS (SELECT node, turn, pos AND turn <> 'R' AS observed FROM m), v AS (SELECT l_suppkey AS node, l_returnflag AS turn, CAST(l_quantity AS DOUBLE) AS value FROM lineitem WHERE l_linestatus = 'F'),
 a AS (SELECT node, turn, avg(value) AS a FROM v JOIN k USING (node, turn) WHERE observed GROUP BY 1, 2), b AS (SELECT turn, avg(value) AS b FROM v JOIN k USING (node, turn) WHERE observed GROUP BY 1), c AS (SELECT turn, avg(value) AS c FROM v GROUP BY 1)
 SELECT node, turn, observed, round(coalesce(a, b, c), 6) AS pred, CASE WHEN a IS NOT NULL THEN 'node' WHEN b IS NOT NULL THEN 'observed' WHEN c IS NOT NULL THEN 'turn' END AS source FROM k LEFT JOIN a USING (node, turn) LEFT JOIN b USING (turn) LEFT JOIN c USING (turn)""")
def means_by_turn(spark, d):
    turn = F.explode(F.array(*map(F.lit, "ANR")))
    mask = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), turn.alias("turn"), (F.col("s_acctbal") > 0).alias("pos")).select("node", "turn", (F.col("pos") & (F.col("turn") != "R")).alias("observed"))
    train = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("node"), F.col("l_returnflag").alias("turn"), F.col("l_quantity").cast("double").alias("value"))
    return C.mean_by_turn(train, mask).withColumn("pred", R("pred"))
