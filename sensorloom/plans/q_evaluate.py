"""Queries over evaluation: peaks, categories, effect sizes, patches, strata and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import evaluate as E
from sensorloom.operators import graph as G
from sensorloom.plans.fixtures import COUNTS_SQL, FACTS_SQL, HOURS_SQL, counts, hours, predictions
from sensorloom.plans.q_graph import SPARSE, sparse
from sensorloom.plans.registry import query, table

R = lambda c, n=6: F.round(c, n)


@query("""WITH x AS (SELECT event_type, CASE WHEN value > 50 THEN 1 ELSE 0 END AS target, CASE WHEN user_id % 3 = 0 THEN NULL WHEN value > 60 THEN 1 ELSE 0 END AS pred FROM events)
 SELECT event_type, round(avg(CASE WHEN pred IS NOT NULL THEN CAST(pred = target AS DOUBLE) END), 6) AS accuracy, count(*) FILTER (target <> 0) AS weight FROM x GROUP BY 1""")
def class_accuracy(spark, d):
    x = table(spark, d, "events").select("event_type", F.when(F.col("value") > 50, 1).otherwise(0).alias("target"), F.when(F.col("user_id") % 3 == 0, None).when(F.col("value") > 60, 1).otherwise(0).alias("pred"))
    return x.groupBy("event_type").agg(R(E.accuracy(F.col("pred"), F.col("target"))).alias("accuracy"), E.metric_weight(F.col("target"), 0.0).alias("weight"))


@query(COUNTS_SQL + """, q AS (SELECT node, quantile_cont(value, 0.9) AS q FROM panel GROUP BY 1), k AS (SELECT node, t, value >= q AS source, lag(value, 1) OVER (PARTITION BY node ORDER BY t) >= q AS target FROM panel JOIN q USING (node)),
 l AS (SELECT a.node, a.t, min(abs(a.t - b.t)) AS l FROM k a LEFT JOIN k b ON b.node = a.node AND b.target AND abs(a.t - b.t) <= 3 WHERE a.source GROUP BY 1, 2)
 SELECT node, count(*) AS peaks, count(l) AS matched, round(avg(l), 6) AS mean_lag, round(count(l) / count(*), 6) AS match_rate FROM l GROUP BY 1""")
def peak_lags(spark, d):
    p = counts(spark, d)
    q = p.groupBy("node").agg(F.percentile("value", F.lit(0.9)).alias("q"))
    k = p.join(q, "node").select("node", "t", (F.col("value") >= F.col("q")).alias("source"), F.coalesce(F.lag("value", 1).over(Window.partitionBy("node").orderBy("t")) >= F.col("q"), F.lit(False)).alias("target"))
    return E.nearest_peak_lag(k, 3).select("node", "peaks", "matched", R("mean_lag").alias("mean_lag"), R("match_rate").alias("match_rate"))


@query(FACTS_SQL + """, x AS (SELECT *, abs(pred - target) AS e, target > 60 AS high, horizon = 3 AS far FROM facts WHERE pred IS NOT NULL AND target IS NOT NULL),
 u AS (SELECT 'high' AS category, high AS c, * FROM x UNION ALL SELECT 'far', far, * FROM x)
 SELECT system, category, count(*) FILTER (c) AS n, round(count(*) FILTER (c) / count(*), 6) AS share, round(avg(e) FILTER (c), 6) AS mae, round(sqrt(avg(e * e) FILTER (c)), 6) AS rmse, round(avg(e) FILTER (NOT c), 6) AS mae_without, round(avg(e) FILTER (NOT c) - avg(e), 6) AS mae_change FROM u GROUP BY 1, 2""")
def anomaly_impact(spark, d):
    c = E.category_impact(predictions(spark, d), {"high": F.col("target") > 60, "far": F.col("horizon") == 3}, ["system"])
    return c.select("system", "category", "n", *[R(x).alias(x) for x in ("share", "mae", "rmse", "mae_without", "mae_change")])


@query("""WITH x AS (SELECT o_orderpriority AS p, o_totalprice AS v, o_orderstatus = 'F' AS a FROM orders), s AS (SELECT p, count(v) FILTER (a) AS n_a, count(v) FILTER (NOT a) AS n_b, avg(v) FILTER (a) - avg(v) FILTER (NOT a) AS difference, var_samp(v) FILTER (a) AS va, var_samp(v) FILTER (NOT a) AS vb FROM x GROUP BY 1)
 SELECT p, n_a, n_b, round(difference, 4) AS difference, round(difference / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) AS d FROM s""")
def effect_sizes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") == "F").alias("a"))
    return E.cohen_d(o, "v", "a", ["p"]).select("p", "n_a", "n_b", R("difference", 4).alias("difference"), R("d").alias("d"))


@query()
def bootstrap_interval(spark, d):
    """Interval of a mean difference over 50 resamplings; tests check coverage and the weights' distribution."""
    o = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v"), (F.col("c_mktsegment") == "BUILDING").alias("a"))
    return E.bootstrap_difference(o, "c_custkey", "v", "a", 50)


_RAMP = """, dd AS (SELECT node, t, value, abs(value - lag(value) OVER w) AS d, max(value) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS top FROM panel WINDOW w AS (PARTITION BY node ORDER BY t)),
 qs AS (SELECT node, quantile_cont(d, 0.8) AS q FROM dd WHERE t < 432 GROUP BY 1), ph AS (SELECT node, t % 24 AS ph, quantile_cont(value, 0.1) AS q10 FROM panel WHERE t < 432 GROUP BY 1, 2)"""


@query(COUNTS_SQL + _RAMP + """ SELECT dd.node, t, coalesce(d >= q, false) AS ramp, coalesce(value < 0.5 * top, false) AS "drop", coalesce(value < q10, false) AS low FROM dd JOIN qs USING (node) LEFT JOIN ph ON ph.node = dd.node AND ph.ph = t % 24""")
def condition_masks(spark, d):
    p = E.contextual_low(E.recent_drop(E.ramp_mask(counts(spark, d), 0.8, 432), 6, 0.5), 24, 0.1, 432)
    return p.select("node", "t", "ramp", "drop", "low")


_PATCH = """, nd AS (SELECT node, row_number() OVER (ORDER BY node) AS r FROM (SELECT DISTINCT node FROM facts)), nr AS (SELECT a.node, b.node AS nb FROM nd a JOIN nd b ON abs(a.r - b.r) <= 1),
 c AS (SELECT f.system, f.horizon, f.node, f.t // 6 AS patch, nr.nb, CAST(s AS INTEGER) AS shift, avg(abs(p.pred - f.target)) AS e, count(abs(p.pred - f.target)) AS n FROM facts f JOIN nr ON nr.node = f.node CROSS JOIN unnest(range(-2, 3)) AS u(s)
 JOIN facts p ON p.system = f.system AND p.horizon = f.horizon AND p.node = nr.nb AND p.t = f.t + s GROUP BY ALL), k AS (SELECT *, round(e, 9) AS re FROM c WHERE n = 6),
 x AS (SELECT system, horizon, node, patch, min(e) FILTER (nb = node AND shift = 0) AS exact, min(e) FILTER (shift = 0) AS neighbour FROM k GROUP BY ALL),
 bp AS (SELECT system, horizon, node, patch, re, shift FROM k QUALIFY row_number() OVER (PARTITION BY system, horizon, node, patch ORDER BY re, abs(shift), shift) = 1)"""


@query(FACTS_SQL + _PATCH + " SELECT system, horizon, node, patch, round(exact, 6) AS exact, round(neighbour, 6) AS neighbour, round(re, 6) AS shifted, shift FROM x JOIN bp USING (system, horizon, node, patch) WHERE exact IS NOT NULL")
def patch_space_time_shift(spark, d):
    f = predictions(spark, d)
    line = f.select("node").distinct().select(F.col("node").alias("src"), F.lead("node").over(Window.orderBy("node")).alias("dst")).where("dst IS NOT NULL")
    p = E.patch_shift(f, G.reach(line, 1, directed=False), ["system", "horizon"], 1, 6, 2)
    return p.select("system", "horizon", "node", "patch", R("exact").alias("exact"), R("neighbour").alias("neighbour"), R("shifted").alias("shifted"), "shift")


@query("""SELECT event_type, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST((hour(ts) * 60 + minute(ts)) // 60 AS INTEGER) AS slot, round(sum(value), 4) AS total, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2, 3""")
def weekday_slot_profile(spark, d):
    """Profiles of two halves of the events, merged."""
    e = table(spark, d, "events")
    halves = [E.slot_profile(e.where(F.col("event_id") % 2 == k), ["event_type"], F.col("ts"), 60, "value") for k in (0, 1)]
    m = E.merge_profiles(halves[0].unionByName(halves[1]), ["event_type"])
    return m.select("event_type", "weekday", "slot", R("total", 4).alias("total"), "n", R("mean").alias("mean"))


@query(COUNTS_SQL + ", s AS (SELECT node, t % 24 AS slot, avg(value) AS v FROM panel GROUP BY 1, 2) SELECT node, list(round(v, 6) ORDER BY slot) AS profile FROM s GROUP BY 1")
def daily_profile(spark, d):
    return E.daily_profiles(counts(spark, d), 24).withColumn("profile", F.transform("profile", lambda x: F.round(x, 6)))


@query(HOURS_SQL + """, p AS (SELECT node, t // 24 AS day, t % 24 AS slot, value FROM panel) SELECT node, day, slot, round(value, 6) AS value, round(avg(value) OVER w, 6) AS expected, count(value) OVER w AS n FROM p WINDOW w AS (PARTITION BY node, slot ORDER BY day RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)""")
def rolling_eight_days(spark, d):
    return E.rolling_profile(hours(spark, d), 24, 8).withColumn("value", R("value")).withColumn("expected", R("expected"))


@query("""WITH s AS (SELECT l_suppkey, l_returnflag AS f, avg(l_quantity) AS q, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2) SELECT s_nationkey, f, count(*) AS sensors, round(avg(q), 6) AS q, round(avg(s), 4) AS s FROM s JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""")
def means_by_group(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("f")).agg(F.avg("l_quantity").alias("q"), F.stddev_samp("l_extendedprice").alias("s"))
    j = per.join(table(spark, d, "supplier"), per.l_suppkey == F.col("s_suppkey"))
    return E.group_means(j, ["s_nationkey", "f"], ["q", "s"]).select("s_nationkey", "f", "sensors", R("q").alias("q"), R("s", 4).alias("s"))


@query(SPARSE + """, dg AS (SELECT node, count(DISTINCT x) AS degree FROM (SELECT src AS node, dst AS x FROM e UNION ALL SELECT dst, src FROM e) GROUP BY 1), st AS (SELECT node, CAST(ntile(4) OVER (ORDER BY degree, node) - 1 AS INTEGER) AS stratum FROM dg),
 ft AS (SELECT CAST(c_nationkey AS BIGINT) AS node, c_acctbal AS target, m.model, c_acctbal * m.k AS pred FROM customer, (VALUES ('a', 1.1), ('b', 0.8)) m(model, k)),
 er AS (SELECT model, stratum, count(*) AS n, avg(abs(pred - target)) AS mae FROM ft JOIN st USING (node) GROUP BY 1, 2) SELECT er.model, er.stratum, er.n, round(er.mae, 4) AS mae, round(er.mae - b.mae, 4) AS delta FROM er LEFT JOIN er b ON b.stratum = er.stratum AND b.model = 'a'""")
def errors_by_degree_stratum(spark, d):
    st = E.degree_strata(G.degrees(sparse(spark, d)).select("node", "degree"), 4)
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("node"), F.col("c_acctbal").alias("target"))
    facts = c.withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("pred", F.col("target") * F.when(F.col("model") == "a", 1.1).otherwise(0.8))
    return E.strata_errors(facts, st, "model", "a").select("model", "stratum", "n", R("mae", 4).alias("mae"), R("delta", 4).alias("delta"))
