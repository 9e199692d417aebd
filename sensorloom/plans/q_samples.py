"""Queries over samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import samples as S
from sensorloom.operators.windows import sliding
from sensorloom.plans.fixtures import COUNTS_SQL, counts
from sensorloom.plans.registry import query, table

R = lambda c, n=6: F.round(c, n)


@query("""SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) IN (3, 4)""")
def months_of_a_year(spark, d):
    return table(spark, d, "orders").where(S.in_months(F.col("o_orderdate"), 1995, [3, 4])).select("o_orderkey")


@query("SELECT event_id FROM events WHERE hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) BETWEEN 25200 AND 32399")
def morning_events(spark, d):
    return table(spark, d, "events").where(S.in_time_of_day(F.col("ts"), 7 * 3600, 9 * 3600)).select("event_id")


@query("SELECT p_partkey, CAST(least(greatest(round_even(p_size / 50.0 * 7 - 0.2, 0), 0), 6) AS INTEGER) AS code FROM part")
def weekday_codes(spark, d):
    return table(spark, d, "part").select("p_partkey", S.weekday_code(F.col("p_size") / 50.0 - 0.2 / 7).alias("code"))


@query("""WITH s AS (SELECT range AS t FROM range(720)), r AS (SELECT * FROM (VALUES ('train', 0, 432), ('train_recent', 264, 432), ('valid', 432, 576), ('test', 576, 720)) v(label, a, b)) SELECT label, count(*) AS n, min(t) AS first, max(t) AS last FROM s JOIN r ON t >= a AND t < b GROUP BY 1""")
def recent_days_split(spark, d):
    p = counts(spark, d).select("t").distinct()
    x = p.withColumn("label", F.explode(S.label_ranges(F.col("t"), S.last_days_split(720, 7, 24, 0.6, 0.2))))
    return x.groupBy("label").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("""WITH d AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)), s AS (SELECT *, CASE WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.6) + floor(n * 0.2) THEN 'valid' ELSE 'test' END AS split FROM d)
 SELECT day, split FROM s WHERE split <> 'train' OR k > floor(n * 0.6) - 10""")
def whole_day_split(spark, d):
    return S.day_split(table(spark, d, "events").select(F.to_date("ts").alias("day")), 0.6, 0.2, 10)


@query(COUNTS_SQL + """, w AS (SELECT node, t, list(value) OVER x AS past, list(t % 24 / 24) OVER x AS tod FROM panel WINDOW x AS (PARTITION BY node ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) SELECT node, t, past, list_transform(tod, lambda z: round(z, 6)) AS tod FROM w WHERE t BETWEEN 5 AND 716""")
def late_step_features(spark, d):
    """Six past counts with the time of day of their steps, joined after windows are made."""
    p = counts(spark, d)
    f = p.select("t").distinct().withColumn("tod", F.round(F.col("t") % 24 / 24, 6))
    return S.with_step_features(sliding(p, 6, 3), f, ["tod"], 6).select("node", "t", "past", "tod")


@query(COUNTS_SQL + """, w AS (SELECT node, t // 24 AS day, t % 24 AS start, list(value) OVER (x ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS past, list(value) OVER (x ROWS BETWEEN 6 FOLLOWING AND 8 FOLLOWING) AS future FROM panel WINDOW x AS (PARTITION BY node, t // 24 ORDER BY t)) SELECT * FROM w WHERE len(past) = 6 AND len(future) = 3""")
def samples_within_days(spark, d):
    return S.day_samples(counts(spark, d), 24, 6, 3)


@query(COUNTS_SQL + """, s AS (SELECT 'train_prefix' AS w, 0 AS a, 432 AS b, NULL::INTEGER AS weekday UNION ALL SELECT 'month_' || k, k * 240, (k + 1) * 240, NULL FROM range(3) r(k) UNION ALL SELECT 'week_' || k // 7 || '_day_' || (k + 2) % 7, k * 24, (k + 1) * 24, CAST((k + 2) % 7 AS INTEGER) FROM range(30) r(k))
 SELECT w AS "window", weekday, node, count(*) AS n, round(avg(value), 6) AS mean FROM panel JOIN s ON t >= a AND t < b GROUP BY ALL""")
def audit_windows(spark, d):
    w = S.in_windows(counts(spark, d), S.window_specs(720, 24, 0.6, 10, 2))
    return w.groupBy("window", "weekday", "node").agg(F.count("*").alias("n"), R(F.avg("value")).alias("mean"))


@query(COUNTS_SQL + """, bn AS (SELECT node, CAST(ntile(2) OVER (ORDER BY node) - 1 AS INTEGER) AS bin FROM (SELECT DISTINCT node FROM panel)), c AS (SELECT p.node, p.t, q.t - p.t + 3 AS step, q.value AS x, bin FROM panel p JOIN panel q ON q.node = p.node AND q.t BETWEEN p.t - 3 AND p.t JOIN bn ON bn.node = p.node WHERE p.t BETWEEN 3 AND 718),
 a AS (SELECT t, 0 AS kind, step AS i, avg(x) AS m, stddev_pop(x) AS s FROM c GROUP BY ALL UNION ALL SELECT t, 2, bin, avg(x), stddev_pop(x) FROM c GROUP BY ALL), r AS (SELECT t, kind, i, m AS x FROM a UNION ALL SELECT t, kind + 1, i, s FROM a),
 z AS (SELECT t, kind, i, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 5) AS z FROM r WINDOW w AS (PARTITION BY kind, i)) SELECT t, list(z ORDER BY kind, i) AS v FROM z GROUP BY 1""")
def window_embedding(spark, d):
    p = counts(spark, d)
    e = S.window_embeddings(sliding(p, 4, 1).select("node", "t", "past"), S.node_bins(p.select("node"), 2))
    return e.withColumn("v", F.transform("v", lambda x: F.round(x, 5)))


@query(COUNTS_SQL + """, w AS (SELECT node, t, list(value) OVER x AS past, list(t % 24 / 24 - 0.5) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS m FROM panel WINDOW x AS (PARTITION BY node ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
 SELECT node, t, list_concat(past[3:4], [0.0, 0.0]) AS dec, list_transform(m[1:4], lambda z: round(z, 6)) AS enc_tod, list_transform(m[3:6], lambda z: round(z, 6)) AS dec_tod FROM w WHERE t BETWEEN 3 AND 717""")
def encoder_decoder_inputs(spark, d):
    p = counts(spark, d)
    mark = F.transform(F.sequence(F.col("t") - 3, F.col("t") + 2), lambda s: s % 24 / 24)
    w = S.decoder_inputs(sliding(p, 4, 2).withColumn("tod", mark), 2, 2, ["tod"], 4)
    six = lambda c: F.transform(c, lambda x: F.round(x, 6)).alias(c)
    return w.select("node", "t", "dec", six("enc_tod"), six("dec_tod"))


@query("""SELECT unnest(['missing', 'unlisted']) AS status, unnest([1, 1])::BIGINT AS n""")
def ordered_columns(spark, d):
    """A wide count frame in the order of a catalog that lacks one column and names one too many."""
    wide = counts(spark, d).groupBy("t").pivot("node", ["click", "error", "purchase", "signup", "view"]).agg(F.first("value"))
    order = spark.createDataFrame([("view", 0), ("click", 1), ("ghost", 2), ("error", 3), ("purchase", 4)], "id string, pos int")
    frame, missing = S.align_columns(wide, order, "t")
    assert frame.columns == ["t", "view", "click", "error", "purchase"]
    return missing.groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey % 7 AS sample, CAST(o_custkey AS VARCHAR) || '.0' AS node, CASE WHEN o_custkey % 2 = 0 THEN o_custkey // 2 END AS pos FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def sample_positions(spark, d):
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select((F.col("o_orderkey") % 7).alias("sample"), F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("node"))
    order = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 2).alias("pos"))
    return S.resolve_positions(o, order)
