"""Queries over panels: grids, calendar, resampling, splits, gaps and scaling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import impute as I
from sensorloom.operators import panel as P
from sensorloom.operators import scale as S
from sensorloom.plans.fixtures import COUNTS_SQL, CUTS, HOURS_SQL, counts, hours
from sensorloom.plans.registry import query, table

R = lambda c, n=8: F.round(c, n)


@query(HOURS_SQL + " SELECT node, t, round(value, 8) AS value FROM panel")
def panel_dense(spark, d):
    return hours(spark, d).select("node", "t", R("value").alias("value"))


@query(HOURS_SQL + """ SELECT node, t, round((hour(ts) * 60 + minute(ts)) / 1440, 8) AS tod, round((isodow(ts) - 1) / 7, 8) AS dow,
 round((day(ts) - 1) / 31, 8) AS dom, round((dayofyear(ts) - 1) / 366, 8) AS doy, round(month(ts) / 12, 8) AS moy, CAST((dayofyear(ts) - 1) // 7 AS BIGINT) AS week_in_year FROM panel""")
def calendar_features(spark, d):
    p = hours(spark, d)
    return p.select("node", "t", *[(R(c) if k != "week_in_year" else c).alias(k) for k, c in P.calendar().items()])


@query("""SELECT event_id, round((epoch(ts)::BIGINT_FLOOR % 86400) / 86400, 7) AS tod FROM events""".replace("epoch(ts)::BIGINT_FLOOR", "CAST(floor(epoch(ts)) AS BIGINT)").replace(" AS tod", " AS tod, round(((CAST(floor(epoch(ts)) AS BIGINT) // 86400 + 3) % 7) / 7, 8) AS dow, CAST((CAST(floor(epoch(ts)) AS BIGINT) % 86400) // 900 AS INTEGER) AS slot"))
def epoch_features(spark, d):
    e = table(spark, d, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    f = P.epoch_features(seconds)
    return e.select("event_id", R(f["tod"], 7).alias("tod"), R(f["dow"]).alias("dow"), P.slot(F.col("ts"), 15).alias("slot"))


@query(HOURS_SQL + """ SELECT node, t, round(sin(2 * pi() * (t % 24) / 24), 8) AS s, round(cos(2 * pi() * (t % 24) / 24), 8) AS c,
 CAST(isodow(ts) = 1 AS INTEGER) AS dow_0, CAST(isodow(ts) = 6 AS INTEGER) AS dow_5, CAST(dense_rank() OVER (ORDER BY node) - 1 AS INTEGER) AS code,
 round((t % 24) / 23, 8) AS slot_scaled FROM panel""")
def cyclic_and_one_hot(spark, d):
    p = P.encode(hours(spark, d), "node", "code")
    s, c = P.cyclic(F.pmod("t", F.lit(24)), 24)
    return p.select("node", "t", R(s).alias("s"), R(c).alias("c"), *P.one_hot(F.weekday("ts"), [0, 5], "dow"), "code", R(F.pmod("t", F.lit(24)) / 23).alias("slot_scaled"))


@query(HOURS_SQL + ", st AS (SELECT date_diff('second', lag(ts) OVER (PARTITION BY node ORDER BY ts), ts) / 60.0 AS m FROM panel) SELECT CAST(median(m) AS DOUBLE) AS minutes FROM st WHERE m > 0")
def frequency_minutes(spark, d):
    return P.infer_minutes(hours(spark, d))


_BUCKET = " SELECT node, t // 6 AS t, round({f}(value), 8) AS value, count(*) AS n FROM panel GROUP BY 1, 2"


@query(HOURS_SQL + _BUCKET.format(f="avg"))
def resample_mean(spark, d):
    return P.resample(hours(spark, d), 6).withColumn("value", R("value"))


@query(COUNTS_SQL + " SELECT node, t // 7 AS t, round(sum(value), 8) AS value, count(*) AS n FROM panel GROUP BY 1, 2 HAVING count(*) = 7")
def resample_sum_complete(spark, d):
    return P.resample(counts(spark, d), 7, "sum", complete=True).withColumn("value", R("value"))


_SPLIT = HOURS_SQL + """, sp AS (SELECT DISTINCT t, CASE WHEN t < 430 THEN 'train' WHEN t < 577 THEN 'valid' WHEN t < 700 THEN 'test' END AS split FROM panel),
bk AS (SELECT t // 4 AS bucket, max(split) AS split FROM sp GROUP BY 1 HAVING count(DISTINCT split) = 1 AND count(split) = 4),
num AS (SELECT bucket, split, row_number() OVER (ORDER BY bucket) - 1 AS t FROM bk)
SELECT p.node, num.t, num.bucket, num.split, round({f}(p.value), 8) AS value FROM panel p JOIN num ON p.t // 4 = num.bucket GROUP BY ALL"""


def _resample_split(spark, d, how):
    p = hours(spark, d)
    t = F.col("t")
    sp = p.select("t").distinct().withColumn("split", F.when(t < 430, "train").when(t < 577, "valid").when(t < 700, "test"))
    return P.resample_split(p, sp, 4, how).withColumn("value", R("value"))


@query(_SPLIT.format(f="avg"))
def resample_split_mean(spark, d):
    return _resample_split(spark, d, "mean")


@query(_SPLIT.format(f="sum"))
def resample_split_sum(spark, d):
    return _resample_split(spark, d, "sum")


@query(HOURS_SQL + " SELECT node, t // 3 AS t, coalesce(round_even(avg(value), 0), 0) AS value FROM panel GROUP BY 1, 2")
def resample_round_fill(spark, d):
    return P.resample(hours(spark, d), 3).select("node", "t", F.coalesce(F.rint("value"), F.lit(0.0)).alias("value"))


@query(COUNTS_SQL + """ SELECT node, CAST(f AS INTEGER) AS factor, round(avg(CAST(v = 0 AS DOUBLE)), 8) AS zero_rate, round(avg(v), 8) AS mean FROM
 (SELECT node, f, t // f AS b, sum(value) AS v FROM panel, unnest([1, 3, 6, 12]) AS u(f) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def multi_resolution_zeros(spark, d):
    x = counts(spark, d).select("node", "t", "value", F.explode(F.array(*map(F.lit, (1, 3, 6, 12)))).alias("factor"))
    s = x.groupBy("node", "factor", F.floor(F.col("t") / F.col("factor")).alias("b")).agg(F.sum("value").alias("v"))
    return s.groupBy("node", "factor").agg(R(F.avg((F.col("v") == 0).cast("double"))).alias("zero_rate"), R(F.avg("v")).alias("mean"))


@query(HOURS_SQL + """ SELECT node, CASE WHEN t < 432 THEN 'train' WHEN t < 576 THEN 'valid' ELSE 'test' END AS split, count(*) AS steps, count(value) AS known FROM panel GROUP BY 1, 2""")
def chronological_split(spark, d):
    cuts = P.ratio_split(720, 0.2, 0.2)
    return hours(spark, d).groupBy("node", P.label_split(F.col("t"), cuts).alias("split")).agg(F.count("*").alias("steps"), F.count("value").alias("known"))


@query(HOURS_SQL + """ SELECT CASE WHEN t < 432 THEN 'train' WHEN t < 576 THEN 'valid' ELSE 'test' END AS split, min(t) AS first, max(t) AS last FROM panel WHERE t >= 384 GROUP BY 1""")
def recent_train_split(spark, d):
    s = P.recent_train(F.col("t"), CUTS, 48)
    return hours(spark, d).withColumn("split", s).where("split is not null").groupBy("split").agg(F.min("t").alias("first"), F.max("t").alias("last"))


@query(HOURS_SQL + " SELECT node, t, round(value, 8) AS value FROM panel WHERE t BETWEEN 48 AND 119")
def day_window(spark, d):
    return P.day_window(hours(spark, d), 24, 2, 3).select("node", "t", R("value").alias("value"))


@query(HOURS_SQL + """, f AS (SELECT min(t) AS a, max(t) AS z FROM (SELECT t FROM panel GROUP BY t HAVING count(*) = count(value)))
 SELECT node, t, round(value, 8) AS value FROM panel, f WHERE t BETWEEN a AND z AND t % 5 = 0""")
def trim_and_subsample(spark, d):
    return P.every_kth(P.trim_null_edges(hours(spark, d)), 5).select("node", "t", R("value").alias("value"))


@query(HOURS_SQL + " SELECT node, t, round(value, 8) AS value FROM panel WHERE t IN (SELECT CAST(floor(k * 719 / 9) AS BIGINT) FROM range(10) u(k))")
def evenly_spaced_steps(spark, d):
    return P.evenly_spaced(hours(spark, d), 720, 10).select("node", "t", R("value").alias("value"))


@query(COUNTS_SQL + """ SELECT node, t, value FROM panel WHERE node IN (SELECT node FROM panel WHERE t < 432 AND value > 2 GROUP BY node HAVING count(*) >= 150)""")
def node_activity_filter(spark, d):
    return P.active_nodes(counts(spark, d), "train_support", 432, eps=2.0, support=150).select("node", "t", "value")


_NEAR = """, w AS (SELECT node, t, value, last_value(value IGNORE NULLS) OVER a AS v0, first_value(value IGNORE NULLS) OVER z AS v1,
 last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t0, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER z AS t1 FROM panel
 WINDOW a AS (PARTITION BY node ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY node ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(HOURS_SQL + _NEAR + " SELECT node, t, round(coalesce(v0, v1, 0), 8) AS filled FROM w")
def fill_forward_backward(spark, d):
    return I.fill_both(hours(spark, d)).select("node", "t", R("filled").alias("filled"))


@query(HOURS_SQL + _NEAR + " SELECT node, t, round(coalesce(value, v0 + (v1 - v0) * (t - t0) / (t1 - t0), v0, v1), 8) AS filled FROM w")
def fill_linear(spark, d):
    return I.interpolate(hours(spark, d)).select("node", "t", R("filled").alias("filled"))


@query(HOURS_SQL + """, z AS (SELECT node, t, CASE WHEN node = 'error' THEN NULL ELSE value END AS v FROM panel), m AS (SELECT node, t, CASE WHEN node = 'error' THEN avg(v) OVER (PARTITION BY t) ELSE v END AS value FROM z)
 SELECT node, t, round(coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY node ORDER BY t ROWS UNBOUNDED PRECEDING),
 first_value(value IGNORE NULLS) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS filled FROM m""")
def fill_previous_or_row_mean(spark, d):
    p = hours(spark, d).withColumn("value", F.when(F.col("node") != "error", F.col("value")))
    return I.fill_previous(p).select("node", "t", R("filled").alias("filled"))


@query(HOURS_SQL + " SELECT node, t, round(coalesce(value, avg(value) OVER (PARTITION BY node), 0), 8) AS filled FROM panel")
def fill_node_mean(spark, d):
    return I.fill_mean(hours(spark, d)).select("node", "t", R("filled").alias("filled"))


@query(HOURS_SQL + " SELECT count(*) FILTER (value IS NULL) AS nulls_before, count(*) FILTER (coalesce(value, 0) IS NULL) AS nulls_after, round(count(*) FILTER (value IS NULL) / count(*), 8) AS filled_ratio FROM panel")
def fill_constant_audit(spark, d):
    p = I.fill_constant(hours(spark, d), 0.0)
    nulls = F.count_if(F.col("value").isNull())
    return p.agg(nulls.alias("nulls_before"), F.count_if(F.col("filled").isNull()).alias("nulls_after"), R(nulls / F.count("*")).alias("filled_ratio"))


@query("""WITH x AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN ' ' ELSE o_orderpriority END AS prio, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS price FROM orders)
 SELECT 'prio' AS field, count(*) - count(prio) AS nulls, round(100 * (count(*) - count(prio)) / count(*), 2) AS null_pct, count(prio) AS present, count(*) FILTER (trim(prio) = '') AS blank,
 round(100 * (count(prio) - count(*) FILTER (trim(prio) = '')) / count(*), 2) AS valid_pct FROM x
 UNION ALL SELECT 'price', count(*) - count(price), round(100 * (count(*) - count(price)) / count(*), 2), count(price), 0, round(100 * count(price) / count(*), 2) FROM x""")
def missing_value_report(spark, d):
    k = F.col("o_orderkey") % 7
    x = table(spark, d, "orders").select(F.when(k == 0, None).when(k == 1, " ").otherwise(F.col("o_orderpriority")).alias("prio"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("price"))
    return I.gap_report(x, ["prio", "price"])


def _scaled(kind, by, sql_center, sql_spread, zero="CASE WHEN s = 0 THEN 1 ELSE s END"):
    group = "GROUP BY node" if by else ""
    key = "node, " if by else ""
    on = "JOIN f USING (node)" if by else "CROSS JOIN f"
    sql = HOURS_SQL + f""", f0 AS (SELECT {key}{sql_center} AS c, {sql_spread} AS s FROM panel WHERE t < 432 {group}), f AS (SELECT {key}c, {zero} AS s FROM f0)
 SELECT node, t, round((value - c) / s, 8) AS scaled, round((value - c) / s * s + c, 5) AS value_back FROM panel {on}"""

    def run(spark, d):
        p = hours(spark, d)
        fitted = S.fit(p.where("t < 432"), kind, by)
        return S.invert(S.apply(p, fitted, by), fitted, by).select("node", "t", R("scaled").alias("scaled"), R("value_back", 5).alias("value_back"))

    query(sql, name=f"scale_{kind}_{'node' if by else 'global'}")(run)


_scaled("z", ["node"], "avg(value)", "stddev_pop(value)")
_scaled("z", [], "avg(value)", "stddev_pop(value)")
_scaled("sample_z", ["node"], "avg(value)", "stddev_samp(value)")
_scaled("minmax", ["node"], "min(value)", "max(value) - min(value)")
_scaled("minmax_raw", [], "min(value)", "max(value) - min(value)", "s")
_scaled("robust", ["node"], "quantile_cont(value, 0.5)", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)")


@query(HOURS_SQL + """, pr AS (SELECT node, t // 24 AS day, t, value FROM panel) SELECT node, t, round((value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-6), 8) AS shape FROM pr WINDOW w AS (PARTITION BY node, day)""")
def scale_daily_shape(spark, d):
    p = hours(spark, d).withColumn("day", F.floor(F.col("t") / 24))
    return S.shape_z(p, ["node", "day"]).select("node", "t", R("shape").alias("shape"))


@query(HOURS_SQL + """, k AS (SELECT node, quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM panel WHERE t < 432 GROUP BY node),
 x AS (SELECT node, t, value, q, greatest(least(len(list_filter(q, lambda a: a <= value)), 10), 1) AS r, greatest(least(len(list_filter(q, lambda a: a < value)), 10), 1) AS l FROM panel JOIN k USING (node))
 SELECT node, t, round(CASE WHEN value IS NULL THEN NULL WHEN value <= q[1] THEN 0 WHEN value >= q[11] THEN 1 ELSE
 (r - 1 + coalesce((value - q[r]) / nullif(q[r + 1] - q[r], 0), 0) + l - 1 + coalesce((value - q[l]) / nullif(q[l + 1] - q[l], 0), 0)) / 20 END, 8) AS uniform FROM x""")
def quantile_transform(spark, d):
    p = hours(spark, d)
    return S.quantile_transform(p, S.quantile_knots(p.where("t < 432"), ["node"], 11), ["node"]).select("node", "t", R("uniform").alias("uniform"))


@query(HOURS_SQL + """, q AS (SELECT node, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM panel GROUP BY node)
 SELECT node, round(a - 1.5 * (b - a), 8) AS low, round(b + 1.5 * (b - a), 8) AS high, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers, count(value) AS n FROM panel JOIN q USING (node) GROUP BY ALL""")
def outliers_iqr(spark, d):
    return S.outlier_bounds(hours(spark, d), ["node"]).select("node", R("low").alias("low"), R("high").alias("high"), "outliers", "n")


@query(HOURS_SQL + """, f AS (SELECT avg(value) AS c, stddev_pop(value) AS s FROM panel WHERE t <= 12 + 3 - 1 + CAST(floor(0.6 * (720 - 14)) AS BIGINT) - 1), s2 AS (SELECT avg(value) AS c2 FROM panel WHERE t < 424 - 12)
 SELECT round(c, 8) AS center, round(s, 8) AS spread, round(c2, 8) AS prefix_center FROM f, s2""")
def scale_by_windows(spark, d):
    """Statistics up to the end of the last training window, and of a prefix without the last history."""
    p = hours(spark, d)
    last = 12 + 3 - 1 + int(0.6 * (720 - 14)) - 1
    a = S.fit(p.where(F.col("t") <= last), "z", [])
    train, _, _ = P.window_split(720, 12, 3, 0.6, 0.2)
    b = p.where(F.col("t") < train + 0 - 12).agg(F.avg("value").alias("prefix_center"))
    return a.crossJoin(b).select(R("center").alias("center"), R("spread").alias("spread"), R("prefix_center").alias("prefix_center"))


@query(HOURS_SQL + """, r AS (SELECT node, t, round_even(t / 4, 0) * 4 AS b, value FROM panel), m AS (SELECT node, b, avg(value) AS v FROM r GROUP BY 1, 2), n AS (SELECT node, b, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS v FROM m WINDOW w AS (PARTITION BY node))
 SELECT node, CAST(b AS BIGINT) AS t, round(coalesce(v, 0), 8) AS value FROM n WHERE b BETWEEN 48 AND 480""")
def series_preprocessing(spark, d):
    """Round steps to the resolution (half to even), mean, min-max per node, period filter, scrub."""
    m = hours(spark, d).withColumn("b", F.rint(F.col("t") / 4) * 4).groupBy("node", "b").agg(F.avg("value").alias("v"))
    w = Window.partitionBy("node")
    n = m.withColumn("v", F.try_divide(F.col("v") - F.min("v").over(w), F.max("v").over(w) - F.min("v").over(w)))
    return n.where("b between 48 and 480").select("node", F.col("b").cast("long").alias("t"), R(F.coalesce(P.scrub(F.col("v")), F.lit(0.0))).alias("value"))
