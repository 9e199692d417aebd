"""Queries over forecasts: naive systems, masked metrics by horizon and group, ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import forecast as C
from sensorloom.operators import metrics as M
from sensorloom.operators import windows as W
from sensorloom.plans.fixtures import COUNTS_SQL, FACTS_SQL, HOURS_SQL, LAST, counts, hours, predictions
from sensorloom.plans.registry import query

R = lambda c, n=6: F.round(c, n)


@query(FACTS_SQL + """ SELECT system, horizon, round(avg(abs(pred - target)), 6) AS mae, round(sqrt(avg((pred - target) * (pred - target))), 6) AS rmse,
 round(avg(abs(pred - target) / abs(target)) FILTER (abs(target) > 5e-5), 6) AS mape, round(sum(abs(pred - target)) / sum(abs(target)) , 6) AS wape, count(target) AS n
 FROM facts WHERE target IS NOT NULL GROUP BY ROLLUP (system, horizon)""")
def forecast_metrics_by_horizon(spark, d):
    """Previous-step and seasonal forecasts on the test hours, scored per system and horizon with subtotals."""
    return M.evaluate(predictions(spark, d), ["MAE", "RMSE", "MAPE", "WAPE"], ["system", "horizon"]).select("system", "horizon", *[R(c).alias(c) for c in ("mae", "rmse", "mape", "wape")], "n")


_E, _V = "abs(pred - target)", "target IS NOT NULL AND abs(target - 50) > 5e-5"


@query(FACTS_SQL + f""" SELECT system, round(coalesce(avg({_E}) FILTER ({_V}), 0), 6) AS mae_null50, round(coalesce(avg({_E} * {_E}) FILTER (abs(target - 50) > 5.5e-4), 0), 6) AS mse_rel,
 round(avg({_E}) FILTER (target <> 50), 6) AS mae_exact, round(avg(100 * {_E} / abs(target)) FILTER (abs(target) > 1), 6) AS mape_percent, round(avg({_E} / target) FILTER (target <> 50), 6) AS mape_signed,
 round(avg({_E} / CASE WHEN target = 0 THEN 1 ELSE abs(target) END), 6) AS mape_or_one, round(avg({_E} / ((abs(pred) + abs(target)) / 2)) FILTER (abs(target) > 5e-5), 6) AS smape,
 round(sum(CASE WHEN target IS NULL THEN 0 WHEN {_E} <= 1 THEN 0.5 * {_E} * {_E} ELSE {_E} - 0.5 END) / count(*), 6) AS huber FROM facts GROUP BY system""")
def metric_dialects(spark, d):
    p, t = F.col("pred"), F.col("target")
    return predictions(spark, d).groupBy("system").agg(
        R(M.mae(p, t, 50.0)).alias("mae_null50"), R(M.mse(p, t, 50.0)).alias("mse_rel"), R(M.mae(p, t, 50.0, "exact")).alias("mae_exact"), R(M.mape(p, t, dialect="percent", eps=1.0)).alias("mape_percent"),
        R(M.mape(p, t, 50.0, "signed")).alias("mape_signed"), R(M.mape(p, t, dialect="or_one")).alias("mape_or_one"), R(M.smape(p, t)).alias("smape"), R(M.huber(p, t)).alias("huber"),
    )


@query(FACTS_SQL + """, s AS (SELECT system, node, horizon, sum(CASE WHEN target IS NULL THEN 0 ELSE abs(pred - target) END) / (sum(coalesce(abs(target), 0)) + 5e-5) AS w,
 1 - sum((coalesce(target, 0) - CASE WHEN target IS NULL THEN 0 ELSE pred END) ** 2) / (var_pop(coalesce(target, 0)) * count(*) + 5e-5) AS r FROM facts WHERE system = 'seasonal' GROUP BY ALL)
 SELECT round(avg(w), 6) AS wape, round(avg(r), 5) AS r2 FROM s""")
def series_wape_and_r2(spark, d):
    f = predictions(spark, d).where("system = 'seasonal'")
    keys = ["system", "node", "horizon"]
    return M.series_wape(f, keys).crossJoin(M.series_r2(f, keys)).select(R("wape").alias("wape"), R("r2", 5).alias("r2"))


@query(FACTS_SQL + """, gr AS (SELECT node, CASE WHEN node IN ('click', 'view') THEN 'hub' ELSE 'normal' END AS grp FROM (SELECT DISTINCT node FROM panel))
 SELECT coalesce(grp, 'ALL') AS grp, horizon, round(avg(abs(pred - target)), 6) AS mae, count(target) AS n FROM facts JOIN gr USING (node) WHERE system = 'previous' AND target IS NOT NULL
 GROUP BY GROUPING SETS ((grp, horizon), (horizon), (grp), ())""")
def grouped_metrics_cube(spark, d):
    f = predictions(spark, d).where("system = 'previous'").withColumn("grp", F.when(F.col("node").isin("click", "view"), "hub").otherwise("normal"))
    return f.cube("grp", "horizon").agg(R(M.mae(F.col("pred"), F.col("target"))).alias("mae"), F.count("target").alias("n")).withColumn("grp", F.coalesce("grp", F.lit("ALL")))


@query(FACTS_SQL + """ SELECT system, node, round(avg(abs(pred - target)), 6) AS mae FROM facts WHERE target IS NOT NULL GROUP BY 1, 2""")
def per_node_mae(spark, d):
    return M.evaluate(predictions(spark, d).where("target is not null"), ["MAE"], ["system", "node"], rollup=False).select("system", "node", R("mae").alias("mae"))


@query(FACTS_SQL + """, h AS (SELECT system, horizon, avg(abs(pred - target)) AS m FROM facts WHERE target IS NOT NULL GROUP BY 1, 2) SELECT system, round(avg(m), 6) AS average_mae, count(*) AS horizons FROM h GROUP BY 1""")
def horizon_average(spark, d):
    h = M.evaluate(predictions(spark, d), ["MAE"], ["system", "horizon"], rollup=False)
    return h.groupBy("system").agg(R(F.avg("mae")).alias("average_mae"), F.count("*").alias("horizons"))


_SCALES = HOURS_SQL + """, df AS (SELECT node, value - lag(value, 24) OVER (PARTITION BY node ORDER BY t) AS d FROM panel WHERE t < 432),
 sc AS (SELECT node, avg(abs(d)) AS sa, avg(d * d) AS sq FROM df GROUP BY node)"""


@query(_SCALES + " SELECT node, round(sa, 6) AS scale_abs, round(sq, 5) AS scale_sq FROM sc")
def seasonal_scales(spark, d):
    return M.seasonal_scales(hours(spark, d).where("t < 432"), 24).select("node", R("scale_abs").alias("scale_abs"), R("scale_sq", 5).alias("scale_sq"))


@query(FACTS_SQL.replace("lastv AS", "df AS (SELECT node, value - lag(value, 24) OVER (PARTITION BY node ORDER BY t) AS d FROM panel WHERE t < 432), sc AS (SELECT node, avg(abs(d)) AS sa, avg(d * d) AS sq FROM df GROUP BY node), lastv AS", 1)
       + " SELECT round(avg(abs(pred - target) / sa), 6) AS mase, round(sqrt(avg((pred - target) ** 2 / sq)), 6) AS rmsse FROM facts JOIN sc USING (node) WHERE system = 'previous' AND target IS NOT NULL")
def mase_rmsse(spark, d):
    sc = M.seasonal_scales(hours(spark, d).where("t < 432"), 24)
    return M.scaled_errors(predictions(spark, d).where("system = 'previous'"), sc).select(R("mase").alias("mase"), R("rmsse").alias("rmsse"))


@query(FACTS_SQL + """, l AS (SELECT system, node, abs(pred - target) AS loss FROM facts WHERE target IS NOT NULL AND pred IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY loss DESC) AS k, count(*) OVER (PARTITION BY system) AS n FROM l)
 SELECT system, round(avg(loss), 6) AS worst, count(*) AS n FROM k WHERE k <= ceil(n * 0.05) GROUP BY system""")
def worst_windows(spark, d):
    f = predictions(spark, d).withColumn("loss", F.abs(F.col("pred") - F.col("target")))
    return M.worst_share(f, ["system"], 0.05).withColumn("worst", R("worst"))


@query(FACTS_SQL + """, ok AS (SELECT * FROM facts WHERE pred IS NOT NULL AND target IS NOT NULL), sa AS (SELECT system, pred, row_number() OVER (PARTITION BY system ORDER BY pred) AS k FROM ok), sb AS (SELECT system, target, row_number() OVER (PARTITION BY system ORDER BY target) AS k FROM ok)
 SELECT system, round(avg(abs(pred - target)), 6) AS w1 FROM sa JOIN sb USING (system, k) GROUP BY system""")
def wasserstein_distance(spark, d):
    return M.wasserstein(predictions(spark, d), ["system"]).withColumn("w1", R("w1"))


@query(FACTS_SQL + """, q AS (SELECT node, quantile_cont(target, 0.9) AS thr FROM facts WHERE system = 'previous' AND horizon = 1 GROUP BY node),
 f AS (SELECT system, target >= thr AS hit, pred >= thr AS said FROM facts JOIN q USING (node) WHERE target IS NOT NULL AND pred IS NOT NULL)
 SELECT system, round(coalesce(count(*) FILTER (hit AND said) / nullif(count(*) FILTER (said), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (hit AND said) / nullif(count(*) FILTER (hit), 0), 0), 6) AS recall,
 round(coalesce(2 * count(*) FILTER (hit AND said) / nullif(count(*) FILTER (hit) + count(*) FILTER (said), 0), 0), 6) AS f1 FROM f GROUP BY system""")
def peak_detection(spark, d):
    p = predictions(spark, d)
    thr = p.where("system = 'previous' and horizon = 1").groupBy("node").agg(F.percentile("target", F.lit(0.9)).alias("thr"))
    f = p.where("target is not null and pred is not null").join(thr, "node")
    cols = M.precision_recall(F.col("target") >= F.col("thr"), F.col("pred") >= F.col("thr"))
    return f.groupBy("system").agg(*[R(c).alias(k) for k, c in cols.items()])


@query(FACTS_SQL + """, q AS (SELECT node, quantile_cont(target, 0.9) AS thr FROM facts WHERE system = 'previous' AND horizon = 1 GROUP BY node)
 SELECT system, target >= thr AS is_peak, round(avg(abs(pred - target)), 6) AS mae, round(sqrt(avg((pred - target) ** 2)), 6) AS rmse, count(*) AS n FROM facts JOIN q USING (node) WHERE target IS NOT NULL AND pred IS NOT NULL GROUP BY 1, 2""")
def peak_split_metrics(spark, d):
    p = predictions(spark, d)
    thr = p.where("system = 'previous' and horizon = 1").groupBy("node").agg(F.percentile("target", F.lit(0.9)).alias("thr"))
    f = p.where("target is not null and pred is not null").join(thr, "node").withColumn("is_peak", F.col("target") >= F.col("thr"))
    t, q = F.col("target"), F.col("pred")
    return f.groupBy("system", "is_peak").agg(R(M.mae(q, t)).alias("mae"), R(M.rmse(q, t)).alias("rmse"), F.count("*").alias("n"))


@query(FACTS_SQL + """, s AS (SELECT f.t, f.node, k, p.value AS moved, f.pred FROM facts f, unnest([-2, -1, 0, 1, 2]) AS u(k) LEFT JOIN panel p ON p.node = f.node AND p.t = f.t + k WHERE system = 'seasonal' AND horizon = 1),
 c AS (SELECT CAST(k AS INTEGER) AS shift, avg(abs(moved - pred)) AS mae, count(moved) AS n FROM s GROUP BY 1) SELECT shift, round(mae, 6) AS mae, n, row_number() OVER (ORDER BY mae, abs(shift)) = 1 AS best FROM c""")
def shifted_mae_curve(spark, d):
    f = predictions(spark, d).where("system = 'seasonal' and horizon = 1").select("node", "t", "pred", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("shift")).withColumn("t", F.col("t") + F.col("shift"))
    c = f.join(hours(spark, d).select("node", "t", "value"), ["node", "t"], "left").groupBy("shift").agg(F.avg(F.abs(F.col("value") - F.col("pred"))).alias("mae"), F.count("value").alias("n"))
    return c.withColumn("best", F.row_number().over(Window.orderBy("mae", F.abs("shift"))) == 1).withColumn("mae", R("mae"))


@query(FACTS_SQL + """, r AS (SELECT system, node, t, pred - target AS e FROM facts WHERE horizon = 1), l AS (SELECT *, lag(e) OVER (PARTITION BY system, node ORDER BY t) AS e1 FROM r)
 SELECT system, round(avg(e), 6) AS bias, round(stddev_pop(e), 6) AS std, round(avg(CAST(e < 0 AS DOUBLE)), 6) AS under_rate, round(corr(e, e1), 5) AS lag1 FROM l GROUP BY system""")
def residual_structure(spark, d):
    r = predictions(spark, d).where("horizon = 1").withColumn("e", F.col("pred") - F.col("target"))
    r = r.withColumn("e1", F.lag("e").over(Window.partitionBy("system", "node").orderBy("t")))
    return r.groupBy("system").agg(R(F.avg("e")).alias("bias"), R(F.stddev_pop("e")).alias("std"), R(F.avg((F.col("e") < 0).cast("double"))).alias("under_rate"), R(M.guarded_corr(F.col("e"), F.col("e1")), 5).alias("lag1"))


_RANKS = FACTS_SQL + """, m AS (SELECT system, node, horizon, round(avg(abs(pred - target)), 2) AS v FROM facts WHERE target IS NOT NULL GROUP BY 1, 2, 3),
 k AS (SELECT *, rank() OVER (PARTITION BY system, horizon ORDER BY v) + (count(*) OVER (PARTITION BY system, horizon, v) - 1) / 2 AS rk FROM m)"""


@query(_RANKS + " SELECT system, node, horizon, rk AS rank FROM k")
def average_rank_table(spark, d):
    m = M.evaluate(predictions(spark, d), ["MAE"], ["system", "node", "horizon"], rollup=False).withColumn("mae", F.round("mae", 2))
    return M.average_rank(m, ["system", "horizon"], "mae").select("system", "node", "horizon", "rank")


@query(_RANKS + """, w AS (SELECT a.horizon, a.node, a.rk AS r1, b.rk AS r2 FROM k a JOIN k b ON a.node = b.node AND a.horizon = b.horizon AND a.system = 'previous' AND b.system = 'seasonal')
 SELECT x.horizon, round(sum(sign((x.r1 - y.r1) * (x.r2 - y.r2))) / nullif(sum(abs(sign((x.r1 - y.r1) * (x.r2 - y.r2)))), 0), 6) AS tau FROM w x JOIN w y ON x.horizon = y.horizon AND x.node < y.node GROUP BY 1""")
def kendall_tau(spark, d):
    m = M.evaluate(predictions(spark, d), ["MAE"], ["system", "node", "horizon"], rollup=False).withColumn("mae", F.round("mae", 2))
    k = M.average_rank(m, ["system", "horizon"], "mae")
    w = k.groupBy("horizon", "node").agg(F.max(F.when(F.col("system") == "previous", F.col("rank"))).alias("r1"), F.max(F.when(F.col("system") == "seasonal", F.col("rank"))).alias("r2"))
    return M.kendall(w, "node", "r1", "r2", ["horizon"]).withColumn("tau", R("tau"))


_NAIVE = HOURS_SQL + """, tr AS (SELECT node, t, value FROM panel WHERE t < 432), sm AS (SELECT node, t % 24 AS s, median(value) AS a FROM tr GROUP BY 1, 2), nm AS (SELECT node, median(value) AS b, avg(value) AS mean FROM tr GROUP BY 1),
 gm AS (SELECT quantile_disc(value, 0.5) AS lowmed FROM tr), tg AS (SELECT node, t, value AS target FROM panel WHERE t >= 576)
 SELECT node, t, round(coalesce(a, b), 8) AS slot_median, round(mean, 8) AS node_mean, round(lowmed, 8) AS low_median FROM tg LEFT JOIN sm USING (node) JOIN nm USING (node) CROSS JOIN gm WHERE sm.s = t % 24 OR sm.s IS NULL"""


@query(_NAIVE)
def naive_constants(spark, d):
    p = hours(spark, d)
    train, f = p.where("t < 432"), C.targets(p, [1], 576)
    f = C.slot_statistic(f, train, 24, "median", "slot_median")
    f = C.constant(f, train, "mean", True, "node_mean")
    f = C.constant(f, train, "low_median", False, "low_median")
    return f.select("node", "t", *[R(c, 8).alias(c) for c in ("slot_median", "node_mean", "low_median")])


_FRAME = "(PARTITION BY node ORDER BY t ROWS BETWEEN {} AND {})"


@query(COUNTS_SQL + f""" SELECT node, t, round(avg(value) OVER {_FRAME.format('6 PRECEDING', '1 PRECEDING')}, 8) AS moving, round(CASE WHEN count(value) OVER {_FRAME.format('5 PRECEDING', 'CURRENT ROW')} = 6 THEN avg(value) OVER {_FRAME.format('5 PRECEDING', 'CURRENT ROW')} END, 8) AS rolled,
 max(CAST(value > 3 AS INTEGER)) OVER {_FRAME.format('2 PRECEDING', '2 FOLLOWING')} AS near FROM panel""")
def moving_frames(spark, d):
    p = counts(spark, d)
    x = C.rolling_mean(C.moving_average(p, 6), 6)
    x = C.dilate(x.withColumn("peak", (F.col("value") > 3).cast("int")), "peak", 2)
    return x.select("node", "t", R("pred", 8).alias("moving"), R("rolled", 8).alias("rolled"), "near")


@query(COUNTS_SQL + """, pad AS (SELECT node, t, k, value FROM (SELECT p.node, p.t, k, q.value FROM panel p, unnest([-2, -1, 0, 1, 2]) AS u(k) JOIN panel q ON q.node = p.node AND q.t = greatest(least(p.t + k, 719), 0)))
 SELECT node, t, round(avg(value), 8) AS low FROM pad GROUP BY 1, 2""")
def centered_moving_average(spark, d):
    return C.centered_average(counts(spark, d), 5, 720).select("node", "t", R("low", 8).alias("low"))


@query(HOURS_SQL + """ SELECT node, t, round(value - lag(value) OVER (PARTITION BY node ORDER BY t), 8) AS diff, round(value - avg(value) OVER (PARTITION BY node), 8) AS r_mean, round(value - avg(value) OVER (PARTITION BY node, t % 24), 8) AS r_slot FROM panel QUALIFY t > 0""")
def differences_and_residuals(spark, d):
    p = C.residualize(C.residualize(hours(spark, d), None, "r_mean"), 24, "r_slot")
    return C.first_difference(p).select("node", "t", *[R(c, 8).alias(c) for c in ("diff", "r_mean", "r_slot")])


@query(HOURS_SQL + """, tr AS (SELECT node, t % 24 AS s, (t // 24) % 7 AS w, value FROM panel WHERE t < 576) SELECT node, s AS slot, w AS week_day, round(quantile_cont(nullif(value, 0), 0.1), 8) AS q10, round(median(nullif(value, 0)), 8) AS mid FROM tr GROUP BY 1, 2, 3""")
def seasonal_reference(spark, d):
    p = hours(spark, d).where("t < 576").select("node", F.pmod("t", F.lit(24)).alias("slot"), F.pmod(F.floor(F.col("t") / 24), F.lit(7)).alias("week_day"), F.nullif("value", F.lit(0.0)).alias("v"))
    return p.groupBy("node", "slot", "week_day").agg(R(F.percentile("v", F.lit(0.1)), 8).alias("q10"), R(F.median("v"), 8).alias("mid"))


# ---- windows

@query(COUNTS_SQL + """, w AS (SELECT node, t, list(value) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS past, list(value) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS future FROM panel)
 SELECT node, t, past, future, list_reverse(past[-2:]) AS pred FROM w WHERE len(past) = 4 AND len(future) = 2""")
def sliding_windows(spark, d):
    return W.copy_history(W.sliding(counts(spark, d), 4, 2), 2, reverse=True)


_STARTS = HOURS_SQL + """, sp AS (SELECT t, CASE WHEN t < 100 OR t BETWEEN 150 AND 400 THEN 'train' WHEN t < 150 THEN 'valid' ELSE 'test' END AS split FROM panel GROUP BY t),
 w AS (SELECT t, count(*) FILTER (split = 'train') OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a, count(*) FILTER (split = 'train') OVER (ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b,
 count(*) FILTER (split = 'valid') OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS v FROM sp)
 SELECT 'train' AS split, t FROM w WHERE a = 3 AND b = 4 UNION ALL SELECT 'valid', t FROM w WHERE v = 3 AND t >= 4"""


@query(_STARTS)
def explicit_split_starts(spark, d):
    t = F.col("t")
    sp = hours(spark, d).select("t").distinct().withColumn("split", F.when((t < 100) | t.between(150, 400), "train").when(t < 150, "valid").otherwise("test"))
    return W.split_starts(sp, "train", 4, 3, False).select(F.lit("train").alias("split"), "t").unionByName(W.split_starts(sp, "valid", 4, 3, True).select(F.lit("valid").alias("split"), "t"))


@query(COUNTS_SQL + """, s(k) AS (SELECT unnest([0, -1, -2, -21, -22, -23, -45, -46, -47])) SELECT p.node, p.t, CAST(k AS INTEGER) AS shift, q.value, p.t + k < 0 OR q.value IS NULL AS missing FROM panel p CROSS JOIN s JOIN panel q ON q.node = p.node AND q.t = greatest(p.t + k, 0)""")
def seasonal_shift_gather(spark, d):
    p = counts(spark, d)
    assert W.seasonal_shifts(3, 24, 2, 3) == [0, -1, -2, -21, -22, -23, -45, -46, -47]
    return W.gather_shifts(p, W.seasonal_shifts(3, 24, 2, 3))


@query(HOURS_SQL + """, z AS (SELECT node, t, CASE WHEN t % 50 >= 5 THEN value END AS value FROM panel), w AS (SELECT t, count(value) OVER f AS n, count(*) OVER f AS m FROM z WINDOW f AS (PARTITION BY node ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
 SELECT t, CAST(sum(n) AS BIGINT) AS n FROM w WHERE m = 3 GROUP BY t HAVING sum(n) > 0""")
def drop_empty_targets(spark, d):
    p = hours(spark, d).withColumn("value", F.when(F.pmod("t", F.lit(50)) >= 5, F.col("value")))
    return W.drop_empty_horizons(p, 3)


_STRATA = COUNTS_SQL + """, w AS (SELECT node, t, value AS last, list(value) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS f FROM panel),
 s AS (SELECT t - 3 AS t, avg(list_sum(list_transform(f, lambda x: abs(x - last))) / 2) AS score FROM w WHERE len(f) = 2 AND t >= 3 GROUP BY 1), q AS (SELECT quantile_cont(score, 1.0/3) AS a, quantile_cont(score, 2.0/3) AS b FROM s),
 st AS (SELECT t, round(score, 8) AS score, (t + 4) % 24 AS phase, CAST(score >= a AS INTEGER) + CAST(score >= b AS INTEGER) AS tercile FROM s, q)"""


@query(_STRATA + " SELECT * FROM st")
def coreset_strata(spark, d):
    return W.strata(W.difficulty(counts(spark, d), 4, 2), 4, 24).withColumn("score", R("score", 8))


@query(_STRATA + """, n AS (SELECT phase, tercile, count(*) AS n FROM st GROUP BY 1, 2), e AS (SELECT *, 100 * n / sum(n) OVER () AS x FROM n), o AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, n DESC, phase, tercile) AS k, 100 - sum(floor(x)) OVER () AS rest FROM e)
 SELECT phase, tercile, n, CAST(floor(x) + CAST(k <= rest AS INTEGER) AS BIGINT) AS budget FROM o""")
def coreset_budget(spark, d):
    s = W.strata(W.difficulty(counts(spark, d), 4, 2), 4, 24)
    return W.allocate(s.groupBy("phase", "tercile").agg(F.count("*").alias("n")), ["phase", "tercile"], 100).withColumn("budget", F.col("budget").cast("long"))


@query(_STRATA + """, k AS (SELECT *, row_number() OVER (PARTITION BY phase, tercile ORDER BY md5(CAST(t AS VARCHAR))) AS k FROM st) SELECT t, phase, tercile FROM k WHERE k <= 2""")
def coreset_random(spark, d):
    s = W.strata(W.difficulty(counts(spark, d), 4, 2), 4, 24)
    return W.hashed_choice(s, ["phase", "tercile"], F.col("t"), F.lit(2)).select("t", "phase", "tercile")
