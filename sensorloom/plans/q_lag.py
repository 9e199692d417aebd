"""Queries over lags, causal scores and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import graph as G
from sensorloom.operators import lag as L
from sensorloom.plans.fixtures import COUNTS_SQL, FACTS_SQL, HOURS_SQL, counts, hours, predictions
from sensorloom.plans.registry import query

R = lambda c, n=6: F.round(c, n)

_CORR = """CASE WHEN count(x * y) >= 3 AND vx > 1e-9 AND vy > 1e-9 THEN vxy / sqrt(vx * vy) END"""
LAGS = """, nd AS (SELECT DISTINCT node FROM panel), pr AS (SELECT a.node AS src, b.node AS dst FROM nd a JOIN nd b ON a.node <> b.node),
 j AS (SELECT {keys}pr.src, pr.dst, CAST(k AS INTEGER) AS lag, CASE WHEN y.value IS NOT NULL THEN x.value END AS x, CASE WHEN x.value IS NOT NULL THEN y.value END AS y FROM pr CROSS JOIN unnest(range(0, {lags} + 1)) AS u(k) JOIN panel x ON x.node = pr.src JOIN panel y ON y.node = pr.dst AND y.t = {at}{on}),
 s AS (SELECT {out}src, dst, lag, count(x) AS n, count(x) * sum(x * x) - sum(x) * sum(x) AS vx, count(x) * sum(y * y) - sum(y) * sum(y) AS vy, count(x) * sum(x * y) - sum(x) * sum(y) AS vxy FROM j GROUP BY ALL),
 sc AS (SELECT {out}src, dst, lag, n, CASE WHEN n >= 3 AND vx > 1e-9 AND vy > 1e-9 THEN vxy / sqrt(vx * vy) END AS corr FROM s)"""
_L6 = LAGS.format(keys="", lags=6, at="x.t + k", on="", out="")


@query(HOURS_SQL + _L6 + " SELECT src, dst, lag, round(corr, 6) AS corr, n FROM sc")
def lagged_correlation(spark, d):
    p = hours(spark, d)
    return L.lag_scores(p, L.all_pairs(p), 6).withColumn("corr", R("corr"))


@query(COUNTS_SQL + LAGS.format(keys="", lags=5, at="(x.t + k) % 720", on="", out="") + " SELECT src, dst, lag, round(corr, 6) AS corr, n FROM sc")
def circular_correlation(spark, d):
    p = counts(spark, d)
    return L.lag_scores(p, L.all_pairs(p), 5, circular=720).withColumn("corr", R("corr"))


_BEST = _L6 + """, bl AS (SELECT src, dst, lag, corr, {s} - max(CASE WHEN lag = 0 THEN {s} END) OVER (PARTITION BY src, dst) AS improvement FROM sc QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY round({s}, 9) DESC NULLS LAST, lag) = 1)"""


@query(HOURS_SQL + _BEST.format(s="corr") + " SELECT src, dst, lag, round(corr, 6) AS corr, round(improvement, 6) AS improvement FROM bl")
def best_delay(spark, d):
    p = hours(spark, d)
    return L.best_lag(L.lag_scores(p, L.all_pairs(p), 6), ["src", "dst"]).select("src", "dst", "lag", R("corr").alias("corr"), R("improvement").alias("improvement"))


@query(HOURS_SQL + _BEST.format(s="abs(corr)") + " SELECT src, round(avg(lag), 6) AS mean, round(stddev_samp(lag), 6) AS std, quantile_cont(lag, 0.5) AS p50, round(quantile_cont(lag, 0.9), 6) AS p90, max(lag) AS max FROM bl GROUP BY 1")
def delay_distribution(spark, d):
    p = hours(spark, d)
    b = L.best_lag(L.lag_scores(p, L.all_pairs(p), 6), ["src", "dst"], absolute=True)
    return L.delay_summary(b, ["src"]).select("src", R("mean").alias("mean"), R("std").alias("std"), "p50", R("p90").alias("p90"), "max")


@query(COUNTS_SQL + LAGS.format(keys="x.t // 240 AS day, ", lags=3, at="x.t + k", on=" AND y.t // 240 = x.t // 240", out="day, ") + """ SELECT day, src, dst, lag, round(corr, 6) AS corr FROM sc QUALIFY row_number() OVER (PARTITION BY day, src, dst ORDER BY round(corr, 9) DESC NULLS LAST, lag) = 1""")
def delay_per_period(spark, d):
    p = counts(spark, d).withColumn("day", F.floor(F.col("t") / 240))
    s = L.lag_scores(p, L.all_pairs(p), 3, extra=["day"])
    return L.best_lag(s, ["day", "src", "dst"]).select("day", "src", "dst", "lag", R("corr").alias("corr"))


@query(COUNTS_SQL + """, f AS (SELECT node, atan2(sum(-value * sin(2 * pi() * t / 24)), sum(value * cos(2 * pi() * t / 24))) AS p FROM panel GROUP BY 1), d AS (SELECT a.node AS src, b.node AS dst, a.p - b.p AS d FROM f a JOIN f b ON a.node <> b.node)
 SELECT src, dst, round((d - 2 * pi() * floor((d + pi()) / (2 * pi()))) * 24 / (2 * pi()), 5) AS delay FROM d""")
def phase_delay(spark, d):
    p = counts(spark, d)
    return L.phase(p, L.all_pairs(p), 24).withColumn("delay", R("delay", 5))


_SCORE = _L6 + ", sm AS (SELECT src, dst, {f}(coalesce(abs(corr), 0)) AS score FROM sc WHERE lag > 0 GROUP BY 1, 2)"


@query(HOURS_SQL + _SCORE.format(f="avg") + " SELECT src, dst, round(score, 6) AS score FROM sm")
def lag_summary_mean(spark, d):
    p = hours(spark, d)
    return L.summarize_lags(L.lag_scores(p, L.all_pairs(p), 6), "mean").withColumn("score", R("score"))


_CAUSE = _SCORE.format(f="max") + """, w AS (SELECT a.src, a.dst, CASE WHEN a.score > b.score THEN a.score ELSE 0 END AS score FROM sm a JOIN sm b ON a.src = b.dst AND a.dst = b.src), mn AS (SELECT node, avg(value) AS m FROM panel GROUP BY 1), rp AS (SELECT a.node AS src, b.node AS dst, greatest(b.m - a.m, 0) AS score FROM mn a JOIN mn b ON a.node <> b.node),
 ch AS (SELECT w.src, w.dst, CASE WHEN w.score > 0 AND row_number() OVER (PARTITION BY w.src ORDER BY w.score > 0 DESC, b.m > a.m DESC, CASE WHEN b.m > a.m THEN b.m - a.m END, w.score DESC, w.dst) = 1 THEN w.score ELSE 0 END AS score FROM w JOIN mn a ON a.node = w.src JOIN mn b ON b.node = w.dst), cb AS (SELECT src, dst, ch.score + rp.score / 100 AS score FROM ch JOIN rp USING (src, dst))"""


def _causal(spark, d):
    p = hours(spark, d)
    s = L.pairwise_winner(L.summarize_lags(L.lag_scores(p, L.all_pairs(p), 6)))
    cc = L.select_child(s, "next", means=p.groupBy("node").agg(F.avg("value").alias("m")))
    return cc, L.mean_scores(p), p


@query(HOURS_SQL + _CAUSE + " SELECT src, dst, round(ch.score, 6) AS cc, round(rp.score, 6) AS rp, round(cb.score, 6) AS combo FROM ch JOIN rp USING (src, dst) JOIN cb USING (src, dst)")
def causal_baselines(spark, d):
    cc, rp, _ = _causal(spark, d)
    combo = L.combine(cc, rp.withColumn("score", F.col("score") / 100), "sum")
    j = cc.withColumnRenamed("score", "cc").join(rp.withColumnRenamed("score", "rp"), ["src", "dst"]).join(combo, ["src", "dst"])
    return j.select("src", "dst", R("cc").alias("cc"), R("rp").alias("rp"), R("score").alias("combo"))


@query(HOURS_SQL + _CAUSE + """, f AS (SELECT a.node AS src, b.node AS dst, CASE WHEN b.m > a.m THEN b.m / greatest(abs(a.m), 1e-12) ELSE 0 END AS score, a.m AS am, b.m AS bm FROM mn a JOIN mn b ON a.node <> b.node), su AS (SELECT src, dst, score AS support FROM sm)
 SELECT src, dst, round(score, 6) AS ratio, round(CASE WHEN score > 0 AND row_number() OVER (PARTITION BY src ORDER BY score > 0 DESC, bm DESC, score DESC, dst) = 1 THEN score ELSE 0 END, 6) AS biggest, round(CASE WHEN score > 0 AND row_number() OVER (PARTITION BY src ORDER BY score > 0 DESC, support DESC, score DESC, dst) = 1 THEN score ELSE 0 END, 6) AS corr FROM f JOIN su USING (src, dst)""")
def child_selection_rules(spark, d):
    """The ratio of means, and which child the rules biggest and corr leave to each source."""
    p = hours(spark, d)
    ratio, m = L.mean_scores(p, "ratio"), p.groupBy("node").agg(F.avg("value").alias("m"))
    support = L.summarize_lags(L.lag_scores(p, L.all_pairs(p), 6)).withColumnRenamed("score", "support")
    big, corr = L.select_child(ratio, "biggest", means=m), L.select_child(ratio, "corr", support=support)
    j = ratio.join(big.withColumnRenamed("score", "biggest"), ["src", "dst"]).join(corr.withColumnRenamed("score", "corr"), ["src", "dst"])
    return j.select("src", "dst", R("score").alias("ratio"), R("biggest").alias("biggest"), R("corr").alias("corr"))


_LABELLED = _CAUSE + ", lb AS (SELECT round(cb.score, 6) AS score, CAST(length(src) < length(dst) AS INTEGER) AS label, src FROM cb)"


@query(HOURS_SQL + _LABELLED + """, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM lb), a AS (SELECT (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auroc FROM r),
 c AS (SELECT (SELECT sum(label) FROM lb b WHERE b.score >= t.score) AS tp, (SELECT count(*) FROM lb b WHERE b.score >= t.score) AS said, (SELECT sum(label) FROM lb) AS pos, (SELECT count(*) FROM lb) AS n FROM (SELECT DISTINCT score FROM lb) t)
 SELECT round((SELECT auroc FROM a), 6) AS auroc, round(max(2 * tp / (said + pos)), 6) AS max_f1, round(max(greatest(tp + n - pos - (said - tp), n - pos) / n), 6) AS max_accuracy FROM c""")
def causal_scoring(spark, d):
    cc, rp, _ = _causal(spark, d)
    combo = L.combine(cc, rp.withColumn("score", F.col("score") / 100), "sum")
    lb = combo.select(R("score").alias("score"), (F.length("src") < F.length("dst")).cast("int").alias("label"), F.lit(1).alias("one"))
    return L.auroc(lb, ["one"]).join(L.best_f1(lb, ["one"]), "one").select(R("auroc").alias("auroc"), R("max_f1").alias("max_f1"), R("max_accuracy").alias("max_accuracy"))


@query("""WITH x AS (SELECT (l_orderkey * 37 % 1000) / 1000.0 AS score, CAST(l_quantity > 30 AS INTEGER) AS label FROM lineitem), h AS (SELECT least(floor(score * 64), 63) AS b, sum(label) AS p, count(*) AS n FROM x GROUP BY 1),
 c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS said FROM h WINDOW w AS (ORDER BY b DESC)) SELECT round(sum(tp / said * p) / sum(p), 6) AS ap FROM c""")
def average_precision_histogram(spark, d):
    from sensorloom.plans.registry import table

    x = table(spark, d, "lineitem").select((F.col("l_orderkey") * 37 % 1000 / 1000.0).alias("score"), (F.col("l_quantity") > 30).cast("int").alias("label"))
    return L.histogram_ap(x, 64).select(R("ap").alias("ap"))


@query(COUNTS_SQL + """, w AS (SELECT node, t, value, lag(value, 1) OVER q AS x1, lag(value, 2) OVER q AS x2, lag(value, 24) OVER q AS x24 FROM panel WINDOW q AS (PARTITION BY node ORDER BY t)), tr AS (SELECT * FROM w WHERE t < 432 AND x24 IS NOT NULL)
 SELECT count(*) AS n, round(sum(x1 * x1), 4) AS g11, round(sum(x1 * x24), 4) AS g13, round(sum(x2 * value), 4) AS y2 FROM tr""")
def autoregression_gram(spark, d):
    from pyspark.sql import Window

    q = Window.partitionBy("node").orderBy("t")
    w = counts(spark, d).select("node", "t", "value", *[F.lag("value", k).over(q).alias(f"x{k}") for k in (1, 2, 24)])
    tr = w.where("t < 432 and x24 is not null")
    return tr.agg(F.count("*").alias("n"), F.round(F.sum(F.col("x1") * F.col("x1")), 4).alias("g11"), F.round(F.sum(F.col("x1") * F.col("x24")), 4).alias("g13"), F.round(F.sum(F.col("x2") * F.col("value")), 4).alias("y2"))


@query()
def autoregression_forecast(spark, d):
    """Ridge autoregression fitted on training hours and applied to all; tests check it against NumPy."""
    from pyspark.sql import Window

    q = Window.partitionBy("node").orderBy("t")
    lags = ["x1", "x2", "x24"]
    w = counts(spark, d).select("node", "t", "value", *[F.lag("value", k).over(q).alias(f"x{k}") for k in (1, 2, 24)])
    coef = L.ridge(w.where("t < 432"), lags, "value", 1.0)
    return w.where("t >= 432").select("node", "t", L.linear(lags, coef, 0.0).alias("pred"))


@query()
def var_baseline(spark, d):
    return L.var_scores(counts(spark, d).withColumn("part", F.floor(F.col("t") / 240)), "part", 2)


@query()
def lowpass_component(spark, d):
    return L.lowpass(hours(spark, d), 0.1)


@query()
def spline_upsample(spark, d):
    return L.cubic_upsample(hours(spark, d), 4)


_SHIFTS = """, nd AS (SELECT node, row_number() OVER (ORDER BY node) AS r FROM (SELECT DISTINCT node FROM panel)),
 near AS (SELECT a.node, b.node AS nb, CAST(k AS INTEGER) AS hop FROM nd a CROSS JOIN nd b CROSS JOIN unnest(range(3)) AS u(k) WHERE abs(a.r - b.r) <= k),
 le AS (SELECT f.system, f.horizon, f.node, f.t, near.hop, CAST(d AS INTEGER) AS shift, min(abs(p.pred - f.target)) AS e FROM facts f JOIN near ON near.node = f.node CROSS JOIN unnest(range(-2, 3)) AS v(d)
 JOIN facts p ON p.system = f.system AND p.horizon = f.horizon AND p.node = near.nb AND p.t = f.t + d WHERE f.target IS NOT NULL GROUP BY ALL),
 cu AS (SELECT system, horizon, hop, shift, avg(e) AS error, count(e) AS n FROM le GROUP BY ALL)"""


def _shifts(spark, d):
    """Shift curve of the forecasts on the line of nodes in name order, up to two hops and two hours."""
    facts = predictions(spark, d)
    line = facts.select("node").distinct().select(F.col("node").alias("src"), F.lead("node").over(Window.orderBy("node")).alias("dst")).where("dst IS NOT NULL")
    return L.space_time_shift(facts, G.reach(line, 2, directed=False), ["system", "horizon"], 2, 2)


@query(FACTS_SQL + _SHIFTS + " SELECT system, horizon, hop, shift, round(error, 6) AS error, n FROM cu")
def joint_shift_curve(spark, d):
    return _shifts(spark, d).withColumn("error", R("error"))


@query(FACTS_SQL + _SHIFTS + " SELECT system, horizon, hop, shift, round(error, 6) AS error, n FROM cu QUALIFY row_number() OVER (PARTITION BY system, horizon ORDER BY round(error, 9), hop, abs(shift), shift) = 1")
def joint_shift_best(spark, d):
    return L.best_shift(_shifts(spark, d), ["system", "horizon"]).withColumn("error", R("error"))
