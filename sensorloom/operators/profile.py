"""Data profiles: zero behaviour, distributions, presence, stability, bins and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.metrics import average_rank, corr_of_sums, guarded_corr, value_ranks
from sensorloom.operators.storage import kept


def distribution(df: DataFrame, by: list[str], value: str = "value", eps: float = 0.0) -> DataFrame:
    """n, zero rate, mean, variance to mean, quantiles of the positive values."""
    v = F.col(value)
    q = F.percentile(F.when(v > eps, v), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    d = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg((v <= eps).cast("double")).alias("zero_rate"), F.avg(v).alias("mean"), F.try_divide(F.var_pop(v), F.avg(v)).alias("dispersion"), q.alias("q"))
    return d.select(*by, "n", "zero_rate", "mean", "dispersion", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p99"))


def zero_transitions(panel: DataFrame, by: list[str], eps: float = 0.0) -> DataFrame:
    """Probabilities of zero and positive following each other from one step to the next."""
    w = Window.partitionBy("node").orderBy("t")
    z = F.col("value") <= eps
    nxt = F.lead(z).over(w)
    s = panel.select(*by, z.alias("a"), nxt.alias("b")).where("b is not null")
    share = lambda a, b: F.try_divide(F.count_if((F.col("a") == a) & (F.col("b") == b)), F.count_if(F.col("a") == a))
    return s.groupBy(*by).agg(share(True, True).alias("p00"), share(True, False).alias("p01"), share(False, True).alias("p10"), share(False, False).alias("p11"))


def expected_zero_rate(train: DataFrame, test: DataFrame, node: str = "node", hour: str = "h", eps: float = 1e-6) -> DataFrame:
    """Observed zero rate of the test part, and what the training part expects of it: a Poisson law by node and hour over the test steps, and a negative binomial law by node over the nodes.

    A node's hour without training steps has the node's mean. The negative binomial law is the
    Poisson one where the variance does not exceed the mean by more than eps. Values within eps
    of 0 are zero.
    """
    m = train.groupBy(node).agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    by_hour = train.groupBy(node, hour).agg(F.avg("value").alias("mh"))
    r = F.col("m") * F.col("m") / F.greatest(F.col("v") - F.col("m"), F.lit(eps))
    # (r / (r + m + eps)) ** r by logarithms, which keep their digits where r is large.
    nb = F.when(F.col("v") > F.col("m") + eps, F.exp(-r * F.log1p((F.col("m") + eps) / r))).otherwise(F.exp(-F.col("m")))
    over = test.where("value is not null").join(m, node).join(by_hour, [node, hour], "left")
    seen = over.agg(F.avg((F.abs("value") <= eps).cast("double")).alias("observed"), F.avg(F.exp(-F.coalesce("mh", "m"))).alias("poisson"))
    return seen.crossJoin(F.broadcast(m.agg(F.avg(nb).alias("negative_binomial"))))  # one row each


def positive_thresholds(train: DataFrame, q: float, support: int, eps: float = 0.0) -> DataFrame:
    """(node, threshold): quantile of a node's positive values, for nodes with enough of them."""
    v = F.when(F.col("value") > eps, F.col("value"))
    return train.groupBy("node").agg(F.count(v).alias("n"), F.percentile(v, F.lit(q)).alias("threshold")).where(F.col("n") >= support).select("node", "threshold")


def zero_aware(facts: DataFrame, by: list[str], eps: float = 0.0) -> DataFrame:
    """Errors over all and positive targets, log errors, and occurrence precision, recall and F1; sums only, so parts merge."""
    p, t = F.col("pred"), F.col("target")
    e, pos = F.abs(p - t), t > eps
    hit = F.count_if(pos & (p > eps))
    return facts.where("pred is not null and target is not null").groupBy(*by).agg(
        F.avg(e).alias("mae"), F.avg(F.when(pos, e)).alias("mae_pos"), F.try_divide(F.sum(e), F.sum(F.abs(t))).alias("wape"), F.avg(F.abs(F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(t))).alias("log_mae"),
        F.coalesce(F.try_divide(hit, F.count_if(p > eps)), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(hit, F.count_if(pos)), F.lit(0.0)).alias("recall"), F.count("*").alias("n"),
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, n): equal widths between minimum and maximum, the last bin closed."""
    b = df.agg(F.min(value).alias("a"), F.max(value).alias("z"))
    step = (F.col("z") - F.col("a")) / bins
    k = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("a"), step)), F.lit(0)), F.lit(bins - 1))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(b)).groupBy(k.alias("bin"), "a", step.alias("w")).agg(F.count("*").alias("n")).select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n")


def quantile_bins(df: DataFrame, value: str, n: int) -> DataFrame:
    """df with qbin: right-closed quantile bins from 0, equal edges dropped."""
    probs = F.array(*[F.lit(k / n) for k in range(n + 1)])
    e = df.agg(F.array_sort(F.array_distinct(F.percentile(F.col(value), probs))).alias("__e"))
    below = F.size(F.filter("__e", lambda x: x < F.col(value)))
    return df.crossJoin(F.broadcast(e)).withColumn("qbin", F.greatest(below, F.lit(1)) - 1).drop("__e")


def presence(readings: DataFrame, node: str, day: Column) -> DataFrame:
    """(node, days, first, last, share): days seen against all days."""
    d = readings.select(F.col(node).alias("node"), day.alias("day")).distinct()
    total = d.agg(F.count_distinct("day").alias("total"))
    return d.groupBy("node").agg(F.count("*").alias("days"), F.min("day").alias("first"), F.max("day").alias("last")).crossJoin(F.broadcast(total)).select("node", "days", "first", "last", (F.col("days") / F.col("total")).alias("share"))


def stable(presences: DataFrame, metadata: DataFrame, share: float, version: str) -> DataFrame:
    """Nodes present at least the share of days, with their latest metadata row."""
    w = Window.partitionBy("node").orderBy(F.desc(version))
    latest = metadata.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return presences.where(F.col("share") >= share).select("node", "days").join(latest, "node")


def day_summary(panel: DataFrame, per_day: int) -> DataFrame:
    """(node, day): slots seen, sum, mean, maximum, sample deviation, coverage."""
    v = F.col("value")
    return panel.groupBy("node", F.floor(F.col("t") / per_day).alias("day")).agg(F.count(v).alias("slots"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.stddev_samp(v).alias("std"), (F.count(v) / per_day).alias("coverage"))


def predictability(panel: DataFrame, per_day: int) -> DataFrame:
    """(node, mean, std, cv, lag1, day_ago, week_ago): moments and guarded correlations with earlier values."""
    w = Window.partitionBy("node").orderBy("t")
    v = F.col("value")
    x = panel.select("node", "value", *[F.lag("value", k).over(w).alias(n) for n, k in (("a", 1), ("b", per_day), ("c", 7 * per_day))])
    mean = F.try_divide(F.sum(v), F.count(v))
    std = F.sqrt(F.greatest(F.try_divide(F.sum(v * v), F.count(v)) - mean * mean, F.lit(0.0)))
    return x.groupBy("node").agg(mean.alias("mean"), std.alias("std"), F.try_divide(std, F.nullif(mean, F.lit(0.0))).alias("cv"), *[guarded_corr(v, F.col(c)).alias(n) for c, n in (("a", "lag1"), ("b", "day_ago"), ("c", "week_ago"))])


def weighted_rollup(parts: DataFrame, by: list[str], weight: str, value: str) -> DataFrame:
    """sum of weights and weighted mean (0 when the weights are 0)."""
    return parts.groupBy(*by).agg(F.sum(weight).alias("weight"), F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), F.lit(0.0)).alias("mean"))


def roll_up(rows: DataFrame, by: list[str], value: str, digits: int = 4) -> DataFrame:
    """n, mean, population deviation, minimum and maximum per key, nulls skipped."""
    v = F.col(value)
    return rows.where(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("n"), *[F.round(f(v), digits).alias(n) for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max"))])


def collapse_runs(rows: DataFrame, run: str, ids: list[str], metric: str, value: str) -> DataFrame:
    """Runs with equal ids and equal sets of (metric, value) collapse: first run, how many, all joined."""
    per = rows.groupBy(run, *ids).agg(F.to_json(F.array_sort(F.collect_list(F.struct(metric, value)))).alias("__m"))
    return per.groupBy(*ids, "__m").agg(F.min(run).alias("first_run"), F.count("*").alias("copies"), F.concat_ws(",", F.array_sort(F.collect_list(F.col(run).cast("string")))).alias("runs")).drop("__m")


def correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, pearson, spearman) of each feature with the target.

    Rows get the feature's rank alone. They are then added up by target, so that the
    target's ranks are joined to its distinct values and not to rows, which are shuffled once.
    """
    long = df.select(target, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("r")).select("r.feature", "r.x", F.col(target).cast("double").alias("y"))
    ok = long.where("x is not null and y is not null")
    rx = F.col("rx")
    by_y = kept(average_rank(ok, ["feature"], "x", "rx").groupBy("feature", "y").agg(F.count("*").alias("n"), F.sum(rx).alias("s"), F.sum(rx * rx).alias("ss")))
    ry = by_y.join(value_ranks(by_y, ["feature"], "y", "ry", counted="n"), ["feature", "y"])
    s = lambda e: F.sum(F.expr(e))
    spearman = ry.groupBy("feature").agg(corr_of_sums(s("n"), s("s"), s("n * ry"), s("ss"), s("n * ry * ry"), s("s * ry")).alias("spearman"))
    return ok.groupBy("feature").agg(guarded_corr(F.col("x"), F.col("y")).alias("pearson")).join(spearman, "feature")


def mode_share(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., top, share): the most frequent value (ties: smallest) and its share."""
    c = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return c.groupBy(*by).agg(F.max(F.struct("n", (-F.col(value)).alias("b"))).alias("m"), F.sum("n").alias("total")).select(*by, (-F.col("m.b")).alias("top"), (F.col("m.n") / F.col("total")).alias("share"))


def unpivot_lanes(wide: DataFrame, keys: list[str], groups: dict[int, list[str]], names: list[str]) -> DataFrame:
    """One row per lane whose first measure is positive: groups gives each lane's columns in the order of names."""
    rows = F.array(*[F.struct(F.lit(k).alias("lane"), *[F.col(c).alias(n) for c, n in zip(cols, names)]) for k, cols in groups.items()])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").where(F.col(names[0]) > 0)
