"""Evaluation beyond plain metrics: peaks, anomaly categories, effect sizes, patches and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.metrics import mae, rmse, valid


def accuracy(p: Column, t: Column) -> Column:
    """Share of equal labels among rows where both are known; null without any."""
    return F.avg(F.when(p.isNotNull() & t.isNotNull(), (p == t).cast("double")))


def metric_weight(t: Column, null_val: float | None = None) -> Column:
    """Number of targets that count: the weight with which a batch's mean error enters the whole."""
    return F.count_if(valid(t, null_val))


def nearest_peak_lag(peaks: DataFrame, window: int, source: str = "source", target: str = "target") -> DataFrame:
    """(node, peaks, matched, mean_lag, match_rate): each source peak's distance to the nearest target peak within the window.

    peaks has node, t and the two flags. The last target peak before and the next one after
    are carried along each node's order, so no peaks are joined by range.
    """
    w = Window.partitionBy("node").orderBy("t")
    at = F.when(F.col(target), F.col("t"))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    lag = F.least(F.col("t") - before, after - F.col("t"))
    s = peaks.withColumn("lag", lag).where(F.col(source)).select("node", F.when(F.col("lag") <= window, F.col("lag")).alias("lag"))
    return s.groupBy("node").agg(F.count("*").alias("peaks"), F.count("lag").alias("matched"), F.avg("lag").alias("mean_lag"), (F.count("lag") / F.count("*")).alias("match_rate"))


def category_impact(facts: DataFrame, categories: dict[str, Column], by: list[str]) -> DataFrame:
    """(by, category, n, share, mae, rmse, mae_without, mae_change): what each category of targets does to the error.

    mae_without leaves the category's targets out; one pass, all categories as columns.
    """
    p, t = F.col("pred"), F.col("target")
    ok = t.isNotNull() & p.isNotNull()
    flags = facts.where(ok).select(*by, "pred", "target", *[F.coalesce(c, F.lit(False)).alias(f"__{k}") for k, c in categories.items()])
    cells = []
    for k in categories:
        inside, only = F.col(f"__{k}"), lambda m, x: F.when(m, x)
        cells.append(F.struct(
            F.lit(k).alias("category"), F.count_if(inside).alias("n"), (F.count_if(inside) / F.count("*")).alias("share"), mae(p, only(inside, t), empty=None).alias("mae"), rmse(p, only(inside, t), empty=None).alias("rmse"),
            mae(p, only(~inside, t), empty=None).alias("mae_without"), (mae(p, only(~inside, t), empty=None) - mae(p, t, empty=None)).alias("mae_change"),
        ))
    return flags.groupBy(*by).agg(F.array(*cells).alias("__c")).select(*by, F.inline("__c"))


def cohen_d(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """(by, n_a, n_b, difference, d): difference of means of group true less false over their pooled deviation."""
    a, b = F.when(F.col(group), F.col(value)), F.when(~F.col(group), F.col(value))
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(F.try_divide((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b), na + nb - 2))
    return df.groupBy(*by).agg(na.alias("n_a"), nb.alias("n_b"), (F.avg(a) - F.avg(b)).alias("difference"), F.try_divide(F.avg(a) - F.avg(b), pooled).alias("d"))


def bootstrap_difference(df: DataFrame, key: str, value: str, group: str, rounds: int, seed: int = 0) -> DataFrame:
    """(low, high): 2.5 and 97.5 percentiles of the groups' mean difference over resampled rows.

    Every row enters every round a Poisson(1) number of times, by a hash of its key and the
    round: rows are weighted where they stand, so resampling needs no shuffle of rows.
    """
    u = F.pmod(F.xxhash64(key, "round", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    steps, at, p = [], 0.0, 2.718281828459045**-1
    for k in range(8):
        at += p
        steps.append(at)
        p /= k + 1
    times = sum((F.when(u >= s, 1).otherwise(0) for s in steps[1:]), F.when(u >= steps[0], 1).otherwise(0))
    rows = df.where(F.col(value).isNotNull()).select(key, value, group, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("__n", times)
    mean = lambda m: F.try_divide(F.sum(F.when(m, F.col("__n") * F.col(value))), F.sum(F.when(m, F.col("__n"))))
    each = rows.groupBy("round").agg((mean(F.col(group)) - mean(~F.col(group))).alias("difference"))
    return each.agg(F.percentile("difference", F.lit(0.025)).alias("low"), F.percentile("difference", F.lit(0.975)).alias("high"))


def ramp_mask(panel: DataFrame, q: float, train_end: int | None = None) -> DataFrame:
    """panel with ramp: the absolute change since the step before is at least the node's q quantile of such changes."""
    w = Window.partitionBy("node").orderBy("t")
    d = panel.withColumn("__d", F.abs(F.col("value") - F.lag("value").over(w)))
    known = d if train_end is None else d.where(F.col("t") < train_end)
    limits = known.groupBy("node").agg(F.percentile("__d", F.lit(q)).alias("__q"))
    return d.join(limits, "node", "left").withColumn("ramp", F.coalesce(F.col("__d") >= F.col("__q"), F.lit(False))).drop("__d", "__q")


def recent_drop(panel: DataFrame, lookback: int, share: float) -> DataFrame:
    """panel with drop: the value is below `share` of the largest of the `lookback` steps before."""
    w = Window.partitionBy("node").orderBy("t").rowsBetween(-lookback, -1)
    return panel.withColumn("drop", F.coalesce(F.col("value") < share * F.max("value").over(w), F.lit(False)))


def contextual_low(panel: DataFrame, period: int, q: float, train_end: int) -> DataFrame:
    """panel with low: the value is below the q quantile of the node's training values of the same phase of the period."""
    p = panel.withColumn("__phase", F.pmod("t", F.lit(period)))
    limits = p.where(F.col("t") < train_end).groupBy("node", "__phase").agg(F.percentile("value", F.lit(q)).alias("__q"))
    return p.join(limits, ["node", "__phase"], "left").withColumn("low", F.coalesce(F.col("value") < F.col("__q"), F.lit(False))).drop("__phase", "__q")


def patch_shift(facts: DataFrame, reach: DataFrame, keys: list[str], hops: int, patch: int, max_shift: int) -> DataFrame:
    """(keys, node, patch, exact, neighbour, shifted, shift): mean absolute error of each patch of `patch` steps.

    exact: against the node's own prediction; neighbour: the best prediction series among nodes
    within hops at zero shift; shifted: the best over shifts too, with its shift (ties: fewest
    hops away is not asked, the shorter and then the earlier shift). Only patches whose
    targets are all known, and shifts at which all predictions are, count.
    """
    w = Window.partitionBy(*keys, "node").orderBy("t")
    shifts = range(-max_shift, max_shift + 1)
    said = facts.select(*keys, F.col("node").alias("__near"), "t", *[(F.lead("pred", d) if d >= 0 else F.lag("pred", -d)).over(w).alias(f"__p{k}") for k, d in enumerate(shifts)])
    near = reach.where(F.col("hop") <= hops).select(F.col("src").alias("node"), F.col("dst").alias("__near"))
    true = facts.select(*keys, "node", "t", "target", F.floor(F.col("t") / patch).alias("patch"))
    cells = true.join(near, "node").join(said, [*keys, "__near", "t"])
    full = lambda c: F.when(F.count(F.abs(F.col(c) - F.col("target"))) == patch, F.avg(F.abs(F.col(c) - F.col("target"))))
    each = cells.groupBy(*keys, "node", "patch", "__near").agg(*[full(f"__p{k}").alias(f"__e{k}") for k, _ in enumerate(shifts)])
    options = F.array(*[F.struct(F.round(f"__e{k}", 9).alias("e"), F.lit(abs(d)).alias("size"), F.lit(d).alias("shift")) for k, d in enumerate(shifts)])
    best = F.min(F.array_min(F.filter(options, lambda x: x["e"].isNotNull())))
    zero = F.col(f"__e{max_shift}")
    out = each.groupBy(*keys, "node", "patch").agg(F.min(F.when(F.col("__near") == F.col("node"), zero)).alias("exact"), F.min(zero).alias("neighbour"), best.alias("__b"))
    return out.where("exact is not null").select(*keys, "node", "patch", "exact", "neighbour", F.col("__b.e").alias("shifted"), F.col("__b.shift").alias("shift"))


def slot_profile(readings: DataFrame, by: list[str], ts: Column, minutes: int, value: str) -> DataFrame:
    """(by, weekday, slot, total, n, mean): sums and counts of a value by weekday (Monday 0) and slot of the day."""
    slot = F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("int")
    return readings.groupBy(*by, F.weekday(ts).alias("weekday"), slot.alias("slot")).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.avg(value).alias("mean"))


def merge_profiles(profiles: DataFrame, by: list[str]) -> DataFrame:
    """Profiles of several files as one: sums and counts add up."""
    return profiles.groupBy(*by, "weekday", "slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))


def daily_profiles(panel: DataFrame, per_day: int) -> DataFrame:
    """(node, profile): mean value of each slot of the day, in order, null where a node never has one."""
    g = panel.groupBy("node", F.pmod("t", F.lit(per_day)).alias("slot")).agg(F.avg("value").alias("v"))
    return g.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "v"))), lambda x: x["v"]).alias("profile"))


def rolling_profile(panel: DataFrame, per_day: int, days: int) -> DataFrame:
    """(node, day, slot, value, expected, n): mean of the same slot over the `days` days before, and how many had it."""
    p = panel.select("node", F.floor(F.col("t") / per_day).alias("day"), F.pmod("t", F.lit(per_day)).alias("slot"), "value")
    w = Window.partitionBy("node", "slot").orderBy("day").rangeBetween(-days, -1)
    return p.withColumn("expected", F.avg("value").over(w)).withColumn("n", F.count("value").over(w))


def group_means(stats: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means of per-sensor statistics by group, with the number of sensors."""
    return stats.groupBy(*by).agg(F.count("*").alias("sensors"), *[F.avg(c).alias(c) for c in columns])


def degree_strata(degrees: DataFrame, strata: int) -> DataFrame:
    """(node, stratum): equal parts of the nodes in order of degree, then node, fixed on one reference graph.

    A node's place is the number of nodes of smaller degree plus its place among those of its
    degree, so no task orders more than the nodes of one degree.
    """
    per = degrees.groupBy("degree").agg(F.count("*").alias("n"))
    below = per.select("degree", (F.sum("n").over(Window.orderBy("degree")) - F.col("n")).alias("below"), F.sum("n").over(Window.partitionBy()).alias("all"))  # a row per degree
    at = degrees.join(below, "degree").withColumn("place", F.col("below") + F.row_number().over(Window.partitionBy("degree").orderBy("node")) - 1)
    big, rest = F.ceil(F.col("all") / strata), F.pmod(F.col("all"), F.lit(strata))
    rest = F.when(rest == 0, strata).otherwise(rest)
    small = F.floor(F.col("all") / strata)
    stratum = F.when(F.col("place") < rest * big, F.floor(F.col("place") / big)).otherwise(rest + F.floor((F.col("place") - rest * big) / F.greatest(small, F.lit(1))))
    return at.select("node", stratum.cast("int").alias("stratum"))


def strata_errors(facts: DataFrame, strata: DataFrame, model: str, reference: str) -> DataFrame:
    """(model, stratum, n, mae, delta): errors by stratum of the reference graph, and their change from the reference model."""
    e = facts.where("pred is not null and target is not null").join(strata, "node").groupBy(F.col(model).alias("model"), "stratum").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae"))
    base = e.where(F.col("model") == reference).select("stratum", F.col("mae").alias("__m"))
    return e.join(base, "stratum", "left").select("model", "stratum", "n", "mae", (F.col("mae") - F.col("__m")).alias("delta"))
