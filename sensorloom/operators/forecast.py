"""Naive forecasts over a dense panel: long rows (origin, horizon, node, target, pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def _steps() -> WindowSpec:
    return Window.partitionBy("node").orderBy("t")


def targets(panel: DataFrame, horizons: list[int], first: int) -> DataFrame:
    """(node, t, horizon, origin, target): targets from step `first` on, seen from `horizon` steps before."""
    return panel.where(F.col("t") >= first).select("node", "t", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"), F.col("value").alias("target")).withColumn("origin", F.col("t") - F.col("horizon"))


def _at(panel: DataFrame, name: str) -> DataFrame:
    return panel.select("node", F.col("t").alias("__t"), F.col("value").alias(name))


def previous_step(facts: DataFrame, panel: DataFrame, out: str = "pred") -> DataFrame:
    """The last known value at the origin or before."""
    last = panel.select("node", F.col("t").alias("origin"), F.last("value", ignorenulls=True).over(_steps().rowsBetween(Window.unboundedPreceding, 0)).alias(out))
    return facts.join(last, ["node", "origin"], "left")


def seasonal(facts: DataFrame, panel: DataFrame, period: int, fallback: Column | None = None, out: str = "pred") -> DataFrame:
    """The value a period before the target, else the fallback."""
    j = facts.withColumn("__t", F.col("t") - period).join(_at(panel, "__v"), ["node", "__t"], "left")
    return j.withColumn(out, F.coalesce("__v", fallback) if fallback is not None else F.col("__v")).drop("__v", "__t")


def slot_statistic(facts: DataFrame, train: DataFrame, slots: int, stat: str = "median", out: str = "pred") -> DataFrame:
    """Median or mean of the training values of the target's slot and node, else of all the node's values."""
    f = {"median": F.median, "mean": F.avg}[stat]
    by_slot = train.groupBy("node", F.pmod("t", F.lit(slots)).alias("__s")).agg(f("value").alias("__a"))
    whole = train.groupBy("node").agg(f("value").alias("__b"))
    j = facts.withColumn("__s", F.pmod("t", F.lit(slots))).join(by_slot, ["node", "__s"], "left").join(whole, "node", "left")
    return j.withColumn(out, F.coalesce("__a", "__b")).drop("__s", "__a", "__b")


def constant(facts: DataFrame, train: DataFrame, stat: str = "median", per_node: bool = True, out: str = "pred") -> DataFrame:
    """A statistic of the training values, per node or over all: mean, median, or low_median (the lower middle value)."""
    f = {"mean": F.avg("value"), "median": F.median("value"), "low_median": F.expr("percentile_disc(0.5) within group (order by value)")}[stat]
    if per_node:
        return facts.join(train.groupBy("node").agg(f.alias(out)), "node", "left")
    return facts.crossJoin(F.broadcast(train.agg(f.alias(out))))


def mean_by_turn(train: DataFrame, mask: DataFrame) -> DataFrame:
    """mask (node, turn, observed) with pred and source: the mean of the training values (node, turn, value) of an observed pair; else that of the observed nodes of its turn; else that of all nodes of its turn.

    source says which of node, observed and turn it is, null where a turn has no value. An
    observed pair without a value is treated like one not observed. Nulls are skipped.
    """
    v = train.where("value is not null").groupBy("node", "turn").agg(F.sum("value").alias("__s"), F.count("*").alias("__n"))
    known = mask.select("node", "turn", F.coalesce("observed", F.lit(False)).alias("observed"))
    seen = v.join(known.where("observed").select("node", "turn").distinct(), ["node", "turn"], "left_semi").withColumn("__o", F.lit(True))
    all_ = v.join(seen.select("node", "turn", "__o"), ["node", "turn"], "left")
    own = F.try_divide(F.sum(F.when(F.col("__o"), F.col("__s"))), F.sum(F.when(F.col("__o"), F.col("__n"))))
    turns = all_.groupBy("turn").agg(own.alias("__b"), F.try_divide(F.sum("__s"), F.sum("__n")).alias("__c"))
    j = known.join(seen.select("node", "turn", (F.col("__s") / F.col("__n")).alias("__a")), ["node", "turn"], "left").join(turns, "turn", "left")
    source = F.when(F.col("__a").isNotNull(), "node").when(F.col("__b").isNotNull(), "observed").when(F.col("__c").isNotNull(), "turn")
    return j.select("node", "turn", "observed", F.coalesce("__a", "__b", "__c").alias("pred"), source.alias("source"))


def moving_average(panel: DataFrame, window: int, out: str = "pred") -> DataFrame:
    """Mean of the known values of the `window` steps before each step."""
    return panel.withColumn(out, F.avg("value").over(_steps().rowsBetween(-window, -1)))


def rolling_mean(panel: DataFrame, window: int, out: str = "rolled") -> DataFrame:
    """Trailing mean, null until the window is full."""
    w = _steps().rowsBetween(1 - window, 0)
    return panel.withColumn(out, F.when(F.count("value").over(w) == window, F.avg("value").over(w)))


def centered_average(panel: DataFrame, window: int, steps: int) -> DataFrame:
    """(low, high): centred mean with the edge values repeated, and the remainder."""
    left = (window - 1) // 2
    right = window - 1 - left
    inner = F.sum("value").over(_steps().rowsBetween(-left, right))
    whole = _steps().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low = (inner + F.greatest(left - F.col("t"), F.lit(0)) * F.first("value").over(whole) + F.greatest(F.col("t") + right - (steps - 1), F.lit(0)) * F.last("value").over(whole)) / window
    return panel.withColumn("low", low).withColumn("high", F.col("value") - low)


def first_difference(panel: DataFrame, out: str = "diff") -> DataFrame:
    return panel.withColumn(out, F.col("value") - F.lag("value").over(_steps())).where(F.col("t") > 0)


def residualize(panel: DataFrame, slots: int | None = None, out: str = "residual") -> DataFrame:
    """Value less the node's mean, or less the mean of the node's slot."""
    keys = ["node"] if slots is None else ["node", F.pmod("t", F.lit(slots))]
    return panel.withColumn(out, F.col("value") - F.avg("value").over(Window.partitionBy(*keys)))


def dilate(flagged: DataFrame, flag: str, steps: int, out: str = "near") -> DataFrame:
    """True where the flag is true within `steps` steps."""
    return flagged.withColumn(out, F.max(F.col(flag)).over(_steps().rowsBetween(-steps, steps)))
