"""Sliding windows, explicit splits, seasonal shifts and coreset strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sensorloom.operators.metrics import exact_quantiles


def _steps() -> WindowSpec:
    return Window.partitionBy("node").orderBy("t")


def sliding(panel: DataFrame, history: int, horizon: int) -> DataFrame:
    """(node, t, past, future): arrays of the history steps up to t and of the horizon steps after; full windows only."""
    w = panel.select(
        "node", "t", F.collect_list(F.struct("value")).over(_steps().rowsBetween(1 - history, 0)).alias("past"), F.collect_list(F.struct("value")).over(_steps().rowsBetween(1, horizon)).alias("future")
    )
    full = w.where((F.size("past") == history) & (F.size("future") == horizon))
    return full.select("node", "t", F.col("past.value").alias("past"), F.col("future.value").alias("future"))


def window_count(steps: int, history: int, horizon: int) -> int:
    return max(0, steps - history - horizon + 1)


def copy_history(windows: DataFrame, horizon: int, reverse: bool = False) -> DataFrame:
    """Persistence: the last `horizon` values of the history as the forecast."""
    tail = F.slice("past", -horizon, horizon)
    return windows.withColumn("pred", F.reverse(tail) if reverse else tail)


def split_starts(split: DataFrame, label: str, history: int, horizon: int, context: bool) -> DataFrame:
    """Steps t whose horizon [t, t + horizon) lies in the split; the history before it too unless context is given."""
    w = Window.orderBy("t")
    inside = (F.col("split") == label).cast("int")
    # Split tables have one row per time step, so their single ordered partition stays small.
    s = split.select(
        "t", F.sum(F.coalesce(inside, F.lit(0))).over(w.rowsBetween(0, horizon - 1)).alias("ahead"), F.sum(F.coalesce(inside, F.lit(0))).over(w.rowsBetween(-history, -1)).alias("behind")
    )
    ok = (F.col("ahead") == horizon) & (F.col("t") >= history)
    return s.where(ok if context else ok & (F.col("behind") == history)).select("t")


def seasonal_shifts(direct: int, period: int, seasons: int, horizon: int) -> list[int]:
    """Direct lookback 0..-(direct-1) and, for each season back, the steps that precede the horizon; descending."""
    found = {-k for k in range(direct)} | {-period * j + h for j in range(1, seasons + 1) for h in range(1, horizon + 1)}
    return sorted((s for s in found if s <= 0), reverse=True)


def gather_shifts(panel: DataFrame, shifts: list[int]) -> DataFrame:
    """(node, t, shift, value, missing): values at t + shift, clipped to step 0 where that is negative and marked missing there."""
    want = panel.select("node", "t", F.explode(F.array(*map(F.lit, shifts))).alias("shift")).withColumn("at", F.greatest(F.col("t") + F.col("shift"), F.lit(0)))
    have = panel.select("node", F.col("t").alias("at"), "value")
    return want.join(have, ["node", "at"], "left").select("node", "t", "shift", "value", ((F.col("t") + F.col("shift") < 0) | F.col("value").isNull()).alias("missing"))


def drop_empty_horizons(panel: DataFrame, horizon: int) -> DataFrame:
    """Steps t where any node has a value within the horizon after t."""
    seen = panel.select("t", F.count("value").over(_steps().rowsBetween(1, horizon)).alias("n"), F.count("*").over(_steps().rowsBetween(1, horizon)).alias("m"))
    return seen.where(F.col("m") == horizon).groupBy("t").agg(F.sum("n").alias("n")).where("n > 0").select("t", "n")


def difficulty(panel: DataFrame, history: int, horizon: int) -> DataFrame:
    """(t, score): mean absolute change from the last history value over the horizon and all nodes; t begins the window."""
    last = F.col("past")[history - 1]
    s = sliding(panel, history, horizon).select((F.col("t") - history + 1).alias("t"), F.explode(F.transform("future", lambda f: F.abs(f - last))).alias("d"))
    return s.groupBy("t").agg(F.avg("d").alias("score"))


def strata(scores: DataFrame, history: int, period: int) -> DataFrame:
    """Temporal phase and difficulty tercile (0, 1, 2; a value on a bound goes up) of windows."""
    q = exact_quantiles(scores, [], "score", [1 / 3, 2 / 3])
    return scores.crossJoin(F.broadcast(q)).select(
        "t", "score", F.pmod(F.col("t") + history, F.lit(period)).alias("phase"), ((F.col("score") >= F.col("q")[0]).cast("int") + (F.col("score") >= F.col("q")[1]).cast("int")).alias("tercile")
    )


def allocate(sizes: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Largest-remainder shares of a budget by stratum size; ties by size, then key."""
    total = F.sum("n").over(Window.partitionBy())
    exact = F.lit(budget) * F.col("n") / total
    a = sizes.withColumn("__floor", F.floor(exact)).withColumn("__rest", exact - F.floor(exact))
    left = F.lit(budget) - F.sum("__floor").over(Window.partitionBy())
    order = F.row_number().over(Window.orderBy(F.desc(F.round("__rest", 9)), F.desc("n"), *keys))
    extra = (F.col("__k") <= F.col("__left")).cast("int")
    return a.withColumn("__left", left).withColumn("__k", order).select(*keys, "n", (F.col("__floor") + extra).alias("budget"))


def hashed_choice(df: DataFrame, by: list[str], key: Column, limit: Column) -> DataFrame:
    """The first `limit` rows of each key in the order of a hash: a fixed random choice."""
    w = Window.partitionBy(*by).orderBy(F.md5(key.cast("string")))
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= limit).drop("__k")
