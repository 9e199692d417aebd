"""Panels: dense (node, t) grids from readings, calendar features, resampling and splits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.storage import numbered


def dense_panel(readings: DataFrame, node: str, ts: str, value: Column, unit: str = "hour") -> DataFrame:
    """(node, t, ts, value): one row per node and time step from the first to the last step; gaps are null.

    value is an aggregate over a step. The grid is nodes x steps and joins the readings'
    partial aggregates, so only aggregated rows are shuffled.
    """
    g = readings.groupBy(F.col(node).alias("node"), F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("ts")).agg(value.alias("value"))
    bounds = g.agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    grid = g.select("node").distinct().crossJoin(F.broadcast(bounds)).select("node", F.posexplode(F.expr(f"sequence(a, z, interval 1 {unit})")).alias("t", "ts"))
    return grid.withColumn("t", F.col("t").cast("long")).join(g, ["node", "ts"], "left").select("node", "t", "ts", "value")


def calendar(ts: str = "ts") -> dict[str, Column]:
    """Calendar features: time of day, day of week (Monday 0), of month and of year, month; as fractions."""
    c = F.col(ts)
    return {
        "tod": (F.hour(c) * 60 + F.minute(c)) / 1440,
        "dow": F.weekday(c) / 7,
        "dom": (F.dayofmonth(c) - 1) / 31,
        "doy": (F.dayofyear(c) - 1) / 366,
        "moy": F.month(c) / 12,
        "week_in_year": F.floor((F.dayofyear(c) - 1) / 7),
    }


def slot(ts: Column, minutes: int) -> Column:
    """Index of the step within the day."""
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("int")


def epoch_features(seconds: Column) -> dict[str, Column]:
    """Time of day and day of week (Monday 0) as fractions, by arithmetic on Unix seconds."""
    return {"tod": F.pmod(seconds, F.lit(86400)) / 86400, "dow": F.pmod(F.floor(seconds / 86400) + 3, F.lit(7)) / 7}


def cyclic(code: Column, period: int) -> tuple[Column, Column]:
    """sin and cos of an integer code on a circle of `period` steps."""
    angle = 2 * F.pi() * code / period
    return F.sin(angle), F.cos(angle)


def one_hot(code: Column, levels: list[int], prefix: str) -> list[Column]:
    return [(code == k).cast("int").alias(f"{prefix}_{k}") for k in levels]


def encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Dense integer code of a column's sorted distinct values (0 based).

    Only the distinct values are ordered, in ranges, and joined back.
    """
    codes = numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), [F.asc(column)], out).withColumn(out, F.col(out).cast("int"))
    return df.join(codes, column, "left")


def auto_periods(days: float) -> list[str]:
    """Periods worth encoding for a training span: the day, then the week, month and year as the span allows."""
    return ["day"] + ["week"] * (days >= 5) + ["month"] * (days >= 14) + ["year"] * (days >= 730)


def parse_minutes(resolution: str | int) -> int:
    """15, '15', '15min', '1h', '2hours', '1d' as minutes."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", str(resolution))
    if not m:
        raise ValueError(f"bad resolution {resolution!r}")
    unit = m[2].lower().rstrip("s")
    factor = {"": 1, "m": 1, "min": 1, "minute": 1, "t": 1, "h": 60, "hr": 60, "hour": 60, "d": 1440, "day": 1440}.get(unit)
    if not factor or not int(m[1]):
        raise ValueError(f"bad resolution {resolution!r}")
    return int(m[1]) * factor


def check_multiple(native: int, target: int) -> int:
    """How many native steps a target step has; an error unless a whole number."""
    if target < native or target % native:
        raise ValueError(f"{target} minutes are no multiple of {native}")
    return target // native


def infer_minutes(panel: DataFrame, ts: str = "ts", node: str = "node") -> DataFrame:
    """Median of the positive steps between a node's timestamps, in minutes, as one row."""
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    step = seconds - F.lag(seconds).over(Window.partitionBy(node).orderBy(ts))
    return panel.select(step.alias("d")).where("d > 0").agg((F.median("d") / 60).alias("minutes"))


def resample(panel: DataFrame, factor: int, how: str = "mean", complete: bool = False) -> DataFrame:
    """(node, t, value, n) of `factor` steps each, by mean or sum; complete keeps only full buckets."""
    agg = {"mean": F.avg, "sum": F.sum}[how]
    out = panel.groupBy("node", F.floor(F.col("t") / factor).alias("t")).agg(agg("value").alias("value"), F.count("*").alias("n"))
    return out.where(F.col("n") == factor) if complete else out


def resample_split(panel: DataFrame, split: DataFrame, factor: int, how: str = "mean") -> DataFrame:
    """Resampling that keeps only buckets whose steps all have one split label; t is renumbered over kept buckets."""
    agg = {"mean": F.avg, "sum": F.sum}[how]
    labels = split.groupBy(F.floor(F.col("t") / factor).alias("bucket")).agg(F.count_distinct("split").alias("kinds"), F.count("split").alias("labelled"), F.max("split").alias("split"))
    pure = labels.where((F.col("kinds") == 1) & (F.col("labelled") == factor)).select("bucket", "split")
    numbered = pure.withColumn("t", (F.row_number().over(Window.orderBy("bucket")) - 1).cast("long"))
    value = panel.withColumn("bucket", F.floor(F.col("t") / factor)).groupBy("node", "bucket").agg(agg("value").alias("value"))
    return value.join(numbered, "bucket").select("node", "t", "bucket", "split", "value")


def ratio_split(steps: int, valid: float, test: float) -> tuple[int, int]:
    """(first validation step, first test step): validation and test by whole parts, training takes the rest."""
    v, s = int(steps * valid), int(steps * test)
    return steps - v - s, steps - s


def leading_split(steps: int, train: float, valid: float) -> tuple[int, int]:
    """Training and validation by whole parts, test takes the rest."""
    a = int(steps * train)
    return a, a + int(steps * valid)


def window_split(steps: int, history: int, horizon: int, train: float, test: float) -> tuple[int, int, int]:
    """Windows for training, validation and test: counts are rounded half to even."""
    n = steps - history - horizon + 1
    a, c = round(n * train), round(n * test)
    return a, n - a - c, c


def label_split(t: Column, cuts: tuple[int, int]) -> Column:
    return F.when(t < cuts[0], "train").when(t < cuts[1], "valid").otherwise("test")


def recent_train(t: Column, cuts: tuple[int, int], keep: int) -> Column:
    """The same split with only the last `keep` training steps."""
    return F.when((t >= cuts[0] - keep) & (t < cuts[0]), "train").when(t >= cuts[0], F.when(t < cuts[1], "valid").otherwise("test"))


def day_window(panel: DataFrame, per_day: int, first: int, days: int) -> DataFrame:
    return panel.where(F.col("t").between(first * per_day, (first + days) * per_day - 1))


def trim_null_edges(panel: DataFrame) -> DataFrame:
    """Drop leading and trailing steps at which any node is null; inner gaps stay."""
    full = panel.groupBy("t").agg(F.count_if(F.col("value").isNull()).alias("gaps")).where("gaps = 0").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    return panel.join(F.broadcast(full), (F.col("t") >= F.col("a")) & (F.col("t") <= F.col("z"))).drop("a", "z")


def every_kth(panel: DataFrame, k: int) -> DataFrame:
    return panel.where(F.pmod(F.col("t"), F.lit(k)) == 0)


def evenly_spaced(panel: DataFrame, steps: int, n: int) -> DataFrame:
    """At most n steps, evenly spaced from first to last."""
    at = sorted({int(k * (steps - 1) / max(n - 1, 1)) for k in range(n)}) if steps > n else list(range(steps))
    return panel.where(F.col("t").isin(at))


def scrub(value: Column) -> Column:
    """NaN and infinities to null."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def active_nodes(panel: DataFrame, rule: str, train_end: int, eps: float = 0.0, support: int = 24) -> DataFrame:
    """Panel of the nodes that a rule keeps: all, train_nonzero, train_support or any_nonzero."""
    if rule == "all":
        return panel
    used = F.col("value") > eps
    test = {"train_nonzero": F.count_if(used & (F.col("t") < train_end)) > 0, "train_support": F.count_if(used & (F.col("t") < train_end)) >= support, "any_nonzero": F.count_if(used) > 0}[rule]
    return panel.join(panel.groupBy("node").agg(test.alias("keep")).where("keep").select("node"), "node", "left_semi")
