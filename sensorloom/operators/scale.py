"""Scalers: statistics of the training part, applied to all rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.metrics import exact_quantiles


def _guard(x: Column, eps: float) -> Column:
    return F.when(F.abs(x) <= eps, 1.0).otherwise(x)


def fit(train: DataFrame, kind: str, by: list[str], value: str = "value", eps: float = 0.0) -> DataFrame:
    """(by..., center, spread) of a scaler: z (population), sample_z, minmax, minmax_raw (no zero guard) or robust."""
    v = F.col(value)
    if kind == "robust":
        return exact_quantiles(train, by, value, [0.25, 0.5, 0.75]).select(*by, F.col("q")[1].alias("center"), _guard(F.col("q")[2] - F.col("q")[0], eps).alias("spread"))
    center, spread = {
        "z": (F.avg(v), F.stddev_pop(v)), "sample_z": (F.avg(v), F.stddev_samp(v)), "minmax": (F.min(v), F.max(v) - F.min(v)), "minmax_raw": (F.min(v), F.max(v) - F.min(v)),
    }[kind]
    out = train.groupBy(*by).agg(center.alias("center"), spread.alias("spread"))
    return out if kind == "minmax_raw" else out.withColumn("spread", _guard(F.col("spread"), eps))


def apply(df: DataFrame, params: DataFrame, by: list[str], value: str = "value", out: str = "scaled") -> DataFrame:
    """Scale with fitted parameters (one row per key, joined); a zero spread gives null."""
    p = params.select(*by, F.col("center").alias("__c"), F.col("spread").alias("__s"))
    joined = df.join(p, by) if by else df.crossJoin(F.broadcast(p))
    return joined.withColumn(out, F.try_divide(F.col(value) - F.col("__c"), F.col("__s"))).drop("__c", "__s")


def invert(df: DataFrame, params: DataFrame, by: list[str], value: str = "scaled", out: str = "value_back") -> DataFrame:
    p = params.select(*by, F.col("center").alias("__c"), F.col("spread").alias("__s"))
    joined = df.join(p, by) if by else df.crossJoin(F.broadcast(p))
    return joined.withColumn(out, F.col(value) * F.col("__s") + F.col("__c")).drop("__c", "__s")


def shape_z(panel: DataFrame, keys: list[str], value: str = "value", eps: float = 1e-6, out: str = "shape") -> DataFrame:
    """Z-score within each profile, the spread at least eps."""
    w = Window.partitionBy(*keys)
    return panel.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.greatest(F.stddev_pop(value).over(w), F.lit(eps)))


def quantile_knots(train: DataFrame, by: list[str], n: int, value: str = "value") -> DataFrame:
    """n evenly spaced quantiles per key, as an array."""
    return exact_quantiles(train, by, value, [k / (n - 1) for k in range(n)], "knots")


def _position(knots: Column, x: Column, right: bool) -> Column:
    """Linear position of x on the knots (0 to 1), by how many knots are below it."""
    n = F.size(knots)
    below = F.size(F.filter(knots, (lambda k: k <= x) if right else (lambda k: k < x)))
    lo = F.greatest(F.least(below, n - 1), F.lit(1))
    a, b = F.element_at(knots, lo), F.element_at(knots, lo + 1)
    inside = (lo - 1 + F.coalesce(F.try_divide(x - a, b - a), F.lit(0.0))) / (n - 1)
    return F.when(x <= knots[0], 0.0).when(x >= F.element_at(knots, -1), 1.0).otherwise(inside)


def quantile_transform(df: DataFrame, knots: DataFrame, by: list[str], value: str = "value", out: str = "uniform") -> DataFrame:
    """Empirical distribution function on the knots: the mean of the positions from the left and from the right."""
    j = df.join(knots, by) if by else df.crossJoin(F.broadcast(knots))
    x = F.col(value)
    return j.withColumn(out, F.when(x.isNotNull(), (_position(F.col("knots"), x, True) + _position(F.col("knots"), x, False)) / 2)).drop("knots")


def outlier_bounds(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Values beyond 1.5 interquartile ranges of the quartiles: bounds and counts per key."""
    b = exact_quantiles(df, by, value, [0.25, 0.75]).select(*by, (F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("low"), (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("high"))
    return df.join(b, by).groupBy(*by, "low", "high").agg(F.count_if((F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).alias("outliers"), F.count(value).alias("n"))
