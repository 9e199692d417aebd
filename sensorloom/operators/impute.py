"""Missing data: fills and interpolation along a node's dense steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def _back() -> WindowSpec:
    return Window.partitionBy("node").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _ahead() -> WindowSpec:
    return Window.partitionBy("node").orderBy("t").rowsBetween(Window.currentRow, Window.unboundedFollowing)


def forward_fill(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(_back())


def backward_fill(value: Column) -> Column:
    return F.first(value, ignorenulls=True).over(_ahead())


def fill_both(panel: DataFrame, out: str = "filled", default: float = 0.0) -> DataFrame:
    """Forward, then backward, then a constant."""
    v = F.col("value")
    return panel.withColumn(out, F.coalesce(forward_fill(v), backward_fill(v), F.lit(default)))


def interpolate(panel: DataFrame, out: str = "filled", default: float | None = None) -> DataFrame:
    """Linear by step number between known values; edges take the nearest known value."""
    v = F.col("value")
    at = F.when(v.isNotNull(), F.col("t"))
    p = panel.select(
        "*", forward_fill(v).alias("__v0"), backward_fill(v).alias("__v1"),
        F.last(at, ignorenulls=True).over(_back()).alias("__t0"), F.first(at, ignorenulls=True).over(_ahead()).alias("__t1"),
    )
    inner = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.try_divide(F.col("t") - F.col("__t0"), F.col("__t1") - F.col("__t0"))
    return p.withColumn(out, F.coalesce(v, inner, "__v0", "__v1", F.lit(default).cast("double"))).drop("__v0", "__v1", "__t0", "__t1")


def fill_previous(panel: DataFrame, out: str = "filled") -> DataFrame:
    """Nodes without any value take the mean of the step over the other nodes; then forward, then backward fill."""
    known = F.count("value").over(Window.partitionBy("node"))
    step = F.avg("value").over(Window.partitionBy("t"))
    p = panel.withColumn("__v", F.when(known == 0, step).otherwise(F.col("value")))
    return p.withColumn(out, F.coalesce(forward_fill(F.col("__v")), backward_fill(F.col("__v")))).drop("__v")


def fill_mean(panel: DataFrame, out: str = "filled") -> DataFrame:
    return panel.withColumn(out, F.coalesce("value", F.avg("value").over(Window.partitionBy("node")), F.lit(0.0)))


def fill_constant(panel: DataFrame, constant: float, out: str = "filled") -> DataFrame:
    return panel.withColumn(out, F.coalesce("value", F.lit(constant)))


def gap_report(panel: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: nulls, their percent (2 places), values, blank texts, percent valid."""
    n = F.count("*")
    parts = []
    for c in columns:
        blank = F.count_if(F.trim(F.col(c).cast("string")) == "")
        nulls = F.count_if(F.col(c).isNull())
        parts.append(F.struct(
            F.lit(c).alias("field"), nulls.alias("nulls"), F.round(100 * nulls / n, 2).alias("null_pct"), (n - nulls).alias("present"), blank.alias("blank"),
            F.round(100 * (n - nulls - blank) / n, 2).alias("valid_pct"),
        ))
    return panel.agg(F.array(*parts).alias("r")).select(F.inline("r"))
