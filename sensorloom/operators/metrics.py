"""Forecast metrics as aggregate columns, with the dialects that differ in masks and denominators.

All take prediction p and target t as Columns; a null target is missing. With a null value
(the number that stands for missing), targets within a tolerance of it are masked.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 5e-5


def valid(t: Column, null_val: float | None = None, dialect: str = "close") -> Column:
    """Which targets count. close: within 5e-5 of null_val is masked; close_rel adds 1e-5 |null_val|; exact compares."""
    if null_val is None:
        return t.isNotNull()
    if dialect == "exact":
        return t.isNotNull() & (t != null_val)
    return t.isNotNull() & (F.abs(t - null_val) > EPS + (1e-5 * abs(null_val) if dialect == "close_rel" else 0.0))


def _mean(mask: Column, x: Column, empty: float | None = 0.0) -> Column:
    m = F.avg(F.when(mask, F.coalesce(x, F.lit(0.0))))
    return m if empty is None else F.coalesce(m, F.lit(empty))


def mae(p: Column, t: Column, null_val: float | None = None, dialect: str = "close", empty: float | None = 0.0) -> Column:
    return _mean(valid(t, null_val, dialect), F.abs(p - t), empty)


def mse(p: Column, t: Column, null_val: float | None = None, dialect: str = "close_rel", empty: float | None = 0.0) -> Column:
    return _mean(valid(t, null_val, dialect), (p - t) * (p - t), empty)


def rmse(p: Column, t: Column, null_val: float | None = None, dialect: str = "close_rel", empty: float | None = 0.0) -> Column:
    return F.sqrt(mse(p, t, null_val, dialect, empty))


def mape(p: Column, t: Column, null_val: float | None = None, dialect: str = "fraction", empty: float | None = 0.0, eps: float = EPS) -> Column:
    """fraction: |e|/|t| without targets near zero; percent: times 100, |t| > eps; signed: |e|/t, exact mask; or_one: zero targets divide by one."""
    if dialect == "percent":
        return _mean(valid(t) & (F.abs(t) > eps), 100 * F.try_divide(F.abs(p - t), F.abs(t)), None)
    if dialect == "signed":
        return _mean(valid(t, null_val, "exact"), F.try_divide(F.abs(p - t), t), empty)
    if dialect == "or_one":
        return _mean(valid(t), F.abs(p - t) / F.when(t == 0, 1.0).otherwise(F.abs(t)), empty)
    return _mean(valid(t, null_val) & (F.abs(t) > eps), F.try_divide(F.abs(p - t), F.abs(t)), empty)


def smape(p: Column, t: Column, null_val: float | None = None, empty: float | None = 0.0) -> Column:
    size = (F.abs(p) + F.abs(t)) / 2
    return _mean(valid(t, null_val) & (F.abs(t) > EPS), F.try_divide(F.abs(p - t), size), empty)


def pooled_wape(p: Column, t: Column, null_val: float | None = None) -> Column:
    """One ratio of all errors to all targets."""
    m = valid(t, null_val)
    return F.try_divide(F.sum(F.when(m, F.abs(p - t))), F.sum(F.when(m, F.abs(t))))


def huber(p: Column, t: Column, null_val: float | None = None, delta: float = 1.0) -> Column:
    """Mean over all rows, masked ones as zero."""
    e = F.abs(p - t)
    return F.avg(F.when(valid(t, null_val), F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))).otherwise(0.0))


METRICS: dict[str, Callable[..., Column]] = {"MAE": mae, "MSE": mse, "RMSE": rmse, "MAPE": mape, "SMAPE": smape, "WAPE": pooled_wape, "HUBER": huber}


def evaluate(facts: DataFrame, names: list[str], by: list[str], rollup: bool = True, null_val: float | None = None) -> DataFrame:
    """Registered metrics of facts (pred, target) by keys; rollup adds subtotals, keys null (one pass, partial sums)."""
    p, t = F.col("pred"), F.col("target")
    cols = [METRICS[n](p, t, null_val=null_val).alias(n.lower()) for n in names] + [F.count_if(valid(t, null_val)).alias("n")]
    return (facts.rollup(*by) if rollup else facts.groupBy(*by)).agg(*cols)


def series_wape(facts: DataFrame, series: list[str], null_val: float | None = None) -> DataFrame:
    """Mean over series of sum|e| / (sum|t| + 5e-5); masked elements are zero in both sums."""
    m = valid(F.col("target"), null_val)
    e = F.sum(F.when(m, F.abs(F.col("pred") - F.col("target"))).otherwise(0.0))
    one = facts.groupBy(*series).agg((e / (F.sum(F.when(m, F.abs("target")).otherwise(0.0)) + EPS)).alias("r"))
    return one.agg(F.avg("r").alias("wape"))


def series_r2(facts: DataFrame, series: list[str], null_val: float | None = None) -> DataFrame:
    """Mean over series of 1 - residual / total sums of squares (plus 5e-5); masked elements are zeros."""
    m = valid(F.col("target"), null_val)
    z = facts.select(*series, F.when(m, F.col("pred")).otherwise(0.0).alias("p"), F.when(m, F.col("target")).otherwise(0.0).alias("t"))
    one = z.groupBy(*series).agg((1 - F.sum((F.col("t") - F.col("p")) ** 2) / (F.var_pop("t") * F.count("*") + EPS)).alias("r"))
    return one.agg(F.avg("r").alias("r2"))


def guarded_corr(x: Column, y: Column, least: int = 3, default: float | None = None) -> Column:
    """Pearson from sums over pairs where both are known; default with fewer than `least` pairs or no variance."""
    ok = x.isNotNull() & y.isNotNull()
    n = F.count_if(ok)
    s = lambda e: F.sum(F.when(ok, e))
    return corr_of_sums(n, s(x), s(y), s(x * x), s(y * y), s(x * y), least, default)


def corr_of_sums(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column, least: int = 3, default: float | None = None) -> Column:
    """guarded_corr from the number of pairs and the sums over them."""
    vx, vy = n * xx - x * x, n * yy - y * y
    r = F.when((n >= least) & (vx > 1e-9) & (vy > 1e-9), F.try_divide(n * xy - x * y, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))))
    return r if default is None else F.coalesce(r, F.lit(default))


def seasonal_scales(train: DataFrame, period: int) -> DataFrame:
    """(node, scale_abs, scale_sq): mean absolute and squared change over a period; tiny ones are null."""
    w = Window.partitionBy("node").orderBy("t")
    d = train.withColumn("d", F.col("value") - F.lag("value", period).over(w))
    keep = lambda x: F.when(x > 1e-8, x)
    return d.groupBy("node").agg(keep(F.avg(F.abs("d"))).alias("scale_abs"), keep(F.avg(F.col("d") * F.col("d"))).alias("scale_sq"))


def scaled_errors(facts: DataFrame, scales: DataFrame) -> DataFrame:
    """MASE and RMSSE over all rows whose node has a scale."""
    e = F.abs(F.col("pred") - F.col("target"))
    return facts.where("target is not null").join(scales, "node").agg(
        F.avg(F.try_divide(e, "scale_abs")).alias("mase"), F.sqrt(F.avg(F.try_divide(e * e, "scale_sq"))).alias("rmsse")
    )


def worst_share(losses: DataFrame, by: list[str], share: float, loss: str = "loss") -> DataFrame:
    """Mean of the largest ceil(share * n) losses per key."""
    w = Window.partitionBy(*by)
    r = losses.where(F.col(loss).isNotNull()).withColumn("__k", F.row_number().over(w.orderBy(F.desc(loss)))).withColumn("__n", F.count("*").over(w))
    return r.where(F.col("__k") <= F.ceil(F.col("__n") * share)).groupBy(*by).agg(F.avg(loss).alias("worst"), F.count("*").alias("n"))


def wasserstein(facts: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute difference of the sorted predictions and the sorted targets per key."""
    ok = facts.where("pred is not null and target is not null")
    w = Window.partitionBy(*by)
    a = ok.select(*by, "pred", F.row_number().over(w.orderBy("pred")).alias("k"))
    b = ok.select(*by, "target", F.row_number().over(w.orderBy("target")).alias("k"))
    return a.join(b, [*by, "k"]).groupBy(*by).agg(F.avg(F.abs(F.col("pred") - F.col("target"))).alias("w1"))


def value_ranks(df: DataFrame, by: list[str], value: str, out: str = "rank", ascending: bool = True, parts: int = 64, times: str | None = None, counted: str | None = None) -> DataFrame:
    """(by, value, out, times if named: its rows): the rank from 1 of each distinct value of a key, ties sharing the mean of their places.

    Rows are counted by value first, unless df has each value once and how often it is there
    in the column `counted`. Approximate quantiles deal a key's values into parts, so
    that no task orders all of a key; a part's ranks start after the counts of the parts
    before it, a few numbers for each key.
    """
    c = df.select(*by, value, F.col(counted).alias("__n")) if counted else df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    cuts = [k / parts for k in range(1, parts)]
    bounds = c.groupBy(*by).agg(F.percentile_approx(value, cuts, 1000).alias("__q"))
    part = F.size(F.filter(F.coalesce("__q", F.array().cast(dict(bounds.dtypes)["__q"])), lambda x: x < F.col(value)))
    d = c.join(bounds, by).withColumn("__b", F.coalesce(part, F.lit(0))).drop("__q")
    order = lambda x: F.col(x).asc() if ascending else F.col(x).desc()
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = d.withColumn("__i", before(Window.partitionBy(*by, "__b").orderBy(order(value))))
    start = d.groupBy(*by, "__b").agg(F.sum("__n").alias("__n")).withColumn("__s", before(Window.partitionBy(*by).orderBy(order("__b")))).drop("__n")
    return inside.join(start, [*by, "__b"]).select(*by, value, (F.col("__s") + F.col("__i") + (F.col("__n") + 1) / 2).alias(out), *([F.col("__n").alias(times)] if times else []))


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], out: str = "q") -> DataFrame:
    """(by, out): exact quantiles of a key's values as an array, linear between neighbours; nulls are left out, and a key without other values has null.

    Values are counted, and value_ranks places each of them: sketches only deal values to
    tasks, counts decide. A place next to a wanted one adds its value by its weight, so memory
    does not grow with a key, and a scope without keys is dealt over tasks like any other.
    """
    key = by or ["__one"]
    rows = df.where(F.col(value).isNotNull()).select(*by, value)
    rows = rows if by else rows.withColumn("__one", F.lit(1))
    r = value_ranks(rows, key, value, "__rank", times="__times")
    n = r.groupBy(*key).agg(F.sum("__times").alias("__all"))
    low = F.col("__rank") - (F.col("__times") + 1) / 2
    holds = lambda k: (low <= k) & (k < low + F.col("__times"))

    def one(p: float) -> Column:
        at = F.lit(float(p)) * (F.col("__all") - 1)
        k = F.floor(at)
        share = F.when(holds(k), 1 - (at - k)).otherwise(0.0) + F.when(holds(k + 1), at - k).otherwise(0.0)
        return F.sum(F.when(share > 0, F.col(value).cast("double") * share))

    found, q = r.join(n, key), F.array(*[one(p) for p in probs]).alias(out)
    return df.select(*by).distinct().join(found.groupBy(*by).agg(q), by, "left") if by else found.agg(q)


def average_rank(df: DataFrame, by: list[str], value: str, out: str = "rank", ascending: bool = True) -> DataFrame:
    """Ranks from 1, ties sharing the mean of their places.

    Values that hold more than a thousandth of all rows are broadcast (there are a thousand at
    most), so that no frequent value is the key of a shuffle.
    """
    r = value_ranks(df, by, value, out, ascending, times="__times")
    often = F.col("__times") * 1000 > df.count()

    def on(a: str, b: str) -> Column:
        same = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*by, value]]
        return reduce(lambda x, y: x & y, same)

    hot, rest = F.broadcast(r.where(often)), r.where(~often)
    x = df.alias("__x")
    found = x.join(hot.alias("__r"), on("__x", "__r")).select("__x.*", F.col(f"__r.{out}"))
    left = x.join(hot.alias("__h"), on("__x", "__h"), "left_anti").alias("__y")
    return found.unionByName(left.join(rest.alias("__r"), on("__y", "__r")).select("__y.*", F.col(f"__r.{out}")))


def kendall(ranks: DataFrame, item: str, a: str, b: str, by: list[str]) -> DataFrame:
    """Kendall's tau of two rankings over pairs of items, tied pairs left out."""
    x, y = ranks.alias("x"), ranks.alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in by] + [F.col(f"x.{item}") < F.col(f"y.{item}")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    s = F.signum((F.col(f"x.{a}") - F.col(f"y.{a}")) * (F.col(f"x.{b}") - F.col(f"y.{b}")))
    return x.join(y, cond).groupBy(*[F.col(f"x.{c}").alias(c) for c in by]).agg(F.try_divide(F.sum(s), F.sum(F.abs(s))).alias("tau"))


def precision_recall(hit: Column, said: Column) -> dict[str, Column]:
    """precision, recall and f1 of a predicted flag against a true one."""
    tp, np_, nt = F.count_if(hit & said), F.count_if(said), F.count_if(hit)
    return {
        "precision": F.coalesce(F.try_divide(tp, np_), F.lit(0.0)), "recall": F.coalesce(F.try_divide(tp, nt), F.lit(0.0)), "f1": F.coalesce(F.try_divide(2 * tp, np_ + nt), F.lit(0.0)),
    }
