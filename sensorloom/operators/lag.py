"""Lagged correlation, delays, causal scores and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.metrics import guarded_corr, value_ranks


def lag_scores(signal: DataFrame, edges: DataFrame, max_lag: int, extra: list[str] | None = None, circular: int | None = None) -> DataFrame:
    """(src, dst, lag, corr, n) of x[src, t] with x[dst, t + lag], lags 0..max_lag; circular wraps t at that length.

    Every source value is sent to its edges and lags once, and meets its target in one
    equi-join; correlations are sums, so partial aggregation keeps the shuffle small.
    """
    keys = extra or []
    a = signal.select(*keys, F.col("node").alias("src"), "t", F.col("value").alias("x"))
    b = signal.select(*keys, F.col("node").alias("dst"), F.col("t").alias("__t"), F.col("value").alias("y"))
    at = F.col("t") + F.col("lag")
    s = edges.select("src", "dst").join(a, "src").withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).withColumn("__t", F.pmod(at, F.lit(circular)) if circular else at)
    j = s.join(b, [*keys, "dst", "__t"])
    return j.groupBy(*keys, "src", "dst", "lag").agg(guarded_corr(F.col("x"), F.col("y")).alias("corr"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n"))


def best_lag(scores: DataFrame, by: list[str], absolute: bool = False, digits: int = 9) -> DataFrame:
    """(by..., lag, corr, improvement): the best correlation, the first lag on ties; improvement over lag 0."""
    s = F.abs("corr") if absolute else F.col("corr")
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(F.round(s, digits)), "lag")
    zero = F.max(F.when(F.col("lag") == 0, s)).over(Window.partitionBy(*by))
    r = scores.withColumn("__k", F.row_number().over(w)).withColumn("improvement", s - zero)
    return r.where("__k = 1").select(*by, "lag", "corr", "improvement")


def delay_summary(lags: DataFrame, by: list[str], column: str = "lag") -> DataFrame:
    """mean, sample deviation, median, 90 % quantile and maximum of delays."""
    v = F.col(column)
    return lags.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.percentile(v, F.lit(0.5)).alias("p50"), F.percentile(v, F.lit(0.9)).alias("p90"), F.max(v).alias("max"))


def phase(signal: DataFrame, edges: DataFrame, period: int) -> DataFrame:
    """(src, dst, delay): steps by which dst trails src at one period, from its Fourier coefficient."""
    angle = 2 * F.pi() * F.col("t") / period
    f = signal.where("value is not null").groupBy("node").agg(F.sum(F.col("value") * F.cos(angle)).alias("re"), F.sum(-F.col("value") * F.sin(angle)).alias("im"))
    p = f.select("node", F.atan2("im", "re").alias("p"))
    j = edges.select("src", "dst").join(p.select(F.col("node").alias("src"), F.col("p").alias("a")), "src").join(p.select(F.col("node").alias("dst"), F.col("p").alias("b")), "dst")
    d = F.col("a") - F.col("b")
    wrapped = d - 2 * F.pi() * F.floor((d + F.pi()) / (2 * F.pi()))
    return j.select("src", "dst", (wrapped * period / (2 * F.pi())).alias("delay"))


def all_pairs(signal: DataFrame) -> DataFrame:
    n = signal.select("node").distinct()
    return n.select(F.col("node").alias("src")).join(n.select(F.col("node").alias("dst")), F.col("src") != F.col("dst"))


def summarize_lags(scores: DataFrame, how: str = "max", skip_zero: bool = True) -> DataFrame:
    """(src, dst, score): largest or mean absolute correlation over lags."""
    s = scores.where("lag > 0") if skip_zero else scores
    v = F.coalesce(F.abs("corr"), F.lit(0.0))
    return s.groupBy("src", "dst").agg((F.max(v) if how == "max" else F.avg(v)).alias("score"))


def pairwise_winner(scores: DataFrame) -> DataFrame:
    """Each pair's stronger direction keeps its score, the other gets 0; of equal scores both get 0."""
    o = scores.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("score").alias("__o"))
    return scores.join(o, ["src", "dst"], "left").withColumn("score", F.when(F.col("score") > F.coalesce("__o", F.lit(0.0)), F.col("score")).otherwise(0.0)).drop("__o")


def mean_scores(signal: DataFrame, mode: str = "difference") -> DataFrame:
    """(src, dst, score) from the nodes' means where dst's is the larger, else 0: their difference, or dst's over the absolute value of src's (1e-12 at least)."""
    m = signal.groupBy("node").agg(F.avg("value").alias("m"))
    a, b = m.select(F.col("node").alias("src"), F.col("m").alias("a")), m.select(F.col("node").alias("dst"), F.col("m").alias("b"))
    v = F.col("b") - F.col("a") if mode == "difference" else F.col("b") / F.greatest(F.abs("a"), F.lit(1e-12))
    return a.join(b, F.col("src") != F.col("dst")).select("src", "dst", F.when(F.col("b") > F.col("a"), v).otherwise(0.0).alias("score"))


def select_child(scores: DataFrame, rule: str, means: DataFrame | None = None, support: DataFrame | None = None) -> DataFrame:
    """Only one child of each source, among those with a score above 0, keeps its score; the others get 0. Ties go to the smaller child.

    next: the child of the next larger mean (means: node, m), then of the larger score; where
    no child has a larger mean, the one of the largest score. biggest: of the largest mean,
    then score. corr: of the largest support (src, dst, support; 0 where missing), then score.
    all: every child.
    """
    if rule == "all":
        return scores
    if rule not in ("next", "biggest", "corr"):
        raise ValueError(f"unknown rule {rule!r}: all, next, biggest or corr")
    c = scores.where("score > 0 AND src <> dst")
    if rule == "corr":
        c = c.join(support.select("src", "dst", "support"), ["src", "dst"], "left").fillna(0.0, ["support"])
        order = [F.desc("support"), F.desc("score")]
    else:
        a, b = means.select(F.col("node").alias("src"), F.col("m").alias("__a")), means.select(F.col("node").alias("dst"), F.col("m").alias("__b"))
        c = c.join(a, "src").join(b, "dst")
        larger = F.col("__b") > F.col("__a")
        order = [F.desc("__b"), F.desc("score")] if rule == "biggest" else [F.desc(larger), F.when(larger, F.col("__b") - F.col("__a")), F.desc("score")]
    best = c.withColumn("__k", F.row_number().over(Window.partitionBy("src").orderBy(*order, "dst"))).where("__k = 1").select("src", "dst", F.lit(True).alias("__best"))
    return scores.join(best, ["src", "dst"], "left").withColumn("score", F.when(F.col("__best"), F.col("score")).otherwise(0.0)).drop("__best")


def combine(a: DataFrame, b: DataFrame, how: str = "max") -> DataFrame:
    j = a.select("src", "dst", F.col("score").alias("__a")).join(b.select("src", "dst", F.col("score").alias("__b")), ["src", "dst"], "full")
    x, y = F.coalesce("__a", F.lit(0.0)), F.coalesce("__b", F.lit(0.0))
    return j.select("src", "dst", (F.greatest(x, y) if how == "max" else x + y).alias("score"))


def auroc(scored: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve by ranks, ties sharing their mean rank; null without both classes."""
    c = scored.groupBy(*by, score).agg(F.count("*").alias("__n"), F.count_if(F.col(label) == 1).alias("__p"))
    r = c.join(value_ranks(scored, by, score, "__r"), [*by, score])
    pos, n = F.sum("__p"), F.sum("__n")
    return r.groupBy(*by).agg(F.try_divide(F.sum(F.col("__p") * F.col("__r")) - pos * (pos + 1) / 2, pos * (n - pos)).alias("auroc"))


def best_f1(scored: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Largest F1 and largest accuracy over all thresholds (predict score >= threshold, or nothing)."""
    g = scored.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    w = Window.partitionBy(*by)
    c = g.select(*by, F.sum("p").over(w.orderBy(F.desc(score))).alias("tp"), F.sum("n").over(w.orderBy(F.desc(score))).alias("said"), F.sum("p").over(w).alias("pos"), F.sum("n").over(w).alias("all"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("said") + F.col("pos")), F.lit(0.0))
    right = F.col("tp") + F.col("all") - F.col("pos") - (F.col("said") - F.col("tp"))
    return c.groupBy(*by).agg(F.max(f1).alias("max_f1"), F.max(F.greatest(right, F.col("all") - F.col("pos")) / F.col("all")).alias("max_accuracy"))


def histogram_ap(scored: DataFrame, bins: int, score: str = "score", label: str = "label") -> DataFrame:
    """Approximate average precision from a histogram of scores in [0, 1], read from the top bin down."""
    b = F.least(F.floor(F.greatest(F.least(F.col(score), F.lit(1.0)), F.lit(0.0)) * bins), F.lit(bins - 1))
    h = scored.groupBy(b.alias("b")).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("b"))  # at most `bins` rows
    c = h.select("p", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("said"), F.sum("p").over(Window.partitionBy()).alias("pos"))
    return c.agg(F.coalesce(F.try_divide(F.sum(F.col("tp") / F.col("said") * F.col("p")), F.max("pos")), F.lit(0.0)).alias("ap"))


def ridge(rows: DataFrame, features: list[str], target: str, alpha: float) -> list[float]:
    """Ridge coefficients (last: unpenalised intercept): Gram sums in one aggregation, a small solve on the driver."""
    import numpy as np

    cols = [F.col(f) for f in features] + [F.lit(1.0)]
    k = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(c * F.col(target)).alias(f"y{i}") for i, c in enumerate(cols)]
    r = rows.dropna(subset=[*features, target]).agg(*sums).first()
    g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + alpha * np.diag([1.0] * (k - 1) + [0.0])
    return np.linalg.solve(g, np.array([r[f"y{i}"] for i in range(k)])).tolist()


def linear(features: list[str], coef: list[float], floor: float | None = None) -> Column:
    x = F.lit(coef[-1])
    for f, c in zip(features, coef):
        x = x + F.col(f) * c
    return x if floor is None else F.greatest(x, F.lit(floor))


def var_scores(signal: DataFrame, by: str, lags: int) -> DataFrame:
    """(by, src, dst, score): absolute coefficients of a least-squares vector autoregression per group, largest over lags.

    A group holds one small sample's series; groups are spread over tasks.
    """

    def fit(pdf):
        import numpy as np
        import pandas as pd

        x = pdf.pivot_table(index="t", columns="node", values="value").sort_index().dropna()
        v, names = x.to_numpy(), list(x.columns)
        n = len(names)
        if len(v) <= lags * n + 1:
            score = np.zeros((n, n))
        else:
            v = v - v.mean(axis=0)
            past = np.concatenate([v[lags - k : len(v) - k] for k in range(1, lags + 1)], axis=1)
            coef = np.linalg.lstsq(past, v[lags:], rcond=None)[0].reshape(lags, n, n)
            score = np.abs(coef).max(axis=0)
        return pd.DataFrame([(pdf[by].iloc[0], names[i], names[j], float(score[i, j])) for i in range(n) for j in range(n) if i != j], columns=[by, "src", "dst", "score"])

    kind = dict(signal.dtypes)
    return signal.select(by, "node", "t", "value").groupBy(by).applyInPandas(fit, f"{by} {kind[by]}, src {kind['node']}, dst {kind['node']}, score double")


def lowpass(signal: DataFrame, keep_ratio: float) -> DataFrame:
    """(node, t, low): the first share of the Fourier bins of each node's series, nulls filled by its mean."""

    def cut(pdf):
        import numpy as np

        pdf = pdf.sort_values("t")
        v = pdf["value"].to_numpy(dtype=float)
        known = np.isfinite(v)
        v = np.where(known, v, v[known].mean() if known.any() else 0.0)
        f = np.fft.rfft(v)
        f[max(1, int(round(keep_ratio * len(f)))) :] = 0
        return pdf.assign(low=np.fft.irfft(f, len(v)))[["node", "t", "low"]]

    kind = dict(signal.dtypes)
    return signal.select("node", "t", "value").groupBy("node").applyInPandas(cut, f"node {kind['node']}, t long, low double")


def cubic_upsample(signal: DataFrame, factor: int) -> DataFrame:
    """(node, t, value) on a grid `factor` times finer by a natural cubic spline; gaps are first filled linearly."""

    def spline(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("t")
        y, n = pdf["value"].to_numpy(dtype=float), len(pdf)
        known = np.isfinite(y)
        x = np.arange(n)
        y = np.interp(x, x[known], y[known]) if known.any() else np.zeros(n)
        at = np.arange((n - 1) * factor + 1) / factor
        if n < 3:
            out = np.interp(at, x, y)
        else:  # second derivatives by elimination on the tridiagonal system 1, 4, 1
            rhs, c, m = 6 * (y[2:] - 2 * y[1:-1] + y[:-2]), np.zeros(n - 2), np.zeros(n)
            for k in range(n - 2):
                den = 4 - (c[k - 1] if k else 0)
                c[k], rhs[k] = 1 / den, (rhs[k] - (rhs[k - 1] if k else 0)) / den
            for k in range(n - 3, -1, -1):
                m[k + 1] = rhs[k] - c[k] * m[k + 2]
            i = np.minimum(at.astype(int), n - 2)
            u = at - i
            out = (1 - u) * y[i] + u * y[i + 1] + ((1 - u) ** 3 - (1 - u)) * m[i] / 6 + (u**3 - u) * m[i + 1] / 6
        return pd.DataFrame({"node": pdf["node"].iloc[0], "t": np.arange(len(at)), "value": out})

    kind = dict(signal.dtypes)
    return signal.select("node", "t", "value").groupBy("node").applyInPandas(spline, f"node {kind['node']}, t long, value double")


def space_time_shift(facts: DataFrame, reach: DataFrame, keys: list[str], hops: int, max_shift: int, by: list[str] | None = None) -> DataFrame:
    """(keys, by, hop, shift, error, n): mean over targets of the least |pred at t + shift - target| among nodes within hop steps.

    facts: keys, node, t (dense in each series), pred, target, and columns of the target to
    report by; reach: (src, dst, hop) with every node its own at 0. Null targets and
    predictions are skipped. Shifts are columns until the end, so no row is multiplied by them.
    """
    by, shifts = by or [], range(-max_shift, max_shift + 1)
    w = Window.partitionBy(*keys, "node").orderBy("t")
    names = [f"__p{i}" for i in range(len(shifts))]
    moved = [(F.lead("pred", d) if d >= 0 else F.lag("pred", -d)).over(w).alias(c) for c, d in zip(names, shifts)]
    said = facts.select(*keys, F.col("node").alias("__near"), "t", *moved)
    near = reach.where(F.col("hop") <= hops).select(F.col("src").alias("node"), F.col("dst").alias("__near"), F.explode(F.sequence("hop", F.lit(hops))).alias("hop"))
    true = facts.where(F.col("target").isNotNull()).select(*keys, "node", "t", "target", *by)
    pairs = true.join(near, "node").join(said, [*keys, "__near", "t"])
    least = pairs.groupBy(*keys, *by, "node", "t", "hop").agg(*[F.min(F.abs(F.col(c) - F.col("target"))).alias(c) for c in names])
    curve = least.groupBy(*keys, *by, "hop").agg(F.array(*[F.struct(F.lit(d).alias("shift"), F.avg(c).alias("error"), F.count(c).alias("n")) for c, d in zip(names, shifts)]).alias("__c"))
    return curve.select(*keys, *by, "hop", F.inline("__c"))


def best_shift(curve: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """The row of least error per group; ties to fewer hops, the shorter shift, the earlier one."""
    w = Window.partitionBy(*by).orderBy(F.round("error", digits).asc_nulls_last(), "hop", F.abs("shift"), "shift")
    return curve.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
