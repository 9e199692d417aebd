"""Summaries of edges: residuals at both ends, delays by distance, degrees against statistics of nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.metrics import exact_quantiles, guarded_corr


def edge_structure(residuals: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, edge_corr, dirichlet, n_edges) of residuals (by, node, t, value) over edges (src, dst, weight).

    edge_corr is the mean of the edges' Pearson correlations (three common steps at least,
    both ends varying); dirichlet the mean squared difference of the two ends, weighted by
    edges, or unweighted where weights sum to 0 or less. Edges without a common step count in n_edges only.
    """
    r = residuals.where(F.col("value").isNotNull())
    a = r.select(*by, F.col("node").alias("src"), "t", F.col("value").cast("double").alias("x"))
    b = r.select(*by, F.col("node").alias("dst"), "t", F.col("value").cast("double").alias("y"))
    met = edges.select("src", "dst", "weight").join(a, "src").join(b, [*by, "dst", "t"])
    gap = F.col("x") - F.col("y")
    one = met.groupBy(*by, "src", "dst", "weight").agg(guarded_corr(F.col("x"), F.col("y")).alias("c"), F.avg(gap * gap).alias("d"))
    weighted = F.when(F.sum("weight") > 0, F.try_divide(F.sum(F.col("d") * F.col("weight")), F.sum("weight"))).otherwise(F.avg("d"))
    found = one.groupBy(*by).agg(F.avg("c").alias("edge_corr"), weighted.alias("dirichlet"))
    scopes = residuals.select(*by).distinct().crossJoin(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))
    same = reduce(lambda p, q: p & q, [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by])
    return scopes.alias("s").join(found.alias("f"), same, "left").select(*[f"s.{c}" for c in by], "edge_corr", "dirichlet", "n_edges")


def distance_bins(delays: DataFrame, bounds: list[float], min_corr: float, min_gain: float) -> DataFrame:
    """One row per half-open bin of distance of delays (dist, best_lag, lag, score, gain, sure): n_edges, ratios and exact medians.

    lag is the effective lag, null where none holds. Ratios: zero_best, weak (score under
    min_corr), no_lag, zero_lag, zero_or_no_lag, low_gain (a positive best lag that is not
    weak, gain under min_gain) and sure. Comparisons with null are false. Bins without rows
    have nulls; the last bound may be infinite; rows of unknown distance or outside of all bins are left out.
    """
    pairs = list(zip(bounds[:-1], bounds[1:]))
    label = lambda lo, hi: f"[{lo:g}, inf)" if hi == float("inf") else f"[{lo:g}, {hi:g})"
    inside = lambda lo, hi: (F.col("dist") >= lo) & (F.lit(True) if hi == float("inf") else F.col("dist") < hi)
    place = reduce(lambda acc, p: acc.when(inside(*p[1]), p[0]), enumerate(pairs), F)
    d = delays.where(F.col("dist").isNotNull() & ~F.isnan(F.col("dist").cast("double"))).withColumn("bin", place).where("bin is not null")
    no, zero = F.col("lag").isNull(), F.coalesce(F.col("lag") == 0, F.lit(False))
    low = (F.col("best_lag") > 0) & (F.col("score") >= min_corr) & (F.col("gain") < min_gain)
    ratios: dict[str, Column] = {"zero_best": F.col("best_lag") == 0, "weak": F.col("score") < min_corr, "no_lag": no, "zero_lag": zero, "zero_or_no_lag": zero | no, "low_gain": low, "sure": F.col("sure")}
    shares = d.groupBy("bin").agg(F.count("*").alias("n_edges"), *[(F.count_if(c) / F.count("*")).alias(f"{n}_ratio") for n, c in ratios.items()])
    names = ["best_lag", "lag", "score", "gain"]
    long = d.select("bin", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in names])).alias("r")).select("bin", "r.name", "r.v")
    m = exact_quantiles(long, ["bin", "name"], "v", [0.5]).groupBy("bin").agg(*[F.max(F.when(F.col("name") == n, F.col("q")[0])).alias(f"median_{n}") for n in names])
    bins = delays.sparkSession.createDataFrame([(k, label(*p)) for k, p in enumerate(pairs)], "bin int, distance string")
    return bins.join(shares.join(m, "bin", "left"), "bin", "left").fillna(0, ["n_edges"]).drop("bin")


def degree_correlations(stats: DataFrame, degrees: DataFrame, by: list[str], metrics: list[str], kinds: tuple[str, ...] = ("in_degree", "out_degree", "degree")) -> DataFrame:
    """(by, degree_metric, metric, corr, n): Pearson of each kind of degree with each statistic over the nodes of a group (stats: by, node, metrics).

    Null with fewer than three nodes that have both, or without variance. n counts all nodes
    of the group; nodes without degrees count in n only. One pass over nodes for all pairs.
    """
    j = stats.select(*by, "node", *metrics).join(degrees.select("node", *kinds), "node", "left")
    pair = lambda k, m: F.struct(F.lit(k).alias("degree_metric"), F.lit(m).alias("metric"), F.col(k).cast("double").alias("x"), F.col(m).cast("double").alias("y"))
    long = j.select(*by, "node", F.explode(F.array(*[pair(k, m) for k in kinds for m in metrics])).alias("p")).select(*by, "node", "p.*")
    return long.groupBy(*by, "degree_metric", "metric").agg(guarded_corr(F.col("x"), F.col("y")).alias("corr"), F.count_distinct("node").alias("n"))
