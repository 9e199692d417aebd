"""Causal methods by name, and the benchmark that scores them against label graphs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators import lag as L
from sensorloom.operators.sampling import with_labels

Method = Callable[[DataFrame, DataFrame], DataFrame]

#: name -> f(signal, pairs) -> (sample, src, dst, score); signal has sample, node, t, value, pairs has sample, src, dst.
METHODS: dict[str, Method] = {}


def method(name: str) -> Callable[[Method], Method]:
    """Register a causal method under a name."""

    def add(f: Method) -> Method:
        if name in METHODS:
            raise ValueError(f"method {name} is registered twice")
        METHODS[name] = f
        return f

    return add


def get_method(name: str) -> Method:
    if name not in METHODS:
        raise KeyError(f"no causal method {name}; there are {sorted(METHODS)}")
    return METHODS[name]


def sample_pairs(signal: DataFrame) -> DataFrame:
    """Ordered pairs of the nodes of each sample."""
    n = signal.select("sample", "node").distinct()
    return n.select("sample", F.col("node").alias("src")).join(n.select("sample", F.col("node").alias("dst")), "sample").where(F.col("src") != F.col("dst"))


def _lagged(signal: DataFrame, pairs: DataFrame, first: int, last: int) -> DataFrame:
    a = signal.select("sample", F.col("node").alias("src"), "t", F.col("value").alias("x"))
    b = signal.select("sample", F.col("node").alias("dst"), F.col("t").alias("__t"), F.col("value").alias("y"))
    s = pairs.join(a, ["sample", "src"]).withColumn("lag", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("__t", F.col("t") + F.col("lag"))
    c = s.join(b, ["sample", "dst", "__t"]).groupBy("sample", "src", "dst", "lag").agg(L.guarded_corr(F.col("x"), F.col("y")).alias("corr"))
    return c.groupBy("sample", "src", "dst").agg(F.max(F.coalesce(F.abs("corr"), F.lit(0.0))).alias("score"))


@method("correlation")
def correlation(signal: DataFrame, pairs: DataFrame) -> DataFrame:
    return _lagged(signal, pairs, 0, 0)


@method("lagged_correlation")
def lagged_correlation(signal: DataFrame, pairs: DataFrame) -> DataFrame:
    return _lagged(signal, pairs, 1, 3)


@method("stronger_direction")
def stronger_direction(signal: DataFrame, pairs: DataFrame) -> DataFrame:
    s = _lagged(signal, pairs, 1, 3)
    o = s.select("sample", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("score").alias("__o"))
    return s.join(o, ["sample", "src", "dst"], "left").select("sample", "src", "dst", F.when(F.col("score") > F.coalesce("__o", F.lit(0.0)), F.col("score")).otherwise(0.0).alias("score"))


@method("mean_difference")
def mean_difference(signal: DataFrame, pairs: DataFrame) -> DataFrame:
    m = signal.groupBy("sample", "node").agg(F.avg("value").alias("m"))
    j = pairs.join(m.select("sample", F.col("node").alias("src"), F.col("m").alias("a")), ["sample", "src"]).join(m.select("sample", F.col("node").alias("dst"), F.col("m").alias("b")), ["sample", "dst"])
    return j.select("sample", "src", "dst", F.greatest(F.col("b") - F.col("a"), F.lit(0.0)).alias("score"))


def grouped_method(name: str, fit: Callable) -> Method:
    """Register a method given as fit(pdf of one sample) -> pdf(src, dst, score): the plug-in point for models; samples are spread over tasks."""

    def run(signal: DataFrame, pairs: DataFrame) -> DataFrame:
        kind = dict(signal.dtypes)

        def one(key, pdf):
            out = fit(pdf)
            out.insert(0, "sample", key[0])
            return out

        return signal.select("sample", "node", "t", "value").groupBy("sample").applyInPandas(one, f"sample {kind['sample']}, src {kind['node']}, dst {kind['node']}, score double")

    return method(name)(run)


def benchmark(signal: DataFrame, labels: DataFrame, names: list[str], digits: int = 9) -> DataFrame:
    """(method, auroc, max_f1, max_accuracy, pairs): every method over all samples, their pairs pooled."""
    pairs = sample_pairs(signal)
    scored = [with_labels(get_method(n)(signal, pairs), labels).select(F.lit(n).alias("method"), F.round("score", digits).alias("score"), "label") for n in names]
    s = reduce(DataFrame.unionByName, scored)
    return L.auroc(s, ["method"]).join(L.best_f1(s, ["method"]), "method").join(s.groupBy("method").agg(F.count("*").alias("pairs")), "method")
