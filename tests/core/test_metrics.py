import math

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import metrics as M


def columns():
    return F.col("pred"), F.col("target")


def frame(spark, pred, target):
    return spark.createDataFrame([(0, float(p), None if t is None else float(t)) for p, t in zip(pred, target)], "s int, pred double, target double")


@pytest.mark.parametrize("metric,pred,target,null,want", [
    (M.mae, [1, 2, 3], [1, 2, 3], None, 0.0), (M.mae, [1, 2, 3], [1, None, 3], None, 0.0), (M.mae, [1, 2, 3], [1, None, 4], None, 0.5),
    (M.mae, [1, 2, 3], [1, -1, 4], -1.0, 0.5), (M.mae, [1, 2, 3], [None] * 3, None, 0.0),
    (M.mape, [2, 3, 3], [1, 3, 2], None, 0.5), (M.mape, [2, 3, 4], [0, 3, 2], None, 0.5), (M.mape, [2, 3, 4], [None, 3, 2], None, 0.5),
    (M.mape, [2, 3, 4], [-1, 3, 2], -1.0, 0.5), (M.mape, [2, 3, 4], [0, 0, 0], None, 0.0),
    (M.mse, [1, 3, 3, 5], [1, 2, 3, 4], None, 0.5), (M.mse, [2, 3, 3, 5], [1, 2, None, 4], None, 1.0), (M.mse, [2, 3, 3, 5], [1, 2, -1, 4], -1.0, 1.0), (M.mse, [1, 2, 3, 4], [None] * 4, None, 0.0),
])
def test_literal_cases(spark, metric, pred, target, null, want):
    got = frame(spark, pred, target).agg(metric(*columns(), null_val=null).alias("m")).first()["m"]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("pred,target,null,want", [
    ([[2, 2, 3], [6, 5, 7]], [[1, 2, 2], [4, 5, 6]], None, 0.3), ([[2, 2, 4], [8, 5, 6]], [[1, None, 3], [5, 5, None]], None, 0.4),
    ([[2, 2, 4], [8, 5, 6]], [[1, -1, 3], [5, 5, -1]], -1.0, 0.4), ([[3, 2, 5], [4, 5, 6]], [[-1] * 3] * 2, -1.0, 0.0),
])
def test_wape_cases(spark, pred, target, null, want):
    rows = [(s, float(p), None if t is None else float(t)) for s in range(2) for p, t in zip(pred[s], target[s])]
    got = M.series_wape(spark.createDataFrame(rows, "s int, pred double, target double"), ["s"], null).first()["wape"]
    assert got == pytest.approx(want, abs=1e-4)


def test_dialects_and_guards(spark):
    p, t = columns()
    df = frame(spark, [1.0, 2.0, 4.0], [2.0, 0.0, -2.0])
    r = df.agg(M.mape(p, t, dialect="percent", eps=1.0).alias("pct"), M.mape(p, t, 0.0, "signed").alias("signed"), M.mape(p, t, dialect="or_one").alias("one"), M.guarded_corr(p, F.lit(1.0)).alias("c"), M.huber(p, t).alias("h")).first()
    assert r.pct == pytest.approx(175.0) and r.signed == pytest.approx((0.5 - 3) / 2) and r.one == pytest.approx((0.5 + 2 + 3) / 3)
    assert r.c is None and r.h == pytest.approx((0.5 + 1.5 + 5.5) / 3)


def test_empty_and_kendall(spark):
    assert math.isclose(frame(spark, [], []).agg(M.mae(*columns()).alias("m")).first()["m"], 0.0)
    ranks = spark.createDataFrame([("a", 1, 3), ("b", 2, 2), ("c", 3, 1), ("d", 3, 4)], "i string, x int, y int").withColumn("g", F.lit(1))
    assert M.kendall(ranks, "i", "x", "y", ["g"]).first()["tau"] == pytest.approx((-3 + 2) / 5)


def test_exact_quantiles(spark):
    """Ties, single values, nulls and one scope without keys, against NumPy."""
    import numpy as np

    from sensorloom.operators.metrics import exact_quantiles

    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.normal(size=301)] + [("b", float(v)) for v in rng.integers(0, 3, 200)] + [("c", 4.0), ("d", None), ("a", None)]
    df, probs = spark.createDataFrame(rows, "k string, v double"), [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.99, 1.0]
    got = {r.k: r.q for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got.pop("d") is None
    for k, q in got.items():
        assert np.allclose(q, np.quantile([v for n, v in rows if n == k and v is not None], probs), atol=1e-12)
    assert np.allclose(exact_quantiles(df, [], "v", probs).first().q, np.quantile([v for _, v in rows if v is not None], probs), atol=1e-12)


def test_correlations_read_rows_few_times(spark):
    """Ranks of the target go to its distinct values: nulls and ties come out as by hand, and rows are not worked out once for each join of a rank."""
    import numpy as np

    from sensorloom.operators.profile import correlations

    rng = np.random.default_rng(6)
    rows = [(float(a), None if k % 7 == 0 else float(b), float(c) if k % 11 else None) for k, (a, b, c) in enumerate(rng.integers(0, [5, 40, 60], (400, 3)))]
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    df = spark.createDataFrame(rows, "a double, b double, y double")
    got = {r.feature: r for r in correlations(df.mapInPandas(count, df.schema), ["a", "b"], "y").collect()}
    for at, name in enumerate("ab"):
        x, y = np.array([(r[at], r[2]) for r in rows if r[at] is not None and r[2] is not None]).T
        rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
        assert math.isclose(got[name].pearson, np.corrcoef(x, y)[0, 1], abs_tol=1e-9) and math.isclose(got[name].spearman, np.corrcoef(rank(x), rank(y))[0, 1], abs_tol=1e-9)
    assert seen.value <= 7 * len(rows)
