import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import forecast, graph, impute, lag, panel, scale, windows


def series(spark, rows):
    return spark.createDataFrame(rows, "node string, t long, value double")


def test_dense_grid(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0, 1.0), ("a", t0 + dt.timedelta(hours=3, minutes=5), 3.0), ("b", t0 + dt.timedelta(hours=1), 5.0)]
    df = spark.createDataFrame(rows, "n string, ts timestamp_ntz, v double")
    got = {(r.node, r.t): r.value for r in panel.dense_panel(df, "n", "ts", F.avg("v")).collect()}
    assert len(got) == 8 and got["a", 0] == 1.0 and got["a", 3] == 3.0 and got["b", 1] == 5.0 and got["b", 0] is None


def test_splits_and_resolutions():
    assert panel.ratio_split(20, 0.2, 0.2) == (12, 16) and panel.leading_split(23, 0.7, 0.1) == (16, 18)
    assert panel.window_split(20, 3, 2, 0.6, 0.2) == (10, 3, 3)
    assert [panel.parse_minutes(x) for x in (15, "15min", "1h", "2hours", "1d")] == [15, 15, 60, 120, 1440]
    assert panel.check_multiple(5, 15) == 3 and panel.auto_periods(20) == ["day", "week", "month"]
    for bad in ("x", "0min", "3weeks"):
        with pytest.raises(ValueError):
            panel.parse_minutes(bad)
    with pytest.raises(ValueError):
        panel.check_multiple(5, 12)


def test_explicit_split_windows(spark):
    """Train 0-9, valid 10-13, test 14-19 with history 3 and horizon 2."""
    label = lambda t: "train" if t < 10 else "valid" if t < 14 else "test"
    split = spark.createDataFrame([(t, label(t)) for t in range(20)], "t long, split string")
    starts = lambda *a: sorted(r.t for r in windows.split_starts(split, *a).collect())
    assert starts("train", 3, 2, False) == [3, 4, 5, 6, 7, 8]
    assert starts("valid", 3, 2, True) == [10, 11, 12]
    assert starts("valid", 3, 2, False) == []


def test_interpolation_against_numpy(spark):
    rng = np.random.default_rng(0)
    v = np.where(rng.random(50) < 0.4, np.nan, rng.normal(size=50))
    df = series(spark, [("a", t, None if np.isnan(x) else float(x)) for t, x in enumerate(v)] + [("b", t, None) for t in range(3)])
    got = {(r.node, r.t): r.filled for r in impute.interpolate(df).collect()}
    known = np.flatnonzero(~np.isnan(v))
    assert np.allclose([got["a", t] for t in range(50)], np.interp(np.arange(50), known, v[known])) and got["b", 0] is None


@pytest.mark.parametrize("kind", ["z", "minmax", "robust"])
def test_scalers_round_trip(spark, kind):
    rng = np.random.default_rng(1)
    df = series(spark, [(n, t, float(x)) for n in "ab" for t, x in enumerate(rng.random(100))] + [("c", t, 4.0) for t in range(100)])
    fitted = scale.fit(df.where("t < 80"), kind, ["node"])
    back = scale.invert(scale.apply(df, fitted, ["node"]), fitted, ["node"])
    assert back.where("abs(value - value_back) > 1e-9").count() == 0
    if kind == "z":
        r = scale.apply(df.where("t < 80"), fitted, ["node"]).where("node <> 'c'").groupBy("node").agg(F.avg("scaled").alias("m"), F.stddev_pop("scaled").alias("s")).collect()
        assert all(abs(x.m) < 1e-9 and abs(x.s - 1) < 1e-9 for x in r)


def test_window_helpers(spark):
    df = series(spark, [("a", t, float(t)) for t in range(10)])
    w = windows.sliding(df, 3, 2).orderBy("t").collect()
    assert len(w) == windows.window_count(10, 3, 2) == 6 and w[0].past == [0, 1, 2] and w[0].future == [3, 4]
    assert windows.seasonal_shifts(2, 5, 2, 2) == [0, -1, -3, -4, -8, -9]
    sizes = spark.createDataFrame([("x", 5), ("y", 3), ("z", 2)], "k string, n long")
    assert {r.k: r.budget for r in windows.allocate(sizes, ["k"], 7).collect()} == {"x": 4, "y": 2, "z": 1}
    low = forecast.centered_average(df, 4, 10).orderBy("t").collect()
    pad = np.pad(np.arange(10.0), (1, 2), mode="edge")
    assert np.allclose([r.low for r in low], [pad[t : t + 4].mean() for t in range(10)])


def test_lags_and_graphs_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = np.r_[rng.normal(size=4), x[:-4]] + 0.1 * rng.normal(size=300)
    df = series(spark, [("x", t, float(v)) for t, v in enumerate(x)] + [("y", t, float(v)) for t, v in enumerate(y)])
    best = {(r.src, r.dst): r.lag for r in lag.best_lag(lag.lag_scores(df, lag.all_pairs(df), 8), ["src", "dst"]).collect()}
    assert best["x", "y"] == 4
    scored = spark.createDataFrame([(1, 0.5, k % 2) for k in range(10)], "g int, score double, label int")
    assert lag.auroc(scored, ["g"]).first()["auroc"] == 0.5
    rows = [(float(a), float(b), float(2 * a - b + 3)) for a, b in rng.normal(size=(50, 2))]
    coef = lag.ridge(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y", 0.0)
    assert np.allclose(coef, [2, -1, 3])
    edges = spark.createDataFrame([(0, 1, 2.0), (0, 2, 3.0), (2, 0, 1.0), (3, 4, 1.0)], "src long, dst long, weight double")
    assert {(r.src, r.dst): r.weight for r in graph.transition(edges).collect()}[0, 1] == pytest.approx(0.4)
    assert {r.node: r.component for r in graph.components(edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    up = lag.cubic_upsample(series(spark, [("a", t, float(t * t)) for t in range(6)]), 2).orderBy("t").collect()
    assert len(up) == 11 and up[4].value == pytest.approx(4.0) and abs(up[5].value - 6.25) < 0.1
