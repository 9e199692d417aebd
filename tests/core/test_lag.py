import math
import random

import numpy as np
import pytest

from sensorloom.operators.graph import reach
from sensorloom.operators.lag import best_shift, lowpass, space_time_shift, var_scores


def test_space_time_shift_against_loops(spark):
    rng = random.Random(3)
    cell = lambda: None if rng.random() < 0.1 else float(rng.randint(0, 50))
    rows = [("a", n, t, cell(), cell(), t % 2 == 0) for n in range(4) for t in range(12)]
    facts = spark.createDataFrame(rows, "system string, node long, t long, pred double, target double, even boolean")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    got = {(r.even, r.hop, r.shift): (round(r.error, 9), r.n) for r in space_time_shift(facts, reach(edges, 2, directed=False), ["system"], 2, 1, ["even"]).collect()}
    pred = {(n, t): p for _, n, t, p, _, _ in rows}
    want = {}
    for even in (True, False):
        for hop in range(3):
            for shift in (-1, 0, 1):
                errors = []
                for _, n, t, _, y, e in rows:
                    near = [abs(pred[m, t + shift] - y) for m in range(4) if y is not None and abs(m - n) <= hop and pred.get((m, t + shift)) is not None]
                    errors += [min(near)] if near and e == even else []
                want[even, hop, shift] = (round(sum(errors) / len(errors), 9), len(errors))
    assert got == want


def test_best_shift_ties(spark):
    curve = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 0, 1, 1.0), ("a", 0, -1, 1.0), ("a", 0, 2, 0.5 + 0.5), ("b", 0, 0, None), ("b", 1, 1, 3.0)], "g string, hop int, shift int, error double")
    assert sorted(tuple(r) for r in best_shift(curve, ["g"]).collect()) == [("a", 0, -1, 1.0), ("b", 1, 1, 3.0)]


def test_lowpass_against_a_direct_transform(spark):
    """Bins are summed one by one; a null counts as the mean; an empty series stays at zero."""
    rng = random.Random(5)
    v = [None if t in (4, 11) else rng.uniform(-3, 3) for t in range(20)]
    rows = [("a", t, x) for t, x in enumerate(v)] + [("b", t, None) for t in range(6)]
    got = {(r.node, r.t): r.low for r in lowpass(spark.createDataFrame(rows, "node string, t long, value double"), 0.3).collect()}
    mean = sum(x for x in v if x is not None) / 18
    full = [mean if x is None else x for x in v]
    keep = round(0.3 * 11)
    for t in range(20):
        low = 0.0
        for k in range(keep):
            re = sum(x * math.cos(2 * math.pi * k * (t - i) / 20) for i, x in enumerate(full))
            low += re * (1 if k == 0 else 2) / 20
        assert got["a", t] == pytest.approx(low, abs=1e-9)
    assert all(got["b", t] == 0 for t in range(6))


def test_var_scores_against_normal_equations(spark):
    """y follows x by two steps; a sample too short for its coefficients scores zero."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=80)
    y = 0.8 * np.r_[0, 0, x[:-2]] + 0.01 * rng.normal(size=80)
    rows = [(0, n, t, float(s[t])) for n, s in (("x", x), ("y", y)) for t in range(80)] + [(1, n, t, float(t)) for n in "xy" for t in range(4)]
    got = {(r.sample, r.src, r.dst): r.score for r in var_scores(spark.createDataFrame(rows, "sample int, node string, t long, value double"), "sample", 2).collect()}
    a, b = x - x.mean(), y - y.mean()
    past = np.stack([a[1:-1], b[1:-1], a[:-2], b[:-2]], axis=1)
    for src, dst, target, at in (("x", "y", b, (0, 2)), ("y", "x", a, (1, 3))):
        coef = np.linalg.solve(past.T @ past, past.T @ target[2:])
        assert got[0, src, dst] == pytest.approx(max(abs(coef[i]) for i in at), abs=1e-9)
    assert got[0, "x", "y"] == pytest.approx(0.8, abs=0.02) and got[1, "x", "y"] == got[1, "y", "x"] == 0
