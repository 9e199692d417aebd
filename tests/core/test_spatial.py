"""Triangles, pruning, edge summaries and turn means against plain loops and small cases."""

import itertools
import random

import pytest

from sensorloom.operators import forecast, graph, spatial


def test_triangles_of_a_graph_with_a_hub(spark):
    rng = random.Random(1)
    pairs = {(a, b) for a, b in itertools.combinations(range(25), 2) if rng.random() < 0.15} | {(25, 100)} | {(0, b) for b in range(1, 60)}
    got = [tuple(r) for r in graph.triangles(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()]
    want = [t for t in itertools.combinations(sorted({x for p in pairs for x in p}), 3) if all(p in pairs for p in itertools.combinations(t, 2))]
    assert sorted(got) == want and len(want) > 20


def _prune(edges):
    """One edge at a time, longest of all three-edge cases first, until none is left."""
    live = dict(edges)
    while True:
        tops = set()
        for (u, v), (x, w) in itertools.product(live, live):
            if v == x and u != w and u != v and v != w and (u, w) in live:
                tops.add(max((live[e], e) for e in ((u, v), (v, w), (u, w))))
        if not tops:
            return live
        del live[max(tops)[1]]


def test_pruning_equals_one_at_a_time(spark):
    rng = random.Random(2)
    for density, values in ((0.25, 100), (0.5, 4)):
        edges = {(a, b): float(rng.randint(1, values)) for a in range(12) for b in range(12) if rng.random() < density}
        rows = [(a, b, w) for (a, b), w in edges.items()] + [(None, 1, 1.0), (1, None, 1.0), (0, 1, None)]
        rows += [(a, b, w + 1) for (a, b), w in list(edges.items())[:5]]
        got = {(r.src, r.dst): r.weight for r in graph.prune_longest(spark.createDataFrame(rows, "src long, dst long, weight double")).collect()}
        assert got == _prune(edges) and len(got) < len(edges)
    small = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 2.0), (3, 4, 5.0)], "src long, dst long, weight double")
    assert sorted((r.src, r.dst) for r in graph.prune_longest(small).collect()) == [(1, 2), (2, 3), (3, 4)]
    assert graph.prune_longest(small.limit(0)).count() == 0


def test_edge_structure(spark):
    rows = [("s", n, t, v) for n, vs in {"a": [1, 2, 3, None], "b": [2, 4, 6, 1], "c": [5, 5, 5, 5], "d": [1, None, None, None]}.items() for t, v in enumerate(vs)]
    r = spark.createDataFrame([(s, n, t, None if v is None else float(v)) for s, n, t, v in rows] + [("empty", "a", 0, None)], "system string, node string, t long, value double")
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("d", "b", 0.0), ("a", "z", 9.0)], "src string, dst string, weight double")
    got = {x.system: x for x in spatial.edge_structure(r, e, ["system"]).collect()}
    assert got["s"].edge_corr == pytest.approx(1.0) and got["s"].n_edges == 4
    assert got["s"].dirichlet == pytest.approx((1.0 * (1 + 4 + 9) / 3 + 3.0 * (16 + 9 + 4) / 3 + 0.0) / 4)
    assert (got["empty"].edge_corr, got["empty"].dirichlet, got["empty"].n_edges) == (None, None, 4)
    flat = spatial.edge_structure(r, e.withColumn("weight", e.weight * 0), ["system"]).where("system = 's'").first()
    assert flat.dirichlet == pytest.approx(((1 + 4 + 9) / 3 + (16 + 9 + 4) / 3 + 1.0) / 3)


def test_distance_bins(spark):
    rows = [(0.0, 0, 0, 0.9, 0.5, True), (4.9, 2, None, 0.1, 0.5, False), (4.0, 3, 3, 0.8, 0.01, None), (5.0, 1, 1, None, None, True), (None, 1, 1, 1.0, 1.0, True), (-1.0, 1, 1, 1.0, 1.0, True)]
    d = spark.createDataFrame(rows, "dist double, best_lag int, lag int, score double, gain double, sure boolean")
    got = {r.distance: r for r in spatial.distance_bins(d, [0, 5, 10, float("inf")], 0.3, 0.03).collect()}
    assert list(sorted(got)) == ["[0, 5)", "[10, inf)", "[5, 10)"]
    a, b, c = got["[0, 5)"], got["[5, 10)"], got["[10, inf)"]
    assert (a.n_edges, a.zero_best_ratio, a.weak_ratio, a.no_lag_ratio, a.zero_lag_ratio) == (3, *[pytest.approx(1 / 3)] * 4)
    assert a.zero_or_no_lag_ratio == pytest.approx(2 / 3) and a.low_gain_ratio == pytest.approx(1 / 3) and a.sure_ratio == pytest.approx(1 / 3)
    assert (a.median_best_lag, a.median_lag, a.median_score, a.median_gain) == (2.0, 1.5, pytest.approx(0.8), pytest.approx(0.5))
    assert (b.n_edges, b.weak_ratio, b.low_gain_ratio, b.median_score) == (1, 0.0, 0.0, None)
    assert (c.n_edges, c.zero_best_ratio, c.median_lag) == (0, None, None)


def test_degree_correlations(spark):
    s = spark.createDataFrame([("g", n, float(n * 2), 1.0) for n in range(5)] + [("h", 9, 1.0, 1.0)], "g string, node long, m double, flat double")
    d = spark.createDataFrame([(n, n, 5 - n, 3) for n in range(4)], "node long, in_degree long, out_degree long, degree long")
    got = {(r.g, r.degree_metric, r.metric): (r["corr"], r.n) for r in spatial.degree_correlations(s, d, ["g"], ["m", "flat"]).collect()}
    assert got["g", "in_degree", "m"] == (pytest.approx(1.0), 5) and got["g", "out_degree", "m"] == (pytest.approx(-1.0), 5)
    assert got["g", "degree", "m"] == (None, 5) and got["g", "in_degree", "flat"] == (None, 5) and got["h", "in_degree", "m"] == (None, 1)


def test_mean_by_turn(spark):
    train = spark.createDataFrame([("a", 0, 2.0), ("a", 0, 4.0), ("b", 0, 9.0), ("c", 0, 100.0), ("a", 1, 7.0), ("b", 1, None), ("b", 1, 1.0)], "node string, turn int, value double")
    mask = spark.createDataFrame([("a", 0, True), ("b", 0, True), ("c", 0, False), ("d", 0, True), ("a", 1, False), ("b", 1, None), ("a", 2, True)], "node string, turn int, observed boolean")
    got = {(r.node, r.turn): (r.pred, r.source) for r in forecast.mean_by_turn(train, mask).collect()}
    assert got == {("a", 0): (3.0, "node"), ("b", 0): (9.0, "node"), ("c", 0): (5.0, "observed"), ("d", 0): (5.0, "observed"), ("a", 1): (4.0, "turn"), ("b", 1): (4.0, "turn"), ("a", 2): (None, None)}
