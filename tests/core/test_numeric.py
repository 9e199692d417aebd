import numpy as np
import pytest

from sensorloom.operators import cluster, numeric


def test_resistance_and_rank(spark):
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 1.0), (0, 2, 0, 1.0), (1, 5, 6, 2.0)], "component int, src long, dst long, weight double")
    got = {(r.src, r.dst): r.resistance for r in numeric.effective_resistance(edges).collect()}
    assert got[0, 1] == pytest.approx(2 / 3) and got[5, 6] == pytest.approx(0.5) and len(got) == 4
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [2.0, 2.0])], "g int, v array<double>")
    assert {r.g: round(r["rank"], 6) for r in numeric.effective_rank(rows, "g", "v").collect()} == {1: 2.0, 2: 1.0}


def test_signals_and_centers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 3))
    panel = spark.createDataFrame([("abc"[n], t, float(x[t, n])) for t in range(30) for n in range(3)], "node string, t long, value double")
    groups = spark.createDataFrame([(c, 0) for c in "abc"], "node string, grp int")
    got = numeric.principal_signals(panel, groups, 1).orderBy("t").collect()
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs([r.value for r in got]), np.abs(u[:, 0] * s[0])) and got[0].share == pytest.approx(s[0] ** 2 / (s**2).sum())
    pts = spark.createDataFrame([(0, i, [float(v)]) for i, v in enumerate([0, 1, 10, 4])], "g int, id int, v array<double>")
    assert [(r.id, r.turn) for r in numeric.k_center(pts, "g", 3).orderBy("turn").collect()] == [(0, 0), (2, 1), (3, 2)]


def test_kmeans_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, size=(20, 2)) for c in (0, 5, 10)])
    pts = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id long, v array<double>")
    centers, found = cluster.kmeans(pts, 3, 15)
    c = {r.cluster: np.array(r.c) for r in centers.collect()}
    for r in found.collect():
        d = {k: np.linalg.norm(x[r.id] - v) for k, v in c.items()}
        assert r.d1 == pytest.approx(min(d.values()), abs=1e-6)
    members = {k: [r.id for r in found.where(f"cluster = {k}").collect()] for k in c}
    assert all(np.allclose(c[k], x[m].mean(axis=0)) for k, m in members.items() if m)
