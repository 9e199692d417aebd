import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import nearest as N


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double")


def brute(rows, k, dist):
    good = [r for r in rows if None not in r and not np.isnan(r[1:]).any()]
    ids, x, y = np.array([r[0] for r in good]), np.array([r[1] for r in good]), np.array([r[2] for r in good])
    out = set()
    for i in range(len(good)):
        d = dist(x[i], y[i], x, y)
        d[(x == x[i]) & (y == y[i])] = 0.0
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out |= {(int(ids[i]), int(ids[j])) for j in order}
    return out


def plane(x, y, a, b):
    return np.sqrt((a - x) ** 2 + (b - y) ** 2)


def flat(x, y, a, b):
    return np.sqrt(((b - y) * 111.320 * np.cos(np.radians((x + a) / 2))) ** 2 + ((a - x) * 110.540) ** 2)


def globe(x, y, a, b):
    h = np.sin(np.radians(a - x) / 2) ** 2 + np.cos(np.radians(x)) * np.cos(np.radians(a)) * np.sin(np.radians(b - y) / 2) ** 2
    return 2 * 6371000 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def clustered(seed, n=900):
    """Tight clusters of very different widths, points far away, and places that many points share."""
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.normal((0, 0), 1e-5, (n // 3, 2)), rng.normal((5, 5), 1.0, (n // 3, 2)), rng.uniform(-40, 40, (n // 6, 2)), np.repeat([[5.0, 5.0]], n // 6, axis=0), [[60.0, -70.0]]])
    return [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)]


@pytest.mark.parametrize("metric,dist", [(N.PLANE, plane), (N.FLAT_KM, flat), (N.HAVERSINE_M, globe)])
def test_against_all_pairs(spark, metric, dist):
    rows = clustered(1)
    got = N.knn(frame(spark, rows + [(9001, None, 1.0), (9002, float("nan"), 1.0)]), 4, metric).collect()
    assert {(r.src, r.dst) for r in got} == brute(rows, 4, dist) and len(got) == 4 * len(rows)


def test_many_ranges_and_small_leaves(spark):
    rows = clustered(2, 600)
    got = N.knn(frame(spark, rows), 3, N.PLANE, leaf=4, range_rows=50).collect()
    assert {(r.src, r.dst) for r in got} == brute(rows, 3, plane)


def test_grid_ties_lines_and_few_points(spark):
    grid = [(i, float(i % 12), float(i // 12)) for i in range(144)]
    assert {(r.src, r.dst) for r in N.knn(frame(spark, grid), 3).collect()} == brute(grid, 3, plane)
    line = [(i, 2.0, float(i * i)) for i in range(60)]
    assert {(r.src, r.dst) for r in N.knn(frame(spark, line), 2).collect()} == brute(line, 2, plane)
    few = [(1, 0.0, 0.0), (2, 1.0, 0.0)]
    assert {(r.src, r.dst, r.dist) for r in N.knn(frame(spark, few), 5).collect()} == {(1, 2, 1.0), (2, 1, 1.0)}
    same = [(i, 1.0, 1.0) for i in range(30)]
    assert {(r.src, r.dst) for r in N.knn(frame(spark, same), 2).collect()} == brute(same, 2, plane)
    assert N.knn(frame(spark, []), 3).count() == 0 and N.knn(frame(spark, few[:1]), 3).count() == 0


def test_candidates_do_not_grow_with_a_cluster(spark):
    """Codes in leaves: no leaf is above its size, also in a tight cluster, and equal codes are cut."""
    rng = np.random.default_rng(3)
    codes = np.sort(np.concatenate([rng.integers(0, 1 << 62, 500), rng.integers(0, 1 << 10, 500), np.full(100, 7)]))
    level, leaf = N.leaves_of(codes, 16)
    assert np.bincount(leaf).max() <= 16 and (level >= 0).all() and (np.diff(leaf) >= 0).all()


def test_graph(spark):
    rows = clustered(4, 300)
    e = N.knn_graph(frame(spark, rows), 3).collect()
    near = {(r.src, r.dst): r.dist for r in N.knn(frame(spark, rows), 3).collect()}
    sigma = np.median([d for d in near.values() if d > 0])
    w = {p: np.exp(-((d / sigma) ** 2)) for p, d in near.items()}
    assert {(r.src, r.dst): round(r.weight, 9) for r in e} == {p: round(max(w.get(p, 0), w.get(p[::-1], 0)), 9) for p in {*w, *(p[::-1] for p in w)}}
    assert all(r.weight == 1.0 for r in N.knn_graph(frame(spark, rows), 2, weight="binary", symmetric=False).collect())
    with pytest.raises(ValueError):
        N.knn_graph(frame(spark, [(1, 0.0, 0.0), (2, 0.0, 0.0)]), 1)
