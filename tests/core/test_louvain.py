import random
from collections import defaultdict

import pytest

from sensorloom.operators import louvain as L


def both_ways(edges):
    w = defaultdict(float)
    for a, b, x in edges:
        if a != b and x > 0:
            w[a, b] = max(w[a, b], x)
            w[b, a] = max(w[b, a], x)
    return w


def score(w, of):
    m = sum(w.values())
    tot, inner = defaultdict(float), 0.0
    for (a, b), x in w.items():
        tot[of[a]] += x
        inner += x * (of[a] == of[b])
    return inner / m - sum(t * t for t in tot.values()) / m**2


def sequential(w, seed):
    """Plain Louvain: nodes one after the other, then groups as nodes."""
    rng, names = random.Random(seed), {a: a for a, _ in w}
    while True:
        near, k = defaultdict(dict), defaultdict(float)
        for (a, b), x in w.items():
            near[a][b] = x
            k[a] += x
        m, of = sum(w.values()), {a: a for a in near}
        tot, moved, order = dict(k), True, sorted(near)
        rng.shuffle(order)
        while moved:
            moved = False
            for a in order:
                tot[of[a]] -= k[a]
                links = defaultdict(float, {of[a]: 0.0})
                for b, x in near[a].items():
                    if b != a:
                        links[of[b]] += x
                best = max(links, key=lambda c: (round(links[c] - k[a] * tot[c] / m, 12), c == of[a]))
                moved |= best != of[a]
                of[a] = best
                tot[best] += k[a]
        if len(set(of.values())) == len(of):
            return names
        names = {n: of[g] for n, g in names.items()}
        up = defaultdict(float)
        for (a, b), x in w.items():
            up[of[a], of[b]] += x
        w = up


def planted(seed, groups=12, size=25, inside=0.3, outside=0.01):
    rng, n = random.Random(seed), groups * size
    return [(a, b, 1.0 + rng.random()) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else outside)]


def arbitrary(seed, n=250, m=900):
    rng = random.Random(seed)
    return [(rng.randrange(n), int(n * rng.random() ** 2), rng.random()) for _ in range(m)]


@pytest.mark.parametrize("edges", [planted(1), arbitrary(2)], ids=["planted", "random"])
def test_modularity_of_plain_louvain(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    got = {r.node: r.grp for r in L.louvain(df).collect()}
    w = both_ways(edges)
    assert set(got) == {a for a, _ in w} and all(got[g] == g for g in got.values())
    want = max(score(w, sequential(w, s)) for s in range(3))
    assert score(w, got) >= 0.98 * want
    sym = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "src long, dst long, weight double")
    q = L.modularity(sym, spark.createDataFrame(list(got.items()), "node long, grp long")).first()[0]
    assert abs(q - score(w, got)) < 1e-9


def test_lone_nodes_do_not_swap(spark):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in ((0, 1), (1, 0), (2, 3), (3, 2), (4, 5), (5, 4))], "src long, dst long, weight double")
    state = e.selectExpr("src AS node", "src AS grp", "weight AS strength")
    moves = [tuple(r) for salt in (0, 1) for r in L.move_round(e, state, 6.0, 1.0, salt).collect()]
    assert sorted(moves) == [(1, 0), (3, 2), (5, 4)]


def test_nothing_to_join(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (2, 3, 0.0)], "src long, dst long, weight double")
    assert L.louvain(df).count() == 0
    pair = spark.createDataFrame([(7, 4, 2.0)], "src long, dst long, weight double")
    assert {tuple(r) for r in L.louvain(pair).collect()} == {(7, 4), (4, 4)}


def test_large_groups_are_cut_breadth_first(spark):
    line = spark.createDataFrame([(n, n + 1, 1.0) for n in range(9)] + [(20, 21, 1.0)], "src long, dst long, weight double")
    groups = spark.createDataFrame([(n, 0) for n in range(10)] + [(30, 0), (20, 20), (21, 20)], "node long, grp long")
    got = {r.node: (r.grp, r.part) for r in L.split_groups(line, groups, 5, 4).collect()}
    # From node 1 (the smallest of the largest degree): 0 and 2, then 3 ...; 30 is not reached.
    assert [sorted(n for n in got if got[n] == (0, p)) for p in range(3)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 30]]
    assert got[20] == got[21] == (20, 0)
