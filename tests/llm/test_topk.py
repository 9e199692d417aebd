import math
import random

from sensorloom.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, k, every):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for i, q in good:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    return sorted(map(tuple, top_k(df, **more).collect()))


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [f32(rng.gauss(0, 0.2)) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]
    rows += [(2000, None), (2020, [None] * 8), (2040, [float("nan")] * 8), (None, rows[0][1]), (2060, [float("inf")] * 8)]
    assert run(spark, rows, block=200, resolve=30) == brute(rows, 20, 20)
    assert run(spark, rows, block=100000, resolve=1, k=3) == brute(rows, 3, 20)
    assert run(spark, rows, block=10, query_block=7, k=50) == brute(rows, 50, 20)


def test_small_and_large_values(spark):
    rows = [(0, [f32(3e9), f32(-5e9)]), (1, [f32(1e9), 1.0]), (2, [1.0])]
    got = run(spark, rows)
    assert got == [(q, r, v, max(min(s, 2**63 - 1), -(2**63))) for q, r, v, s in brute([(0, rows[0][1]), (1, rows[1][1]), (2, [1.0, 0.0])], 20, 20)]
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def test_blocks_and_carried_bounds(spark):
    """Any number of blocks gives the same rows, ties and repeated rows included; bounds carried on settle queries early."""
    import numpy as np

    from sensorloom.llm.topk import RunningBest

    rng = random.Random(8)
    rows = [(i, [f32(rng.choice([-1, 0, 1]) * 0.25) for _ in range(6)]) for i in range(600)] + [(41, [0.25] * 6)] * 3
    want = brute(rows, 20, 20)
    assert all(run(spark, rows, block=b, query_block=q, resolve=r) == want for b, q, r in ((16, 5, 4), (64, 1000, 10), (1000, 8192, 160)))
    # One list decides these scores, so a few reads of it do.
    v = np.zeros((4096, 8), dtype=np.int64)
    v[:, 0] = np.random.default_rng(0).permutation(4096)
    best = RunningBest(np.array([-1]), np.array([[1, 0, 0, 0, 0, 0, 0, 0]]), 5, 40)
    settled = [best.add(np.arange(at, at + 1024), v[at : at + 1024]) for at in range(0, 4096, 1024)]
    assert sorted(best.score.tolist()) == [4091, 4092, 4093, 4094, 4095] and all(s[-1] == 0 for s in settled)
