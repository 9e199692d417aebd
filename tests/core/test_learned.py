import numpy as np
import pytest

from sensorloom.operators import learned as G


def made(spark, m):
    return spark.createDataFrame([(i * 3, [float(x) for x in v]) for i, v in enumerate(m)], "node long, v array<double>").repartition(5)


def best(score, k, weight):
    out = {}
    for i, row in enumerate(score):
        for j in sorted(range(len(row)), key=lambda j: (-round(row[j], 12), j))[:k]:
            if np.isfinite(row[j]):
                out[i * 3, j * 3] = weight[i, j]
    return out


@pytest.mark.parametrize("own", [True, False])
def test_dense_softmax(spark, own):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(70, 6)) * 3, rng.normal(size=(70, 6)) * 3
    score = np.maximum(a @ b.T, 0)
    if not own:
        np.fill_diagonal(score, -np.inf)
    e = np.exp(score - score.max(axis=1, keepdims=True))
    want = best(score, 9, e / e.sum(axis=1, keepdims=True))
    for block in (4096, 11):
        got = {(r.src, r.dst): r.weight for r in G.adaptive_graph(made(spark, a), made(spark, b), 9, own=own, block=block).collect()}
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_ties_of_zero_go_to_the_smaller_node(spark):
    m = -np.eye(30)
    got = sorted((r.src, r.dst) for r in G.strongest(made(spark, m), made(spark, np.abs(m)), 3, softmax=False).collect())
    assert got == [(i * 3, j * 3) for i in range(30) for j in range(3)]


def test_directed_graph(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(40, 4)), rng.normal(size=(40, 4))
    score = np.maximum(np.tanh(0.5 * (a @ b.T - b @ a.T)), 0)
    want = {p: w for p, w in best(score, 5, score).items() if w > 0}
    got = {(r.src, r.dst): r.weight for r in G.directed_top_k(made(spark, a), made(spark, b), 5, alpha=0.5).collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert not any((y, x) in got for x, y in got)


def test_empty_and_large_scores(spark):
    empty = made(spark, np.zeros((0, 2)))
    assert G.adaptive_graph(empty, empty, 3).count() == 0 and G.adaptive_graph(made(spark, np.ones((2, 2))), empty, 3).count() == 0
    m = np.array([[1e3, 0], [0, 1e3]])
    got = {(r.src, r.dst): r.weight for r in G.adaptive_graph(made(spark, m), made(spark, m), 2).collect()}
    assert got == {(0, 0): 1.0, (0, 3): 0.0, (3, 0): 0.0, (3, 3): 1.0}


def test_scores_wait_for_merges():
    """Many chunks in one task: what waits, the bound below which nothing enters, and ties at it give the same as one ordered row."""
    rng = np.random.default_rng(4)
    ids, n = np.arange(40) * 3, 6000
    asked, vectors, names = rng.integers(-2, 3, (40, 5)).astype(float), rng.integers(-2, 3, (n, 5)).astype(float), rng.permutation(n)
    for curve, softmax in (("relu", True), ("relu", False), ("tanh", False)):
        rows = G.RunningRows(ids, asked, 7, True, curve, 0.3, softmax)
        for at in range(0, n, 100):
            rows.add(names[at : at + 100], vectors[at : at + 100])
        score = np.maximum(np.tanh(0.3 * (asked @ vectors.T)) if curve == "tanh" else asked @ vectors.T, 0)
        out = rows.left().to_pydict()
        want = [[int(names[j]) for j in np.lexsort((names, -np.round(s, 12)))[:7]] for s in score]
        assert [[p["dst"] for p in b] for b in out["best"]] == want
        assert not softmax or np.allclose(np.log(out["total"]) + out["top"], np.log(np.exp(score).sum(axis=1)))
