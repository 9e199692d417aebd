import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import causal as K
from sensorloom.operators import evaluate as E
from sensorloom.operators import sampling as G
from sensorloom.operators import selection as S


def clouds(spark, centers, each=40, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k * each + i, [float(x) for x in rng.normal(c, 0.3)], k) for k, c in enumerate(centers) for i in range(each)]
    return spark.createDataFrame(rows, "id long, v array<double>, cluster int"), rows


def plain_silhouettes(v, lab):
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(v)):
        own = [j for j in range(len(v)) if lab[j] == lab[i] and j != i]
        others = [d[i, lab == k].mean() for k in set(lab.tolist()) - {lab[i]}]
        out.append((min(others) - d[i, own].mean()) / max(min(others), d[i, own].mean()) if own and others else 0.0)
    return np.array(out)


def plain_ratio(v, lab, q):
    c = {k: v[lab == k].mean(axis=0) for k in sorted(set(lab.tolist()))}
    r = {k: np.quantile(np.linalg.norm(v[lab == k] - c[k], axis=1), q) for k in c}
    return min((np.linalg.norm(c[a] - c[b]) / (r[a] + r[b] + 1e-8), a, b) for a in c for b in c if a < b)


def plain_davies_bouldin(v, lab):
    c = {k: v[lab == k].mean(axis=0) for k in set(lab.tolist())}
    s = {k: np.linalg.norm(v[lab == k] - c[k], axis=1).mean() for k in c}
    return np.mean([max((s[a] + s[b]) / np.linalg.norm(c[a] - c[b]) for b in c if b != a) for a in c])


def test_silhouettes_and_metrics(spark):
    """Euclidean silhouettes over all pairs, a lone point 0, labels below 0 left out but for their share; null with one cluster."""
    df, rows = clouds(spark, [(0, 0), (6, 0), (0, 6)], 12)
    v, lab = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    more = spark.createDataFrame([(100, [3.0, 9.0], 7), (101, [1.0, 1.0], -1), (102, [2.0, 1.0], -1)], df.schema)
    v2, lab2 = np.vstack([v, [[3.0, 9.0]]]), np.r_[lab, 7]
    got = {r.id: r.s for r in S.silhouettes(df.unionByName(more)).collect()}
    assert len(got) == 37 and np.allclose([got[i] for i in [*range(36), 100]], plain_silhouettes(v2, lab2)) and got[100] == 0
    m = S.cluster_metrics(df.unionByName(more)).first()
    f = np.array([12, 12, 12, 1]) / 37
    assert m.clusters == 4 and abs(m.silhouette - plain_silhouettes(v2, lab2).mean()) < 1e-9 and abs(m.davies_bouldin - plain_davies_bouldin(v2, lab2)) < 1e-9
    assert abs(m.size_entropy + (f * np.log(f + 1e-12)).sum() / np.log(4)) < 1e-9 and abs(m.uncertain_ratio - 2 / 39) < 1e-12
    one = S.cluster_metrics(df.where("cluster = 0")).first()
    assert one.clusters == 1 and one.silhouette is None and one.davies_bouldin is None and one.calinski_harabasz is None


def test_scores_of_k(spark):
    """The score from its parts, over the labels that k-means gave; a floor of the shares excludes a k."""
    from sensorloom.operators.cluster import kmeans

    df, rows = clouds(spark, [(0, 0), (6, 0), (0, 6)], 12)
    v = np.array([r[1] for r in rows])
    for r in S.adaptive_k(df.select("id", "v"), [2, 3], 8).collect():
        labels = {x.id: x.cluster for x in kmeans(df.select("id", "v"), r.clusters, 8)[1].collect()}
        lab = np.array([labels[i] for i in range(len(v))])
        s, n = plain_silhouettes(v, lab), np.bincount(lab) / len(lab)
        want = s.mean() + 0.5 * np.quantile(s, 0.2) + 0.2 * np.log(plain_ratio(v, lab, 0.9)[0]) - 0.2 * plain_davies_bouldin(v, lab) - 0.1 * (n.max() - 1 / r.clusters)
        assert abs(r.score - want) < 1e-6
    assert S.adaptive_k(df.select("id", "v"), [4], 3, least_share=0.4).first().score == float("-inf")


def plain_merge(v, lab, rho, q, share):
    lab = lab.copy()

    def dense(a):
        return np.array([sorted(set(a[a >= 0].tolist())).index(x) if x >= 0 else -1 for x in a])

    def tiny(a):
        a = dense(a)
        while True:
            n = np.bincount(a[a >= 0])
            small = [k for k in range(len(n)) if n[k] < max(1, int(np.ceil(share * len(a))))]
            if not small or len(n) <= 1:
                return a
            t = min(small, key=lambda k: (n[k], k))
            c = [v[a == k].mean(axis=0) for k in range(len(n))]
            a[a == t] = min((k for k in range(len(n)) if k != t), key=lambda k: (np.linalg.norm(c[k] - c[t]), k))
            a = dense(a)

    lab = tiny(lab)
    while lab.max() + 1 > 2:
        gap, a, b = plain_ratio(v[lab >= 0], lab[lab >= 0], q)
        if gap >= rho:
            break
        keep, drop = (a, b) if (lab == a).sum() >= (lab == b).sum() else (b, a)
        lab[lab == drop] = keep
        lab = tiny(lab)
    return lab


@pytest.mark.parametrize("rho,share", [(1.0, 0.0), (1.6, 0.06), (50.0, 0.0)])
def test_merges_by_plain_loops(spark, rho, share):
    rng = np.random.default_rng(3)
    at = [(0, 0), (0.4, 0.2), (5, 5), (5.3, 5.1), (9, 0), (9.2, 0.5), (2, 2)]
    rows = [(100 * k + i, [float(x) for x in rng.normal(c, 0.5)], k) for k, c in enumerate(at) for i in range(3 if k == 6 else 10 + 3 * k)] + [(900, [1.0, 1.0], -1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, cluster int")
    got = {r.id: r.cluster for r in S.merge_overlapping(df, rho, 0.9, share).collect()}
    want = plain_merge(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), rho, 0.9, share)
    assert [got[r[0]] for r in rows] == want.tolist()


def test_labels_of_days(spark):
    """Days whose clusters bear different numbers get the same labels, also where one dimension is a thousand times wider."""
    rng = np.random.default_rng(5)
    at = np.array([(0, 0), (1, 4000), (2, 1000)], dtype=float)
    rows = [(d, (k + d) % 3, (at[k] + rng.normal(size=2) * (0.05, 50)).tolist()) for d in range(5) for k in range(3)]
    got = {(r.day, r.cluster): r.label for r in S.align_labels(spark.createDataFrame(rows, "day long, cluster int, c array<double>"), 3, 20).collect()}
    for k in range(3):
        assert len({got[d, (k + d) % 3] for d in range(5)}) == 1
    few = S.align_labels(spark.createDataFrame(rows[:2], "day long, cluster int, c array<double>"), 9, 5).collect()
    assert len({r.label for r in few}) == 2


def test_balanced_assignment_is_greedy(spark):
    df, rows = clouds(spark, [(0, 0), (1, 0), (0.5, 1)], 15, seed=3)
    rows, df = rows[:44], df.where("id < 44")
    centers = np.array([(0, 0), (1, 0), (0.5, 1)], dtype=float)
    c = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(centers)], "cluster int, c array<double>")
    d = {r[0]: np.round(((np.array(r[1]) - centers) ** 2).sum(axis=1), 9) for r in rows}
    order = sorted(d, key=lambda i: (-(np.sort(d[i])[1] - np.sort(d[i])[0]), i))
    room, want = [15, 15, 14], {}
    for i in order:
        want[i] = next(k for k in sorted(range(3), key=lambda k: (d[i][k], k)) if room[k])
        room[want[i]] -= 1
    assert {r.id: r.cluster for r in S.balanced_assignment(df.select("id", "v"), c).collect()} == want


def test_selection_with_probabilities(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "id long, loss double")
    got = {r.id: (r.hard, r.probability) for r in S.epsilon_greedy(df, 0.25, 0.01, 1).collect()}
    best = sorted(range(50), key=lambda i: (-(i % 7), i))[:11]  # round(12.5) is 12, one of them explores
    assert len(got) == 12 and all(got[i] == (True, 1.0) for i in best) and [p for h, p in got.values() if not h] == [1 / 39]
    assert len(S.epsilon_greedy(df, 1.0, 0.5).collect()) == 50 and S.epsilon_greedy(df, 0.1, 0.0).where("not hard").count() == 0


def test_global_order(spark):
    """Places over many ranges are those of one sort, descending and with ties by id."""
    from sensorloom.operators.storage import first_rows, numbered

    rows = [(i, None if i % 41 == 0 else (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x int")
    got = {r.id: r.k for r in numbered(df, [F.desc("x"), F.asc("id")], "k", part_rows=60).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [got[i] for i, _ in order] == list(range(500))
    assert {r.id for r in first_rows(df, 33, [F.desc("x"), F.asc("id")]).collect()} == {i for i, _ in order[:33]}


def test_leaves_and_groups(spark):
    """Leaves are those of a plain split of the largest leaf at the median of its wider axis."""
    rng = np.random.default_rng(1)
    pts = {i: (float(rng.normal()), float(rng.normal() * 3)) for i in range(101)}
    leaves = [list(pts)]
    while len(leaves) < 5:
        n = max(range(len(leaves)), key=lambda k: (len(leaves[k]), -k))
        mine = leaves[n]
        wide = [max(pts[i][a] for i in mine) - min(pts[i][a] for i in mine) for a in (0, 1)]
        mine = sorted(mine, key=lambda i: (pts[i][0 if wide[0] >= wide[1] else 1], i))
        leaves[n] = mine[: (len(mine) + 1) // 2]
        leaves.append(mine[(len(mine) + 1) // 2 :])
    got = {r.id: r.leaf for r in S.widest_split(spark.createDataFrame([(i, *p) for i, p in pts.items()], "id long, x double, y double"), 5).collect()}
    assert got == {i: n for n, leaf in enumerate(leaves) for i in leaf}
    e = [(a, b, 5.0) for g in (0, 10, 20) for a in range(g, g + 5) for b in range(g, g + 5) if a != b] + [(4, 10, 0.1), (14, 20, 0.1)]
    got = {r.node: r.grp for r in S.label_groups(spark.createDataFrame(e, "src long, dst long, weight double")).collect()}
    assert len({got[n] for n in range(5)}) == len({got[n] for n in range(10, 15)}) == 1 and len(set(got.values())) == 3


def test_bootstrap(spark):
    """Poisson weights have mean and variance one, and the interval holds the true difference."""
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal(i % 2, 1)), i % 2 == 1) for i in range(1200)]
    r = E.bootstrap_difference(spark.createDataFrame(rows, "k long, v double, g boolean"), "k", "v", "g", 100).first()
    d = np.mean([v for _, v, g in rows if g]) - np.mean([v for _, v, g in rows if not g])
    assert r.low < d < r.high and 0.1 < r.high - r.low < 0.4


def test_isolated_nodes(spark):
    rows = [(s, n) for s in range(30) for n in range(s, s + 3)]
    samples, cand = spark.createDataFrame(rows, "sample long, node long"), spark.range(50).withColumnRenamed("id", "node")
    got = {}
    for r in G.add_isolated(samples, cand).collect():
        got.setdefault(r.sample, []).append(r.node)
    assert len(got) == 30 and all(len(n) == len(set(n)) == 4 and set(range(s, s + 3)) < set(n) for s, n in got.items())
    assert len({next(iter(set(n) - set(range(s, s + 3)))) for s, n in got.items()}) > 10


def test_causal_registry(spark):
    """A delayed copy is found by lagged correlation; a plug-in method runs per sample; unknown names are told."""
    rng = np.random.default_rng(4)
    rows = []
    for s in range(3):
        x = rng.normal(size=200)
        for t in range(200):
            rows += [(s, "a", t, float(x[t])), (s, "b", t, float(x[t - 2] + 0.1 * rng.normal())), (s, "c", t, float(rng.normal()))]
    sig = spark.createDataFrame(rows, "sample long, node string, t long, value double")
    labels = spark.createDataFrame([(s, "a", "b") for s in range(3)], "sample long, src string, dst string")
    K.METHODS.pop("ones", None)
    K.grouped_method("ones", lambda pdf: pd.DataFrame([(a, b, 1.0) for a in sorted(set(pdf["node"])) for b in sorted(set(pdf["node"])) if a != b], columns=["src", "dst", "score"]))
    got = {r.method: r for r in K.benchmark(sig, labels, ["lagged_correlation", "stronger_direction", "correlation", "ones"]).collect()}
    assert got["lagged_correlation"].auroc == got["stronger_direction"].max_f1 == 1 and got["correlation"].auroc < 1 and got["ones"].auroc == 0.5 and got["ones"].pairs == 18
    with pytest.raises(KeyError):
        K.get_method("none")
    assert G.edges_all(labels, F.lit(True)).count() == 3


def test_independent_columns_and_chunks(spark):
    from sensorloom.operators import numeric as N

    rng = np.random.default_rng(7)
    a, b = rng.normal(size=50), rng.normal(size=50)
    cols = {"a": a, "b": b, "c": a + b, "d": np.ones(50), "e": a - 2 * b + 1, "f": rng.normal(size=50)}
    rows = [(0, n, t, float(v[t])) for n, v in cols.items() for t in range(50)]
    got = N.independent_columns(spark.createDataFrame(rows, "part long, node string, t long, value double"), "part").collect()
    assert [(r.node, r.pos) for r in sorted(got, key=lambda r: r.pos)] == [("a", 0), ("b", 1), ("f", 2)]
    e = spark.createDataFrame([(1, k, k + 1) for k in range(9)] + [(2, 20, 21)], "component long, src long, dst long")
    out = {}
    for r in N.breadth_chunks(e, 4).collect():
        out.setdefault((r.component, r.chunk), []).append(r.node)
    assert max(map(len, out.values())) <= 4 and len(out) <= 5
    for nodes in out.values():  # every chunk is a connected stretch of its line
        assert sorted(nodes) == list(range(min(nodes), max(nodes) + 1))
    assert sorted(n for v in out.values() for n in v) == [*range(10), 20, 21]


def test_silhouettes_are_of_all_points(spark):
    """More points than any sample: every one has a row, and they equal those over all pairs; blocks change nothing."""
    rng = np.random.default_rng(11)
    v, lab = rng.normal(size=(5200, 2)), rng.integers(0, 3, 5200)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], int(lab[i])) for i in range(5200)], "id long, v array<double>, cluster int")
    got = {r.id: r.s for r in S.silhouettes(df, block=1500).collect()}
    assert len(got) == 5200
    for i in range(0, 5200, 650):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        a, b = d[lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1), min(d[lab == k].mean() for k in range(3) if k != lab[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9


def test_pairs_are_looked_at_once_for_every_k(spark, monkeypatch):
    """The points are read in one set of blocks, not one for each k; no point is shuffled to find its center."""
    from sensorloom.operators import cluster as C

    df, _ = clouds(spark, [(0, 0), (6, 0), (0, 6)], 12)
    scans, blocks_of = [], S.blocks_of
    monkeypatch.setattr(S, "blocks_of", lambda *a: scans.append(a) or blocks_of(*a))
    assert sorted(r.clusters for r in S.adaptive_k(df.select("id", "v"), [2, 3, 4], 3).collect()) == [2, 3, 4]
    assert len(scans) == 1
    centers = spark.createDataFrame([(0, [0.0, 0.0]), (1, [6.0, 0.0])], "cluster int, c array<double>")
    near = C.nearest_centers(df, centers)
    assert "hashpartitioning" not in near._jdf.queryExecution().executedPlan().toString()
    for r in near.collect():
        d = [round(float(np.hypot(r.v[0] - x, r.v[1])), 9) for x in (0, 6)]
        assert r.cluster == int(np.argmin(d)) and [r.d1, r.d2] == pytest.approx(sorted(d), abs=2e-9)


def test_silhouettes_keep_digits(spark):
    """Small clusters far from zero and from each other, exact copies, labelings of one scan, batches of several tiles; components that are no numbers are unknown."""
    rng = np.random.default_rng(5)
    v = np.repeat([[1e6, 1e6], [1e6, 1e6 + 4], [3e6, -1e6]], 200, axis=0) + 1e-3 * rng.normal(size=(600, 2))
    v[150:190] = v[150]
    v[190:200] += 2
    labels = np.column_stack([np.repeat([0, 1, 2], 200), np.arange(600) % 3, np.where(np.arange(600) < 170, 0, np.where(np.arange(600) < 190, 7, 3))])
    rows = [(i, [float(x) for x in v[i]], *map(int, labels[i])) for i in range(600)] + [(600, [float("nan"), 1.0], 0, 0, 0), (601, [float("inf"), 1.0], 0, 0, 0), (602, None, 0, 0, 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, a int, b int, c int")
    got = {(r.label, r.id): (r.cluster, r.s) for r in S.silhouettes_by(df, ["a", "b", "c"], block=256).collect()}
    assert len(got) == 3 * 603 and all(got[j, i][1] == 0 for j in range(3) for i in (600, 601, 602))
    for j in range(3):
        assert [got[j, i][0] for i in range(600)] == labels[:, j].tolist()
        assert np.allclose([got[j, i][1] for i in range(600)], plain_silhouettes(v, labels[:, j]), rtol=0, atol=1e-9)
