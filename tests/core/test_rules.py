"""Small cases worked out by hand from the rules that operators follow."""

from sensorloom.operators import lag as L
from sensorloom.operators import lines as P
from sensorloom.operators import sampling as G
from sensorloom.operators.graph import components, degrees, shortest_paths
from sensorloom.operators.profile import expected_zero_rate


def test_brackets(spark):
    refs = spark.createDataFrame([("f", 10.0, 5), ("f", 10.0, 3), ("f", 20.0, 4), ("f", 20.0, 9), ("f", 21.0, 1)], "fwy string, pm double, rid long")
    at = {1: 10.04, 2: 3.0, 3: 30.0, 4: 15.0, 5: 20.5, 6: 10.2}
    pts = spark.createDataFrame([(i, "f", p) for i, p in at.items()] + [(7, "g", 1.0)], "id long, fwy string, pm double")
    row = lambda r: (r.match, r.lower, r.upper, r.mode, None if r.gap is None else round(r.gap, 6))
    got = {r.id: row(r) for r in P.bracket(pts, refs, ["fwy"], "pm", "rid", 0.01).collect()}
    none = (None, None, None, None, None)
    assert got == {1: (3, 3, 3, "exact", 0.04), 2: (None, 3, 3, "before_start", 7.0), 3: (None, 1, 1, "after_end", 9.0), 4: none, 5: none, 6: none, 7: none}
    wide = {r.id: row(r) for r in P.bracket(pts, refs, ["fwy"], "pm", "rid", 0.01, 5.0).collect()}
    assert wide[4] == (None, 5, 4, "between", 5.0) and wide[5] == (None, 9, 1, "between", 0.5) and wide[6] == none
    assert {r.id: r.match for r in P.bracket(pts, refs, ["fwy"], "pm", "rid", 0.6).collect()}[5] == 4  # as near on both sides: the lower


def test_routes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7)], "src long, dst long")
    stops = [(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 1), (2, 2, 2), (3, 0, 1), (3, 1, 7), (4, 0, 2), (4, 1, 1), (5, 0, 1), (5, 1, None), (6, None, None), (7, 0, 99)]
    got = G.repair_routes(spark.createDataFrame(stops, "route int, pos int, road long"), edges, spark.range(1, 8).withColumnRenamed("id", "road"))
    assert {r.route: (r.roads, r.reason, r.changed) for r in got.collect()} == {
        1: ([1, 2], None, False), 2: ([1, 2], None, False), 3: ([1, 2, 3, 4, 5, 6, 7], None, True), 4: (None, "unreachable_anchor", False),
        5: (None, "unknown_road", False), 6: (None, "empty_or_nonlist_route", False), 7: (None, "unknown_road", False),
    }


def test_directions_and_children(spark):
    s = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5), ("a", "c", 0.4), ("c", "a", 0.1), ("a", "d", 0.3), ("d", "a", 0.0)], "src string, dst string, score double")
    assert {(r.src, r.dst): r.score for r in L.pairwise_winner(s).collect()} == {("a", "b"): 0.0, ("b", "a"): 0.0, ("a", "c"): 0.4, ("c", "a"): 0.0, ("a", "d"): 0.3, ("d", "a"): 0.0}
    means = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 9.0), ("d", 3.0)], "node string, m double")
    kept = lambda rule, **more: sorted((r.src, r.dst) for r in L.select_child(s, rule, **more).where("score > 0").collect())
    assert kept("next", means=means) == [("a", "d"), ("b", "a"), ("c", "a")] and kept("biggest", means=means) == [("a", "c"), ("b", "a"), ("c", "a")]
    support = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.2)], "src string, dst string, support double")
    assert kept("corr", support=support) == [("a", "b"), ("b", "a"), ("c", "a")] and len(kept("all")) == 5
    signal = spark.createDataFrame([("x", 0.0), ("y", 4.0), ("z", -2.0)], "node string, value double")
    assert {(r.src, r.dst): r.score for r in L.mean_scores(signal, "ratio").where("score <> 0").collect()} == {("x", "y"): 4.0 / 1e-12, ("z", "y"): 2.0}


def test_hubs(spark):
    star = spark.createDataFrame([(0, n) for n in range(1, 10)] + [(1, 2)], "src long, dst long")
    assert [r.node for r in degrees(star, 0.25).where("is_hub").collect()] == [0, 1]  # round(2.5) is 2
    ring = spark.createDataFrame([(n, (n + 1) % 5) for n in range(5)], "src long, dst long")
    assert degrees(ring, 0.5).where("is_hub").count() == 0


def test_expected_zeros(spark):
    import math

    train = spark.createDataFrame([("a", 0, 0.0), ("a", 0, 6.0), ("a", 1, 3.0), ("b", 0, 2.0), ("b", 1, 2.0)], "node string, h int, value double")
    test = spark.createDataFrame([("a", 0, 0.0), ("a", 2, 5.0), ("b", 1, 1e-9)], "node string, h int, value double")
    r = expected_zero_rate(train, test).first()
    k = 9.0 / (6.0 - 3.0)  # a: mean 3, variance 6; b: variance 0, so Poisson
    assert abs(r.observed - 2 / 3) < 1e-12 and abs(r.poisson - (2 * math.exp(-3) + math.exp(-2)) / 3) < 1e-12
    assert abs(r.negative_binomial - ((k / (k + 3 + 1e-6)) ** k + math.exp(-2)) / 2) < 1e-9


def most_joined(df):
    """The most rows that a join of a collected DataFrame made."""

    def walk(p):
        name, below = p.nodeName(), [p.children().apply(i) for i in range(p.children().size())]
        below += [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else []
        mine = p.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return max([mine, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_ramps_by_distinct_places(spark):
    """Sensors and ramps that share a place: the pairs joined are of places, and every sensor keeps its row."""
    nodes = spark.createDataFrame([(0, 1, 0.0, 0.0), (1, 1, 0.0, 0.0), (2, 1, 9.0, 0.0), (3, 2, 1.0, 1.0)], "node int, k int, x double, y double")
    ramps = spark.range(4000).selectExpr("id AS link", "CASE WHEN id % 2 = 0 THEN 'on' ELSE 'off' END AS kind", "CAST(id % 4 AS INT) AS node")
    at = [("on", 1, 3.0, 4.0), ("off", 1, 3.0, 4.0), ("on", 1, 8.0, 0.0), ("on", 2, 1.0, 1.0), ("on", 1, None, 0.0), ("on", None, 0.0, 0.0), ("off", 2, 99.0, 1.0)]
    rows = [(i, *at[i % len(at)]) for i in range(700)]
    sensors = spark.createDataFrame(rows, "id long, kind string, k int, x double, y double")
    df = P.match_ramps(sensors, ramps, nodes, ["k"], 6.0)
    want = [("on", 0, 5.0, None), ("off", 1, 5.0, None), ("on", 2, 1.0, None), ("on", None, None, "no_ramp"), ("on", None, None, None), ("on", None, None, "no_ramp"), ("off", None, 98.0, "too_far")]
    rows = df.collect()
    assert {r.id: tuple(r)[1:] for r in rows} == {i: want[i % len(at)] for i in range(700)} and 0 < most_joined(df) <= 4000


def test_rounds_read_edges_once(spark):
    """The edges of a search by rounds are worked out once, however many rounds it takes."""
    for search in (lambda e: components(e).count(), lambda e: shortest_paths(e, spark.range(1).withColumnRenamed("id", "node"), 99.0).count()):
        seen = spark.sparkContext.accumulator(0)

        def count(frames, seen=seen):
            for f in frames:
                seen.add(len(f))
                yield f

        chain = spark.range(0, 12, 1, 2).selectExpr("id AS src", "id + 1 AS dst", "1.0D AS weight")
        assert search(chain.mapInPandas(count, chain.schema)) == 13 and seen.value <= 24
