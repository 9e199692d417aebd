"""Freeway assignment: small cases worked out by rule, and the line search against brute force."""

import random

from sensorloom.operators import freeways as W

EDGE = "edge string, highway string, ref string, unsigned_ref string, osmid string, points array<struct<x:double,y:double>>, name string"
REL = "way long, relation long, ref string"
NET = "route long, line long, direction string, points array<struct<x:double,y:double>>"


def _edges(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], EDGE)


def test_references_in_order_with_their_issue(spark):
    edges = _edges(spark, [
        ("a", "motorway", "I 5; CA 99", "CA 51;I 5", "11;12;x", None),
        ("b", "trunk", None, None, "12", None),
        ("c", "motorway", " ", "Old Road", None, None),
        ("d", "motorway", None, None, "77", None),
        ("e", "residential", "I 5", None, "11", None),
        ("f", "trunk", "I 80 Bus;I 80", None, "", None),
        ("b", "trunk", None, None, "12", None),
    ])
    rel = spark.createDataFrame([(12, 2, "I 80 Business"), (12, 1, "CA 99"), (11, 9, " US 50 "), (11, 3, None), (11, 4, ""), (None, 5, "I 1"), (12, 2, "I 80 Business")], REL)
    got = {r.edge: r for r in W.edge_references(edges, rel).collect()}
    assert sorted(got) == ["a", "b", "c", "d", "f"]
    assert got["a"].refs == ["I 5", "CA 99", "US 50", "I 80 Business", "CA 51"] and got["a"].routes == [5, 50, 51, 99]
    assert (got["a"].sources, got["a"].issue, got["a"].ambiguous) == ("both", None, True)
    assert got["b"].refs == ["CA 99", "I 80 Business"] and got["b"].sources == "relation"
    assert (got["c"].refs, got["c"].issue, got["c"].sources) == (["Old Road"], "no_number", None)
    assert (got["d"].refs, got["d"].issue, got["d"].ambiguous) == ([], "no_ref", False)
    assert got["f"].routes == [51, 80]


def test_midpoint_lies_halfway_along(spark):
    rows = [(0, [(0.0, 0.0), (4.0, 0.0)]), (1, [(0.0, 0.0), (1.0, 0.0), (1.0, 3.0)]), (2, [(2.0, 5.0)]), (3, [(1.0, 1.0)] * 3), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "id int, points array<struct<x:double,y:double>>")
    got = {r.id: r.p and tuple(r.p) for r in df.select("id", W.midpoint(df.points).alias("p")).collect()}
    assert got == {0: (2.0, 0.0), 1: (1.0, 1.0), 2: (2.0, 5.0), 3: (1.0, 1.0), 4: None, 5: None}


def test_assignment_overlapping_routes_and_unknown_tags(spark):
    h = 0.0003
    edges = _edges(spark, [
        ("on", "motorway", "I 5", None, "1", [(0.0, 0.0), (0.01, 0.0)]),  # both routes run here
        ("far", "motorway", "I 5;I 7", None, "1", [(0.0, 1.0), (0.01, 1.0)]),
        ("bare", "trunk", None, None, None, [(0.0, 0.0001), (0.01, 0.0001)]),
        ("undrawn", "trunk", "CA 99", None, None, None),
        ("odd", "motorway", "I 5", None, None, [(0.0, 0.5), (0.01, 0.5)]),  # the nearest line has no known direction
        (None, "motorway", "I 5", None, None, [(0.0, 0.0), (0.01, 0.0)]),
        ("street", "residential", "I 5", None, None, [(0.0, 0.0), (0.01, 0.0)]),
    ])
    net = spark.createDataFrame([
        (5, 1, "NB", [(0.0, h / 2), (0.01, h / 2)]), (5, 2, "SB", [(0.0, -h / 2), (0.01, -h / 2)]),  # as near: the smaller line
        (99, 3, "WB", [(-5.0, 0.0002), (5.0, 0.0002)]), (42, 4, "EB", [(0.0, 0.0), (0.01, 0.0)]),
        (5, 5, "??", [(0.0, 0.5), (0.01, 0.5)]), (5, 6, "NB", [(0.0, 0.5001), (0.01, 0.5001)]), (7, 8, "NB", None), (7, 9, "NB", []),
    ], NET)
    routes = spark.createDataFrame([(5,), (99,), (99,), (None,), (7,)], "route int")
    got = {(r.edge, r.route): (r.dir, r.ref, r.reason) for r in W.assign_freeways(edges, spark.createDataFrame([], REL), net, routes).collect()}
    assert got == {
        ("on", 5): ("N", "I 5", None), ("on", 99): ("W", "SHN:99", None), ("far", 5): (None, "I 5;I 7", "too_far"), ("far", 7): (None, "I 5;I 7", "too_far"),
        ("bare", 5): ("N", "SHN:5", None), ("bare", 99): ("W", "SHN:99", None), ("undrawn", 99): (None, "CA 99", "no_geometry"), ("odd", 5): (None, "I 5", "too_far"),
    }
    assert W.assign_freeways(edges, spark.createDataFrame([], REL), net.limit(0), routes.limit(0)).count() == 0


def test_line_search_equals_brute_force(spark):
    rng = random.Random(3)
    p = [(k, rng.uniform(-1, 1), rng.uniform(-1, 1)) for k in range(400)] + [(400 + k, 0.25, -0.5) for k in range(30)]
    lines = [(k % 7, k, "NB", [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(rng.randint(1, 4))]) for k in range(60)]
    lines += [(r, 100 + k, d, pts) for k, (r, _, d, pts) in enumerate(lines[:9])]
    limit, want = 0.02, {}
    for i, x, y in p:
        for route, line, _, pts in lines:
            for (ax, ay), (bx, by) in zip(pts, pts[1:] or pts):
                dx, dy = bx - ax, by - ay
                t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                dist = ((ax + t * dx - x) ** 2 + (ay + t * dy - y) ** 2) ** 0.5
                if dist <= limit:
                    want[i, route] = min(want.get((i, route), (9.0, 0)), (round(dist, 12), line))
    near = W.lines_near(spark.createDataFrame(p, "id int, x double, y double"), spark.createDataFrame(lines, NET), "route", limit)
    got = {(r.id, r.route): (r.dist, r.line) for r in near.collect()}
    assert len(want) > 150 and got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
