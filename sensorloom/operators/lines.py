"""Positions along lines: brackets, interpolation, projection, ramps, paired and embedded sensors, altitude paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracket(points: DataFrame, refs: DataFrame, by: list[str], pos: str, rid: str, tolerance: float, reach: float | None = None) -> DataFrame:
    """points (id, by, pos) with the reference rows (by, pos, rid) around them: match, lower, lower_pos, upper, upper_pos, mode, gap.

    exact: the nearest row (the lower of two as near) lies within max(tolerance, 0.05) and is
    match, lower and upper. before_start, after_end: the first or last row is both. Else
    between, if both neighbours lie within `reach` (the tolerance, unless given), gap the
    larger distance; or all null. Of rows at one place the smaller rid comes first. Both sides
    are put in one order per key and references are carried forward and backward: one shuffle, no range join.
    """
    reach = tolerance if reach is None else reach
    row = F.struct(F.col(pos).alias("pos"), F.col("__a").alias("first"), F.col("__z").alias("last"))
    r = refs.groupBy(*by, pos).agg(F.min(rid).alias("__a"), F.max(rid).alias("__z")).select(*by, F.col(pos).alias("__p"), row.alias("__r"), F.lit(None).cast(dict(points.dtypes)["id"]).alias("id"))
    p = points.select(*by, F.col(pos).alias("__p"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), "id")
    w = Window.partitionBy(*by).orderBy("__p")
    u = r.unionByName(p).withColumn("lo", F.last("__r", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.first("__r", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    u = u.where("id is not null").withColumn("dl", F.abs(F.col("lo.pos") - F.col("__p"))).withColumn("dh", F.abs(F.col("hi.pos") - F.col("__p")))
    inf = F.lit(float("inf"))
    low, high = F.coalesce("dl", inf), F.coalesce("dh", inf)
    mode = F.when(F.least(low, high) <= max(tolerance, 0.05), "exact").when(F.col("lo").isNull() & F.col("hi").isNotNull(), "before_start").when(F.col("hi").isNull() & F.col("lo").isNotNull(), "after_end").when(F.greatest(low, high) <= reach, "between")
    u = u.withColumn("mode", mode)
    one = F.when(F.col("mode") == "exact", F.when(low <= high, F.struct(F.col("lo.pos"), F.col("lo.first").alias("rid"))).otherwise(F.struct(F.col("hi.pos"), F.col("hi.first").alias("rid")))).when(F.col("mode") == "before_start", F.struct(F.col("hi.pos"), F.col("hi.first").alias("rid"))).when(F.col("mode") == "after_end", F.struct(F.col("lo.pos"), F.col("lo.last").alias("rid")))
    between = F.col("mode") == "between"
    lower, upper = F.coalesce(one, F.when(between, F.struct(F.col("lo.pos"), F.col("lo.last").alias("rid")))), F.coalesce(one, F.when(between, F.struct(F.col("hi.pos"), F.col("hi.first").alias("rid"))))
    gap = F.when(between, F.greatest(low, high)).when(F.col("mode").isNotNull(), F.least(low, high))
    return u.select("id", *by, F.col("__p").alias(pos), F.when(F.col("mode") == "exact", one["rid"]).alias("match"), lower["rid"].alias("lower"), lower["pos"].alias("lower_pos"), upper["rid"].alias("upper"), upper["pos"].alias("upper_pos"), "mode", gap.alias("gap"))


def interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """y at x between (x0, y0) and (x1, y1), held at the ends; y0 where both ends are one, the known end where the other is null."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(x - x0, x1 - x0), F.lit(0.0))))
    return F.coalesce(y0 + f * (y1 - y0), y0, y1)


def project(points: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """(id, line, x, y, along, dist): nearest point of every line of the same key; lines has line, by and pts (array of x, y structs).

    Lines go in segments; the foot of each is held at its ends. Ties: the earlier segment.
    """
    pairs = F.arrays_zip(F.slice("pts", F.lit(1), F.size("pts") - 1).alias("a"), F.slice("pts", F.lit(2), F.size("pts") - 1).alias("b"))
    seg = lines.select(*by, "line", F.posexplode(pairs).alias("seg", "s")).select(*by, "line", "seg", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by_"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    size = F.sqrt(dx * dx + dy * dy)
    w = Window.partitionBy("line").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0.0)))
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy, dx * dx + dy * dy), F.lit(0.0))))
    j = points.select("id", *by, F.col("x").alias("px"), F.col("y").alias("py")).join(seg, by).withColumn("f", f).withColumn("x", F.col("ax") + F.col("f") * dx).withColumn("y", F.col("ay") + F.col("f") * dy)
    d = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    best = j.groupBy("id", "line").agg(F.min(F.struct(F.round(d, 9).alias("dist"), "seg", "x", "y", (F.col("before") + F.col("f") * size).alias("along"))).alias("m"))
    return best.select("id", "line", "m.x", "m.y", "m.along", "m.dist")


def nearest_line(points: DataFrame, lines: DataFrame, by: list[str], limit: float) -> DataFrame:
    """points with line, dist and reason: the nearest line of the same key within limit; no_line or too_far otherwise. Ties: the smaller line."""
    best = project(points, lines, by).groupBy("id").agg(F.min(F.struct("dist", "line")).alias("m"))
    j = points.join(best, "id", "left")
    near = F.col("m.dist") <= limit
    return j.select(*points.columns, F.when(near, F.col("m.line")).alias("line"), F.col("m.dist").alias("dist"), F.when(F.col("m").isNull(), "no_line").when(~near, "too_far").alias("reason"))


def ramp_links(incidence: DataFrame, mainline: DataFrame) -> DataFrame:
    """(link, kind, node): ramp links that touch a mainline node: incidence +1 is an on-ramp, -1 an off-ramp; the first node of each link."""
    t = incidence.join(mainline.select("node").distinct(), "node", "left_semi").where(F.col("incidence").isin(1, -1))
    return t.groupBy("link").agg(F.min(F.struct("node", "incidence")).alias("m")).select("link", F.when(F.col("m.incidence") == 1, "on").otherwise("off").alias("kind"), "m.node")


def match_ramps(sensors: DataFrame, ramps: DataFrame, nodes: DataFrame, by: list[str], limit: float) -> DataFrame:
    """(id, kind, link, dist, reason): each ramp sensor (id, kind, by, x, y) with the nearest ramp of its kind and key.

    ramps (link, kind, node) and nodes (node, by, x, y) are joined first. Reasons: no_ramp
    where the key has none of the kind, too_far beyond the limit. Ties: the smaller link.
    """
    place = ["kind", *by, "x", "y"]
    # Sensors at one place have one answer, and of ramps at one place only the smallest link can win: pairs are of distinct places.
    r = ramps.join(nodes, "node").groupBy(*place).agg(F.min("link").alias("link")).withColumnsRenamed({"x": "__x", "y": "__y"})
    d = F.sqrt((F.col("x") - F.col("__x")) ** 2 + (F.col("y") - F.col("__y")) ** 2)
    best = sensors.select(*place).distinct().join(r, ["kind", *by]).groupBy(*place).agg(F.min(F.struct(F.round(d, 9).alias("dist"), "link")).alias("m"))
    s, b = sensors.alias("__s"), best.alias("__b")
    same = reduce(lambda p, q: p & q, [F.col(f"__s.{c}").eqNullSafe(F.col(f"__b.{c}")) for c in place])
    j = s.join(b, same, "left").select("__s.*", "__b.m")
    near = F.col("m.dist") <= limit
    return j.select("id", "kind", F.when(near, F.col("m.link")).alias("link"), F.col("m.dist").alias("dist"), F.when(F.col("m").isNull(), "no_ramp").when(~near, "too_far").alias("reason"))


def nearest_along(left: DataFrame, right: DataFrame, by: list[str], pos: str) -> DataFrame:
    """left (id, by, pos) with match and dist of the nearest right (id, by, pos) of the same key, kept without one; ties to the smaller id.

    The last right row before and the next one after are carried along: one sort per key.
    """
    r = right.groupBy(*by, pos).agg(F.min("id").alias("__rid")).select(*by, F.col(pos).alias("__p"), F.struct(F.col(pos).alias("pos"), F.col("__rid").alias("rid")).alias("__r"), F.lit(None).cast(dict(left.dtypes)["id"]).alias("id"))
    q = left.select(*by, F.col(pos).alias("__p"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), "id")
    w = Window.partitionBy(*by).orderBy("__p")
    lo, hi = F.last("__r", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.first("__r", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    u = r.unionByName(q).withColumn("lo", lo).withColumn("hi", hi).where("id is not null")
    options = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.pos") - F.col("__p")).alias("dist"), F.col(f"{c}.rid").alias("match"))) for c in ("lo", "hi")])
    best = F.array_min(F.filter(options, lambda x: x.isNotNull()))
    return u.select("id", *by, F.col("__p").alias(pos), best["match"].alias("match"), best["dist"].alias("dist"))


def lane_pairs(sensors: DataFrame, by: list[str], pos: str, kind: str, first: str, second: str, threshold: float) -> DataFrame:
    """(id, match, dist, colocated): each sensor of kind `first` with the nearest of kind `second` on its line; colocated below the threshold."""
    n = nearest_along(sensors.where(F.col(kind) == first), sensors.where(F.col(kind) == second), by, pos)
    return n.select("id", "match", "dist", F.coalesce(F.col("dist") < threshold, F.lit(False)).alias("colocated"))


def pending_sensors(sensors: DataFrame, kind: str, value: str, by: list[str]) -> DataFrame:
    """(by, n): sensors of a kind that wait for manual work, counted by line."""
    return sensors.where(F.col(kind) == value).groupBy(*by).agg(F.count("*").alias("n")).withColumn("status", F.lit("pending_manual"))


def embed_sensors(edges: DataFrame, sensors: DataFrame) -> DataFrame:
    """(edge, part, src, dst, length): edges (edge, src, dst, length) cut at the sensors (id, edge, along) on them, in order.

    Sensors beyond the ends are held at them; sensors become nodes named by their ids.
    """
    s = sensors.join(edges.select("edge", "length"), "edge").select("edge", F.greatest(F.lit(0.0), F.least("along", "length")).alias("at"), F.lit(1).alias("k"), F.col("id").alias("node"))
    ends = edges.select("edge", F.explode(F.array(F.struct(F.lit(0.0).alias("at"), F.lit(0).alias("k"), F.col("src").alias("node")), F.struct(F.col("length").alias("at"), F.lit(2).alias("k"), F.col("dst").alias("node")))).alias("e")).select("edge", "e.*")
    w = Window.partitionBy("edge").orderBy("at", "k", "node")
    stops = s.unionByName(ends).select("edge", F.row_number().over(w).alias("part"), F.col("node").alias("src"), F.lead("node").over(w).alias("dst"), (F.lead("at").over(w) - F.col("at")).alias("length"))
    return stops.where("dst is not null")


def line_cells(y0: Column, x0: Column, y1: Column, x1: Column) -> Column:
    """Array of grid cells (y, x) on the straight line between two cells, one for each step of the longer axis."""
    n = F.greatest(F.abs(y1 - y0), F.abs(x1 - x0))
    at = lambda a, b, i: F.floor(a + (b - a) * i / F.greatest(n, F.lit(1)) + 0.5).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(at(y0, y1, i).alias("y"), at(x0, x1, i).alias("x")))


def altitude_graph(pairs: DataFrame, grid: DataFrame, limit: float, threshold: float, most: int = 3) -> DataFrame:
    """(src, dst, dist): of candidate pairs (src, y0, x0, dst, y1, x1, dist) those within (0, limit] with fewer than `most` cells on the line higher than either end by the threshold.

    grid is (y, x, altitude). Cells of a line are exploded and joined with the grid; ends are its first and last cell.
    """
    near = pairs.where((F.col("dist") > 0) & (F.col("dist") <= limit)).withColumn("cells", line_cells(F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1")))
    c = near.select("src", "dst", "dist", F.size("cells").alias("n"), F.posexplode("cells").alias("i", "c")).select("src", "dst", "dist", "n", "i", "c.y", "c.x").join(grid, ["y", "x"])
    a = c.groupBy("src", "dst", "dist").agg(F.max(F.when(F.col("i") == 0, F.col("altitude"))).alias("a"), F.max(F.when(F.col("i") == F.col("n") - 1, F.col("altitude"))).alias("b"), F.array_agg("altitude").alias("h"))
    high = lambda end: F.size(F.filter("h", lambda h: h - F.col(end) > threshold))
    return a.where((high("a") < most) & (high("b") < most)).select("src", "dst", "dist")
