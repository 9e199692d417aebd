"""Freeway assignment: mainline edges of a road map given to the routes that sensors stand on, with a direction.

A route comes from the edge's own references, from those of the route relations its ways belong
to, and from the nearest line of a highway network; the direction comes from that line only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.joins import polyline_length

#: References whose number is not the route's.
SPECIAL = {"I 80 Bus": 51, "I 80 Business": 51, "I 305": 305}
#: Directions of network lines and those of sensors.
DIRECTIONS = {"NB": "N", "SB": "S", "EB": "E", "WB": "W"}
#: Classes of mainline edges.
MAINLINE = ("motorway", "trunk")


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _pieces(text: Column) -> Column:
    """Trimmed parts of a text cut at semicolons; none for null and blank texts."""
    none = F.array().cast("array<string>")
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", none).otherwise(F.transform(F.split(text, ";"), lambda x: F.trim(x)))


def route_number(ref: Column, special: dict[str, int] | None = None) -> Column:
    """Route of a reference: a special one by name, else its first digits, else null."""
    return F.coalesce(_lookup(special or SPECIAL, ref).cast("long"), F.regexp_extract(ref, r"([0-9]+)", 1).try_cast("long"))


def midpoint(points: Column) -> Column:
    """struct (x, y) halfway along an array of (x, y) structs; null for null and empty arrays."""
    first = points[0]
    start = F.struct((polyline_length(points) / 2).alias("left"), first["x"].cast("double").alias("x"), first["y"].cast("double").alias("y"), F.lit(False).alias("done"))

    def walk(at: Column, to: Column) -> Column:
        dx, dy = to["x"] - at["x"], to["y"] - at["y"]
        size = F.sqrt(dx * dx + dy * dy)
        share = F.when(size >= at["left"], F.coalesce(F.try_divide(at["left"], size), F.lit(0.0))).otherwise(1.0)
        gone = F.struct((at["left"] - size).alias("left"), (at["x"] + dx * share).alias("x"), (at["y"] + dy * share).alias("y"), (size >= at["left"]).alias("done"))
        return F.when(at["done"], at).otherwise(gone)

    end = F.aggregate(points, start, walk)
    return F.when(F.size(points) > 0, F.struct(end["x"].alias("x"), end["y"].alias("y")))


def edge_references(edges: DataFrame, relations: DataFrame, special: dict[str, int] | None = None) -> DataFrame:
    """(edge, refs, routes, sources, issue, ambiguous) of every mainline edge.

    edges is (edge, highway, ref, unsigned_ref, osmid), each text with parts between
    semicolons; relations is (way, relation, ref). refs are the parts of ref, then references
    of relations in the order of the edge's ways and of relation, then parts of unsigned_ref,
    later ones only where they are not there yet. Ways that are no whole number are left out.
    issue is no_ref without a reference and no_number where none has a route; ambiguous edges
    have several references; sources is way, relation, both or null, by which of the two has one.
    """
    e = edges.where(F.col("highway").isin(*MAINLINE)).select("edge", "ref", "unsigned_ref", "osmid").dropDuplicates(["edge"])
    part = lambda rank: lambda x, i: F.struct(F.lit(rank).alias("rank"), i.cast("long").alias("at"), F.lit(0).cast("long").alias("then"), x.alias("ref"))
    none = F.array(part(-1)(F.lit(None).cast("string"), F.lit(0)))  # keeps edges without a reference
    own = e.select("edge", F.explode(F.concat(none, F.transform(_pieces(F.col("ref")), part(0)), F.transform(_pieces(F.col("unsigned_ref")), part(2)))).alias("p")).select("edge", "p.*").where("rank < 2 or ref <> ''")
    ways = e.select("edge", F.posexplode(F.split("osmid", ";")).alias("at", "way")).select("edge", F.col("at").cast("long").alias("at"), F.trim("way").try_cast("long").alias("way")).where("way is not null")
    r = relations.where("way is not null and ref <> ''").select(F.col("way").cast("long").alias("way"), F.col("relation").cast("long").alias("then"), F.trim("ref").alias("ref"))
    found = own.unionByName(ways.join(r, "way").select("edge", F.lit(1).alias("rank"), "at", "then", "ref")).repartition("edge")
    place = F.struct("rank", "at", "then")
    # A reference stands at its first place only, but the edge's own are kept as they are written.
    found = found.withColumn("first", F.row_number().over(Window.partitionBy("edge", "ref").orderBy(place))).withColumn("route", route_number(F.col("ref"), special))
    said = F.col("rank") >= 0
    g = found.groupBy("edge").agg(
        F.array_sort(F.collect_list(F.when(said & ((F.col("rank") == 0) | (F.col("first") == 1)), F.struct(place.alias("place"), "ref")))).alias("refs"),
        F.array_sort(F.collect_set("route")).alias("routes"), F.count_if(F.col("rank") == 0).alias("way"), F.count_if(F.col("rank") == 1).alias("rel"),
    )
    way, rel = F.col("way") > 0, F.col("rel") > 0
    return g.select(
        "edge", F.col("refs.ref").alias("refs"), "routes", F.when(way & rel, "both").when(way, "way").when(rel, "relation").alias("sources"),
        F.when(F.size("refs") == 0, "no_ref").when(F.size("routes") == 0, "no_number").alias("issue"), (F.size("refs") > 1).alias("ambiguous"),
    )


def segments(lines: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, ax, ay, bx, by) of each two neighbouring points of lines (keep, points); a line of one point is a segment of no length."""
    n = F.size("points")
    pair = lambda i: F.struct(F.col("points")[i].alias("a"), F.col("points")[F.least(i + 1, n - 1)].alias("b"))
    s = lines.where(n > 0).select(*keep, F.explode(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), pair)).alias("s"))
    return s.select(*keep, *[F.col(f"s.{p}.{c}").cast("double").alias(p + c) for p in "ab" for c in "xy"])


def lines_near(points: DataFrame, lines: DataFrame, by: str, limit: float, cells: float = 10.0) -> DataFrame:
    """(id, by, line, direction, dist): for each key of lines the line nearest to a point (id, x, y), where it is within limit; ties to the smaller line.

    Points and segments meet in grid cells `cells` limits wide. A segment is laid into the cells
    around pieces of itself no longer than a cell, so long segments take cells in proportion to
    their length and no pair further apart than a few cells is made. Equal points are looked up
    once, and equal segments of a key stand once, so that repeated rows make no hot cell.
    """
    width = limit * cells
    cell = lambda v: F.floor(v / width)
    at = points.where("x is not null and y is not null").select("id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    places = at.select("px", "py").distinct().withColumn("cx", cell(F.col("px"))).withColumn("cy", cell(F.col("py")))
    s = segments(lines, [by, "line", "direction"]).groupBy(by, "ax", "ay", "bx", "by").agg(F.min(F.struct("line", "direction")).alias("l"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    pieces = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / width))
    laid = s.withColumn("n", pieces).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    for c, d in (("x", dx), ("y", dy)):
        a, b = F.col(f"a{c}") + d * F.col("k") / F.col("n"), F.col(f"a{c}") + d * (F.col("k") + 1) / F.col("n")
        laid = laid.withColumn(f"c{c}", F.explode(F.sequence(cell(F.least(a, b) - limit * 1.001), cell(F.greatest(a, b) + limit * 1.001))))
    laid = laid.select(by, "l", "ax", "ay", "bx", "by", "cx", "cy").distinct()
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy, dx * dx + dy * dy), F.lit(0.0))))
    ox, oy = F.col("ax") + share * dx - F.col("px"), F.col("ay") + share * dy - F.col("py")
    met = places.join(laid, ["cx", "cy"]).withColumn("dist", F.sqrt(ox * ox + oy * oy)).where(F.col("dist") <= limit)
    best = met.groupBy("px", "py", by).agg(F.min(F.struct(F.round("dist", 12).alias("dist"), "l")).alias("m"))
    return at.join(best, ["px", "py"]).select("id", by, "m.l.line", "m.l.direction", "m.dist")


def assign_freeways(edges: DataFrame, relations: DataFrame, network: DataFrame, routes: DataFrame, limit: float = 0.0003, special: dict[str, int] | None = None, mark: str = "SHN") -> DataFrame:
    """(edge, route, dir, ref, reason): every mainline edge under each route of `routes` it belongs to.

    edges as in edge_references, with points, an array of (x, y) in degrees; network is
    (route, line, direction, points). For each route, the network's line nearest to the edge's
    midpoint counts where it is within limit and its direction is known (if the nearest one's
    is not, no other is taken): it gives the direction, and membership too where no
    reference does; ref is then mark:route, else all the edge's references. dir is null, and
    reason no_geometry or too_far, where no such line is found. Null edges, routes and points
    are left out; of rows with one edge id, one stands for it; empty tables give no rows.
    """
    wanted = routes.where("route is not null").select(F.col("route").cast("long").alias("route")).distinct()
    main = edges.where(F.col("highway").isin(*MAINLINE) & F.col("edge").isNotNull()).dropDuplicates(["edge"])
    refs = edge_references(main, relations, special).select("edge", F.explode("routes").alias("route"), F.array_join("refs", ";").alias("ref"))
    mid = main.select(F.col("edge").alias("id"), midpoint(F.col("points")).alias("p")).select("id", "p.x", "p.y")
    lines = network.select(F.col("route").cast("long").alias("route"), "line", "direction", "points").join(wanted, "route", "left_semi")
    near = lines_near(mid, lines, "route", limit).withColumn("dir", _lookup(DIRECTIONS, F.col("direction"))).where("dir is not null")
    both = refs.join(wanted, "route", "left_semi").join(near.select(F.col("id").alias("edge"), "route", "dir"), ["edge", "route"], "full")
    known = main.select("edge", (F.coalesce(F.size("points"), F.lit(0)) > 0).alias("drawn"))
    reason = F.when(F.col("dir").isNull(), F.when(F.col("drawn"), "too_far").otherwise("no_geometry"))
    return both.join(known, "edge").select("edge", "route", "dir", F.coalesce("ref", F.concat(F.lit(mark + ":"), F.col("route"))).alias("ref"), reason.alias("reason"))
