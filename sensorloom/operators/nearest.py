"""Exact k nearest neighbours of any number of points in the plane or on the globe.

Equal positions are one, with their k + 1 smallest ids. Positions are dealt by ranges of a
Z-order code, and each range is split, quarter by quarter, into leaves of few positions, so
clusters get small leaves and empty land large ones. A leaf's parent cell holds more than k
positions; its diagonal bounds the distance of every k-th neighbour. Leaves look up the cells
within that bound, the bound shrinks to the nearest full leaf, and only positions of leaves
that remain are measured: no point meets all others.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.graph import kept
from sensorloom.operators.joins import flat_km, haversine_m

LEVELS = 31


@dataclass(frozen=True)
class Metric:
    """A distance of (x1, y1, x2, y2) and its bounds.

    rates(x from, x to, y from, y to) gives (per_x, per_y, stretch): the distance is at least
    per_x |dx| and per_y |dy|, and at most stretch times the hypotenuse of the two.
    """

    distance: Callable[[Column, Column, Column, Column], Column]
    rates: Callable[[float, float, float, float], tuple[float, float, float]]


def _widest(a: float, b: float) -> float:
    return max(abs(a), abs(b))


def _narrowest(a: float, b: float) -> float:
    return 0.0 if a <= 0 <= b else min(abs(a), abs(b))


def _flat(x0: float, x1: float, y0: float, y1: float) -> tuple[float, float, float]:
    low, high = math.cos(math.radians(_widest(x0, x1))), math.cos(math.radians(_narrowest(x0, x1)))
    return 110.540, 111.320 * max(low, 1e-3), high / max(low, 1e-3)


def _globe(x0: float, x1: float, y0: float, y1: float) -> tuple[float, float, float]:
    """sin is concave: a longitude's chord is at least what the widest one leaves for each degree."""
    low, high, wide = math.cos(math.radians(_widest(x0, x1))), math.cos(math.radians(_narrowest(x0, x1))), max(math.radians(y1 - y0), 1e-9)
    least = 2 * 6371000 * math.asin(min(1.0, max(low, 1e-3) * math.sin(min(wide, math.pi) / 2))) / math.degrees(wide)
    degree = 6371000 * math.radians(1)
    return degree, least, max(1.0, degree * high / least)


#: x is the latitude, y the longitude of the two on the globe; those points must not lie across the 180th meridian.
PLANE = Metric(lambda x1, y1, x2, y2: F.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), lambda *_: (1.0, 1.0, 1.0))
FLAT_KM = Metric(flat_km, _flat)
HAVERSINE_M = Metric(haversine_m, _globe)


def leaves_of(codes, most: int):
    """(level, leaf number) of each of sorted Z-order codes: the largest quarter cells with at most `most` codes; overfull finest cells are cut into runs."""
    import numpy as np

    level = np.full(len(codes), -1)
    for at in range(LEVELS + 1):
        open_ = np.flatnonzero(level < 0)
        if not len(open_):
            break
        cell = codes[open_] >> 2 * (LEVELS - at)
        new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[new, len(cell)])
        small = np.repeat((sizes <= most) | (at == LEVELS), sizes)
        level[open_[small]] = at
    cell = codes >> 2 * (LEVELS - level)
    changed = np.r_[True, (cell[1:] != cell[:-1]) | (level[1:] != level[:-1])] if len(codes) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(changed, np.arange(len(codes)), 0)) if len(codes) else np.zeros(0, int)
    inside = np.arange(len(codes)) - start
    return level, np.cumsum(changed | (inside % most == 0)) - 1


def _positions(points: DataFrame, k: int) -> DataFrame:
    """(x, y, ids): each position with the k + 1 smallest of its ids; the limit is applied before the shuffle too."""
    w = Window.partitionBy("x", "y").orderBy("id")
    few = points.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    return few.groupBy("x", "y").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def knn(points: DataFrame, k: int, metric: Metric = PLANE, leaf: int = 0, range_rows: int = 1 << 17) -> DataFrame:
    """The k nearest other points of each point (id, x, y) as (src, dst, dist), ties to the smaller dst; all others where there are fewer.

    Points with a null id or coordinate have no neighbours. Points at one place are
    neighbours at distance 0. Ids are distinct.
    """
    spark = points.sparkSession
    known = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    placed = kept(_positions(known, k))
    b = placed.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not b["n"]:
        return known.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"))
    per_x, per_y, stretch = metric.rates(b["x0"], b["x1"], b["y0"], b["y1"])
    side = max((b["x1"] - b["x0"]) * per_x, (b["y1"] - b["y0"]) * per_y, 1e-300) * (1 + 1e-9)
    most = leaf or max(16, 2 * (k + 1))
    grid = lambda v, low, per: F.least(F.floor((F.col(v) - low) * (per / side) * (1 << LEVELS)), F.lit((1 << LEVELS) - 1)).cast("long")

    def spread(c: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.call_function("shiftleft", c, F.lit(shift))).bitwiseAND(F.lit(mask))
        return c

    coded = placed.withColumn("code", spread(grid("x", b["x0"], per_x)).bitwiseOR(F.call_function("shiftleft", spread(grid("y", b["y0"], per_y)), F.lit(1))))
    ranges = max(1, -(-b["n"] // range_rows))

    def split(pdfs):
        import pandas as pd
        from pyspark import TaskContext

        pdf = pd.concat(list(pdfs), ignore_index=True)
        if not len(pdf):
            return
        pdf = pdf.sort_values(["code", "x", "y"], ignore_index=True)
        level, number = leaves_of(pdf["code"].to_numpy(), most)
        yield pdf.assign(level=level, leaf=number + (TaskContext.get().partitionId() << 40))

    schema = coded.schema.simpleString()[7:-1].replace(":", " ") + ", level int, leaf long"
    held = kept((coded.repartitionByRange(ranges, "code") if ranges > 1 else coded.coalesce(1)).mapInPandas(split, schema))

    # Leaves as boxes, in units of the distance.
    ux, uy = F.col("x") * per_x, F.col("y") * per_y
    boxes = held.groupBy("leaf").agg(F.first("level").alias("level"), F.min("code").alias("code"), F.count("*").alias("n"), F.min(ux).alias("ax"), F.max(ux).alias("bx"), F.min(uy).alias("ay"), F.max(uy).alias("by"))
    boxes = kept(boxes)
    cell = lambda c, lev: F.expr(f"shiftright({c}, 2 * ({LEVELS} - ({lev})))")
    even = lambda c: F.expr("aggregate(sequence(0, 30), 0L, (s, i) -> s | shiftleft(shiftright(%s, 2 * i) & 1L, i))" % c)
    # A leaf asks, at its parent's level, for the cells within the bound of its parent's cell.
    reach = math.ceil(stretch * math.sqrt(2) + 1e-9)
    asked = boxes.withColumn("q", F.greatest(F.col("level") - 1, F.lit(0))).withColumn("pc", cell("code", "q"))
    asked = asked.withColumn("cx", even("pc")).withColumn("cy", even("shiftright(pc, 1)"))
    # In a range of few positions the parent's cell may hold less than k + 1: such leaves ask for everything.
    full = held.select(F.explode(F.array(F.col("level") - 1)).alias("q"), "code").where("q >= 0").withColumn("pc", cell("code", "q")).groupBy("q", "pc").agg(F.count("*").alias("sure"))
    asked = asked.join(full, ["q", "pc"], "left")
    bounded = F.coalesce(F.col("sure"), F.lit(0)) > k
    side_at = F.lit(side) / F.pow(F.lit(2.0), F.col("q"))
    asked = asked.withColumn("bound", F.when(bounded | (F.col("n") > k), stretch * math.sqrt(2) * side_at).otherwise(F.lit(float("inf"))))
    asked = asked.withColumn("q", F.when(F.col("bound") < float("inf"), F.col("q")).otherwise(0)).withColumn("cx", F.when(F.col("bound") < float("inf"), F.col("cx")).otherwise(0)).withColumn("cy", F.when(F.col("bound") < float("inf"), F.col("cy")).otherwise(0))
    near = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    spots = asked.withColumn("o", F.explode(near)).withColumn("cx", F.col("cx") + F.col("o.i")).withColumn("cy", F.col("cy") + F.col("o.j"))
    limit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("q"))
    spots = spots.where((F.col("cx") >= 0) & (F.col("cy") >= 0) & (F.col("cx") < limit) & (F.col("cy") < limit))
    spots = spots.select("leaf", "q", spread(F.col("cx")).bitwiseOR(F.call_function("shiftleft", spread(F.col("cy")), F.lit(1))).alias("c"))
    # Smaller leaves are found by their ancestor at the asked level, larger ones as an ancestor of the asked cell.
    above = boxes.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("level")))).select(F.col("leaf").alias("other"), "q", cell("code", "q").alias("c"))
    inside = spots.join(above, ["q", "c"]).select("leaf", "other")
    up = spots.where("q > 0").withColumn("l", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).select("leaf", F.col("l").alias("q"), F.expr("shiftright(c, 2 * (q - l))").alias("c")).distinct()
    outside = up.join(boxes.select(F.col("leaf").alias("other"), F.col("level").alias("q"), cell("code", "level").alias("c")), ["q", "c"]).select("leaf", "other")
    pairs = inside.unionByName(outside).distinct()

    o = boxes.select(*[F.col(c).alias(c if c == "level" else f"o_{c}") for c in ("leaf", "n", "ax", "bx", "ay", "by")])
    gap = lambda a, z, oa, oz: F.greatest(F.col(oa) - F.col(z), F.col(a) - F.col(oz), F.lit(0.0))
    far = lambda a, z, oa, oz: F.greatest(F.col(oz) - F.col(a), F.col(z) - F.col(oa))
    m = pairs.join(asked.select("leaf", "bound", "ax", "bx", "ay", "by"), "leaf").join(o, F.col("other") == F.col("o_leaf"))
    m = m.withColumn("least", F.greatest(gap("ax", "bx", "o_ax", "o_bx"), gap("ay", "by", "o_ay", "o_by"))).withColumn("most", stretch * F.sqrt(far("ax", "bx", "o_ax", "o_bx") ** 2 + far("ay", "by", "o_ay", "o_by") ** 2))
    m = kept(m.select("leaf", "other", "bound", "least", F.when(F.col("o_n") > k, F.col("most")).alias("most")))
    tight = m.groupBy("leaf").agg((F.least(F.min("bound"), F.coalesce(F.min("most"), F.lit(float("inf")))) * (1 + 1e-9) + 1e-12).alias("bound"))
    m = m.drop("bound").join(tight, "leaf").where("least <= bound").select("leaf", "other", "bound").join(o.select("o_leaf", "o_ax", "o_bx", "o_ay", "o_by"), F.col("other") == F.col("o_leaf"))

    mine = held.select(F.col("leaf"), F.col("code").alias("pcode"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    px, py = F.col("x1") * per_x, F.col("y1") * per_y
    outer = F.greatest(F.col("o_ax") - px, px - F.col("o_bx"), F.col("o_ay") - py, py - F.col("o_by"), F.lit(0.0))
    asks = mine.join(m, "leaf").where(outer <= F.col("bound")).select("other", "x1", "y1")
    met = asks.join(held.select(F.col("leaf").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), "ids"), "other")
    met = met.withColumn("dist", F.when((F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2")), 0.0).otherwise(metric.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))).select("x1", "y1", "dist", F.explode("ids").alias("dst"))
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("x1", "y1").orderBy("dist", "dst"))).where(F.col("r") <= k + 1)
    lists = best.groupBy(F.col("x1").alias("x"), F.col("y1").alias("y")).agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("near"))

    # A place that many points share is broadcast (at most 1000 can hold a thousandth of all points each).
    total = known.count()
    crowded = F.broadcast(known.groupBy("x", "y").agg(F.count("*").alias("times")).where(F.col("times") * 1000 > total).select("x", "y"))
    hot = known.join(F.broadcast(lists.join(crowded, ["x", "y"])), ["x", "y"])
    rest = known.join(crowded, ["x", "y"], "left_anti").join(lists, ["x", "y"])
    out = hot.unionByName(rest).select(F.col("id").alias("src"), F.slice(F.filter("near", lambda p: p["dst"] != F.col("id")), 1, k).alias("near"))
    return out.select("src", F.explode("near").alias("p")).select("src", F.col("p.dst").alias("dst"), F.col("p.dist").alias("dist"))


def knn_graph(points: DataFrame, k: int, metric: Metric = PLANE, weight: str = "gaussian", symmetric: bool = True) -> DataFrame:
    """(src, dst, weight) of the k nearest neighbours: 1 (`binary`) or exp(-(d / sigma)^2) (`gaussian`), sigma the median of the positive distances; symmetric: both ways with the larger weight.

    Raises ValueError for Gaussian weights where no distance is positive. Points at one place have weight 1.
    """
    near = kept(knn(points, k, metric))
    if weight == "binary":
        e = near.select("src", "dst", F.lit(1.0).alias("weight"))
    elif weight == "gaussian":
        sigma = near.where("dist > 0").agg(F.median("dist")).first()[0]
        if sigma is None:
            raise ValueError("Gaussian weights need a positive distance")
        e = near.select("src", "dst", F.exp(-((F.col("dist") / sigma) ** 2)).alias("weight"))
    else:
        raise ValueError(f"unknown weight {weight}")
    if not symmetric:
        return e
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return e.unionByName(back).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
