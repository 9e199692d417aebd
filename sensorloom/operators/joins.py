"""As-of, range, nearest and k-nearest joins, catalogs, set differences and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres, radius 6371000."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance in kilometres."""
    dx, dy = (lon2 - lon1) * 111.320 * F.cos(F.radians((lat1 + lat2) / 2)), (lat2 - lat1) * 110.540
    return F.sqrt(dx * dx + dy * dy)


def degree_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in degrees, times 111320."""
    return F.sqrt((lat2 - lat1) ** 2 + (lon2 - lon1) ** 2) * 111320


def polyline_length(points: Column) -> Column:
    """Length of an array of (x, y) structs."""
    n = F.size(points)
    pairs = F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.sqrt((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2))
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)


def asof(left: DataFrame, right: DataFrame, at: str, since: str, by: list[str], payload: str, fallback: bool = False) -> DataFrame:
    """Latest right row with since <= at, per key; with fallback the earliest where there is none.

    The two sides are put in one order per key and the last payload is carried forward: one
    shuffle by key and no range join.
    """
    r = right.select(*by, F.col(since).alias("__o"), F.lit(0).alias("__side"), F.struct(F.col(since).alias("s"), F.col(payload).alias("p")).alias("__r"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__l"))
    q = left.select(*by, F.col(at).alias("__o"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    w = Window.partitionBy(*by).orderBy("__o", "__side")
    got = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if fallback:
        got = F.coalesce(got, F.first("__r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    u = r.unionByName(q).withColumn("__got", got).where("__side = 1")
    return u.select("__l.*", F.col("__got.p").alias(payload), F.col("__got.s").alias(since))


def within_radius(points: DataFrame, radius_m: float) -> DataFrame:
    """Unordered pairs (a, b, dist_m) of points (id, lat, lon) at most radius_m apart.

    Points meet in grid cells as wide as the radius; one side is put in its cell and the
    neighbours', so only points near each other are compared. Cells of longitude widen with
    the latitude; beyond 85 degrees they are not meant to be used.
    """
    step = radius_m / 111000.0
    cell = lambda x: F.floor(x / step)
    wide = F.cos(F.radians(F.least(F.abs(F.col("lat")) + step, F.lit(85.0))))
    a = points.select(F.col("id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), cell(F.col("lat")).alias("cy"), F.floor(F.col("lon") / step).alias("cx"))
    reach = F.ceil(1 / wide).cast("int")
    b = points.withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dx", F.explode(F.sequence(-reach, reach))).select(
        F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), (cell(F.col("lat")) + F.col("dy")).alias("cy"), (F.floor(F.col("lon") / step) + F.col("dx")).alias("cx")
    )
    j = a.join(b, ["cy", "cx"]).where("a < b").withColumn("dist_m", haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    return j.where(F.col("dist_m") <= radius_m).select("a", "b", "dist_m")


def bins_join(df: DataFrame, value: str, edges: list[float], out: str = "bin") -> DataFrame:
    """Index of the half-open bin [edge k, edge k+1) of a value, the last bin open; null below the first edge."""
    b = reduce(lambda acc, e: acc.when(F.col(value) >= e[1], e[0]), reversed(list(enumerate(edges))), F)
    return df.withColumn(out, b)


def consecutive(points: DataFrame, by: list[str], order: Column, node: str, max_gap: float | None = None) -> DataFrame:
    """(by..., src, dst, gap): each node with the next one along its line."""
    w = Window.partitionBy(*by).orderBy(order.asc_nulls_last(), node)
    e = points.select(*by, F.col(node).alias("src"), F.lead(node).over(w).alias("dst"), F.abs(F.lead(order).over(w) - order).alias("gap")).where("dst is not null")
    return e if max_gap is None else e.where(F.col("gap") <= max_gap)


def colocated(points: DataFrame, by: list[str], position: str, eps: float) -> DataFrame:
    """Groups along a line: a gap above eps starts a new one."""
    w = Window.partitionBy(*by).orderBy(position, "id")
    fresh = (F.coalesce(F.col(position) - F.lag(position).over(w), F.lit(eps + 1)) > eps).cast("int")
    return points.withColumn("__new", fresh).withColumn("grp", F.sum("__new").over(w)).drop("__new")


def nearest(left: DataFrame, right: DataFrame, by: list[str], lpos: str, rpos: str, rid: str, limit: float | None = None) -> DataFrame:
    """Each left row (id) with the nearest right row of the same key, kept without one; ties to the smaller id.

    Neighbours on either side are carried along each key's order; no pairs of a key are made.
    """
    from sensorloom.operators.lines import nearest_along

    best = nearest_along(left.select("id", *by, lpos), right.select(F.col(rid).alias("id"), *by, F.col(rpos).alias(lpos)), by, lpos).select("id", "match", "dist")
    best = best.where("match is not null") if limit is None else best.where(F.col("dist") <= limit)
    return left.join(best, "id", "left")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, field, before, after): added and removed keys, and changed fields of common ones."""
    added = new.join(old, key, "left_anti").select(key, F.lit("added").alias("status"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    removed = old.join(new, key, "left_anti").select(key, F.lit("removed").alias("status"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    both = old.select(key, *[F.col(f).cast("string").alias(f"__a{i}") for i, f in enumerate(fields)]).join(new.select(key, *[F.col(f).cast("string").alias(f"__b{i}") for i, f in enumerate(fields)]), key)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__a{i}").alias("before"), F.col(f"__b{i}").alias("after")) for i, f in enumerate(fields)])
    changed = both.select(key, F.explode(rows).alias("r")).where(~F.col("r.before").eqNullSafe(F.col("r.after"))).select(key, F.lit("changed").alias("status"), "r.*")
    return added.unionByName(removed).unionByName(changed)


def in_all(snapshots: DataFrame, key: str, snapshot: str) -> DataFrame:
    """Keys that every snapshot has."""
    total = snapshots.agg(F.count_distinct(snapshot).alias("total"))
    return snapshots.groupBy(key).agg(F.count_distinct(snapshot).alias("n")).crossJoin(F.broadcast(total)).where("n = total").select(key)


def add_edge_types(edges: DataFrame, types: DataFrame) -> DataFrame:
    """edges with edge_type = type of src + '_' + type of dst, UNK where unknown; types is (id, type)."""
    s, t = types.select(F.col("id").alias("src"), F.col("type").alias("__s")), types.select(F.col("id").alias("dst"), F.col("type").alias("__t"))
    j = edges.join(s, "src", "left").join(t, "dst", "left")
    return j.withColumn("edge_type", F.concat_ws("_", F.coalesce("__s", F.lit("UNK")), F.coalesce("__t", F.lit("UNK")))).drop("__s", "__t")
