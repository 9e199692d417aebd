"""Samples of nodes around a center, joined samples that lie far apart, and rows out of text fields."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from sensorloom.operators.storage import kept


def two_hop_samples(edges: DataFrame, size: int) -> DataFrame:
    """(nodes): the distinct sorted sets of `size` nodes around every center: itself, then its nearest of at most two steps, of these those of larger degree, then smaller id. Centers with fewer nodes in reach have none.

    Directions and self loops do not count. Each node hands on its 2 * size best neighbours
    only: a center takes fewer than size, and has to pass over fewer than size that it knows
    already, so a hub's list is as short as any.
    """
    both = edges.where("src <> dst").select("src", "dst").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = kept(both)
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    best = both.join(degree.select(F.col("node").alias("dst"), (-F.col("degree")).alias("d")), "dst")
    best = best.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))).where(F.col("k") <= 2 * size)
    near = kept(best.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list(F.struct("d", F.col("dst").alias("id")))).alias("near")))
    ids = lambda c: F.transform(c, lambda x: x["id"])
    full = near.where(F.size("near") >= size - 1).select(F.array_sort(F.concat(F.array("node"), ids(F.slice("near", 1, size - 1)))).alias("nodes"))
    few = near.where(F.size("near") < size - 1).select(F.col("node").alias("center"), ids("near").alias("one"))
    hop = few.select("center", "one", F.explode("one").alias("node")).join(near, "node").select("center", "one", F.explode("near").alias("x"))
    hop = hop.where((F.col("x.id") != F.col("center")) & ~F.array_contains("one", F.col("x.id")))
    two = hop.groupBy("center", "one").agg(F.array_sort(F.collect_set("x")).alias("two"))
    rest = two.where(F.size("one") + F.size("two") >= size - 1).select(F.array_sort(F.concat(F.array("center"), "one", ids(F.slice("two", F.lit(1), size - 1 - F.size("one"))))).alias("nodes"))
    return full.unionByName(rest).distinct()


#: Corners of the hull of all centroids that may be broadcast.
MOST_CORNERS = 200_000


def hull(points):
    """Rows of (n, 2) points that are corners of their convex hull, points on its edges left out."""
    import numpy as np

    order = np.lexsort((points[:, 1], points[:, 0]))
    if len(order) < 3:
        return order

    def half(at):
        out: list[int] = []
        for i in at:
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = points[out[-2]], points[out[-1]], points[i]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(int(i))
        return out

    return np.array(sorted({*half(order), *half(order[::-1])}))


def combine_far_apart(samples: DataFrame, places: DataFrame) -> DataFrame:
    """(nodes): each sample (sample long, node) joined with the one whose mean place lies farthest, as the distinct sorted arrays of both nodes' lists; places is (node, y, x). Ties go to the smaller sample.

    What lies farthest from any place is a corner of the convex hull of all: tasks leave the
    corners of their own points, and each sample is measured against the corners that remain
    only. Where all samples have one mean place there is no other, and a sample stays alone.
    Nodes without a place count in no mean; a sample without any is left out.
    """
    held = samples.join(places, "node").groupBy("sample").agg(F.avg("y").alias("y"), F.avg("x").alias("x"))
    lists = kept(samples.groupBy("sample").agg(F.collect_list("node").alias("own")).join(held, "sample"))
    spots = lists.groupBy("y", "x").agg(F.min("sample").alias("sample"))

    def corners(frames: Iterator) -> Iterator:
        import pandas as pd

        left = None
        for pdf in frames:
            pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            left = pdf.iloc[hull(pdf[["y", "x"]].to_numpy())].reset_index(drop=True) if len(pdf) else pdf
        if left is not None and len(left):
            yield left

    outer = kept(spots.select("y", "x", "sample").mapInPandas(corners, "y double, x double, sample long").coalesce(1).mapInPandas(corners, "y double, x double, sample long"))
    if outer.count() > MOST_CORNERS:
        raise ValueError(f"more than {MOST_CORNERS} corners")
    o = F.broadcast(outer.select(F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("sample").alias("other")))
    gap = ((F.col("oy") - F.col("y")) ** 2 + (F.col("ox") - F.col("x")) ** 2) / 2
    far = lists.select("sample", "y", "x").crossJoin(o).groupBy("sample").agg(F.max(F.struct(gap.alias("gap"), (-F.col("other")).alias("minus"))).alias("m"))
    far = far.select("sample", F.when(F.col("m.gap") > 0, -F.col("m.minus")).alias("other"))
    j = lists.join(far, "sample").join(lists.select(F.col("sample").alias("other"), F.col("own").alias("more")), "other", "left")
    return j.select(F.array_sort(F.concat("own", F.coalesce("more", F.expr("slice(own, 1, 0)")))).alias("nodes")).distinct()


class ConnectorRoutes:
    """Table function: the rows (pos, route, direction) of a connector's name, such as '5N TO 805S'."""

    @staticmethod
    def analyze(name: AnalyzeArgument) -> AnalyzeResult:
        from pyspark.sql.types import IntegerType, StringType, StructType

        if not isinstance(name.dataType, StringType):
            raise ValueError("connector_routes takes a string")
        return AnalyzeResult(StructType().add("pos", IntegerType()).add("route", IntegerType()).add("direction", StringType()))

    def eval(self, name):
        import re

        for pos, (route, way) in enumerate(re.findall(r"\b(\d{1,3})\s*-?\s*([NSEW])B?\b", (name or "").upper())):
            yield pos, int(route), way


def register_table_functions(spark: SparkSession) -> None:
    """connector_routes for SQL: SELECT ... FROM t, LATERAL connector_routes(name)."""
    spark.udtf.register("connector_routes", F.udtf(ConnectorRoutes))
