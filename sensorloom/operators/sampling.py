"""Subgraph samples: filters by properties and paths, isolated nodes, route repair, learned graphs and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.storage import kept


def with_properties(samples: DataFrame, properties: DataFrame, prop: str, allowed: list) -> DataFrame:
    """Samples (sample, node) whose nodes all have a property value among those allowed; a node without one counts as not."""
    j = samples.join(properties.select("node", F.col(prop).alias("__p")), "node", "left")
    ok = j.groupBy("sample").agg(F.bool_and(F.coalesce(F.col("__p").isin(*allowed), F.lit(False))).alias("ok")).where("ok").select("sample")
    return samples.join(ok, "sample", "left_semi")


def edges_all(edges: DataFrame, condition: Column) -> DataFrame:
    """Edges (sample, src, dst ...) of the samples all of whose edges meet the condition; null counts as not met."""
    ok = edges.groupBy("sample").agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("ok")).where("ok").select("sample")
    return edges.join(ok, "sample", "left_semi")


def longest_paths(edges: DataFrame, most: int) -> DataFrame:
    """(sample, length, hops): the largest sum of weights over simple directed paths of at most `most` edges, and the most edges of any; a null weight counts as infinite.

    Paths grow by a join a step and remember their nodes; samples are small subgraphs.
    """
    e = edges.select("sample", "src", "dst", F.coalesce("weight", F.lit(float("inf"))).alias("w"))
    paths = e.where("src <> dst").select("sample", F.array("src", "dst").alias("nodes"), "dst", F.col("w").alias("length"), F.lit(1).alias("hops"))
    every = paths
    step = e.select("sample", F.col("src").alias("dst"), F.col("dst").alias("nxt"), "w")
    for _ in range(most - 1):
        paths = paths.join(step, ["sample", "dst"]).where(~F.array_contains("nodes", F.col("nxt"))).select("sample", F.concat("nodes", F.array("nxt")).alias("nodes"), F.col("nxt").alias("dst"), (F.col("length") + F.col("w")).alias("length"), (F.col("hops") + 1).alias("hops"))
        every = every.unionByName(paths)
    return every.groupBy("sample").agg(F.max("length").alias("length"), F.max("hops").alias("hops"))


def single_root_chains(edges: DataFrame, nodes: int) -> DataFrame:
    """Samples in which one directed path visits all of their `nodes` nodes, so that one node causes all others in turn."""
    return longest_paths(edges.withColumn("weight", F.lit(1.0)), nodes - 1).where(F.col("hops") == nodes - 1).select("sample")


def add_isolated(samples: DataFrame, candidates: DataFrame, tries: int = 4, seed: int = 0) -> DataFrame:
    """samples (sample, node) with one more node each that no edge joins: hash-chosen among the candidates (node), not one of its own.

    Candidates are numbered by partition counts of their hash order; a sample looks at `tries`
    places by its hash, which a sample of fewer nodes than that cannot all hold.
    """
    n = candidates.select("node").distinct()
    placed = n.withColumn("__b", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1024)))
    per = placed.groupBy("__b").agg(F.count("*").alias("c"))
    start = per.select("__b", (F.sum("c").over(Window.orderBy("__b")) - F.col("c")).alias("s"), F.sum("c").over(Window.partitionBy()).alias("n"))  # at most 1024 rows
    numbered = placed.join(F.broadcast(start), "__b").select("node", "n", (F.col("s") + F.row_number().over(Window.partitionBy("__b").orderBy(F.xxhash64("node", F.lit(seed)), "node")) - 1).alias("place"))
    total = per.agg(F.sum("c").alias("n"))
    ask = samples.select("sample").distinct().crossJoin(F.broadcast(total)).select("sample", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("k"), "n")
    ask = ask.withColumn("place", F.pmod(F.xxhash64("sample", F.lit(seed)), F.col("n")) + F.col("k")).withColumn("place", F.pmod("place", F.col("n")))
    got = ask.join(numbered.select("place", "node"), "place").join(samples.select("sample", "node"), ["sample", "node"], "left_anti")
    return samples.select("sample", "node").unionByName(got.groupBy("sample").agg(F.min(F.struct("k", "node")).alias("m")).select("sample", F.col("m.node").alias("node")))


def repair_routes(stops: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """(route, roads, reason, changed): routes (route, pos, road) with the shortest connecting paths filled in where neighbours are not joined; a road that follows itself is kept once.

    reason: empty_or_nonlist_route without stops (a row of null pos), unknown_road if a road is
    null or not known, unreachable_anchor if a gap has no path, else null. changed: a path of
    more than two roads was filled in. Paths are searched for every distinct gap, all at once,
    a join a step, no place twice; ties go to the smaller roads.
    """
    w = Window.partitionBy("route").orderBy("pos")
    s = stops.where("pos is not null").select("route", "pos", "road", F.lead("road").over(w).alias("nxt"), (F.lead("pos").over(w)).isNotNull().alias("more"))
    s = kept(s.join(known.select("road", F.lit(True).alias("ok")).distinct(), "road", "left"))
    gap = s.where("road is not null and nxt is not null and road <> nxt").select(F.col("road").alias("a"), F.col("nxt").alias("b")).distinct()
    front = kept(gap.select("a", "b", F.array("a").alias("path"), F.col("a").alias("at")))
    seen, found = front.select("a", "b", "at"), front.select("a", "b", "path").limit(0)
    e = kept(edges.select(F.col("src").alias("at"), "dst").distinct())
    while front.limit(1).count():
        grown = front.join(e, "at").groupBy("a", "b", F.col("dst").alias("at")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        grown = kept(grown.join(seen, ["a", "b", "at"], "left_anti"))
        hit = grown.where("at = b").select("a", "b", "path")
        found, seen = kept(found.unionByName(hit)), kept(seen.unionByName(grown.select("a", "b", "at")))
        front = grown.join(hit.select("a", "b"), ["a", "b"], "left_anti")
    j = s.join(found.select(F.col("a").alias("road"), F.col("b").alias("nxt"), "path"), ["road", "nxt"], "left")
    part = F.when(~F.col("more"), F.array("road")).when(F.col("road") == F.col("nxt"), F.array().cast("array<bigint>")).otherwise(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))))
    g = j.groupBy("route").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))), lambda x: x["p"])).alias("roads"), F.bool_or(F.col("ok").isNull()).alias("unknown"),
        F.bool_or(F.col("more") & (F.col("road") != F.col("nxt")) & F.col("path").isNull()).alias("cut"), F.bool_or(F.size("path") > 2).alias("longer"),
    )
    r = stops.select("route").distinct().join(g, "route", "left")
    reason = F.when(F.col("unknown").isNull(), "empty_or_nonlist_route").when(F.col("unknown"), "unknown_road").when(F.col("cut"), "unreachable_anchor")
    return r.select("route", F.when(reason.isNull(), F.col("roads")).alias("roads"), reason.alias("reason"), (reason.isNull() & F.coalesce("longer", F.lit(False))).alias("changed"))


def roughness_top_k(edges: DataFrame, panel: DataFrame, k: int, pool: int) -> DataFrame:
    """(src, dst, roughness): of each node's `pool` nearest (edges: src, dst, dist) the k whose z-scored series differ least in the mean square."""
    w = Window.partitionBy("src")
    near = edges.withColumn("__k", F.row_number().over(w.orderBy("dist", "dst"))).where(F.col("__k") <= pool).select("src", "dst")
    stats = panel.groupBy("node").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = panel.join(stats, "node").select("node", "t", F.coalesce(F.try_divide(F.col("value") - F.col("m"), F.when(F.col("s") > 1e-12, F.col("s"))), F.lit(0.0)).alias("z"))
    a, b = z.select(F.col("node").alias("src"), "t", F.col("z").alias("x")), z.select(F.col("node").alias("dst"), "t", F.col("z").alias("y"))
    r = near.join(a, "src").join(b, ["dst", "t"]).groupBy("src", "dst").agg(F.avg((F.col("x") - F.col("y")) ** 2).alias("roughness"))
    return r.withColumn("__k", F.row_number().over(w.orderBy(F.round("roughness", 9), "dst"))).where(F.col("__k") <= k).select("src", "dst", "roughness")


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def mad_gap(vectors: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(near, far, gap): mean cosine distance of vectors (node, v) over edges and over the candidate pairs (src, dst) that are no edges in either direction."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    far = pairs.where("src <> dst").select("src", "dst").distinct().join(both, ["src", "dst"], "left_anti")
    rows = e.withColumn("near", F.lit(True)).unionByName(far.withColumn("near", F.lit(False)))
    a, b = vectors.select(F.col("node").alias("src"), F.col("v").alias("x")), vectors.select(F.col("node").alias("dst"), F.col("v").alias("y"))
    d = rows.join(a, "src").join(b, "dst").withColumn("d", cosine_distance(F.col("x"), F.col("y")))
    near_, far_ = F.avg(F.when(F.col("near"), F.col("d"))), F.avg(F.when(~F.col("near"), F.col("d")))
    return d.agg(near_.alias("near"), far_.alias("far"), (far_ - near_).alias("gap"))


def sample_graphs(samples: DataFrame, learned: DataFrame) -> DataFrame:
    """(sample, src, dst, score): a learned graph's weights at every ordered pair of a sample's nodes; 0 where it has none.

    Pairs are made within samples only, which are small by construction.
    """
    a, b = samples.select("sample", F.col("node").alias("src")), samples.select("sample", F.col("node").alias("dst"))
    p = a.join(b, "sample").where(F.col("src") != F.col("dst"))
    return p.join(learned.select("src", "dst", "weight"), ["src", "dst"], "left").select("sample", "src", "dst", F.coalesce("weight", F.lit(0.0)).alias("score"))


def with_labels(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """scores (sample, src, dst, score) with label 1 where the pair is an edge of the sample's label graph (sample, src, dst)."""
    lab = labels.select("sample", "src", "dst").distinct().withColumn("__l", F.lit(1))
    return scores.join(lab, ["sample", "src", "dst"], "left").withColumn("label", F.coalesce("__l", F.lit(0))).drop("__l")
