"""Modularity groups of a weighted graph by Louvain's method, in rounds of alternating halves.

In a round a hashed half of the nodes moves to the neighbouring groups of the largest gain
while the other half stays. When few move, groups become the nodes of a smaller graph and the rounds start
anew; a level that does not raise modularity is not taken, and single nodes then move once more. Each step is a join and an
aggregation on nodes or groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.graph import kept, symmetrize


def modularity(edges: DataFrame, groups: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of groups (node, grp) of a graph whose edges (src, dst, weight) stand in both directions; a self loop's weight counts once. 0 without edges."""
    a, b = groups.select(F.col("node").alias("src"), F.col("grp").alias("ga")), groups.select(F.col("node").alias("dst"), F.col("grp").alias("gb"))
    j = edges.join(a, "src").join(b, "dst")
    per = j.groupBy(F.col("ga").alias("grp")).agg(F.sum("weight").alias("tot"), F.sum(F.when(F.col("ga") == F.col("gb"), F.col("weight")).otherwise(0.0)).alias("inner"))
    s = per.agg(F.sum("tot").alias("m"), F.sum("inner").alias("inner"), F.sum(F.col("tot") ** 2).alias("squares"))
    return s.select(F.coalesce(F.try_divide("inner", "m") - resolution * F.try_divide("squares", F.col("m") ** 2), F.lit(0.0)).alias("modularity"))


def move_round(edges: DataFrame, state: DataFrame, total: float, resolution: float, salt: int) -> DataFrame:
    """(node, to): moves of this round's half of the nodes; state is (node, grp, strength).

    A node alone in its group moves to another such node only if that one is smaller, so two never swap places.
    """
    mine = state.where(F.pmod(F.xxhash64("node", F.lit(salt // 2)), F.lit(2)) == salt % 2).select(F.col("node").alias("src"), F.col("grp").alias("own"), "strength")
    votes = edges.where("src <> dst").join(mine.select("src"), "src").join(state.select(F.col("node").alias("dst"), "grp"), "dst").select("src", "grp", "weight")
    votes = votes.unionByName(mine.select("src", F.col("own").alias("grp"), F.lit(0.0).alias("weight"))).groupBy("src", "grp").agg(F.sum("weight").alias("w"))
    sizes = state.groupBy("grp").agg(F.sum("strength").alias("tot"), F.count("*").alias("n"))
    stay = F.col("grp") == F.col("own")
    others = F.col("tot") - F.when(stay, F.col("strength")).otherwise(0.0)
    gain = F.round(F.col("w") - resolution * F.col("strength") * others / total, 12)
    seen = votes.join(mine, "src").join(sizes, "grp").withColumn("gain", gain)
    best = seen.groupBy(F.col("src").alias("node"), "own").agg(
        F.max(F.struct("gain", (-F.col("grp")).alias("minus"), "n")).alias("to"), F.max(F.when(stay, F.struct("gain", "n"))).alias("stay")
    ).withColumn("target", -F.col("to.minus"))
    lone = (F.col("to.n") == 1) & (F.col("stay.n") == 1)
    return best.where((F.col("to.gain") > F.col("stay.gain") + 1e-11) & (~lone | (F.col("target") < F.col("own")))).select("node", F.col("target").alias("to"))


def one_level(edges: DataFrame, total: float, resolution: float, rounds: int, start: DataFrame | None = None, quiet: float = 0.01) -> DataFrame:
    """(node, grp) after rounds of moves from single nodes or from the groups of `start`; ends when both halves together move at most a `quiet` share."""
    state = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("strength"))
    state = state.withColumn("grp", F.col("node")) if start is None else state.join(start, "node")
    state = kept(state.withColumn("moved", F.lit(False)))
    size, before = state.count(), None
    for n in range(rounds):
        moved = move_round(edges, state.drop("moved"), total, resolution, n)
        state = kept(state.join(moved, "node", "left").select("node", "strength", F.coalesce("to", "grp").alias("grp"), F.col("to").isNotNull().alias("moved")))
        now = state.where("moved").count()
        if before is not None and now + before <= quiet * size:
            break
        before = now
    return state.select("node", "grp")


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 16, levels: int = 12) -> DataFrame:
    """(node, grp): groups of high modularity of a graph (src, dst, weight) of long ids, directions joined by the larger weight; grp is the smallest node of the group.

    Self loops and weights of 0 or less are left out, and so are nodes that have no other edge.
    """
    e = kept(symmetrize(edges.where("src <> dst AND weight > 0")).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight")))
    total = e.agg(F.sum("weight")).first()[0]
    names = e.select(F.col("src").alias("node")).distinct().withColumn("grp", F.col("node"))
    if not total:
        return names
    best = modularity(e, names, resolution).first()[0]
    nodes = e
    for _ in range(levels):
        found = kept(one_level(e, total, resolution, rounds))
        q = modularity(e, found, resolution).first()[0]
        if q <= best + 1e-9:
            # Single nodes may still gain where their groups have grown; if they do, the levels go on from there.
            found = kept(one_level(nodes, total, resolution, rounds, names))
            q, e = modularity(nodes, found, resolution).first()[0], nodes
            if q <= best + 1e-6:
                break
            names = nodes.select(F.col("src").alias("node")).distinct().withColumn("grp", F.col("node"))
        best = q
        names = kept(names.join(found.select(F.col("node").alias("grp"), F.col("grp").alias("up")), "grp").select("node", F.col("up").alias("grp")))
        a, b = found.select(F.col("node").alias("src"), F.col("grp").alias("ga")), found.select(F.col("node").alias("dst"), F.col("grp").alias("gb"))
        e = kept(e.join(a, "src").join(b, "dst").groupBy(F.col("ga").alias("src"), F.col("gb").alias("dst")).agg(F.sum("weight").alias("weight")))
    first = names.groupBy("grp").agg(F.min("node").alias("least"))
    return names.join(first, "grp").select("node", F.col("least").alias("grp"))


def split_groups(edges: DataFrame, groups: DataFrame, largest: int, target: int) -> DataFrame:
    """(node, grp, part): groups (node, grp) above `largest` nodes cut into parts of `target`, breadth first from their node of the largest degree; others are part 0.

    Nodes go by the number of steps inside the group, then by degree (largest first), then by
    id; what the first node does not reach comes last. Steps are one join a round.
    """
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    big = kept(groups.join(sizes.where(F.col("n") > largest), "grp").select("node", "grp"))
    both = symmetrize(edges.where("src <> dst").select("src", "dst", F.lit(1.0).alias("weight"))).select("src", "dst")
    a, b = big.select(F.col("node").alias("src"), F.col("grp").alias("ga")), big.select(F.col("node").alias("dst"), F.col("grp").alias("gb"))
    inner = kept(both.join(a, "src").join(b, "dst").where("ga = gb").select("src", "dst"))
    degree = inner.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    known = kept(big.join(degree, "node", "left").fillna(0, ["degree"]))
    seeds = known.groupBy("grp").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("s")).select((-F.col("s.minus")).alias("node"))
    seen = kept(seeds.withColumn("hop", F.lit(0)))
    while True:
        last = seen.agg(F.max("hop")).first()[0]
        front = seen.where(F.col("hop") == last).select(F.col("node").alias("src"))
        new = inner.join(front, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit((last or 0) + 1))
        grown = kept(seen.unionByName(new))
        if last is None or not grown.where(F.col("hop") > last).limit(1).count():
            break
        seen = grown
    w = Window.partitionBy("grp").orderBy(F.col("hop").asc_nulls_last(), F.desc("degree"), "node")
    cut = known.join(seen, "node", "left").withColumn("part", F.floor((F.row_number().over(w) - 1) / target).cast("int")).select("node", "grp", "part")
    return groups.join(big.select("node"), "node", "left_anti").select("node", "grp", F.lit(0).alias("part")).unionByName(cut)
