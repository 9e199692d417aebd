"""Graphs as edge tables (src, dst, weight): normalisation, selection, reach and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.storage import ensure_checkpoint_dir, kept, numbered  # noqa: F401


def strip_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions, the larger weight."""
    return edges.select("src", "dst", "weight").unionByName(reverse(edges)).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def transition(edges: DataFrame) -> DataFrame:
    """Random-walk weights: each row divided by its sum (zero rows stay zero)."""
    return edges.withColumn("weight", F.coalesce(F.try_divide("weight", F.sum("weight").over(Window.partitionBy("src"))), F.lit(0.0)))


def _degree_scaled(edges: DataFrame) -> DataFrame:
    deg = edges.groupBy("src").agg(F.sum("weight").alias("d")).withColumn("r", F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(0.0))
    a = deg.select("src", F.col("r").alias("__a"))
    b = deg.select(F.col("src").alias("dst"), F.col("r").alias("__b"))
    j = edges.join(a, "src").join(b, "dst", "left")
    return j.select("src", "dst", (F.col("weight") * F.col("__a") * F.coalesce("__b", F.lit(0.0))).alias("weight"))


def _identity(edges: DataFrame, value: float) -> DataFrame:
    return nodes_of(edges).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(value).alias("weight"))


def _plus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def laplacian(edges: DataFrame) -> DataFrame:
    """Symmetric normalised Laplacian I - D^-1/2 A D^-1/2, degrees by rows."""
    return _plus(_identity(edges, 1.0), _degree_scaled(edges).withColumn("weight", -F.col("weight")))


def scaled_laplacian(edges: DataFrame, largest: float = 2.0) -> DataFrame:
    """2 L / largest - I."""
    return _plus(laplacian(edges).withColumn("weight", F.col("weight") * (2.0 / largest)), _identity(edges, -1.0))


def message_passing(edges: DataFrame) -> DataFrame:
    """Symmetric normalisation of A + I."""
    return _degree_scaled(_plus(edges.select("src", "dst", "weight"), _identity(edges, 1.0)))


NORMALIZATIONS = {"normlap": laplacian, "scalap": scaled_laplacian, "symnadj": message_passing, "transition": transition, "identity": lambda e: _identity(e, 1.0), "original": lambda e: e}


def normalize(edges: DataFrame, kind: str) -> DataFrame:
    """One of NORMALIZATIONS, or doubletransition: both directions, marked by support 0 and 1."""
    if kind == "doubletransition":
        return transition(edges).withColumn("support", F.lit(0)).unionByName(transition(reverse(edges)).withColumn("support", F.lit(1)))
    return NORMALIZATIONS[kind](edges)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse matrix product."""
    x = a.select("src", F.col("dst").alias("__m"), F.col("weight").alias("__w"))
    y = b.select(F.col("src").alias("__m"), "dst", "weight")
    return x.join(y, "__m").groupBy("src", "dst").agg(F.sum(F.col("__w") * F.col("weight")).alias("weight"))


def chebyshev(lap: DataFrame, order: int) -> DataFrame:
    """(k, src, dst, weight) of the polynomials T_0 .. T_(order-1) of a scaled Laplacian."""
    t = [_identity(lap, 1.0), lap]
    for _ in range(2, order):
        t.append(_plus(multiply(lap, t[-1]).withColumn("weight", 2 * F.col("weight")), t[-2].withColumn("weight", -F.col("weight"))))
    out = t[0].withColumn("k", F.lit(0))
    for k in range(1, order):
        out = out.unionByName(t[k].withColumn("k", F.lit(k)))
    return out


def degrees(edges: DataFrame, hub_share: float = 0.15) -> DataFrame:
    """(node, in_degree, out_degree, degree, is_hub); degree counts distinct neighbours either way, hubs are the top share by degree (halves to the even number, one at least), then id; none where all degrees are equal."""
    e = strip_self_loops(edges)
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    any_ = e.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"))).groupBy("node").agg(F.count_distinct("other").alias("degree"))
    n = nodes_of(edges).join(out, "node", "left").join(into, "node", "left").join(any_, "node", "left").fillna(0)
    placed = numbered(n, [F.desc("degree"), F.asc("node")], "__k")
    s = placed.agg(F.count("*").alias("n"), F.max("degree").alias("hi"), F.min("degree").alias("lo")).first()
    hubs = max(1, round(s["n"] * hub_share)) if s["n"] and s["hi"] > s["lo"] else 0
    return placed.select("node", "in_degree", "out_degree", "degree", (F.col("__k") < hubs).alias("is_hub"))


def top_k(edges: DataFrame, k: int, largest: bool = True) -> DataFrame:
    """The k largest (or smallest) weights of each row, ties to the smaller dst."""
    w = Window.partitionBy("src").orderBy(F.desc("weight") if largest else F.asc("weight"), "dst")
    return edges.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def global_top(edges: DataFrame, m: int, ties: bool = False) -> DataFrame:
    """The m largest edges in a stable order; with ties, all that reach the m-th weight."""
    best = edges.orderBy(F.desc("weight"), "src", "dst").limit(m)
    return edges.join(F.broadcast(best.agg(F.min("weight").alias("__t"))), F.col("weight") >= F.col("__t")).drop("__t") if ties else best


def top_k_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(src, overlap): how many of the k strongest neighbours two graphs share, by row."""
    x, y = top_k(a, k).select("src", "dst"), top_k(b, k).select("src", "dst", F.lit(1).alias("__hit"))
    return x.join(y, ["src", "dst"], "left").groupBy("src").agg(F.count("__hit").alias("overlap"))


def gaussian(edges: DataFrame, sigma: Column | None = None, threshold: float = 0.0, distance: str = "dist") -> DataFrame:
    """exp(-(d / sigma)^2), sigma the population deviation of the distances unless given; weights below the threshold go."""
    s = edges.agg((F.stddev_pop(distance) if sigma is None else sigma).alias("__s"))
    e = edges.crossJoin(F.broadcast(s)).withColumn("weight", F.exp(-((F.col(distance) / F.col("__s")) ** 2)))
    return e.where(F.col("weight") >= threshold).drop("__s")


def reach(edges: DataFrame, hops: int, directed: bool = True) -> DataFrame:
    """(src, dst, hop): nodes within `hops` steps, at their smallest; the node itself at 0."""
    e = edges.select("src", "dst").where("src <> dst")
    e = (e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).distinct()
    seen = nodes_of(edges).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("hop"))
    front = seen.select("src", "dst")
    step = e.select(F.col("src").alias("dst"), F.col("dst").alias("__n"))
    for h in range(1, hops + 1):
        new = front.join(step, "dst").select("src", F.col("__n").alias("dst")).distinct().join(seen, ["src", "dst"], "left_anti")
        seen = seen.unionByName(new.withColumn("hop", F.lit(h)))
        front = new
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges in either direction.

    Labels spread to neighbours and then jump to their label's label, until none changes;
    lineage is cut in the session's checkpoint folder.
    """
    # Kept: every round reads the pairs again.
    both = kept(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")).checkpoint()
    while True:
        near = both.join(label.select(F.col("node").alias("src"), "component"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("__m"))
        spread = label.join(near, "node", "left").select("node", F.least("component", "__m").alias("component"))
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("__j"))
        nxt = spread.join(jump, "component", "left").select("node", F.least("component", "__j").alias("component")).checkpoint()
        changed = nxt.join(label.withColumnRenamed("component", "__o"), "node").where("component <> __o").limit(1).count()
        label = nxt
        if not changed:
            return label


def stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges without loops, mean out-degree, density, weight quartiles."""
    e = strip_self_loops(edges)
    n = nodes_of(edges).agg(F.count("*").alias("nodes"))
    q = F.percentile("weight", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return e.agg(F.count("*").alias("edges"), q.alias("q")).crossJoin(n).select(
        "nodes", "edges", F.try_divide(F.col("edges"), F.col("nodes")).alias("mean_degree"), F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"), F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75")
    )


def propagate(edges: DataFrame, signal: DataFrame) -> DataFrame:
    """(node, t, value) of weighted sums over in-neighbours: one step of a graph convolution."""
    x = signal.select(F.col("node").alias("src"), "t", "value")
    return edges.join(x, "src").groupBy(F.col("dst").alias("node"), "t").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def edge_differences(edges: DataFrame, signal: DataFrame) -> DataFrame:
    """Gap (mean |x_src - x_dst|) and Dirichlet energy (mean weight * squared difference) over edges and steps."""
    a = signal.select(F.col("node").alias("src"), "t", F.col("value").alias("a"))
    b = signal.select(F.col("node").alias("dst"), "t", F.col("value").alias("b"))
    d = F.col("a") - F.col("b")
    return edges.join(a, "src").join(b, ["dst", "t"]).agg(F.avg(F.abs(d)).alias("gap"), F.avg(F.col("weight") * d * d).alias("energy"))


def choose_direction(pairs: DataFrame, tie: float = 1.0) -> DataFrame:
    """direction of (forward, backward) distances: the shorter, both within the tie, none if neither is known."""
    f, b = F.col("forward"), F.col("backward")
    d = F.when(f.isNull() & b.isNull(), "none").when(b.isNull(), "forward").when(f.isNull(), "backward").when(F.abs(f - b) <= tie, "both").when(f < b, "forward").otherwise("backward")
    return pairs.withColumn("direction", d)


def shortest_paths(edges: DataFrame, sources: DataFrame, cutoff: float) -> DataFrame:
    """(source, node, dist) within a cutoff, by rounds of relaxation until no distance falls."""
    best = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"))
    # Kept: every round reads the edges again.
    e = kept(edges.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("__to"), F.col("weight").alias("__w")))
    before = None
    while True:
        step = best.join(e, "node").select("source", F.col("__to").alias("node"), (F.col("dist") + F.col("__w")).alias("dist")).where(F.col("dist") <= cutoff)
        best = best.unionByName(step).groupBy("source", "node").agg(F.min("dist").alias("dist")).checkpoint()
        now = tuple(best.agg(F.count("*"), F.sum("dist")).first())
        if now == before:
            return best
        before = now


def split_long(edges: DataFrame, limit: float) -> DataFrame:
    """(src, dst, part, parts, length): edges cut into ceil(weight / limit) equal parts."""
    parts = F.greatest(F.ceil(F.col("weight") / limit), F.lit(1)).cast("int")
    return edges.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts")))).select("src", "dst", "part", "parts", (F.col("weight") / F.col("parts")).alias("length"))


def induced(edges: DataFrame, anchors: DataFrame, both: bool = True) -> DataFrame:
    """Edges with both (or either) ends among anchors (node), ids renumbered densely from 0."""
    a, b = anchors.select(F.col("node").alias("src"), F.lit(1).alias("__a")), anchors.select(F.col("node").alias("dst"), F.lit(1).alias("__b"))
    j = edges.join(a, "src", "left").join(b, "dst", "left")
    found = j.where(F.col("__a").isNotNull() & F.col("__b").isNotNull() if both else F.col("__a").isNotNull() | F.col("__b").isNotNull()).drop("__a", "__b")
    number = numbered(nodes_of(found), [F.asc("node")], "idx").withColumn("idx", F.col("idx").cast("int"))
    return found.join(number.select(F.col("node").alias("src"), F.col("idx").alias("src_idx")), "src").join(number.select(F.col("node").alias("dst"), F.col("idx").alias("dst_idx")), "dst")


def connected_subgraphs(edges: DataFrame, size: int) -> DataFrame:
    """Distinct sorted node sets (array) of connected subgraphs of `size` nodes, by repeated extension."""
    both = edges.where("src <> dst").select("src", "dst").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    sets = nodes_of(edges).select(F.array("node").alias("nodes"))
    for _ in range(size - 1):
        grown = sets.select("nodes", F.explode("nodes").alias("src")).join(both, "src").where(~F.array_contains("nodes", F.col("dst")))
        sets = grown.select(F.array_sort(F.array_append("nodes", F.col("dst"))).alias("nodes")).distinct()
    return sets


def sink_cases(edges: DataFrame) -> DataFrame:
    """(sink, causes): every pair of a node's predecessors, sorted."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    return e.alias("x").join(e.alias("y"), (F.col("x.dst") == F.col("y.dst")) & (F.col("x.src") < F.col("y.src"))).select(F.col("x.dst").alias("sink"), F.array("x.src", "y.src").alias("causes"))


def confounder_sets(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, nodes): sets that hold a node of at least two successors and all of these."""
    succ = edges.where("src <> dst").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("succ")).where(F.size("succ") >= 2)
    return sets.select("nodes", F.explode("nodes").alias("src")).join(succ, "src").where(F.size(F.array_except("succ", "nodes")) == 0).select(F.col("src").alias("node"), "nodes")


def label_matrix(samples: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample, cause, effect, label) over all ordered pairs of each sample's nodes (sample, node)."""
    a, b = samples.select("sample", F.col("node").alias("cause")), samples.select("sample", F.col("node").alias("effect"))
    e = edges.select(F.col("src").alias("cause"), F.col("dst").alias("effect"), F.lit(1).alias("__l")).distinct()
    return a.join(b, "sample").join(e, ["cause", "effect"], "left").select("sample", "cause", "effect", F.coalesce("__l", F.lit(0)).alias("label"))


def triangles(pairs: DataFrame) -> DataFrame:
    """(a, b, c) of every three nodes that are all joined, once each, from distinct pairs (a, b) with a < b.

    Each pair points from its node of fewer neighbours to that of more, so of m pairs a node
    has at most sqrt(2m) pointing away, however many neighbours a hub has, and two of them
    make at most m rows a node; the third pair is looked up by a join.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    j = pairs.join(ends.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(ends.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    up = F.struct("na", "a") < F.struct("nb", "b")
    d = j.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("high"))
    two = d.alias("x").join(d.alias("y"), "low").where("x.high < y.high").select("low", F.col("x.high").alias("a"), F.col("y.high").alias("b"))
    three = two.join(pairs.select("a", "b"), ["a", "b"])
    s = F.array_sort(F.array("low", "a", "b"))
    return three.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def prune_longest(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) that are not the longest of any u-v, v-w, u-w that are all there.

    Longer means more weight, then larger src, then larger dst. Taken longest first, an edge
    goes while all shorter ones are still there, so whether it goes depends on the input
    alone: no fixpoint is needed, and no such three edges are left. Self loops stay and take
    no part; of repeated edges the lightest stands; rows with a null are left out.
    """
    one = edges.where("src is not null and dst is not null and weight is not null").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    e = strip_self_loops(one)
    pairs = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(F.col("src") < F.col("dst"), F.col("weight")).alias("up"), F.when(F.col("src") > F.col("dst"), F.col("weight")).alias("down"))
    pairs = pairs.groupBy("a", "b").agg(F.max("up").alias("up"), F.max("down").alias("down"))
    t = triangles(pairs)
    for x, y in ("ab", "bc", "ac"):
        t = t.join(pairs.select(F.col("a").alias(x), F.col("b").alias(y), F.col("up").alias(x + y), F.col("down").alias(y + x)), [x, y])
    edge = lambda x, y: F.struct(F.col(x + y).alias("weight"), F.col(x).alias("src"), F.col(y).alias("dst"))
    tops = [
        F.when(F.col(u + v).isNotNull() & F.col(v + w).isNotNull() & F.col(u + w).isNotNull(), F.greatest(edge(u, v), edge(v, w), edge(u, w)))
        for u, v, w in ("abc", "acb", "bac", "bca", "cab", "cba")
    ]
    gone = t.select(F.explode(F.array(*tops)).alias("e")).where("e is not null").select("e.src", "e.dst").distinct()
    return one.join(gone, ["src", "dst"], "left_anti")
