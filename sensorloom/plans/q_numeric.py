"""Queries of the grouped NumPy operators; tests check them against plain NumPy."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import graph as G
from sensorloom.operators import numeric as N
from sensorloom.plans.fixtures import counts
from sensorloom.plans.q_graph import SPARSE, sparse
from sensorloom.plans.registry import query, table


@query()
def effective_resistance(spark, d):
    return N.effective_resistance(sparse(spark, d).withColumn("component", F.lit(0)))


@query()
def effective_rank(spark, d):
    return N.effective_rank(table(spark, d, "embeddings"), "label", "embedding")


@query()
def principal_signals(spark, d):
    p = counts(spark, d)
    g = p.select("node").distinct().withColumn("grp", F.when(F.col("node") < "f", 0).otherwise(1))
    return N.principal_signals(p, g, 2)


@query()
def k_center_coreset(spark, d):
    return N.k_center(table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "label", 5)


@query(SPARSE.replace("k <= 3", "k <= 6") + """, t AS (SELECT list_max([{'w': a.weight, 's': a.src, 'd': a.dst}, {'w': b.weight, 's': b.src, 'd': b.dst}, {'w': c.weight, 's': c.src, 'd': c.dst}]) AS m FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE a.src <> b.dst)
 SELECT src, dst, round(weight, 6) AS weight FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.m.s = e.src AND t.m.d = e.dst)""")
def transitive_pruning(spark, d):
    return G.prune_longest(sparse(spark, d, 6)).withColumn("weight", F.round("weight", 6))


@query(SPARSE + """, x AS (SELECT u.src, v.dst FROM e u JOIN e v ON u.dst = v.src WHERE u.src <> v.dst) SELECT src, dst, count(*) AS paths FROM x WHERE EXISTS (SELECT 1 FROM e WHERE e.src = x.src AND e.dst = x.dst) GROUP BY 1, 2""")
def two_hop_projection(spark, d):
    """Edges of the graph that a two-step path also joins, with the number of such paths."""
    e = sparse(spark, d).select("src", "dst")
    two = e.alias("u").join(e.alias("v"), F.col("u.dst") == F.col("v.src")).where("u.src <> v.dst").select(F.col("u.src").alias("src"), F.col("v.dst").alias("dst"))
    return two.join(e, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.count("*").alias("paths"))


@query()
def full_rank_columns(spark, d):
    """Independent series of each period of the counts; tests check planted sums and constants."""
    return N.independent_columns(counts(spark, d).withColumn("part", F.floor(F.col("t") / 240)), "part")


@query()
def breadth_first_chunks(spark, d):
    """Chunks of at most six nodes of the sparse graph's components; tests check sizes and connection."""
    e = sparse(spark, d)
    return N.breadth_chunks(e.join(G.components(e).withColumnRenamed("node", "src"), "src"), 6)
