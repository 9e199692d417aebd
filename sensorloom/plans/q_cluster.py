"""Queries over groups of nodes and selections of samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import cluster as C
from sensorloom.plans.fixtures import COUNTS_SQL, counts
from sensorloom.plans.q_graph import SPARSE, sparse
from sensorloom.plans.registry import query, table

R = lambda c, n=6: F.round(c, n)


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query("""WITH c AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cluster, embedding AS c FROM embeddings WHERE vec_id < 5), p AS (SELECT vec_id AS id, cluster, round(sqrt(list_sum(list_transform(list_zip(embedding, c.c), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2))), 9) AS d FROM embeddings, c),
 k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS k, lead(d) OVER (PARTITION BY id ORDER BY d, cluster) AS d2 FROM p) SELECT id, cluster, round((d2 - d) / (d2 + 1e-9), 6) AS confidence FROM k WHERE k = 1""")
def cluster_confidence(spark, d):
    p = _points(spark, d)
    centers = p.where("id < 5").select(F.col("id").cast("int").alias("cluster"), F.col("v").alias("c"))
    return C.confidence(C.nearest_centers(p, centers)).select("id", "cluster", R("confidence").alias("confidence"))


@query()
def kmeans_groups(spark, d):
    """Lloyd's algorithm on the embeddings; tests check it against NumPy."""
    return C.kmeans(_points(spark, d), 8, 5)[1].select("id", "cluster", "d1")


@query("""WITH p AS (SELECT vec_id AS id, embedding[1] AS x, embedding[2] AS y FROM embeddings), a AS (SELECT *, CAST(row_number() OVER (ORDER BY x, id) > ceil(count(*) OVER () / 2) AS INTEGER) AS l FROM p), b AS (SELECT *, l * 2 + CAST(row_number() OVER (PARTITION BY l ORDER BY y, id) > ceil(count(*) OVER (PARTITION BY l) / 2) AS INTEGER) AS m FROM a)
 SELECT id, m * 2 + CAST(row_number() OVER (PARTITION BY m ORDER BY x, id) > ceil(count(*) OVER (PARTITION BY m) / 2) AS INTEGER) AS leaf FROM b""")
def balanced_leaves(spark, d):
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return C.halving_leaves(p, 3)


@query(SPARSE + """, n AS (SELECT src.src % 5 AS sg, dst % 5 AS tg, count(*) AS n FROM e src GROUP BY 1, 2 HAVING sg <> tg) SELECT a.sg, a.tg, a.n, coalesce(b.n, 0) AS back FROM n a LEFT JOIN n b ON a.sg = b.tg AND a.tg = b.sg""")
def edges_between_groups(spark, d):
    g = spark.range(25).select(F.col("id").alias("node"), (F.col("id") % 5).alias("grp"))
    return C.group_edges(sparse(spark, d), g)


@query(COUNTS_SQL + """, g AS (SELECT node, CASE WHEN node < 'f' THEN 0 ELSE 1 END AS grp FROM (SELECT DISTINCT node FROM panel)) SELECT grp, t, round(median(value), 6) AS value FROM panel JOIN gg USING (node) GROUP BY 1, 2""".replace(", g AS", ", gg AS"))
def pooled_group_signal(spark, d):
    p = counts(spark, d)
    g = p.select("node").distinct().withColumn("grp", F.when(F.col("node") < "f", 0).otherwise(1))
    return C.group_signal(p, g, "median").withColumn("value", R("value"))


@query("SELECT n_nationkey AS node, CAST((row_number() OVER (ORDER BY md5(CAST(n_nationkey AS VARCHAR))) - 1) // 6 AS BIGINT) AS grp FROM nation")
def size_matched_groups(spark, d):
    return C.hashed_groups(table(spark, d, "nation").select(F.col("n_nationkey").alias("node")), 6)


@query("""WITH j AS (SELECT c_custkey % 4 AS a, CASE WHEN c_custkey % 9 = 0 THEN (c_custkey + 1) % 4 ELSE c_custkey % 4 END AS b FROM customer), c AS (SELECT a, b, count(*) AS n FROM j GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n, sum(n) FILTER (a <> b) AS moved FROM c),
 r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY a)), k AS (SELECT sum(n * (n - 1) / 2) AS k FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((s - r * k / (n * (n - 1) / 2)) / ((r + k) / 2 - r * k / (n * (n - 1) / 2)), 6) AS ari, round(moved / n, 6) AS changed FROM s, r, k""")
def cluster_stability(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    a = c.withColumn("label", F.col("id") % 4)
    b = c.withColumn("label", F.when(F.col("id") % 9 == 0, (F.col("id") + 1) % 4).otherwise(F.col("id") % 4))
    return C.adjusted_rand(a, b).select(R("ari").alias("ari"), R("changed").alias("changed"))


@query("SELECT event_id AS id, value AS loss FROM events ORDER BY value DESC, event_id LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM events)", name="hard_sample_selection")
def _hard(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("loss"))
    return C.keep_hard(e, 0.1)


@query("""WITH x AS (SELECT event_id AS id, value AS loss, avg(value) OVER () AS m, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM events) SELECT id, loss, CAST(CASE WHEN loss >= m THEN 1 ELSE 4 END AS DOUBLE) AS weight FROM x WHERE loss >= m OR u < 0.25""")
def importance_pruning(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("loss"))
    return C.importance_prune(e, 0.25)
