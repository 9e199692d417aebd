"""Queries over cluster quality, balanced groups and sample selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import selection as S
from sensorloom.operators.graph import ensure_checkpoint_dir, strip_self_loops, symmetrize
from sensorloom.operators.louvain import louvain, modularity, split_groups
from sensorloom.plans.fixtures import FACTS_SQL, predictions
from sensorloom.plans.q_graph import SPARSE, sparse
from sensorloom.plans.registry import query, table

R = lambda c, n=6: F.round(c, n)

_EM = "em AS (SELECT vec_id AS id, CAST(embedding[1:4] AS DOUBLE[]) AS v, CAST(vec_id % 3 AS INTEGER) AS cluster FROM embeddings)"
_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) ** 2))"
_CENTERS = ", cd AS (SELECT cluster, i, avg(v[i]) AS x, count(*) AS n FROM em, unnest([1, 2, 3, 4]) u(i) GROUP BY 1, 2), ce AS (SELECT cluster, max(n) AS n, list(x ORDER BY i) AS c FROM cd GROUP BY 1)"


def _labelled(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("v"), (F.col("vec_id") % 3).cast("int").alias("cluster"))


_SIL = f", ms AS (SELECT a.id, a.cluster AS own, b.cluster AS k, avg(sqrt({_D2.format(a='a.v', b='b.v')})) AS m FROM em a JOIN em b ON a.id <> b.id GROUP BY ALL), sl AS (SELECT id, own, max(CASE WHEN k = own THEN m END) AS a, min(CASE WHEN k <> own THEN m END) AS b FROM ms GROUP BY 1, 2)"


@query("WITH " + _EM + _CENTERS + _SIL + " SELECT id, own AS cluster, round((b - a) / greatest(a, b), 6) AS s FROM sl")
def silhouette_by_point(spark, d):
    return S.silhouettes(_labelled(spark, d)).withColumn("s", R("s"))


@query("WITH " + _EM.replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 7 <> 6)") + _CENTERS + _SIL + f""", dd AS (SELECT em.cluster, {_D2.format(a="v", b="c")} AS d2 FROM em JOIN ce ON ce.cluster = em.cluster), wi AS (SELECT cluster, avg(sqrt(d2)) AS s, sum(d2) AS w, count(*) AS n FROM dd GROUP BY 1), cw AS (SELECT ce.cluster, c, s, w, wi.n FROM ce JOIN wi ON wi.cluster = ce.cluster),
 db AS (SELECT avg(r) AS davies_bouldin FROM (SELECT x.cluster, max((x.s + y.s) / sqrt({_D2.format(a="x.c", b="y.c")})) AS r FROM cw x JOIN cw y ON x.cluster <> y.cluster GROUP BY 1)), tt AS (SELECT sum(t) AS t FROM (SELECT i, var_pop(v[i]) * count(*) AS t FROM em, unnest([1, 2, 3, 4]) u(i) GROUP BY 1)), nn AS (SELECT count(*) AS n FROM em),
 pa AS (SELECT sum(w) AS w, count(*) AS k, -sum(cw.n / nn.n * ln(cw.n / nn.n)) / ln(count(*)) AS size_entropy, max(cw.n / nn.n) AS max_ratio FROM cw, nn), si AS (SELECT avg((b - a) / greatest(a, b)) AS silhouette FROM sl), un AS (SELECT avg(CAST(vec_id % 7 = 6 AS DOUBLE)) AS u FROM embeddings)
 SELECT k AS clusters, round(silhouette, 6) AS silhouette, round(davies_bouldin, 5) AS davies_bouldin, round(((t - w) / (k - 1)) / (w / (n - k)), 5) AS calinski_harabasz, round(size_entropy, 6) AS size_entropy, round(max_ratio, 6) AS max_ratio, round(u, 6) AS uncertain_ratio FROM pa, tt, db, si, nn, un""")
def cluster_quality(spark, d):
    """Every seventh point is without a label."""
    p = _labelled(spark, d).withColumn("cluster", F.when(F.col("id") % 7 == 6, -1).otherwise(F.col("cluster")))
    m = S.cluster_metrics(p)
    return m.select("clusters", R("silhouette").alias("silhouette"), R("davies_bouldin", 5).alias("davies_bouldin"), R("calinski_harabasz", 5).alias("calinski_harabasz"), *[R(c).alias(c) for c in ("size_entropy", "max_ratio", "uncertain_ratio")])


@query()
def adaptive_cluster_number(spark, d):
    """Scores of k = 2, 3, 4; tests work the measures out over all pairs."""
    return S.adaptive_k(_labelled(spark, d).select("id", "v"), [2, 3, 4], 3)


@query("""SELECT vec_id AS id, CAST(CASE WHEN vec_id % 50 = 0 THEN (SELECT k FROM (SELECT CAST(vec_id % 2 + 1 AS INTEGER) AS k, [avg(embedding[1]::DOUBLE), avg(embedding[2]::DOUBLE)] AS c FROM embeddings WHERE vec_id % 50 <> 0 GROUP BY 1) m, (SELECT [avg(embedding[1]::DOUBLE), avg(embedding[2]::DOUBLE)] AS t FROM embeddings WHERE vec_id % 50 = 0) s
 ORDER BY round(sqrt((c[1] - t[1]) ** 2 + (c[2] - t[2]) ** 2), 9), k LIMIT 1) ELSE vec_id % 2 + 1 END - 1 AS INTEGER) AS cluster FROM embeddings""")
def tiny_clusters_merged(spark, d):
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("v"), F.when(F.col("vec_id") % 50 == 0, 0).otherwise(F.col("vec_id") % 2 + 1).cast("int").alias("cluster"))
    return S.merge_tiny(p, 0.1).select("id", "cluster")


@query()
def overlapping_clusters_merged(spark, d):
    """Four label groups, one of them far away; tests merge them by plain loops."""
    k = (F.col("vec_id") % 4).cast("int")
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double") + F.when(k == 3, 50.0).otherwise(0.0)).alias("v"), k.alias("cluster"))
    return S.merge_overlapping(p, 1.0).select("id", "cluster")


@query()
def labels_across_days(spark, d):
    """Each day's clusters, renamed alike over days; tests compare with planted groups."""
    c = table(spark, d, "embeddings").groupBy((F.col("vec_id") % 6).alias("day"), F.col("label").cast("int").alias("cluster"), F.lit(1)).agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}") for i in range(4)])
    return S.align_labels(c.select("day", "cluster", F.array(*[f"m{i}" for i in range(4)]).alias("c")), 5, 20)


_SEATS = """WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), c AS (SELECT CAST(id AS INTEGER) AS k, x AS cx, y AS cy FROM p WHERE id < 3),
 dd AS (SELECT id, k, round((x - cx) ** 2 + (y - cy) ** 2, 9) AS d FROM p, c), od AS (SELECT id, list(k ORDER BY d, k) AS o, list(d ORDER BY d, k) AS ds FROM dd GROUP BY 1), sq AS (SELECT id, o, row_number() OVER (ORDER BY ds[2] - ds[1] DESC, id) AS r FROM od),
 go(r, id, k, used) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::INTEGER, [0, 0, 0] UNION ALL SELECT sq.r, sq.id, list_filter(o, lambda z: used[z + 1] < cap[z + 1])[1], list_transform(used, lambda u, i: u + CASE WHEN i - 1 = list_filter(o, lambda z: used[z + 1] < cap[z + 1])[1] THEN 1 ELSE 0 END) FROM go JOIN sq ON sq.r = go.r + 1, (SELECT list_transform([0, 1, 2], lambda z: count(*) // 3 + CASE WHEN z < count(*) % 3 THEN 1 ELSE 0 END) AS cap FROM p))"""


@query(_SEATS + " SELECT id, k AS cluster FROM go WHERE r > 0")
def balanced_center_assignment(spark, d):
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("v"))
    c = p.where("id < 3").select(F.col("id").cast("int").alias("cluster"), F.col("v").alias("c"))
    return S.balanced_assignment(p, c)


@query()
def widest_axis_leaves(spark, d):
    """Five leaves by halving the largest at the median of its wider axis; tests check sizes against a plain split."""
    ensure_checkpoint_dir(spark)
    return S.widest_split(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")), 5)


@query(SPARSE + """, g AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey % 4 AS BIGINT) AS leaf FROM nation), h AS (SELECT leaf, count(*) AS n FROM g GROUP BY 1), w AS (SELECT leaf, dst AS id, sum(weight) AS w FROM g JOIN e ON src = g.id GROUP BY 1, 2), m AS (SELECT w.*, n, row_number() OVER (PARTITION BY leaf ORDER BY round(w, 9) DESC, w.id) AS k FROM w JOIN h USING (leaf) WHERE w.id % 4 <> leaf)
 SELECT leaf, id, false AS padded FROM g UNION ALL SELECT leaf, id, true FROM m WHERE k <= 9 - n""")
def padded_leaves(spark, d):
    g = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") % 4).cast("long").alias("leaf"))
    return S.pad_leaves(g, sparse(spark, d), 9)


@query()
def propagated_groups(spark, d):
    """Communities of the sparse graph; tests check planted ones."""
    ensure_checkpoint_dir(spark)
    return S.label_groups(sparse(spark, d))


@query()
def modularity_groups(spark, d):
    """Louvain groups of the sparse graph, groups above eight nodes cut breadth first; tests hold modularity against a plain Louvain."""
    e = sparse(spark, d)
    return split_groups(e, louvain(e), 8, 4)


@query(SPARSE + """, y AS (SELECT src, dst, max(weight) AS w FROM (SELECT src, dst, weight FROM e WHERE src <> dst UNION ALL SELECT dst, src, weight FROM e WHERE src <> dst) GROUP BY 1, 2), g AS (SELECT CAST(n_nationkey AS BIGINT) AS node, n_regionkey AS grp FROM nation),
 j AS (SELECT a.grp AS ga, b.grp AS gb, w FROM y JOIN g a ON a.node = src JOIN g b ON b.node = dst), m AS (SELECT sum(w) AS m FROM j) SELECT round(sum(inn) / max(m) - sum(tot * tot) / max(m * m), 6) AS modularity FROM (SELECT ga, sum(w) AS tot, sum(w) FILTER (ga = gb) AS inn FROM j GROUP BY 1), m""")
def region_modularity(spark, d):
    """How well the regions part the trade graph."""
    g = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("grp"))
    return modularity(symmetrize(strip_self_loops(sparse(spark, d))), g).select(R("modularity").alias("modularity"))


@query("""WITH n AS (SELECT count(*) AS n, CAST(round_even(count(*) * 0.05, 0) AS BIGINT) AS w, greatest(1, CAST(round_even(round_even(count(*) * 0.05, 0) * 0.2, 0) AS BIGINT)) AS l FROM events), r AS (SELECT event_id AS id, row_number() OVER (ORDER BY value DESC, event_id) AS k FROM events), h AS (SELECT id FROM r, n WHERE k <= w - l), o AS (SELECT event_id AS id, row_number() OVER (ORDER BY md5('7/' || event_id), event_id) AS k FROM events WHERE event_id NOT IN (SELECT id FROM h))
 SELECT id, true AS hard, 1.0::DOUBLE AS probability FROM h UNION ALL SELECT id, false, round(l / (n - w + l), 9) FROM o, n WHERE k <= l""")
def epsilon_greedy_samples(spark, d):
    return S.epsilon_greedy(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("loss")), 0.05, 0.2, 7).withColumn("probability", R("probability", 9))


@query("""WITH l AS (SELECT o_custkey % 50 AS batch, o_orderkey AS node, o_totalprice AS loss, o_totalprice % 997 AS score FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY score DESC, node) AS k, count(*) OVER (PARTITION BY batch) AS n, CAST('0x' || substr(md5(batch || '/' || node), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM l),
 w AS (SELECT *, CASE WHEN k <= greatest(1, round_even(n * 0.3, 0)) THEN 1.0 WHEN u < 0.25 THEN 4.0 ELSE 0.0 END AS weight FROM r) SELECT batch, round(sum(weight * loss) / count(*), 3) AS loss, count(*) FILTER (weight > 0) AS kept FROM w GROUP BY 1""")
def hard_node_revisit(spark, d):
    x = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("batch"), F.col("o_orderkey").alias("node"), F.col("o_totalprice").alias("loss"), (F.col("o_totalprice") % 997).alias("score"))
    return S.revisit_loss(x, "batch", 0.3, 0.25).withColumn("loss", R("loss", 3))


@query("SELECT event_id AS id FROM events ORDER BY value DESC, event_id LIMIT 137")
def forward_budget(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("loss"))
    return S.within_budget(e, 137, [F.desc("loss"), F.asc("id")]).select("id")


@query(FACTS_SQL + """, ep AS (SELECT * FROM (VALUES (1, 3), (3, 1), (4, 1), (5, 2), (9, 3)) v(epoch, h)) SELECT CAST(epoch AS INTEGER) AS epoch, count(*) AS n, round(avg(abs(pred - target)), 6) AS mae FROM facts JOIN ep ON horizon <= h GROUP BY 1""")
def curriculum_by_epoch(spark, d):
    c = S.curriculum(predictions(spark, d), [1, 3, 4, 5, 9], 2, 2, 1, 3)
    return c.groupBy("epoch").agg(F.count("*").alias("n"), R(F.avg(F.abs(F.col("pred") - F.col("target")))).alias("mae"))
