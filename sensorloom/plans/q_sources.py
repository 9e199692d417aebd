"""Queries over sources and sinks: a table is written by a sink, read by its source, and compared with what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sensorloom.operators.panel import encode
from sensorloom.operators.storage import ensure_checkpoint_dir
from sensorloom.plans.fixtures import COUNTS_SQL, CUTS, FACTS_SQL, counts, flows, predictions
from sensorloom.plans.q_graph import SPARSE, sparse
from sensorloom.plans.registry import query, table
from sensorloom.sources import arrays as A
from sensorloom.sources import ndarray as N
from sensorloom.sources import readers as S

R = lambda c, n=6: F.round(c, n)


def _path(spark) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/written-{uuid.uuid4().hex}"


_CODED = COUNTS_SQL + ", cd AS (SELECT node, CAST(dense_rank() OVER (ORDER BY node) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT node FROM panel))"


def _coded(spark, d):
    return encode(counts(spark, d), "node", "idx").select("t", F.col("idx").cast("long").alias("node"), "value")


@query(_CODED + " SELECT t, idx AS node, value FROM panel JOIN cd USING (node)")
def array_blocks_whole(spark, d):
    """The hourly counts as blocks of a float array, written and read by many tasks."""
    p, out = _coded(spark, d), _path(spark)
    N.write_ndarray_blocks(p, out, p.agg(F.max("node")).first()[0] + 1, block_rows=100)
    return N.read_ndarray(spark, f"{out}/", ["t", "node"], split_bytes=4096)


@query(_CODED + " SELECT idx AS node, count(*) AS n, round(sum(value), 6) AS total FROM panel JOIN cd USING (node) WHERE t >= 150 AND t < 333 AND idx IN (1, 3) GROUP BY 1")
def array_blocks_filtered(spark, d):
    """Filters on both dimensions, pushed to the source."""
    p, out = _coded(spark, d), _path(spark)
    N.write_ndarray_blocks(p, out, p.agg(F.max("node")).first()[0] + 1, block_rows=64)
    a = N.read_ndarray(spark, f"{out}/", ["t", "node"]).where("t >= 150 AND t < 333 AND node IN (1, 3)")
    return a.groupBy("node").agg(F.count("*").alias("n"), R(F.sum("value")).alias("total"))


@query(COUNTS_SQL + " SELECT node, count(*) AS n, round(sum(value), 6) AS total FROM panel WHERE node IN ('click', 'view') GROUP BY 1")
def tensor_sink_and_scan(spark, d):
    p, out = counts(spark, d), _path(spark)
    A.write_tensor(p.select("t", "node", "value"), out, {"shape": [720, 5, 1], "frequency (minutes)": 60})
    return S.load_series(spark, f"{out}/data", ["click", "view"]).groupBy("node").agg(F.count("*").alias("n"), R(F.sum("value")).alias("total"))


@query(COUNTS_SQL + " SELECT split, count(*) AS n, min(t) AS low, max(t) AS high FROM (SELECT DISTINCT t, CASE WHEN t < 432 THEN 'train' WHEN t < 576 THEN 'valid' ELSE 'test' END AS split FROM panel) GROUP BY 1")
def split_sink_and_scan(spark, d):
    out, t = _path(spark), F.col("t")
    split = counts(spark, d).select("t").distinct().withColumn("split", F.when(t < CUTS[0], "train").when(t < CUTS[1], "valid").otherwise("test"))
    A.write_split(split, out)
    return spark.read.parquet(out).groupBy("split").agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high"))


@query(SPARSE + ", nn AS (SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS id FROM nation) SELECT a.id AS src, b.id AS dst, round(weight, 6) AS weight FROM e JOIN nn a ON a.pos = e.src JOIN nn b ON b.pos = e.dst WHERE weight <> 0")
def adjacency_sink_and_scan(spark, d):
    out = _path(spark)
    A.write_adjacency(sparse(spark, d), out, table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("id")))
    e, ids = spark.read.parquet(f"{out}/edges"), spark.read.parquet(f"{out}/ids")
    j = e.join(ids.select(F.col("pos").alias("src"), F.col("id").alias("a")), "src").join(ids.select(F.col("pos").alias("dst"), F.col("id").alias("b")), "dst")
    return j.select(F.col("a").alias("src"), F.col("b").alias("dst"), R("weight").alias("weight"))


@query(FACTS_SQL + " SELECT horizon, count(*) AS n, round(avg(abs(pred - target)), 6) AS mae FROM facts GROUP BY 1")
def results_sink_in_batches(spark, d):
    """Facts of one system, then of the other appended, partitioned by horizon."""
    f, out = predictions(spark, d).withColumn("sample", F.col("t")), _path(spark)
    for n, name in enumerate(("previous", "seasonal")):
        A.write_results(f.where(F.col("system") == name).select("sample", "horizon", "node", "pred", "target"), out, append=n > 0)
    return spark.read.parquet(out).groupBy("horizon").agg(F.count("*").alias("n"), R(F.avg(F.abs(F.col("pred") - F.col("target")))).alias("mae"))


@query(COUNTS_SQL + " SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, max(value) FILTER (node = 'view') AS a, max(value) FILTER (node = 'click') AS b FROM panel GROUP BY ts")
def forecast_csv_sink(spark, d):
    out = _path(spark)
    A.write_forecast_csv(counts(spark, d).select("ts", "node", "value"), out, ["view", "click"])
    return spark.read.csv(out, schema="ts string, a double, b double")


@query("SELECT coalesce(c_mktsegment, '-') AS segment, count(*) AS n, count(s_suppkey) AS suppliers, round(sum(CAST(bal AS DOUBLE)), 2) AS balance FROM (SELECT c_mktsegment, NULL AS s_suppkey, c_acctbal AS bal FROM customer UNION ALL SELECT NULL, s_suppkey, s_acctbal FROM supplier) GROUP BY 1")
def heterogeneous_rows_sink(spark, d):
    """Frames of different columns as one CSV."""
    out = _path(spark)
    S.write_rows([table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("bal")), table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("bal"))], out)
    r = spark.read.option("header", True).csv(out)
    return r.groupBy(F.coalesce("c_mktsegment", F.lit("-")).alias("segment")).agg(F.count("*").alias("n"), F.count("s_suppkey").alias("suppliers"), F.round(F.sum(F.col("bal").cast("double")), 2).alias("balance"))


@query(SPARSE + ", x AS (SELECT src, dst, round(weight, 3) AS cost FROM e WHERE src < dst) SELECT src, dst, cost FROM x UNION ALL SELECT dst, src, cost FROM x")
def distance_csv_scan(spark, d):
    """A from,to,cost file with malformed rows, read as symmetric edges."""
    out = _path(spark)
    good = sparse(spark, d).where("src < dst").select(F.col("src").cast("string").alias("from"), F.col("dst").cast("string").alias("to"), F.round("weight", 3).cast("string").alias("cost"))
    bad = table(spark, d, "region").select(F.col("r_name").alias("from"), F.lit("y").alias("to"), F.lit("z").alias("cost"))
    good.unionByName(bad).write.option("header", True).csv(out)
    return S.read_distances(spark, out)


@query("SELECT CAST(o_orderkey % 3 AS INTEGER) AS shard, count(*) AS n, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS total, CAST(count(CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END) AS BIGINT) AS priorities FROM orders GROUP BY 1")
def shards_merged(spark, d):
    """Three shards, of which only one has a further column, as one table."""
    out, o = _path(spark), table(spark, d, "orders")
    for k in range(3):
        o.where(F.col("o_orderkey") % 3 == k).select("o_orderkey", "o_totalprice", *(["o_orderpriority"] if k == 2 else [])).write.parquet(f"{out}/{k}")
    A.merge_shards(spark, [f"{out}/{k}" for k in range(3)], f"{out}/all")
    return spark.read.parquet(f"{out}/all").groupBy("shard").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"), F.count("o_orderpriority").alias("priorities"))


@query(FACTS_SQL + " SELECT system AS method, node, round(avg(abs(pred - target)), 6) AS mae, 1.5::DOUBLE AS seconds FROM facts GROUP BY 1, 2")
def method_runs_sink(spark, d):
    """Runs of two methods with their scores, runtimes and predictions, and the runtimes of all."""
    out, f = _path(spark), predictions(spark, d)
    part = {s: f.where(F.col("system") == s) for s in ("previous", "seasonal")}
    runs = {s: (p.groupBy("node").agg(R(F.avg(F.abs(F.col("pred") - F.col("target")))).alias("mae")), p, 1.5) for s, p in part.items()}
    A.write_runs(out, runs, {"horizons": [1, 2, 3]})
    got = None
    for s in runs:
        one = spark.read.option("header", True).csv(f"{out}/{s}/scoring", schema="node string, mae double").withColumn("method", F.lit(s))
        got = one if got is None else got.unionByName(one)
    seconds = spark.read.option("header", True).csv(f"{out}/runtimes", schema="method string, seconds double")
    return got.join(seconds, "method").select("method", "node", "mae", "seconds")
