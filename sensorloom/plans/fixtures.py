"""The test tables seen as panels and graphs, in Spark and (as common table expressions) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.forecast import previous_step, seasonal, targets
from sensorloom.operators.panel import dense_panel
from sensorloom.operators.storage import kept
from sensorloom.plans.registry import table

HOURS = 720
CUTS = (432, 576)  # 0.6 / 0.2 / 0.2 of 720 hours


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel A: event types by hour, mean value; gaps are real."""
    return dense_panel(table(spark, sf_dir, "events"), "event_type", "ts", F.avg("value"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel of event counts by type and hour, empty cells zero."""
    p = dense_panel(table(spark, sf_dir, "events"), "event_type", "ts", F.count("*").cast("double"))
    return p.withColumn("value", F.coalesce("value", F.lit(0.0)))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed graph of revenue from supplier nations to customer nations: src, dst, weight (millions); kept, as queries read its few rows more than once."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    g = j.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    return kept(g.agg((F.sum(F.expr("cast(l_extendedprice * (1 - l_discount) as decimal(18,4))")).cast("double") / 1e6).alias("weight")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-part facts of two naive systems: system, node, t, horizon, target, pred."""
    p = hours(spark, sf_dir)
    f = targets(p, [1, 2, 3], CUTS[1])
    a = previous_step(f, p).withColumn("system", F.lit("previous"))
    b = seasonal(previous_step(f, p, "__last"), p, 24, F.col("__last")).withColumn("system", F.lit("seasonal"))
    cols = ["system", "node", "t", "horizon", "target", "pred"]
    return a.select(*cols).unionByName(b.select(*cols))


PANEL = """
g AS (SELECT event_type AS node, date_trunc('hour', ts) AS h, {value} AS value FROM events GROUP BY 1, 2),
b AS (SELECT min(h) AS h0, CAST(date_diff('hour', min(h), max(h)) AS BIGINT) AS n FROM g),
grid AS (SELECT node, t, h0 + t * INTERVAL 1 HOUR AS ts FROM (SELECT DISTINCT node FROM g), b, unnest(range(n + 1)) AS u(t)),
panel AS (SELECT grid.node, grid.t, grid.ts, {cell} AS value FROM grid LEFT JOIN g ON g.node = grid.node AND g.h = grid.ts)"""
HOURS_SQL = "WITH " + PANEL.format(value="avg(value)", cell="g.value")
COUNTS_SQL = "WITH " + PANEL.format(value="CAST(count(*) AS DOUBLE)", cell="coalesce(g.value, 0.0)")
FLOWS_CTE = """
flows AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst,
 CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) / 1e6 AS weight
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
FLOWS_SQL = "WITH " + FLOWS_CTE
LAST = "last_value(value IGNORE NULLS) OVER (PARTITION BY node ORDER BY t ROWS UNBOUNDED PRECEDING)"
FACTS_CTE = f""",
lastv AS (SELECT node, t, {LAST} AS lv FROM panel),
tg AS (SELECT node, t, CAST(h AS INTEGER) AS horizon, value AS target FROM panel, unnest([1, 2, 3]) AS u(h) WHERE t >= 576),
facts AS (SELECT 'previous' AS system, tg.*, lv AS pred FROM tg LEFT JOIN lastv ON lastv.node = tg.node AND lastv.t = tg.t - horizon
 UNION ALL SELECT 'seasonal', tg.*, coalesce(p.value, lv) FROM tg LEFT JOIN lastv ON lastv.node = tg.node AND lastv.t = tg.t - horizon
 LEFT JOIN panel p ON p.node = tg.node AND p.t = tg.t - 24)"""
FACTS_SQL = HOURS_SQL + FACTS_CTE
