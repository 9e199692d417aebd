"""Queries of the streaming operators in their table form."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.plans.fixtures import COUNTS_SQL, counts
from sensorloom.plans.registry import query, table
from sensorloom.streaming import buckets as B
from sensorloom.streaming import states as S


@query("""SELECT CAST(epoch(time_bucket(INTERVAL 15 MINUTE, ts)) AS BIGINT) AS start, event_type AS key, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def tumbling_buckets(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return B.tumbling(e, "ts", "event_type", "value", "15 minutes").select(F.unix_seconds("start").alias("start"), "key", "n", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))


@query("""WITH m AS (SELECT event_type AS lane, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS tick, list(DISTINCT user_id) AS members FROM events GROUP BY 1, 2), l AS (SELECT *, coalesce(lag(members) OVER (PARTITION BY lane ORDER BY tick), []) AS b FROM m)
 SELECT lane, tick, len(list_filter(members, lambda x: NOT list_contains(b, x))) AS entered, len(list_filter(b, lambda x: NOT list_contains(members, x))) AS exited FROM l""")
def occupancy_changes(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("lane"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("tick")).agg(F.collect_set("user_id").alias("members"))
    return B.occupancy_changes(e)


_CORR = "CASE WHEN count(*) >= 3 AND stddev_pop({a}) >= 1e-8 AND stddev_pop({b}) >= 1e-8 THEN round(corr({a}, {b}), 6) + 0.0 END"


@query(COUNTS_SQL + f""", p AS (SELECT node, CAST(t // 24 AS INTEGER) AS day, t % 24 AS slot, value AS v, lead(value) OVER (PARTITION BY node, t // 24 ORDER BY t) AS w FROM panel), l AS (SELECT node, day, {_CORR.format(a="v", b="w")} AS lag1_corr FROM p WHERE w IS NOT NULL GROUP BY 1, 2),
 d AS (SELECT p.node, p.day, {_CORR.format(a="p.v", b="q.v")} AS day_corr FROM p JOIN p q ON q.node = p.node AND q.slot = p.slot AND q.day = p.day - 1 GROUP BY 1, 2), k AS (SELECT p.node, p.day, {_CORR.format(a="p.v", b="q.v")} AS week_corr FROM p JOIN p q ON q.node = p.node AND q.slot = p.slot AND q.day = p.day - 7 GROUP BY 1, 2)
 SELECT g.node, g.day, lag1_corr, day_corr, week_corr FROM (SELECT DISTINCT node, day FROM p) g LEFT JOIN l USING (node, day) LEFT JOIN d USING (node, day) LEFT JOIN k USING (node, day)""")
def day_profile_correlations(spark, d):
    """Table form of the rolling profile state: hourly counts of a day against those of the day and of the week before."""
    c = counts(spark, d).groupBy("node", F.floor(F.col("t") / 24).cast("int").alias("day")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("profile"))
    return S.day_profile_table(c).select("node", "day", *[(F.round(x, 6) + 0.0).alias(x) for x in ("lag1_corr", "day_corr", "week_corr")])


@query("""WITH k AS (SELECT event_type AS road, user_id % 3 AS lane, date_trunc('hour', ts) AS ts, list(DISTINCT user_id) AS m, list(value) AS s FROM events GROUP BY 1, 2, 3), l AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY road, lane ORDER BY ts), []) AS b FROM k),
 t AS (SELECT road, ts, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS bucket, len(list_filter(m, lambda x: NOT list_contains(b, x))) AS i, len(list_filter(b, lambda x: NOT list_contains(m, x))) AS o, len(m) AS n, coalesce(list_sum(list_filter(s, lambda x: x >= 0)), 0) AS v, len(list_filter(s, lambda x: x >= 0)) AS c FROM l)
 SELECT road, bucket, CAST(sum(i) AS BIGINT) AS entered, CAST(sum(o) AS BIGINT) AS exited, round(sum(n) / count(DISTINCT ts), 6) AS mean_active, round(CASE WHEN sum(c) > 0 THEN sum(v) / sum(c) * 3.6 ELSE 0 END, 6) AS mean_speed_kmh, round(sum(n) / count(DISTINCT ts) / 0.5, 6) AS density, round(sum(n) * 3600.0, 3) AS vehicle_seconds FROM t GROUP BY 1, 2""")
def road_buckets(spark, d):
    """Table form of the buckets that timers flush: users seen in an hour are the vehicles of a lane, values their speeds."""
    e = table(spark, d, "events").withColumn("ts", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    t = e.groupBy("ts", F.col("event_type").alias("road"), (F.col("user_id") % 3).alias("lane")).agg(F.collect_set(F.col("user_id").cast("string")).alias("members"), F.collect_list("value").alias("speeds")).withColumn("lane_km", F.lit(0.5))
    b = S.road_buckets_table(t, 21600, 3600.0)
    return b.select("road", "bucket", "entered", "exited", F.round("mean_active", 6).alias("mean_active"), F.round("mean_speed_kmh", 6).alias("mean_speed_kmh"), F.round("density", 6).alias("density"), F.round("vehicle_seconds", 3).alias("vehicle_seconds"))
