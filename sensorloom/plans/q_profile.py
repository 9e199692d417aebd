"""Queries over profiles, distributions, reshaping and text fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import profile as P
from sensorloom.plans.fixtures import COUNTS_SQL, FACTS_SQL, HOURS_SQL, counts, hours, predictions
from sensorloom.plans.registry import query, table

R = lambda c, n=6: F.round(c, n)


def _round(df, cols, n=6):
    return df.select(*[R(c, n).alias(c) if c in cols else c for c in df.columns])


@query(COUNTS_SQL + """ SELECT node, count(value) AS n, round(avg(CAST(value <= 0 AS DOUBLE)), 6) AS zero_rate, round(avg(value), 6) AS mean, round(var_pop(value) / avg(value), 6) AS dispersion, round(quantile_cont(value, 0.5) FILTER (value > 0), 6) AS p50,
 round(quantile_cont(value, 0.9) FILTER (value > 0), 6) AS p90, round(quantile_cont(value, 0.99) FILTER (value > 0), 6) AS p99 FROM panel GROUP BY 1""")
def zero_distribution(spark, d):
    return _round(P.distribution(counts(spark, d), ["node"]), ["zero_rate", "mean", "dispersion", "p50", "p90", "p99"])


@query(COUNTS_SQL + """, z AS (SELECT node, value <= 0 AS a, lead(value <= 0) OVER (PARTITION BY node ORDER BY t) AS b FROM panel) SELECT node, round(count(*) FILTER (a AND b) / count(*) FILTER (a), 6) AS p00, round(count(*) FILTER (a AND NOT b) / count(*) FILTER (a), 6) AS p01,
 round(count(*) FILTER (NOT a AND b) / count(*) FILTER (NOT a), 6) AS p10, round(count(*) FILTER (NOT a AND NOT b) / count(*) FILTER (NOT a), 6) AS p11 FROM z WHERE b IS NOT NULL GROUP BY 1""")
def zero_transitions(spark, d):
    return _round(P.zero_transitions(counts(spark, d), ["node"]), ["p00", "p01", "p10", "p11"])


@query(COUNTS_SQL + """, m AS (SELECT node, avg(value) AS m, var_pop(value) AS v FROM panel WHERE t < 432 GROUP BY 1), h AS (SELECT node, t % 24 AS h, avg(value) AS mh FROM panel WHERE t < 432 GROUP BY 1, 2),
 nb AS (SELECT avg(CASE WHEN v > m + 1e-6 THEN exp(-(m * m / greatest(v - m, 1e-6)) * ln(1 + (m + 1e-6) / (m * m / greatest(v - m, 1e-6)))) ELSE exp(-m) END) AS nb FROM m)
 SELECT round(avg(CAST(abs(value) <= 1e-6 AS DOUBLE)), 6) AS observed, round(avg(exp(-coalesce(mh, m))), 6) AS poisson, round(max(nb), 6) AS negative_binomial FROM panel p JOIN m USING (node) LEFT JOIN h ON h.node = p.node AND h.h = p.t % 24, nb WHERE t >= 576""")
def expected_zero_rates(spark, d):
    p = counts(spark, d).withColumn("h", F.pmod("t", F.lit(24)))
    return _round(P.expected_zero_rate(p.where("t < 432"), p.where("t >= 576")), ["observed", "poisson", "negative_binomial"])


@query(COUNTS_SQL + " SELECT node, round(quantile_cont(value, 0.9) FILTER (value > 0), 6) AS threshold FROM panel WHERE t < 432 GROUP BY 1 HAVING count(*) FILTER (value > 0) >= 24")
def positive_thresholds(spark, d):
    return _round(P.positive_thresholds(counts(spark, d).where("t < 432"), 0.9, 24), ["threshold"])


@query(COUNTS_SQL + """, f AS (SELECT p.node, p.value AS target, q.value AS pred FROM panel p JOIN panel q ON q.node = p.node AND q.t = p.t - 24 WHERE p.t >= 576)
 SELECT node, round(avg(abs(pred - target)), 6) AS mae, round(avg(abs(pred - target)) FILTER (target > 0), 6) AS mae_pos, round(sum(abs(pred - target)) / sum(abs(target)), 6) AS wape, round(avg(abs(ln(1 + greatest(pred, 0)) - ln(1 + target))), 6) AS log_mae,
 round(coalesce(count(*) FILTER (target > 0 AND pred > 0) / nullif(count(*) FILTER (pred > 0), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (target > 0 AND pred > 0) / nullif(count(*) FILTER (target > 0), 0), 0), 6) AS recall, count(*) AS n FROM f GROUP BY 1""")
def zero_aware_metrics(spark, d):
    p = counts(spark, d)
    f = p.where("t >= 576").select("node", "t", F.col("value").alias("target")).join(p.select("node", (F.col("t") + 24).alias("t"), F.col("value").alias("pred")), ["node", "t"])
    return _round(P.zero_aware(f, ["node"]), ["mae", "mae_pos", "wape", "log_mae", "precision", "recall"])


@query("""WITH b AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS z FROM orders) SELECT CAST(least(floor((o_totalprice - a) / ((z - a) / 20)), 19) AS BIGINT) AS bin, round(a + least(floor((o_totalprice - a) / ((z - a) / 20)), 19) * ((z - a) / 20), 4) AS low,
 round(a + (least(floor((o_totalprice - a) / ((z - a) / 20)), 19) + 1) * ((z - a) / 20), 4) AS high, count(*) AS n FROM orders, b GROUP BY ALL""")
def price_histogram(spark, d):
    return _round(P.histogram(table(spark, d, "orders"), "o_totalprice", 20), ["low", "high"], 4)


@query("""WITH e AS (SELECT list_sort(list_distinct(quantile_cont(p_size, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM part) SELECT CAST(greatest(len(list_filter(e, lambda x: x < p_size)), 1) - 1 AS INTEGER) AS qbin, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM part, e GROUP BY 1""")
def quantile_bins(spark, d):
    return P.quantile_bins(table(spark, d, "part"), "p_size", 5).groupBy("qbin").agg(F.count("*").alias("n"), R(F.avg("p_retailprice")).alias("mean"))


@query("""WITH x AS (SELECT DISTINCT user_id AS node, dayofyear(ts) AS day FROM events) SELECT node, count(*) AS days, min(day) AS first, max(day) AS last, round(count(*) / (SELECT count(DISTINCT day) FROM x), 6) AS share FROM x GROUP BY 1""")
def presence_statistics(spark, d):
    e = table(spark, d, "events")
    return _round(P.presence(e, "user_id", F.dayofyear("ts")), ["share"])


@query("""WITH x AS (SELECT DISTINCT user_id AS node, dayofyear(ts) AS day FROM events), p AS (SELECT node, count(*) AS days FROM x GROUP BY 1 HAVING count(*) >= 0.4 * (SELECT count(DISTINCT day) FROM x)), m AS (SELECT user_id AS node, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
 SELECT p.node, days, event_type FROM p JOIN m ON m.node = p.node AND k = 1""")
def stable_nodes(spark, d):
    e = table(spark, d, "events")
    return P.stable(P.presence(e, "user_id", F.dayofyear("ts")), e.select(F.col("user_id").alias("node"), "event_type", "event_id"), 0.4, "event_id").select("node", "days", "event_type")


@query(HOURS_SQL + """ SELECT node, t // 24 AS day, count(value) AS slots, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, max(value) AS max, round(stddev_samp(value), 6) AS std, round(count(value) / 24, 6) AS coverage FROM panel GROUP BY 1, 2""")
def sensor_day_summary(spark, d):
    return _round(P.day_summary(hours(spark, d), 24), ["total", "mean", "std", "coverage"])


@query(HOURS_SQL + """, x AS (SELECT node, value AS v, lag(value, 1) OVER w AS a, lag(value, 24) OVER w AS b, lag(value, 168) OVER w AS c FROM panel WINDOW w AS (PARTITION BY node ORDER BY t))
 SELECT node, round(avg(v), 6) AS mean, round(stddev_pop(v), 5) AS std, round(stddev_pop(v) / avg(v), 5) AS cv, round(corr(v, a), 5) AS lag1, round(corr(v, b), 5) AS day_ago, round(corr(v, c), 5) AS week_ago FROM x GROUP BY 1""")
def sensor_predictability(spark, d):
    return _round(_round(P.predictability(hours(spark, d), 24), ["mean"]), ["std", "cv", "lag1", "day_ago", "week_ago"], 5)


@query("""SELECT l_returnflag AS road, round(sum(l_quantity), 2) AS weight, round(coalesce(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 0), 8) AS mean FROM lineitem GROUP BY 1""")
def lane_to_road(spark, d):
    x = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "road")
    return P.weighted_rollup(x, ["road"], "l_quantity", "l_discount").select("road", R("weight", 2).alias("weight"), R("mean", 8).alias("mean"))


@query("""SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max FROM events WHERE value IS NOT NULL GROUP BY 1""")
def result_roll_up(spark, d):
    return P.roll_up(table(spark, d, "events"), ["event_type"], "value")


@query("""WITH r AS (SELECT o_orderkey % 40 AS run, o_orderkey % 4 AS ds, k AS metric, o_orderkey % 8 + k AS v FROM (SELECT DISTINCT o_orderkey % 40 AS o_orderkey FROM orders), unnest([1, 2]) u(k)), p AS (SELECT run, ds, string_agg(metric || ':' || v, ',' ORDER BY metric, v) AS m FROM r GROUP BY 1, 2)
 SELECT ds, min(run) AS first_run, count(*) AS copies, string_agg(CAST(run AS VARCHAR), ',' ORDER BY CAST(run AS VARCHAR)) AS runs FROM p GROUP BY ds, m""")
def collapse_duplicate_runs(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 40).alias("run")).distinct()
    r = o.select("run", (F.col("run") % 4).alias("ds"), F.explode(F.array(F.lit(1), F.lit(2))).alias("metric")).withColumn("v", F.col("run") % 8 + F.col("metric"))
    return P.collapse_runs(r, "run", ["ds"], "metric", "v")


@query("""WITH x AS (SELECT l_quantity AS q, l_discount AS dsc, l_tax AS tax, l_extendedprice AS y FROM lineitem), l AS (SELECT 'q' AS feature, q AS x, y FROM x UNION ALL SELECT 'dsc', dsc, y FROM x UNION ALL SELECT 'tax', tax, y FROM x),
 r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry FROM l)
 SELECT feature, round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM r GROUP BY 1""")
def correlation_table(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("dsc"), F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("y"))
    return _round(P.correlations(x, ["q", "dsc", "tax"], "y"), ["pearson", "spearman"], 5)


@query("""WITH c AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, h) AS k, sum(n) OVER (PARTITION BY user_id) AS total FROM c) SELECT user_id, CAST(h AS INTEGER) AS top, round(n / total, 6) AS share FROM k WHERE k = 1""")
def lag_mode_stability(spark, d):
    return _round(P.mode_share(table(spark, d, "events").select("user_id", F.hour("ts").alias("h")), ["user_id"], "h"), ["share"]).withColumn("top", F.col("top").cast("int"))


@query("""WITH w AS (SELECT o_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS q1, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS q2, max(CASE WHEN l_linenumber = 1 THEN l_tax END) AS t1, max(CASE WHEN l_linenumber = 2 THEN l_tax END) AS t2 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
 SELECT o_orderkey, 1 AS lane, q1 AS flow, t1 AS occ FROM w WHERE q1 > 0 UNION ALL SELECT o_orderkey, 2, q2, t2 FROM w WHERE q2 > 0""")
def wide_lanes_to_long(spark, d):
    li = table(spark, d, "lineitem")
    pick = lambda n, c: F.max(F.when(F.col("l_linenumber") == n, F.col(c)))
    w = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(pick(1, "l_quantity").alias("q1"), pick(2, "l_quantity").alias("q2"), pick(1, "l_tax").alias("t1"), pick(2, "l_tax").alias("t2"))
    w = w.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    return P.unpivot_lanes(w, ["o_orderkey"], {1: ["q1", "t1"], 2: ["q2", "t2"]}, ["flow", "occ"])


@query(FACTS_SQL + """, m AS (SELECT system, horizon, avg(abs(pred - target)) AS v FROM facts WHERE target IS NOT NULL GROUP BY 1, 2) SELECT system, round(max(v) FILTER (horizon = 1), 6) AS h1, round(max(v) FILTER (horizon = 2), 6) AS h2, round(max(v) FILTER (horizon = 3), 6) AS h3, round(avg(v), 6) AS average FROM m GROUP BY 1""")
def pivot_metric(spark, d):
    m = predictions(spark, d).where("target is not null").groupBy("system", "horizon").agg(F.avg(F.abs(F.col("pred") - F.col("target"))).alias("v"))
    p = m.groupBy("system").pivot("horizon", [1, 2, 3]).agg(F.first("v"))
    return p.join(m.groupBy("system").agg(F.avg("v").alias("average")), "system").select("system", *[R(str(k)).alias(f"h{k}") for k in (1, 2, 3)], R("average").alias("average"))


@query("""SELECT coalesce(l_returnflag, 'All') AS flag, coalesce(l_linestatus, 'All') AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cross_tab_margins(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).select(F.coalesce("l_returnflag", F.lit("All")).alias("flag"), F.coalesce("l_linestatus", F.lit("All")).alias("status"), "n")


@query("""SELECT 'mkt' AS field, c_mktsegment AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 6) AS ratio FROM customer GROUP BY 2 UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), count(*), round(count(*) / (SELECT count(*) FROM customer), 6) FROM customer GROUP BY 2""")
def categorical_counts(spark, d):
    c = table(spark, d, "customer")
    x = c.select(F.explode(F.array(F.struct(F.lit("mkt").alias("field"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("nation").alias("field"), F.col("c_nationkey").cast("string").alias("value")))).alias("r")).select("r.*")
    return x.groupBy("field", "value").agg(F.count("*").alias("n")).withColumn("ratio", R(F.col("n") / F.sum("n").over(Window.partitionBy("field"))))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, upper(trim(event_type)) AS kind, CASE upper(event_type) WHEN 'CLICK' THEN 'ML' WHEN 'VIEW' THEN 'OR' WHEN 'ERROR' THEN 'FR' ELSE 'UNK' END AS canon, TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS num FROM events""".replace("\\\\", "\\"))
def props_and_types(spark, d):
    e = table(spark, d, "events")
    canon = F.create_map(*[F.lit(x) for x in ("CLICK", "ML", "VIEW", "OR", "ERROR", "FR")])
    kind = F.upper(F.trim("event_type"))
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), kind.alias("kind"), F.coalesce(F.try_element_at(canon, kind), F.lit("UNK")).alias("canon"), F.regexp_extract("props", r"(\d+)", 1).try_cast("double").alias("num"))


@query("""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CAST(len(regexp_extract_all(html, '<a ')) AS INTEGER) AS links, length(html) AS size FROM pages""")
def page_fields(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))).alias("links"), F.length("html").alias("size"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def first_row_per_key(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def largest_values(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer) SELECT c_custkey FROM customer, q WHERE c_acctbal BETWEEN a AND b AND c_nationkey < 5""")
def core_by_quantile_box(spark, d):
    c = table(spark, d, "customer")
    q = c.agg(F.percentile("c_acctbal", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return c.crossJoin(F.broadcast(q)).where((F.col("c_acctbal") >= F.col("q")[0]) & (F.col("c_acctbal") <= F.col("q")[1]) & (F.col("c_nationkey") < 5)).select("c_custkey")


@query("""WITH k AS (SELECT event_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, value, user_id FROM events) SELECT user_id, round(sum(value / (0.25 + (event_id % 4) * 0.25)) / count(*), 6) AS ipw, CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM k GROUP BY 1""")
def inverse_probability_loss(spark, d):
    e = table(spark, d, "events").withColumn("p", 0.25 + F.col("event_id") % 4 * 0.25)
    return e.groupBy("user_id").agg(R(F.sum(F.col("value") / F.col("p")) / F.count("*")).alias("ipw"), F.count_if(F.col("value") > 100).alias("kept"))
