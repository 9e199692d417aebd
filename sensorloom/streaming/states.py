"""Streams with keyed state: rolling day profiles of sensors, and road buckets that event-time timers flush.

Both have a table form that gives the same rows. State lies in the RocksDB store that these
operators need; it is checkpointed with the query, so a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Days that the history of a sensor holds.
HISTORY = 8
PROFILE_ROWS = "node long, day int, lag1_corr double, day_corr double, week_corr double, late boolean"


def safe_corr(a, b) -> float | None:
    """Correlation over the places known in both; None with fewer than three or without variance."""
    import numpy as np

    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    n = min(len(a), len(b))
    ok = np.isfinite(a[:n]) & np.isfinite(b[:n])
    a, b = a[:n][ok], b[:n][ok]
    if len(a) < 3 or a.std() < 1e-8 or b.std() < 1e-8:
        return None
    return float(((a - a.mean()) * (b - b.mean())).mean() / (a.std() * b.std()))


class DayProfiles(StatefulProcessor):
    """Each day's profile against those of the day and of the week before, from a list of the last HISTORY days."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "day int, profile array<double>")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        past = [(d, list(p)) for d, p in self.history.get()] if self.history.exists() else []
        out = []
        days = sorted(((int(r.day), [float("nan") if x is None else float(x) for x in r.profile]) for pdf in rows for r in pdf.itertuples()), key=lambda r: r[0])
        for day, profile in days:
            if past and day <= past[-1][0]:
                out.append((key[0], day, None, None, None, True))
                continue
            before = dict(past)
            corr = [safe_corr(profile, before[day - k]) if day - k in before else None for k in (1, 7)]
            out.append((key[0], day, safe_corr(profile[:-1], profile[1:]), *corr, False))
            past = [*past, (day, profile)][-HISTORY:]
        self.history.put([(d, [None if x != x else x for x in p]) for d, p in past])
        yield pd.DataFrame(out, columns=["node", "day", "lag1_corr", "day_corr", "week_corr", "late"]).astype({"lag1_corr": "float64", "day_corr": "float64", "week_corr": "float64"})

    def close(self) -> None:
        pass


def _array_corr(a: Column, b: Column) -> Column:
    """safe_corr of two array columns."""
    ok = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"].isNotNull() & z["b"].isNotNull() & ~F.isnan(z["a"]) & ~F.isnan(z["b"]))
    n = F.size(ok).cast("double")
    mean = lambda f: F.aggregate(ok, F.lit(0.0), lambda s, z: s + f(z)) / n
    ma, mb = mean(lambda z: z["a"]), mean(lambda z: z["b"])
    va, vb = mean(lambda z: z["a"] * z["a"]) - ma * ma, mean(lambda z: z["b"] * z["b"]) - mb * mb
    cov = mean(lambda z: z["a"] * z["b"]) - ma * mb
    return F.when((n >= 3) & (va >= 1e-16) & (vb >= 1e-16), cov / F.sqrt(va * vb))


def day_profile_stream(profiles: DataFrame) -> DataFrame:
    """(node, day, lag1_corr, day_corr, week_corr, late) for each row of a stream (node long, day int, profile array<double>).

    Correlations are null where the other day is not known. A day that is not after the
    newest one of its sensor is late: it is reported so, compared with nothing and not kept.
    """
    use_state_store(profiles.sparkSession)
    return profiles.select("node", "day", "profile").groupBy("node").transformWithStateInPandas(DayProfiles(), PROFILE_ROWS, "append", "none")


def day_profile_table(profiles: DataFrame) -> DataFrame:
    """The same over a table whose days are distinct and all in order: a join with the day and the week before."""
    p = profiles.select("node", "day", "profile")
    back = lambda k, name: p.select("node", (F.col("day") + k).alias("day"), F.col("profile").alias(name))
    j = p.join(back(1, "a"), ["node", "day"], "left").join(back(7, "b"), ["node", "day"], "left")
    lag = _array_corr(F.slice("profile", F.lit(1), F.greatest(F.size("profile") - 1, F.lit(0))), F.slice("profile", F.lit(2), F.greatest(F.size("profile") - 1, F.lit(0))))
    corr = lambda c: F.when(F.col(c).isNotNull(), _array_corr(F.col("profile"), F.col(c)))
    return j.select("node", "day", F.when(F.size("profile") > 0, lag).alias("lag1_corr"), corr("a").alias("day_corr"), corr("b").alias("week_corr"), F.lit(False).alias("late"))


ROAD_ROWS = "road string, bucket long, entered long, exited long, mean_active double, mean_speed_kmh double, density double, vehicle_seconds double"


class RoadBuckets(StatefulProcessor):
    """Sums of a road's open buckets and each lane's last vehicles; a timer at a bucket's end flushes it."""

    def __init__(self, bucket_s: int, interval_s: float):
        self.bucket_s, self.interval_s = bucket_s, interval_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lanes = handle.getMapState("lanes", "lane string", "at long, members array<string>")
        self.sums = handle.getMapState("sums", "bucket long", "entered long, exited long, active double, metres double, seen double, lane_km double, ticks array<long>")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        last, sums = {}, {}
        for r in sorted((r for pdf in rows for r in pdf.itertuples()), key=lambda r: (r.at, r.lane)):
            lane, bucket = (r.lane,), int(r.at // (1000 * self.bucket_s) * self.bucket_s)
            if lane not in last:
                last[lane] = self.lanes.getValue(lane) if self.lanes.containsKey(lane) else (None, [])
            at, members = last[lane]
            if at is not None and r.at <= at or (bucket + self.bucket_s) * 1000 <= timerValues.getCurrentWatermarkInMs():
                continue
            if bucket not in sums:
                sums[bucket] = list(self.sums.getValue((bucket,))) if self.sums.containsKey((bucket,)) else [0, 0, 0.0, 0.0, 0.0, float(r.lane_km), []]
            now, before, s = set(r.members), set(members), sums[bucket]
            s[0] += len(now - before)
            s[1] += len(before - now)
            s[2] += len(now) * self.interval_s
            good = [v for v in r.speeds if v is not None and v == v and v >= 0]
            s[3] += sum(good) * self.interval_s
            s[4] += len(good) * self.interval_s
            s[6] = sorted({*s[6], int(r.at)})
            last[lane] = (int(r.at), sorted(now))
        for lane, v in last.items():
            self.lanes.updateValue(lane, v)
        for bucket, s in sums.items():
            if not self.sums.containsKey((bucket,)):
                self.handle.registerTimer((bucket + self.bucket_s) * 1000)
            self.sums.updateValue((bucket,), tuple(s))
        yield pd.DataFrame([], columns=["road", "bucket", "entered", "exited", "mean_active", "mean_speed_kmh", "density", "vehicle_seconds"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        bucket = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.bucket_s
        if self.sums.containsKey((bucket,)):
            entered, exited, active, metres, seen, lane_km, ticks = self.sums.getValue((bucket,))
            self.sums.removeKey((bucket,))
            mean = active / max(len(ticks) * self.interval_s, self.interval_s)
            row = (key[0], bucket, entered, exited, mean, metres / seen * 3.6 if seen > 0 else 0.0, mean / lane_km if lane_km > 0 else 0.0, active)
            yield pd.DataFrame([row], columns=["road", "bucket", "entered", "exited", "mean_active", "mean_speed_kmh", "density", "vehicle_seconds"])

    def close(self) -> None:
        pass


def road_buckets_stream(ticks: DataFrame, bucket_s: int = 300, interval_s: float = 1.0, late: str = "60 seconds") -> DataFrame:
    """(road, bucket, entered, exited, mean_active, mean_speed_kmh, density, vehicle_seconds) of a stream of ticks (ts timestamp, road, lane, lane_km, members array<string>, speeds array<double>, in m/s).

    A tick says which vehicles a lane holds. bucket is its start in seconds since the epoch; it
    is flushed when the watermark passes its end, and stays open across micro-batches and
    restarts until then. A lane counts changes from its tick before; a tick that is not after
    that one, or whose bucket is flushed, is left out. Means are over the ticks that a road
    had. Negative and missing speeds do not count. Group by lane instead by passing it as road.
    """
    use_state_store(ticks.sparkSession)
    t = ticks.where("ts IS NOT NULL").withWatermark("ts", late)
    t = t.select("road", "ts", F.unix_millis("ts").alias("at"), "lane", "lane_km", "members", "speeds")
    return t.groupBy("road").transformWithStateInPandas(RoadBuckets(bucket_s, interval_s), ROAD_ROWS, "append", "eventTime")


def road_buckets_table(ticks: DataFrame, bucket_s: int = 300, interval_s: float = 1.0) -> DataFrame:
    """The same over a table: a window by lane for the changes, then one aggregation; all buckets are closed. Ticks of a lane are distinct in time."""
    w = Window.partitionBy("road", "lane").orderBy("ts")
    before = F.coalesce(F.lag("members").over(w), F.array().cast("array<string>"))
    good = F.filter("speeds", lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0))
    t = ticks.where("ts IS NOT NULL").withColumn("before", before).select(
        "road", (F.floor(F.unix_seconds("ts") / bucket_s) * bucket_s).alias("bucket"), "ts", "lane_km", F.size(F.array_except("members", "before")).alias("i"), F.size(F.array_except("before", "members")).alias("o"),
        F.size(F.array_distinct("members")).alias("n"), F.aggregate(good, F.lit(0.0), lambda s, v: s + v).alias("v"), F.size(good).alias("k"),
    )
    g = t.groupBy("road", "bucket").agg(
        F.sum("i").alias("entered"), F.sum("o").alias("exited"), (F.sum("n") * interval_s).alias("vehicle_seconds"), F.sum("v").alias("v"), F.sum("k").alias("k"), F.max("lane_km").alias("lane_km"), F.count_distinct("ts").alias("ticks")
    )
    mean = F.col("vehicle_seconds") / (F.col("ticks") * interval_s)
    speed = F.when(F.col("k") > 0, F.col("v") / F.col("k") * 3.6).otherwise(0.0)
    return g.select("road", "bucket", "entered", "exited", mean.alias("mean_active"), speed.alias("mean_speed_kmh"), F.when(F.col("lane_km") > 0, mean / F.col("lane_km")).otherwise(0.0).alias("density"), "vehicle_seconds")
