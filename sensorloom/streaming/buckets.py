"""Structured Streaming: tumbling buckets with a watermark, mergeable metrics, enter and exit sets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(readings: DataFrame, ts: str, key: str, value: str, width: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """(start, key, n, total, mean) per bucket and key; rows later than the watermark are dropped by the stream.

    Rows without a time are dropped. Works on streams and on tables alike.
    """
    r = readings.where(F.col(ts).isNotNull())
    r = r.withWatermark(ts, late) if r.isStreaming else r
    g = r.groupBy(F.window(ts, width), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("window.start").alias("start"), "key", "n", "total", "mean")


def running_metrics(facts: DataFrame, by: list[str]) -> DataFrame:
    """Sums that merge over micro-batches: n, absolute and squared error."""
    e = F.col("pred") - F.col("target")
    return facts.where("target is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def occupancy_changes(ticks: DataFrame, key: str = "lane", order: str = "tick", members: str = "members") -> DataFrame:
    """(lane, tick, entered, exited) between consecutive member sets of a lane (table form)."""
    from pyspark.sql import Window

    before = F.coalesce(F.lag(members).over(Window.partitionBy(key).orderBy(order)), F.array().cast(dict(ticks.dtypes)[members]))
    return ticks.select(key, order, F.size(F.array_except(members, before)).alias("entered"), F.size(F.array_except(before, members)).alias("exited"))


def occupancy_stream(ticks: DataFrame) -> DataFrame:
    """The same over a stream of (lane string, tick long, members array<long>): the last member set is kept as state.

    Ticks of a lane are put in order within a micro-batch; a tick older than the state is ignored.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator, state: GroupState):
        import pandas as pd

        at, inside = state.get if state.exists else (-1, [])
        inside, out = set(inside), []
        for f in sorted((f for pdf in frames for f in pdf.itertuples()), key=lambda r: r.tick):
            if f.tick <= at:
                continue
            now = set(f.members)
            out.append((key[0], f.tick, len(now - inside), len(inside - now)))
            at, inside = f.tick, now
        state.update((at, sorted(int(x) for x in inside)))
        yield pd.DataFrame(out, columns=["lane", "tick", "entered", "exited"])

    return ticks.groupBy("lane").applyInPandasWithState(step, "lane string, tick long, entered long, exited long", "tick long, members array<long>", "append", GroupStateTimeout.NoTimeout)


def append_forecast_grid(panel: DataFrame, horizon: int) -> DataFrame:
    """panel with `horizon` steps more per node after the last one, values null."""
    last = panel.groupBy("node").agg(F.max("t").alias("z"))
    more = last.select("node", F.explode(F.sequence(F.col("z") + 1, F.col("z") + horizon)).alias("t"))
    return panel.select("node", "t", "value").unionByName(more.select("node", "t", F.lit(None).cast("double").alias("value")))
