"""Samples and splits: calendar subsets, whole-day splits, model inputs, window specifications and embeddings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.storage import numbered


def in_months(ts: Column, year: int, months: list[int]) -> Column:
    return (F.year(ts) == year) & F.month(ts).isin(months)


def in_time_of_day(ts: Column, start_s: int, end_s: int) -> Column:
    """Steps whose start lies in [start_s, end_s) seconds of the day."""
    s = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return (s >= start_s) & (s < end_s)


def weekday_code(channel: Column) -> Column:
    """Weekday 0 to 6 from its fraction of a week, rounded half to even."""
    return F.least(F.greatest(F.rint(channel * 7), F.lit(0.0)), F.lit(6.0)).cast("int")


def last_days_split(steps: int, days: int, per_day: int, train: float, valid: float) -> dict[str, tuple[int, int]]:
    """Step ranges [from, to) of full and last-days training, with one validation and test part."""
    a = int(steps * train)
    b = a + int(steps * valid)
    return {"train": (0, a), "train_recent": (max(0, a - days * per_day), a), "valid": (a, b), "test": (b, steps)}


def label_ranges(t: Column, ranges: dict[str, tuple[int, int]]) -> Column:
    """Array of the names of all ranges that hold t, in the order given."""
    names = F.array(*[F.when((t >= a) & (t < b), F.lit(k)) for k, (a, b) in ranges.items()])
    return F.filter(names, lambda x: x.isNotNull())


def day_split(days: DataFrame, train: float, valid: float, last: int | None = None) -> DataFrame:
    """(day, split): whole days in order, training and validation by whole parts of their number, the rest test.

    With last, only the last so many training days stay. A row per day, so one ordered
    partition is small.
    """
    n = F.count("*").over(Window.partitionBy())
    k = F.row_number().over(Window.orderBy("day"))
    d = days.select("day").distinct().withColumn("k", k).withColumn("n", n)
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * train) + F.floor(F.col("n") * valid)
    d = d.withColumn("split", F.when(F.col("k") <= a, "train").when(F.col("k") <= b, "valid").otherwise("test"))
    if last is not None:
        d = d.where((F.col("split") != "train") | (F.col("k") > a - last))
    return d.select("day", "split")


def with_step_features(windows: DataFrame, features: DataFrame, names: list[str], past: int) -> DataFrame:
    """Windows (node, t, past ...) with an array column per feature over the same past steps; features (t, names) hold for all nodes.

    The features' windows are made once per step, not per node, and joined late.
    """
    w = Window.orderBy("t").rowsBetween(1 - past, 0)  # a row per step
    f = features.select("t", *[F.collect_list(F.struct(n)).over(w)[n].alias(n) for n in names])
    return windows.join(f.where(F.size(names[0]) == past), "t")


def day_samples(panel: DataFrame, per_day: int, window: int, horizon: int) -> DataFrame:
    """(node, day, start, past, future): windows and horizons that do not cross days."""
    p = panel.select("node", F.floor(F.col("t") / per_day).alias("day"), F.pmod("t", F.lit(per_day)).alias("start"), "value")
    w = Window.partitionBy("node", "day").orderBy("start")
    a, b = F.collect_list(F.struct("value")).over(w.rowsBetween(0, window - 1)), F.collect_list(F.struct("value")).over(w.rowsBetween(window, window + horizon - 1))
    s = p.select("node", "day", "start", a["value"].alias("past"), b["value"].alias("future"))
    return s.where((F.size("past") == window) & (F.size("future") == horizon))


@dataclass(frozen=True)
class WindowSpec:
    """A named range of steps [start, stop); weekday restricts it (Monday 0)."""

    name: str
    start: int
    stop: int
    weekday: int | None = None


def window_specs(steps: int, per_day: int, train: float, month_days: int = 30, first_weekday: int = 0) -> list[WindowSpec]:
    """Ranges to look at: the training prefix, whole months, and each week by weekday."""
    out = [WindowSpec("train_prefix", 0, int(steps * train))]
    month = month_days * per_day
    out += [WindowSpec(f"month_{k}", k * month, min(steps, (k + 1) * month)) for k in range(-(-steps // month))]
    for day in range(steps // per_day):
        out.append(WindowSpec(f"week_{day // 7}_day_{(first_weekday + day) % 7}", day * per_day, (day + 1) * per_day, (first_weekday + day) % 7))
    return out


def in_windows(panel: DataFrame, specs: list[WindowSpec]) -> DataFrame:
    """panel once for each range that holds the step, with the range's name and weekday; specs are a short list."""
    cells = F.array(*[F.when((F.col("t") >= s.start) & (F.col("t") < s.stop), F.struct(F.lit(s.name).alias("window"), F.lit(s.weekday).cast("int").alias("weekday"))) for s in specs])
    return panel.withColumn("__w", F.explode(F.filter(cells, lambda x: x.isNotNull()))).select(*panel.columns, "__w.window", "__w.weekday")


def node_bins(nodes: DataFrame, bins: int) -> DataFrame:
    """(node, bin): nodes in order, dealt into bins of near-equal size, the first ones larger."""
    d = numbered(nodes.select("node").distinct(), [F.asc("node")], "k")
    n = d.count()
    big, rest = n // bins + 1, n % bins
    late = rest + F.floor((F.col("k") - rest * big) / max(big - 1, 1))
    return d.select("node", F.when(F.col("k") < rest * big, F.floor(F.col("k") / big)).otherwise(late).cast("int").alias("bin"))


def window_embeddings(windows: DataFrame, bins: DataFrame) -> DataFrame:
    """(t, v): of each window (node, t, past) the mean and deviation over nodes of every step, then the mean and deviation of every bin of nodes; every entry standardised over windows."""
    cells = windows.select("node", "t", F.posexplode("past").alias("step", "x")).join(F.broadcast(bins), "node")
    m = lambda: [F.coalesce(F.avg("x"), F.lit(0.0)).alias("m"), F.coalesce(F.stddev_pop("x"), F.lit(0.0)).alias("s")]
    a = cells.groupBy("t", F.col("step").alias("i")).agg(*m()).withColumn("kind", F.lit(0))
    b = cells.groupBy("t", F.col("bin").alias("i")).agg(*m()).withColumn("kind", F.lit(2))
    rows = a.unionByName(b).select("t", F.explode(F.array(F.struct("kind", "i", F.col("m").alias("x")), F.struct((F.col("kind") + 1).alias("kind"), F.col("i"), F.col("s").alias("x")))).alias("c")).select("t", "c.*")
    scale = rows.groupBy("kind", "i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev"))  # a row per entry
    z = rows.join(F.broadcast(scale), ["kind", "i"]).select("t", F.struct("kind", "i", (F.coalesce(F.try_divide(F.col("x") - F.col("mean"), F.when(F.col("dev") > 1e-12, F.col("dev"))), F.lit(0.0))).alias("z")).alias("c"))
    return z.groupBy("t").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["z"]).alias("v"))


def decoder_inputs(windows: DataFrame, start: int, horizon: int, marks: list[str], past: int) -> DataFrame:
    """Encoder-decoder inputs: time marks less 0.5, and a decoder start of the last `start` values followed by zeros.

    marks are array columns over past + horizon steps; enc_<mark> has the past ones, dec_<mark>
    the last `start` past ones and the horizon's.
    """
    shifted = {m: F.transform(m, lambda x: x - 0.5) for m in marks}
    out = windows.withColumn("dec", F.concat(F.slice("past", -start, start), F.array_repeat(F.lit(0.0), horizon)))
    for m in marks:
        out = out.withColumn(f"enc_{m}", F.slice(shifted[m], 1, past)).withColumn(f"dec_{m}", F.slice(shifted[m], past - start + 1, start + horizon))
    return out


def align_columns(wide: DataFrame, order: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Wide frame with its node columns in the order of a catalog (id, pos), and (id, status) of ids on one side only.

    Column names are schema, so the catalog's ids are read by the driver: a list of sensors.
    """
    ids = [r["id"] for r in order.orderBy("pos").select("id").collect()]
    have = [c for c in wide.columns if c != key]
    known = set(have)
    missing = [(i, "missing") for i in ids if i not in known] + [(c, "unlisted") for c in have if c not in set(ids)]
    return wide.select(key, *[F.col(f"`{i}`") for i in ids if i in known]), wide.sparkSession.createDataFrame(missing, "id string, status string")


def resolve_positions(samples: DataFrame, order: DataFrame) -> DataFrame:
    """(sample, node, pos) of sample nodes in a catalog's order (id, pos), by ids normalised to text without trailing .0; unknown nodes have a null pos."""
    norm = lambda c: F.regexp_replace(F.trim(F.col(c).cast("string")), r"\.0+$", "")
    o = order.select(norm("id").alias("__id"), "pos").dropDuplicates(["__id"])
    return samples.withColumn("__id", norm("node")).join(o, "__id", "left").select("sample", "node", "pos")
