"""Sources and sinks: detector files, metadata snapshots, wide frames, tensors and edge lists."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The detector file's base columns and the five measures of each of its eight lanes.
DETECTOR_BASE = ("ts", "station", "district", "freeway", "direction", "lane_type", "station_length", "samples", "pct_observed", "total_flow", "avg_occupancy", "avg_speed")
DETECTOR_LANE = ("samples", "flow", "avg_occ", "avg_speed", "observed")

#: Header names that metadata files use, by canonical name.
ALIASES = {
    "station": ("id", "station", "station_id", "sensor_id"), "freeway": ("fwy", "freeway"), "direction": ("dir", "direction"), "district": ("district", "dist"), "lat": ("latitude", "lat"),
    "lon": ("longitude", "lng", "lon"), "abs_pm": ("abs_pm", "abs_postmile"), "type": ("type", "station_type"), "lanes": ("lanes", "lane"), "name": ("name",),
}


@dataclass(frozen=True)
class Descriptor:
    """Shape and meaning of a series cube."""

    name: str
    shape: tuple[int, int, int]
    minutes: int
    features: tuple[str, ...]

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=1)

    @staticmethod
    def load(path: str) -> Descriptor:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        return Descriptor(d["name"], tuple(d["shape"]), d["minutes"], tuple(d["features"]))


def detector_columns(lanes: int = 8) -> list[str]:
    return [*DETECTOR_BASE, *(f"lane{k}_{m}" for k in range(1, lanes + 1) for m in DETECTOR_LANE)]


def read_detectors(spark: SparkSession, paths: str | list[str], stations: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """Headerless 5-minute detector files (gzip too): typed, bad values null, rows without a time dropped.

    All fields are read as text and cast leniently, so one bad field does not lose its row.
    stations(station) keeps only its ids; metadata is joined left on station. slot is the
    5-minute step of the day; day comes from the file's name where it has a date.
    """
    cols = detector_columns()
    raw = spark.read.csv(paths, schema=", ".join(f"{c} string" for c in cols))
    ids = {"station", "district"}
    text = {"freeway", "direction", "lane_type"}
    typed = raw.select(
        F.try_to_timestamp("ts", F.lit("MM/dd/yyyy HH:mm:ss")).cast("timestamp_ntz").alias("ts"),
        *[(F.trim(c) if c in text else F.expr(f"try_cast({c} as {'bigint' if c in ids else 'double'})")).alias(c) for c in cols[1:]],
        F.regexp_extract(F.input_file_name(), r"(\d{4}_\d{2}_\d{2})", 1).alias("__d"),
    )
    day = F.expr("try_cast(replace(__d, '_', '-') as date)")
    out = typed.where("ts is not null and station is not null").withColumn("file_day", day).drop("__d").withColumn("slot", F.floor((F.hour("ts") * 60 + F.minute("ts")) / 5).cast("int"))
    if stations is not None:
        out = out.join(stations.select("station").distinct(), "station", "left_semi")
    return out if metadata is None else out.join(metadata, "station", "left")


def read_metadata(spark: SparkSession, path: str, columns: list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Tab-separated snapshot with a header; rows of the wrong length are repaired.

    Extra fields are joined into the last column, short rows are padded with empty text.
    """
    n = len(columns)
    # The text source reads UTF-8 only; a CSV of one column with a separator that no file has knows encodings.
    raw = spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").schema("value string").csv(path)
    f = raw.select(F.split("value", "\t", -1).alias("f")).where(F.col("f")[0] != columns[0])
    tail = F.regexp_replace(F.array_join(F.slice("f", F.lit(n), F.greatest(F.size("f") - n + 1, F.lit(1))), "\t"), r"\s+$", "")
    fixed = F.when(F.size("f") > n, F.concat(F.slice("f", 1, n - 1), F.array(tail))).otherwise(F.concat("f", F.array_repeat(F.lit(""), F.greatest(F.lit(n) - F.size("f"), F.lit(0)))))
    return f.withColumn("f", fixed).select(*[F.col("f")[k].alias(c) for k, c in enumerate(columns)])


def canonical_columns(df: DataFrame) -> DataFrame:
    """Known header names renamed to their canonical ones; the first match of a name wins."""
    known = {a: c for c, names in ALIASES.items() for a in names}
    renamed, used = {}, set()
    for c in df.columns:
        to = known.get(c.strip().lower().replace(" ", "_"))
        if to and to not in used:
            renamed[c] = to
            used.add(to)
    return df.withColumnsRenamed(renamed)


def wide_to_long(df: DataFrame, ts: str) -> DataFrame:
    """(ts, node, value) of a frame with one column per node; NaN and infinities become null."""
    nodes = [c for c in df.columns if c != ts]
    long = df.select(F.col(ts).alias("ts"), *[F.col(c).cast("double").alias(c) for c in nodes]).unpivot("ts", nodes, "node", "value")
    return long.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") < math.inf), F.col("value")))


def long_to_wide(panel: DataFrame, nodes: list[str]) -> DataFrame:
    return panel.groupBy("ts").pivot("node", nodes).agg(F.first("value"))


def read_distances(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Symmetric edges of a from,to,cost file; malformed rows are dropped, ids (id, idx) renumber."""
    e = spark.read.option("header", True).option("mode", "DROPMALFORMED").csv(path, schema="src long, dst long, cost double").dropna()
    if ids is not None:
        a, b = ids.select(F.col("id").alias("src"), F.col("idx").alias("__a")), ids.select(F.col("id").alias("dst"), F.col("idx").alias("__b"))
        e = e.join(a, "src").join(b, "dst").select(F.col("__a").alias("src"), F.col("__b").alias("dst"), "cost")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")).dropDuplicates(["src", "dst"])


def read_tensor(spark: SparkSession, path: str, descriptor: Descriptor, nodes_per_row: int = 1) -> DataFrame:
    """(t, node, c0..) of a raw little-endian float32 [T, N, C] file.

    The file is read as fixed-length binary records, one per time step, by Spark's own
    reader, so it is split over tasks.
    """
    steps, nodes, channels = descriptor.shape
    size = nodes * channels * 4
    records = spark.sparkContext.binaryRecords(path, size).zipWithIndex()
    rows = spark.createDataFrame(records.map(lambda r: (r[1], bytearray(r[0]))), "t long, body binary")

    def unpack(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            cube = np.stack([np.frombuffer(b, "<f4").reshape(nodes, channels) for b in pdf["body"]]) if len(pdf) else np.zeros((0, nodes, channels), "f4")
            out = {"t": np.repeat(pdf["t"].to_numpy(), nodes), "node": np.tile(np.arange(nodes), len(pdf))}
            for c in range(channels):
                v = cube[:, :, c].reshape(-1).astype(float)
                out[f"c{c}"] = np.where(np.isfinite(v), v, np.nan)
            yield pd.DataFrame(out)

    schema = "t long, node long, " + ", ".join(f"c{c} double" for c in range(channels))
    raw = rows.mapInPandas(unpack, schema)
    return raw.select("t", "node", *[F.when(~F.isnan(f"c{c}"), F.col(f"c{c}")).alias(f"c{c}") for c in range(channels)])


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """(road, length, lanes, speed_limit) of a road network JSON; length is that of the road's points."""
    from sensorloom.operators.joins import polyline_length

    schema = "roads array<struct<id:string,points:array<struct<x:double,y:double>>,lanes:array<struct<width:double,maxSpeed:double>>>>"
    r = spark.read.option("multiLine", True).schema(schema).json(path).select(F.inline("roads"))
    return r.select(F.col("id").alias("road"), polyline_length(F.col("points")).alias("length"), F.size("lanes").alias("lanes"), (F.aggregate("lanes", F.lit(0.0), lambda s, x: F.greatest(s, x["maxSpeed"])) * 3.6).alias("speed_limit"))


def pulses(spark: SparkSession, steps: int, period: int, height: float = 1.0) -> DataFrame:
    """Deterministic test series: one pulse per period."""
    return spark.range(steps).select(F.lit("pulse").alias("node"), F.col("id").alias("t"), F.when(F.col("id") % period == 0, height).otherwise(0.0).alias("value"))


def write_rows(parts: list[DataFrame], path: str) -> None:
    """One CSV table of frames with different columns: the union of the columns is the header."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).csv(path)


READERS = {"parquet": lambda s, p: s.read.parquet(p), "csv": lambda s, p: s.read.option("header", True).csv(p), "json": lambda s, p: s.read.json(p)}


def load_series(spark: SparkSession, path: str, nodes: list | None = None, node: str = "node") -> DataFrame:
    """A long series by the path's suffix (a folder is Parquet), with the node filter pushed to the scan."""
    kind = path.rstrip("/").rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else "parquet"
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}")
    df = READERS[kind](spark, path)
    return df if nodes is None else df.where(F.col(node).isin(nodes))
