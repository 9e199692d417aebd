"""Array files and run folders: NumPy archives, splits, label graphs, predictions, classification series; their sinks.

Files are read as binary rows by Spark's own reader and unpacked in the tasks, one file a
row, so any store that Spark reaches will do. Pickles are never opened: adjacency and label
graphs come as arrays or JSON. Sinks write Parquet, CSV or JSON through Spark's writers.
"""

from __future__ import annotations

import io
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "length", "content")


def _arrays(body: bytes, name: str) -> dict:
    import numpy as np

    got = np.load(io.BytesIO(body), allow_pickle=False)
    return {k: got[k] for k in got.files} if hasattr(got, "files") else {name: got}


def read_matrix(spark: SparkSession, paths: str | list[str], key: str = "arr_0") -> DataFrame:
    """(path, i, j, value) of the two-dimensional array `key` of .npz files, or of .npy files; zeros and non-finite cells are left out."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for path, body in zip(pdf["path"], pdf["content"]):
                m = np.asarray(_arrays(body, key)[key], dtype=float)
                i, j = np.nonzero(np.isfinite(m) & (m != 0))
                yield pd.DataFrame({"path": path, "i": i, "j": j, "value": m[i, j]})

    return _files(spark, paths).select("path", "content").mapInPandas(run, "path string, i long, j long, value double")


def read_adjacency(spark: SparkSession, path: str, key: str = "adj", ids: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight) of an adjacency array; ids (pos, id) names its rows and columns."""
    e = read_matrix(spark, path, key).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("value").alias("weight"))
    if ids is None:
        return e
    a, b = ids.select(F.col("pos").alias("src"), F.col("id").alias("__a")), ids.select(F.col("pos").alias("dst"), F.col("id").alias("__b"))
    return e.join(a, "src").join(b, "dst").select(F.col("__a").alias("src"), F.col("__b").alias("dst"), "weight")


def read_split(spark: SparkSession, path: str, names: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """(t, split) of an archive that holds a vector of steps under each name."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for body in pdf["content"]:
                got = _arrays(body, names[0])
                yield pd.concat([pd.DataFrame({"t": np.asarray(got[n], dtype=np.int64), "split": n}) for n in names if n in got])

    return _files(spark, path).select("content").mapInPandas(run, "t long, split string")


def read_archive_series(spark: SparkSession, path: str, nodes: list[int] | None = None, values: str = "targets", times: str = "unix_timestamps") -> DataFrame:
    """(ts, node, value) of an archive of unix times [T] and values [T, N]; only the nodes asked for are unpacked; NaN and infinities become null."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for body in pdf["content"]:
                got = _arrays(body, values)
                v, at = got[values], np.asarray(got[times], dtype=np.int64)
                cols = np.arange(v.shape[1]) if nodes is None else np.asarray(nodes)
                x = np.asarray(v[:, cols], dtype=float)
                yield pd.DataFrame({"at": np.repeat(at, len(cols)), "node": np.tile(cols, len(at)), "value": x.reshape(-1)})

    raw = _files(spark, path).select("content").mapInPandas(run, "at long, node long, value double")
    ok = ~F.isnan("value") & (F.abs("value") < float("inf"))
    return raw.select(F.timestamp_seconds("at").alias("ts"), "node", F.when(ok, F.col("value")).alias("value"))


def read_label_graphs(spark: SparkSession, path: str, only: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((sample, src, dst), (sample, node)) of a JSON list of graphs with nodes and edges; only restricts to one sample."""
    schema = "nodes array<long>, edges array<array<long>>"
    g = spark.read.option("multiLine", True).schema(f"graphs array<struct<{schema.replace(' array', ':array', 2)}>>").json(path).select(F.posexplode("graphs").alias("sample", "g"))
    if only is not None:
        g = g.where(F.col("sample") == only)
    e = g.select("sample", F.explode("g.edges").alias("e")).select("sample", F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"))
    return e, g.select("sample", F.explode("g.nodes").alias("node"))


def read_predictions(spark: SparkSession, path: str, horizon: int, nodes: int, key: str = "prediction") -> DataFrame:
    """(sample, horizon, node, value) of an [S, H, N, 1] array: .npz and .npy by their headers, any other file as raw little-endian float32 whose sample count follows from its size."""

    def unpack(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for name, body in zip(pdf["path"], pdf["content"]):
                a = _arrays(body, key)[key] if name.endswith((".npz", ".npy")) else np.frombuffer(body, "<f4")
                a = np.asarray(a, dtype=float).reshape(-1, horizon, nodes)
                s, h, n = (x.reshape(-1) for x in np.indices(a.shape))
                yield pd.DataFrame({"sample": s, "horizon": h + 1, "node": n, "value": a.reshape(-1)})

    if path.endswith((".npz", ".npy")):
        raw = _files(spark, path).select("path", "content").mapInPandas(unpack, "sample long, horizon int, node long, value double")
    else:  # raw files are split over tasks, a record for each sample
        size = horizon * nodes * 4
        rows = spark.createDataFrame(spark.sparkContext.binaryRecords(path, size).zipWithIndex().map(lambda r: (r[1], bytearray(r[0]))), "sample long, body binary")

        def records(frames):
            import numpy as np
            import pandas as pd

            for pdf in frames:
                for sample, body in zip(pdf["sample"], pdf["body"]):
                    a = np.frombuffer(body, "<f4").astype(float)
                    yield pd.DataFrame({"sample": sample, "horizon": np.repeat(np.arange(1, horizon + 1), nodes), "node": np.tile(np.arange(nodes), horizon), "value": a})

        raw = rows.mapInPandas(records, "sample long, horizon int, node long, value double")
    return raw.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value")))


def prediction_facts(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """(sample, horizon, node, pred, target) of two such tables; rows of either side alone keep a null."""
    p = predictions.withColumnRenamed("value", "pred")
    return p.join(targets.withColumnRenamed("value", "target"), ["sample", "horizon", "node"], "full")


def archive_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, dtype, shape) of the members of .npz and .npy files, from their headers alone."""

    def run(frames):
        import zipfile

        import numpy as np
        import pandas as pd

        def header(f):
            version = np.lib.format.read_magic(f)
            shape, _, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
            return str(kind), list(shape)

        for pdf in frames:
            for path, body in zip(pdf["path"], pdf["content"]):
                rows = []
                if zipfile.is_zipfile(io.BytesIO(body)):
                    with zipfile.ZipFile(io.BytesIO(body)) as z:
                        for m in z.namelist():
                            with z.open(m) as f:
                                rows.append((path, m.removesuffix(".npy"), *header(f)))
                else:
                    rows.append((path, None, *header(io.BytesIO(body))))
                yield pd.DataFrame(rows, columns=["path", "name", "dtype", "shape"])

    return _files(spark, paths).select("path", "content").mapInPandas(run, "path string, name string, dtype string, shape array<long>")


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(item, kind, detail) of a file: columns and row count of Parquet, array headers of archives, lines and size of text."""
    if path.endswith((".npz", ".npy")):
        return archive_headers(spark, path).select(F.coalesce("name", F.lit("array")).alias("item"), F.col("dtype").alias("kind"), F.concat_ws("x", F.transform("shape", lambda x: x.cast("string"))).alias("detail"))
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return spark.createDataFrame([(n, k, "") for n, k in df.dtypes], "item string, kind string, detail string").unionByName(df.agg(F.count("*").alias("n")).select(F.lit("rows").alias("item"), F.lit("count").alias("kind"), F.col("n").cast("string").alias("detail")))
    t = spark.read.text(path)
    return t.agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("c"), F.first("value").alias("f")).select(F.inline(F.array(
        F.struct(F.lit("lines").alias("item"), F.lit("count").alias("kind"), F.col("n").cast("string").alias("detail")), F.struct(F.lit("characters").alias("item"), F.lit("count").alias("kind"), F.col("c").cast("string").alias("detail")),
        F.struct(F.lit("first").alias("item"), F.lit("line").alias("kind"), F.col("f").alias("detail")),
    )))


def read_classified_series(spark: SparkSession, path: str, length: int) -> DataFrame:
    """(sample, channel, label, values) of a text file of labelled series: after @data, a line per sample, channels parted by colons, the class last.

    Classes get dense numbers from 0 in their order; gaps (?) are filled linearly and held at
    the ends; series are cut or filled with zeros to `length` and standardised.
    """
    lines = spark.sparkContext.textFile(path).zipWithIndex()
    t = spark.createDataFrame(lines.map(lambda r: (r[1], r[0])), "n long, line string")
    start = t.where(F.lower(F.trim("line")) == "@data").agg(F.min("n").alias("s"))
    body = t.crossJoin(F.broadcast(start)).where((F.col("n") > F.col("s")) & (F.length(F.trim("line")) > 0) & ~F.col("line").startswith("#"))
    parts = body.select((F.col("n") - F.col("s") - 1).alias("sample"), F.split("line", ":").alias("p"))
    names = parts.select(F.element_at("p", -1).alias("name")).distinct()
    codes = names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("label"))  # a row per class
    c = parts.select("sample", F.element_at("p", -1).alias("name"), F.posexplode(F.slice("p", F.lit(1), F.size("p") - 1)).alias("channel", "text")).join(F.broadcast(codes), "name")

    def fill(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            out = []
            for text in pdf["text"]:
                v = np.array([np.nan if x.strip() in ("?", "NaN", "") else float(x) for x in text.split(",")])
                known = np.isfinite(v)
                at = np.arange(len(v))
                v = np.interp(at, at[known], v[known]) if known.any() else np.zeros(len(v))
                v = np.concatenate([v[:length], np.zeros(max(0, length - len(v)))])
                dev = v.std()
                out.append(((v - v.mean()) / (dev if dev > 1e-12 else 1.0)).tolist())
            yield pd.DataFrame({"sample": pdf["sample"], "channel": pdf["channel"], "label": pdf["label"], "values": out})

    return c.select("sample", "channel", "label", "text").mapInPandas(fill, "sample long, channel int, label int, values array<double>")


def merge_shards(spark: SparkSession, paths: list[str], out: str) -> None:
    """Parquet shards as one table, rows of all, columns by name, with the shard's place in the list."""
    parts = [spark.read.parquet(p).withColumn("shard", F.lit(k)) for k, p in enumerate(paths)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    whole.write.mode("overwrite").parquet(out)


def _write_text(spark: SparkSession, path: str, body: str) -> None:
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_tensor(panel: DataFrame, path: str, descriptor: dict) -> None:
    """A long series as Parquet with its description as JSON beside it, through Spark's writers."""
    panel.write.mode("overwrite").parquet(f"{path}/data")
    _write_text(panel.sparkSession, f"{path}/desc", json.dumps(descriptor, sort_keys=True))


def write_split(split: DataFrame, path: str) -> None:
    split.select("t", "split").write.mode("overwrite").partitionBy("split").parquet(path)


def write_adjacency(edges: DataFrame, path: str, ids: DataFrame) -> None:
    """Edge list and the order of ids (pos, id): what an adjacency triple holds."""
    edges.select("src", "dst", "weight").where("weight <> 0").write.mode("overwrite").parquet(f"{path}/edges")
    ids.select("pos", "id").write.mode("overwrite").parquet(f"{path}/ids")


def write_results(facts: DataFrame, path: str, append: bool = False) -> None:
    """Test facts (sample, horizon, node, pred, target), one folder a horizon; batches append."""
    facts.write.mode("append" if append else "overwrite").partitionBy("horizon").parquet(path)


def write_forecast_csv(forecast: DataFrame, path: str, nodes: list[str]) -> None:
    """Headerless CSV of timestamp and one value per node, in the order given."""
    wide = forecast.groupBy("ts").pivot("node", nodes).agg(F.first("value")).orderBy("ts")
    wide.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *[F.col(f"`{n}`") for n in nodes]).write.mode("overwrite").csv(path)


def write_run(path: str, scores: DataFrame, predictions: DataFrame, seconds: float, config: dict) -> None:
    """A causal run: scoring and runtime as CSV, predictions as Parquet, the configuration as JSON."""
    spark = scores.sparkSession
    scores.write.mode("overwrite").option("header", True).csv(f"{path}/scoring")
    spark.createDataFrame([(float(seconds),)], "seconds double").write.mode("overwrite").option("header", True).csv(f"{path}/runtime")
    predictions.write.mode("overwrite").parquet(f"{path}/preds")
    _write_text(spark, f"{path}/config", json.dumps(config, sort_keys=True))


def write_runs(path: str, runs: dict[str, tuple[DataFrame, DataFrame, float]], config: dict) -> None:
    """Runs of several methods, name -> (scores, predictions, seconds), each in its folder, and the seconds of all."""
    for name, (scores, predictions, seconds) in runs.items():
        write_run(f"{path}/{name}", scores, predictions, seconds, config | {"method": name})
    spark = next(iter(runs.values()))[0].sparkSession
    rows = [(n, float(s)) for n, (_, _, s) in runs.items()]
    spark.createDataFrame([*rows, ("overall", sum(s for _, s in rows))], "method string, seconds double").write.mode("overwrite").option("header", True).csv(f"{path}/runtimes")
