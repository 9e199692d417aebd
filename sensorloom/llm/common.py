"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only in local mode where the session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "sensorloom-checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def join_by_key(rows: DataFrame, one: DataFrame, key: str | list[str], total: int, times: str = "times", share: int = 1000) -> DataFrame:
    """rows joined with `one`, which has a row for each key and says how many rows the key has.

    Keys that hold more than one in `share` of all `total` rows are broadcast: there can be no
    more than `share` of them. The others are shuffled, so no hot key lands in one task.
    """
    hot = F.broadcast(one.where(F.col(times) * share > total))
    return rows.join(hot, key).unionByName(rows.join(hot.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(one, key)).drop(times)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared checkpoint folder and read it again.

    Unlike checkpoint() the copy is columnar and compressed, so later passes read only
    the columns they use.
    """
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """stored(df), and the folder it lies in."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/sensorloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of stored_at() that no later step reads: what was made of them is stored itself."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver collects its garbage.

    For steps whose results are stored or cut: a frame run again writes its shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def map_binary(df: DataFrame, id_col: str, text_col: str, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """mapInArrow over (id, UTF-8 bytes); a null text is empty, other columns are left unread."""
    narrow = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"),
    )
    return narrow.mapInArrow(fn, schema)


def smaller(batches: Iterator, limit: int = 1 << 20) -> Iterator:
    """The rows of batches in slices of about `limit` bytes (a row at least), so that what is made of texts beside their batch stays small."""
    for b in batches:
        rows = max(1, min(1024, b.num_rows * limit // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def compare_pairs(pairs: DataFrame, items: DataFrame, prepare: Callable, same: Callable) -> DataFrame:
    """Of pairs (grp, a, b) of items (node, body) those (src, dst) for which same(lefts, rights), lists of prepare(body), is true.

    Each body goes once to every group in which it has pairs, not once per pair. A task reads
    its groups one after the other: a group's bodies, then its pairs.
    """
    ends = pairs.select("grp", F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = ends.join(items, "node").select("grp", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "body")
    rows = rows.unionByName(pairs.select("grp", F.lit(1).alias("kind"), "a", "b", F.lit(b"").alias("body")))

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        group, held, waiting = None, {}, []

        def done():
            good = np.flatnonzero(same([w[2] for w in waiting], [w[3] for w in waiting]))
            ids = np.array([w[:2] for w in waiting], dtype=np.int64).reshape(-1, 2)[good]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1])], names=["src", "dst"])

        for batch in smaller(batches):
            for g, kind, a, b, body in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if g != group:
                    group, held = g, {}
                if kind:
                    waiting.append((a, b, held[a], held[b]))
                    if len(waiting) >= 4096:
                        yield done()
                else:
                    held[a] = prepare(body)
        if waiting:
            yield done()

    return rows.repartition("grp").sortWithinPartitions("grp", "kind").mapInArrow(compare, "src long, dst long")


def bitmap(hashes: DataFrame, column: str, most_bits: int = 27):
    """(bits, broadcast bitmap) of a column of distinct 64-bit hashes.

    It has about sixteen bits a hash, and never more than 2**most_bits bits in all. Bits are
    combined by aggregation and packed into blocks on the executors; the driver gets the
    packed blocks alone.
    """
    import numpy as np

    bits = min(most_bits, max(8, (16 * max(1, hashes.count())).bit_length()))
    pos = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = hashes.select(F.shiftright(pos, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), pos.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    merged = words.groupBy("w").agg(F.bit_or("b").alias("b")).withColumn("block", F.shiftright("w", 10))

    def packed(pdf):
        import pandas as pd

        block = np.zeros(1024, dtype=np.int64)
        block[pdf["w"].to_numpy() & 1023] = pdf["b"].to_numpy()
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "body": [block.tobytes()]})

    table = np.zeros(max(1024, 1 << (bits - 6)), dtype=np.uint64)
    for r in merged.groupBy("block").applyInPandas(packed, "block long, body binary").toLocalIterator():
        table[r["block"] * 1024 : r["block"] * 1024 + 1024] = np.frombuffer(r["body"], dtype=np.uint64)
    return bits, hashes.sparkSession.sparkContext.broadcast(table)


def inside(table, hashes, bits: int):
    """Which hashes (uint64) a bitmap may hold."""
    import numpy as np

    pos = hashes >> np.uint64(64 - bits)
    return (table[(pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap_hits(df: DataFrame, column: str, made) -> DataFrame:
    """Rows whose hash is in a bitmap: all that a join on it keeps, and false hits."""
    bits, table = made
    at = df.columns.index(column)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array(inside(table.value, b.column(at).to_numpy().view(np.uint64), bits)))

    return df.mapInArrow(run, df.schema)


def sample_texts(known: DataFrame, max_rows: int, long_text: int) -> DataFrame:
    """Of rows (i, t, l): at most max_rows ids of each label l, by a hash of the id, one text (of smallest hash) for each.

    A hash threshold from the approximate number of ids leaves about twice as many as are
    wanted, however many rows a label has, before ids are ranked. Texts of more than
    long_text characters come last. Texts are not part of the ranking; the ids picked are
    broadcast: max_rows for each label.
    """
    wanted = {r["l"]: (2.0 * max_rows + 64) / max(r["n"], 1) for r in known.groupBy("l").agg(F.approx_count_distinct("i").alias("n")).collect()}
    if not wanted:
        return known.limit(0)
    place = F.shiftrightunsigned(F.xxhash64("i"), 11) / F.lit(float(1 << 53))
    share = F.lit(2.0) if all(x >= 1 for x in wanted.values()) else F.element_at(F.create_map(*[F.lit(x) for kv in sorted(wanted.items()) for x in kv]), F.col("l"))
    body = F.struct((F.length("t") > long_text).alias("long"), F.xxhash64("t").alias("h"))
    some = known.where(place < share).groupBy("l", "i").agg(F.min(body).alias("b"))
    ranked = some.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("b.long", F.xxhash64("i"), "i"))).where(F.col("n") <= max_rows)
    picked = known.join(F.broadcast(ranked.select("l", "i", F.col("b.h").alias("h"))), ["l", "i"]).where(F.xxhash64("t") == F.col("h"))
    return picked.groupBy("l", "i").agg(F.min("t").alias("t")).select("i", "t", "l")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (src, dst) longs as (node, root): root is the smallest node reachable.

    Alternates two star contractions (every node's larger neighbours, then its smaller
    ones, are hooked to its smallest neighbour) until the edge set is a forest of stars;
    the number of rounds grows with the logarithm of the longest path. All steps are
    aggregates and joins on a node (adaptive execution splits the join of a hub), so no
    group is gathered in one task.
    """
    e = edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct()
    e = cut(e)

    def signature(d: DataFrame) -> tuple:
        r = d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    seen = signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("a"), "m").where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        now = signature(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
