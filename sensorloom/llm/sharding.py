"""Shards that each hold the mixture of the whole, by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; a row's place is its rank as a
share of the source, so that a source's rows lie evenly over [0, 1). All rows sorted by
that share and cut into equal runs are the shards: each holds its part of each source (of n
of N rows and S sources, to within 1 + n (S + 1) / N), and the numbers of rows differ by one at most.

Hashes and shares are spread evenly, so buckets of them have known sizes: ranks come from
counts by bucket and windows inside buckets, and no task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored


def seeded_hash(seed: int, *parts: Column) -> Column:
    """52 bits of an MD5 of the seed and the parts, so that its share of 2**52 is an exact double."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def starts(counts: DataFrame, by: list[str], bucket: str, n: str) -> DataFrame:
    """counts (by, bucket, n) with `start`, the sum of n of the lower buckets of the same key.

    Sums go over blocks of 1024 buckets, then over the blocks' totals.
    """
    before = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = counts.withColumn("blk", F.shiftright(bucket, 10))
    inner = c.withColumn("ins", before(Window.partitionBy(*by, "blk").orderBy(bucket)))
    outer = c.groupBy(*by, "blk").agg(F.sum(n).alias(n)).withColumn("pre", before(Window.partitionBy(*by).orderBy("blk"))).drop(n)
    return inner.join(outer, [*by, "blk"]).withColumn("start", F.col("pre") + F.col("ins")).drop("blk", "pre", "ins")


def interleave(rows: DataFrame, stratum: str, shards: int, seed: int = 12, bucket_rows: int = 1 << 16) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (gapless from 0 in a shard).

    Rows that agree in all columns are one entry with a number while ranks are counted, so
    however often a row is repeated it makes no hot group; they take consecutive ranks.
    Rows of a null stratum are a stratum of their own. All columns take part in the shuffle's
    hash, so pass only those that tell rows apart (an id and a digest of the text).
    """
    columns = rows.columns
    total = rows.count()
    bits = max(min(8, total.bit_length()), (total // bucket_rows).bit_length())
    key = F.when(F.col(stratum).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(stratum).cast("string")))
    (k, h, hb, times, n, rank, share, fb, place, part) = fresh(rows, "key", "hash", "hash_bucket", "times", "n", "rank", "share", "share_bucket", "place", "part")
    once = rows.withColumn(k, key).withColumn(h, seeded_hash(seed, *[F.col(c) for c in columns if c != stratum]))
    once = once.groupBy(k, h, *columns).agg(F.count("*").alias(times)).withColumn(hb, F.shiftrightunsigned(h, 52 - bits))

    counts = once.groupBy(k, hb).agg(F.sum(times).alias(n))
    offsets = starts(counts, [k], hb, n).drop(n).join(counts.groupBy(k).agg(F.sum(n).alias(n)), k)
    local = Window.partitionBy(k, hb).orderBy(h, *columns).rowsBetween(Window.unboundedPreceding, -1)
    ranked = once.withColumn(rank, F.coalesce(F.sum(times).over(local), F.lit(0))).join(offsets, [k, hb])
    # A repeated row is dealt out in runs of at most 4096 places.
    runs = F.when(F.col(times) == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(4096).cast("long")))
    ranked = ranked.withColumn(part, F.explode(runs))
    places = F.sequence(F.col(part), F.least(F.col(part) + 4096, F.col(times)) - 1)
    ranked = ranked.withColumn(part, F.explode(places)).withColumn(rank, F.col("start") + F.col(rank) + F.col(part))

    # Each source starts at an offset of its own, or all sources of one row would meet in the middle.
    shift = seeded_hash(seed, F.lit("source"), F.col(k)) / F.lit(float(1 << 52))
    shared = ranked.withColumn(share, (F.col(rank) + shift) / F.col(n)).withColumn(fb, F.least(F.floor(F.col(share) * (1 << bits)), F.lit((1 << bits) - 1)).cast("long"))
    shared = stored(shared.select(*columns, k, h, rank, share, fb))
    offsets = starts(shared.groupBy(fb).agg(F.count("*").alias(n)), [], fb, n).select(fb, "start")
    local = Window.partitionBy(fb).orderBy(share, k, rank)
    placed = shared.withColumn(place, F.row_number().over(local) - 1).join(offsets, fb).withColumn(place, F.col("start") + F.col(place))
    shard = F.expr(f"({place} * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col(place) - first).select(*columns, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 12, stratum: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, source, shard and slot of every document.

    size is the UTF-8 bytes of the text plus 8, text_crc32 the CRC-32 of those bytes; a null
    text is empty. The law that holds is `rows`: shards' counts differ by one at most.
    Groups of equal texts may lie in several shards, as equal counts ask for. Rows of null
    ids or null sources are dealt like others; repeated rows stand once each, in slots of
    their own; rows of one id and text are in no order among themselves. An empty table gives
    no rows. Other columns are not read.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("source"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    return interleave(stored(rows), "source", shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int = 24, file_rows: int = 1 << 20, seed: int = 12, stratum: str = "source", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents to `path`/shard=N, in runs of file_rows slots that each are one file, ordered by slot.

    Rows of one id and text are numbered to meet their slots; columns named shard or slot give way.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    d, c, s, i, o = fresh(docs, "d", "c", "s", "i", "o")
    keyed = docs.withColumn(d, F.col(id_col).cast("long")).withColumn(c, F.crc32(body)).withColumn(s, F.octet_length(body) + 8).withColumn(o, F.col(stratum).cast("string"))
    keyed = keyed.withColumn(i, F.row_number().over(Window.partitionBy(d, c, s, o).orderBy(F.lit(0)))).drop("shard", "slot")
    plan = shard_documents(docs, shards, seed, stratum, id_col, text_col)
    plan = plan.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "text_crc32", "size", "source").orderBy("shard", "slot")))
    a, b = keyed.alias("a"), plan.alias("b")
    on = F.col(f"a.{d}").eqNullSafe(F.col("b.doc_id")) & (F.col(f"a.{c}") == F.col("b.text_crc32")) & (F.col(f"a.{s}") == F.col("b.size")) & F.col(f"a.{o}").eqNullSafe(F.col("b.source")) & (F.col(f"a.{i}") == F.col("b.n"))
    kept = [x for x in docs.columns if x.lower() not in ("shard", "slot")]
    out = a.join(b, on).select(*[F.col(f"a.{x}") for x in kept], F.col("b.shard").alias("shard"), F.col("b.slot").alias("slot"))
    out.repartition("shard", F.floor(F.col("slot") / file_rows)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def interleave_sql(shards: int = 24, seed: int = 12) -> str:
    """The same shards as DuckDB SQL over `documents`, CRC-32 included."""
    h = lambda *parts: f"CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 13)) AS BIGINT)"
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH RECURSIVE crc(i, c, k) AS (SELECT i, CAST(i AS BIGINT), 0 FROM range(256) t(i) UNION ALL SELECT i, {step}, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, source, encode(coalesce(text, '')) AS body FROM documents),
e AS (SELECT rid, doc_id, source, CAST(octet_length(body) + 8 AS BIGINT) AS size,
 xor(list_reduce(list_transform(regexp_extract_all(hex(body), '..'), lambda x: CAST(('0x' || x) AS BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
 FROM d, tab),
r AS (SELECT *, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key, {h("coalesce(CAST(doc_id AS VARCHAR), '')", "CAST(size AS VARCHAR)", "CAST(text_crc32 AS VARCHAR)")} AS h FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY h, doc_id NULLS FIRST, size, text_crc32, rid) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n, {h("'source'", "key")} / 4503599627370496.0::DOUBLE AS shift FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY (rank + shift) / n, key, rank) - 1 AS place, count(*) OVER () AS total FROM k),
s AS (SELECT *, CAST((place * {shards}) // total AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(place - (CAST(shard AS BIGINT) * total + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""
