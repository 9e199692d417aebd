import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sensorloom.llm.sharding import interleave, shard_documents, write_shards

SCHEMA = "doc_id long, text string, source string, shard string, slot int, size string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "y") for i, t, s in rows], SCHEMA)


def check(rows, got, shards):
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), s) for i, t, s in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["source"]) for r in got) == want
    held = Counter(r["shard"] for r in got)
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, n) for s in sorted(held) for n in range(held[s])]
    if len(rows) >= shards:
        assert sorted(held) == list(range(shards)) and max(held.values()) - min(held.values()) <= 1


def test_laws_and_mixture(spark):
    rng = random.Random(5)
    sources = ["hot"] * 60 + ["a", "b", None, "c", "d", ""] * 4 + [f"rare{n}" for n in range(30)]
    rows = [(i, "".join(rng.choice("aé𝄞 ") for _ in range(rng.randrange(30))), rng.choice(sources)) for i in range(4000)]
    got = shard_documents(made(spark, rows), shards=24).collect()
    check(rows, got, 24)
    total, seen = Counter(s for _, _, s in rows), Counter((r["source"], r["shard"]) for r in got)
    # An interval of shares holds a source's part to within one row; an interval of N/24 rows is as long as 1/24 to within a row for each source.
    assert all(abs(seen[s, k] - total[s] / 24) <= 1 + total[s] * (len(total) + 1) / 4000 for s in total for k in range(24))


def test_any_buckets_give_the_same_shards(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(300)]), rng.choice(["", None, "x", "y"]), rng.choice(["p", "p", "q", None])) for _ in range(900)]
    df = made(spark, rows).select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t"))
    a = Counter(map(tuple, interleave(df, "source", 7, bucket_rows=1 << 16).collect()))
    assert a == Counter(map(tuple, interleave(df, "source", 7, bucket_rows=3).collect())) and sum(a.values()) == 900


def test_repeated_rows_nulls_long_texts_and_empty_tables(spark):
    rows = [(7, "same", "s")] * 9000 + [(None, None, None)] * 5 + [(1, "", "s"), (2, "long " * 300000, "t")]
    check(rows, shard_documents(made(spark, rows), shards=24).collect(), 24)
    check([], shard_documents(made(spark, []), shards=24).collect(), 24)
    check([(1, None, None)], shard_documents(made(spark, [(1, None, None)]), shards=24).collect(), 24)


def test_written_shards_hold_every_document_in_order(spark, tmp_path):
    rows = [(i // 2, f"text {i // 3}", f"s{i % 3}") for i in range(200)] + [(5, None, None), (None, "n", "s1")] + [(9, "z", "s0")] * 6
    write_shards(made(spark, rows), str(tmp_path / "out"), shards=4, file_rows=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in back.collect()) == Counter(rows)
    plan = Counter((r["doc_id"], r["size"], r["source"], r["shard"], r["slot"]) for r in shard_documents(made(spark, rows), shards=4).collect())
    assert Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, r["source"], r["shard"], r["slot"]) for r in back.collect()) == plan
