import datetime as dt
import random

from sensorloom.streaming import buckets as B
from sensorloom.streaming import states as S


def feed(spark, folder, frames, build, out, upto):
    """Files 0..upto-1 of a folder as micro-batches of a query with a checkpoint; results are appended to Parquet."""
    for n, rows in enumerate(frames[:upto]):
        if not (folder / f"b{n}").exists():
            rows.coalesce(1).write.parquet(str(folder / f"b{n}"))
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "b*"))
    q = build(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(folder / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(str(out))


def rounded(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_profiles_over_micro_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(1)
    schema = "node long, day int, profile array<double>"
    rows = [(n, d, [None if rng.random() < 0.1 else rng.random() + (k % 5) for k in range(12)]) for n in (1, 2) for d in range(19) if not (n == 2 and d in (4, 5, 11))]
    rows += [(3, 0, [1.0] * 12), (3, 1, [2.0, None]), (3, 7, [])]
    cut = [spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema) for lo, hi in ((0, 6), (6, 13), (13, 30))]
    late = spark.createDataFrame([(1, 3, [0.0] * 12), (1, 19, rows[0][2])], schema)
    frames = [*cut, late]
    feed(spark, tmp_path, frames, S.day_profile_stream, tmp_path / "out", 2)
    got = feed(spark, tmp_path, frames, S.day_profile_stream, tmp_path / "out", 4)  # a new query on the same checkpoint
    assert rounded(got.where("NOT late AND day < 19")) == rounded(S.day_profile_table(spark.createDataFrame(rows, schema)))
    assert [tuple(r) for r in got.where("late").collect()] == [(1, 3, None, None, None, True)]
    assert got.where("node = 1 AND day = 19").first().week_corr is not None


def ticks(seed):
    rng, t0, rows = random.Random(seed), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), []
    for lane, road, km in (("a0", "a", 0.4), ("a1", "a", 0.4), ("b0", "b", 0.0)):
        held: set = set()
        for k in range(60):
            held = {v for v in held if rng.random() < 0.7} | {f"v{rng.randrange(30)}" for _ in range(rng.randrange(3))}
            members = sorted(held)
            rows.append((t0 + dt.timedelta(seconds=5 * k), road, lane, km, members, [None if rng.random() < 0.1 else rng.uniform(-1, 20) for _ in members]))
    return rows


TICKS = "ts timestamp, road string, lane string, lane_km double, members array<string>, speeds array<double>"


def test_buckets_are_flushed_by_timers_over_a_restart(spark, tmp_path):
    rows = ticks(2)
    start = rows[0][0]
    part = lambda lo, hi: [r for r in rows if lo <= (r[0] - start).total_seconds() < hi]
    end = [(start + dt.timedelta(hours=h), "z", "z0", 1.0, [], []) for h in (1, 2)]
    frames = [spark.createDataFrame(x, TICKS) for x in (part(0, 70), part(70, 175), part(175, 1000), end[:1], end[1:])]
    build = lambda s: S.road_buckets_stream(s, 60, 5.0, "10 seconds")
    feed(spark, tmp_path, frames, build, tmp_path / "out", 2)
    got = feed(spark, tmp_path, frames, build, tmp_path / "out", 5)
    want = S.road_buckets_table(spark.createDataFrame(rows, TICKS), 60, 5.0)
    assert rounded(got.where("road <> 'z'")) == rounded(want) and want.count() == 10


def test_running_meters_merge_over_a_restart(spark, tmp_path):
    rng = random.Random(3)
    facts = [(k % 4, rng.random(), None if k % 9 == 0 else rng.random()) for k in range(200)]
    frames = [spark.createDataFrame(facts[a : a + 50], "horizon int, pred double, target double") for a in range(0, 200, 50)]
    seen = {}

    def build(upto):
        for n, f in enumerate(frames[:upto]):
            if not (tmp_path / f"b{n}").exists():
                f.coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
        s = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b*"))
        q = B.running_metrics(s, ["horizon"]).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: seen.update({r.horizon: tuple(r) for r in df.collect()})).trigger(availableNow=True).start()
        q.awaitTermination(120)

    build(2)
    build(4)
    whole = spark.createDataFrame(facts, "horizon int, pred double, target double")
    want = {r.horizon: tuple(r) for r in B.running_metrics(whole, ["horizon"]).collect()}
    assert seen.keys() == want.keys() and all(abs(x - y) < 1e-9 for h in want for x, y in zip(seen[h], want[h]))
