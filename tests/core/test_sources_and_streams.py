import datetime as dt
import gzip
import json

import numpy as np
from pyspark.sql import functions as F

from sensorloom.sources import readers as S
from sensorloom.streaming import buckets as B


def test_detector_files(spark, tmp_path):
    rest = ",".join(["1"] * 40)
    lines = [f"01/02/2023 00:10:00,77,4,101,N,ML,0.5,10,100,12.5,0.1,60,{rest}", f"bad,77,4,101,N,ML,0.5,10,100,1,0.1,60,{rest}", f"01/02/2023 00:15:00,78,4,101,N,ML,x,10,100,oops,0.1,60,{rest}"]
    p = tmp_path / "d04_text_station_5min_2023_01_02.txt.gz"
    p.write_bytes(gzip.compress("\n".join(lines).encode()))
    got = {r.station: r for r in S.read_detectors(spark, str(p)).collect()}
    assert set(got) == {77, 78} and got[77].slot == 2 and got[77].total_flow == 12.5 and got[78].total_flow is None
    assert got[77].file_day == dt.date(2023, 1, 2) and got[77].lane8_observed == 1.0
    only = spark.createDataFrame([(78,)], "station long")
    assert S.read_detectors(spark, str(p), only).count() == 1


def test_metadata_repair(spark, tmp_path):
    p = tmp_path / "meta.txt"
    p.write_bytes("ID\tFwy\tName\n1\t5\tCaf\xe9\n2\t5\tA\tB\n3\t8\n4\t8\tX\t\t\n".encode("latin-1"))
    df = S.read_metadata(spark, str(p), ["ID", "Fwy", "Name"])
    assert {r.ID: r.Name for r in df.collect()} == {"1": "Caf\xe9", "2": "A\tB", "3": "", "4": "X"}
    assert S.canonical_columns(df).columns == ["station", "freeway", "name"]


def test_tensor_wide_and_distances(spark, tmp_path):
    cube = np.arange(24, dtype="<f4").reshape(4, 3, 2)
    cube[1, 1, 0] = np.nan
    cube.tofile(tmp_path / "data.dat")
    S.Descriptor("x", (4, 3, 2), 5, ("a", "b")).save(str(tmp_path / "desc.json"))
    got = {(r.t, r.node): (r.c0, r.c1) for r in S.read_tensor(spark, str(tmp_path / "data.dat"), S.Descriptor.load(str(tmp_path / "desc.json"))).collect()}
    assert len(got) == 12 and got[2, 1] == (14.0, 15.0) and got[1, 1] == (None, 9.0)
    wide = spark.createDataFrame([(1, 2.0, float("nan")), (2, 3.0, 4.0)], "ts int, a double, b double")
    long = S.wide_to_long(wide, "ts")
    assert {(r.ts, r.node): r.value for r in long.collect()}[1, "b"] is None
    assert [tuple(r) for r in S.long_to_wide(long, ["a", "b"]).orderBy("ts").collect()] == [(1, 2.0, None), (2, 3.0, 4.0)]
    (tmp_path / "dist.csv").write_text("from,to,cost\n1,2,3.5\nx,y\n2,3,1\n")
    assert sorted((r.src, r.dst, r.cost) for r in S.read_distances(spark, str(tmp_path / "dist.csv")).collect()) == [(1, 2, 3.5), (2, 1, 3.5), (2, 3, 1.0), (3, 2, 1.0)]


def test_roads_and_rows(spark, tmp_path):
    roads = {"roads": [{"id": "r1", "points": [{"x": 0, "y": 0}, {"x": 3, "y": 4}, {"x": 3, "y": 6}], "lanes": [{"width": 3, "maxSpeed": 10}, {"width": 3, "maxSpeed": 15}]}]}
    (tmp_path / "net.json").write_text(json.dumps(roads))
    assert tuple(S.read_roads(spark, str(tmp_path / "net.json")).first()) == ("r1", 7.0, 2, 54.0)
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "x int, z int")
    S.write_rows([a, b], str(tmp_path / "rows.csv"))
    assert sorted(spark.read.option("header", True).csv(str(tmp_path / "rows.csv")).columns) == ["x", "y", "z"]
    S.pulses(spark, 6, 3).write.parquet(str(tmp_path / "series"))
    assert S.load_series(spark, str(tmp_path / "series"), ["pulse"]).agg(F.sum("value")).first()[0] == 2.0


def drain(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_tumbling_stream_matches_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=7 * k), "ab"[k % 2], float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, road string, v double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    drain(B.tumbling(stream, "ts", "road", "v"), "complete", "buckets")
    key = lambda d: sorted((r.start, r.key, r.n, r.total) for r in d.collect())
    assert key(spark.table("buckets")) == key(B.tumbling(df, "ts", "road", "v"))


def test_occupancy_stream_matches_batch(spark, tmp_path):
    rows = [("l1", 1, [1, 2]), ("l1", 2, [2, 3]), ("l1", 3, []), ("l2", 1, [9]), ("l2", 2, [9, 8])]
    df = spark.createDataFrame(rows, "lane string, tick long, members array<long>")
    df.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ticks"))
    drain(B.occupancy_stream(stream), "append", "changes")
    got = sorted(tuple(r) for r in spark.table("changes").collect())
    assert got == sorted(tuple(r) for r in B.occupancy_changes(df).collect()) == [("l1", 1, 2, 0), ("l1", 2, 1, 1), ("l1", 3, 0, 2), ("l2", 1, 1, 0), ("l2", 2, 1, 0)]


def test_future_grid(spark):
    p = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "node string, t long, value double")
    assert sorted((r.t, r.value) for r in B.append_forecast_grid(p, 2).collect() if r.t > 1) == [(2, None), (3, None)]
