import json

import numpy as np
from pyspark.sql import functions as F

from sensorloom.sources import arrays as A


def test_archives(spark, tmp_path):
    adj = np.array([[0, 1.5, 0], [0, 0, np.nan], [2, 0, 0]])
    np.savez(tmp_path / "g.npz", adj=adj)
    ids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos long, id string")
    assert sorted(map(tuple, A.read_adjacency(spark, str(tmp_path / "g.npz"), ids=ids).collect())) == [("a", "b", 1.5), ("c", "a", 2.0)]
    np.savez_compressed(tmp_path / "s.npz", train=[0, 1, 2], valid=[3], test=[4, 5])
    assert sorted(map(tuple, A.read_split(spark, str(tmp_path / "s.npz")).collect())) == [(0, "train"), (1, "train"), (2, "train"), (3, "valid"), (4, "test"), (5, "test")]
    np.savez(tmp_path / "u.npz", unix_timestamps=np.array([0, 300]), targets=np.array([[1, np.inf, 3], [4, 5, np.nan]]))
    got = A.read_archive_series(spark, str(tmp_path / "u.npz"), [1, 2]).selectExpr("unix_seconds(ts) AS s", "node", "value").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(0, 1, None), (0, 2, 3.0), (300, 1, 5.0), (300, 2, None)], key=str)
    heads = {r["name"]: (r["dtype"], r["shape"]) for r in A.archive_headers(spark, str(tmp_path / "u.npz")).collect()}
    assert heads == {"unix_timestamps": ("int64", [2]), "targets": ("float64", [2, 3])}
    assert {r["item"] for r in A.inspect(spark, str(tmp_path / "g.npz")).collect()} == {"adj"}


def test_predictions(spark, tmp_path):
    p = np.arange(24, dtype="<f4").reshape(4, 3, 2, 1)
    p[1, 1, 1] = np.nan
    p.tofile(tmp_path / "p.dat")
    np.save(tmp_path / "p.npy", p)
    np.savez(tmp_path / "p.npz", prediction=p)
    got = [sorted(map(tuple, A.read_predictions(spark, str(tmp_path / f"p.{k}"), 3, 2).collect()), key=str) for k in ("dat", "npy", "npz")]
    assert got[0] == got[1] == got[2] and len(got[0]) == 24 and (1, 2, 1, None) in got[0] and (3, 3, 1, 23.0) in got[0]
    a = A.read_predictions(spark, str(tmp_path / "p.npy"), 3, 2)
    assert A.prediction_facts(a, a.where("sample < 3")).where("target is null").count() == 7


def test_labels_and_classified_series(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"graphs": [{"nodes": [1, 2, 3], "edges": [[1, 2], [2, 3]]}, {"nodes": [7], "edges": []}]}))
    e, n = A.read_label_graphs(spark, str(tmp_path / "l.json"))
    assert sorted(map(tuple, e.collect())) == [(0, 1, 2), (0, 2, 3)] and n.count() == 4
    assert A.read_label_graphs(spark, str(tmp_path / "l.json"), 1)[1].count() == 1
    (tmp_path / "x.ts").write_text("# a comment\n@problemName x\n@data\n1,2,?,4:5,5:up\n\n1,?:3,4,5,6,7,8:down\n")
    rows = {(r.sample, r.channel): r for r in A.read_classified_series(spark, str(tmp_path / "x.ts"), 4).collect()}
    assert {k: r.label for k, r in rows.items()} == {(0, 0): 1, (0, 1): 1, (2, 0): 0, (2, 1): 0}
    z = np.array([1, 2, 3, 4.0])
    assert np.allclose(rows[0, 0]["values"], (z - z.mean()) / z.std()) and np.allclose(rows[2, 1]["values"], (z - z.mean()) / z.std())
    assert np.allclose(rows[2, 0]["values"], [1, 1, -1, -1])


def test_sinks(spark, tmp_path):
    d = str(tmp_path)
    facts = spark.range(12).selectExpr("id AS sample", "cast(id % 3 + 1 as int) AS horizon", "id % 2 AS node", "id * 1.0 AS pred", "id * 2.0 AS target")
    A.write_results(facts, f"{d}/r")
    A.write_results(facts, f"{d}/r", append=True)
    assert spark.read.parquet(f"{d}/r").where("horizon = 2").count() == 8
    A.write_split(spark.createDataFrame([(0, "train"), (1, "test")], "t long, split string"), f"{d}/s")
    assert spark.read.parquet(f"{d}/s").where("split = 'test'").first().t == 1
    A.write_adjacency(spark.createDataFrame([(1, 2, 0.0), (2, 1, 3.0)], "src long, dst long, weight double"), f"{d}/a", spark.createDataFrame([(0, 1), (1, 2)], "pos long, id long"))
    assert spark.read.parquet(f"{d}/a/edges").count() == 1 and spark.read.parquet(f"{d}/a/ids").count() == 2
    A.write_tensor(facts, f"{d}/t", {"name": "x", "shape": [1, 2, 3]})
    assert json.loads(spark.read.text(f"{d}/t/desc").first()[0])["shape"] == [1, 2, 3]
    f = spark.createDataFrame([("2020-01-01 00:05:00", "b", 2.0), ("2020-01-01 00:05:00", "a", 1.0), ("2020-01-01 00:00:00", "a", 0.0)], "ts string, node string, value double").withColumn("ts", F.to_timestamp("ts"))
    A.write_forecast_csv(f, f"{d}/f", ["a", "b"])
    assert sorted(r[0] for r in spark.read.text(f"{d}/f").collect()) == ["2020-01-01 00:00:00,0.0,", "2020-01-01 00:05:00,1.0,2.0"]
    scores = spark.createDataFrame([("m", 0.5)], "method string, auroc double")
    A.write_runs(f"{d}/runs", {"m": (scores, facts, 1.5), "k": (scores, facts, 2.0)}, {"lags": 3})
    assert json.loads(spark.read.text(f"{d}/runs/k/config").first()[0]) == {"lags": 3, "method": "k"}
    assert {r["method"]: r["seconds"] for r in spark.read.option("header", True).csv(f"{d}/runs/runtimes").collect()}["overall"] == "3.5"
    for k in range(3):
        spark.range(k + 1).write.parquet(f"{d}/p{k}")
    A.merge_shards(spark, [f"{d}/p{k}" for k in range(3)], f"{d}/all")
    assert spark.read.parquet(f"{d}/all").groupBy("shard").count().count() == 3
