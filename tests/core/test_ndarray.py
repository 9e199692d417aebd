import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.sources import ndarray as A


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def want(a):
    return sorted((*(int(x) for x in at), float(v) if np.isfinite(v) else None) for at, v in np.ndenumerate(a))


@pytest.fixture()
def folder(tmp_path):
    a = np.arange(600, dtype="f4").reshape(60, 10)
    a[3, 4], a[5, 6] = np.nan, np.inf
    np.save(tmp_path / "targets.npy", a)
    np.save(tmp_path / "turned.npy", np.asfortranarray(a))
    np.save(tmp_path / "unix_timestamps.npy", np.arange(60) * 300)
    np.save(tmp_path / "node_ids.npy", np.arange(10) * 11 + 100)
    np.savez(tmp_path / "plain.npz", other=np.zeros(3), targets=a, unix_timestamps=np.arange(60) * 300)
    np.savez_compressed(tmp_path / "packed.npz", targets=a, unix_timestamps=np.arange(60) * 300)
    a.reshape(5, 12, 10).tofile(tmp_path / "raw.dat")
    return tmp_path, a


def test_every_layout_gives_the_same_cells(spark, folder):
    p, a = folder
    for name, more in (("targets.npy", {}), ("turned.npy", {}), ("plain.npz", {"member": "targets"}), ("packed.npz", {"member": "targets"})):
        df = A.read_ndarray(spark, f"{p}/{name}", ["t", "node"], split_bytes=200, **more)
        assert rows(df) == want(a), name
        assert (df.rdd.getNumPartitions() > 1) == (name != "packed.npz")
    raw = A.read_ndarray(spark, f"{p}/raw.dat", ["sample", "horizon", "node"], shape="-1,12,10", split_bytes=480)
    assert rows(raw) == want(a.reshape(5, 12, 10)) and raw.rdd.getNumPartitions() == 5


def test_filters_are_pushed(spark, folder):
    p, a = folder
    full = want(a)
    for name in ("targets.npy", "turned.npy", "packed.npz"):
        df = A.read_ndarray(spark, f"{p}/{name}", ["t", "node"], split_bytes=200, gap_bytes=4, member="targets" if name.endswith("npz") else None)
        got = df.where("t >= 7 and t < 20 and node in (2, 3, 9) and value > 0")
        assert rows(got) == [r for r in full if 7 <= r[0] < 20 and r[1] in (2, 3, 9) and r[2] is not None and r[2] > 0]
        assert rows(df.where("t = 59")) == [r for r in full if r[0] == 59] and df.where("t > 59 or t < 0").count() == 0 and df.where("t = 77").count() == 0
    df = A.read_ndarray(spark, f"{p}/targets.npy", ["t", "node"], split_bytes=200)
    assert df.rdd.getNumPartitions() == 12 and df.where("t between 20 and 24").rdd.getNumPartitions() == 1


def test_a_node_filter_reads_fewer_bytes(folder):
    p, a = folder
    lay = A.layout_of(f"{p}/targets.npy", ["t", "node"])
    with A.open_file(lay.path) as f:
        block, few = A.read_rows(f, lay, 2, 30, np.array([1, 8]), 8)
        same, all_ = A.read_rows(f, lay, 2, 30, np.array([1, 8]), 1000)
        whole, most = A.read_rows(f, lay, 2, 30, np.arange(10), 8)
    assert np.array_equal(block, a[2:30, [1, 8]]) and np.array_equal(same, block) and np.array_equal(whole, a[2:30], equal_nan=True)
    assert few == 28 * 2 * 4 and all_ == 28 * 8 * 4 and most == 28 * 10 * 4


def test_series_with_times_and_ids(spark, folder):
    p, a = folder
    df = A.read_series_folder(spark, str(p)).where("node = 144").select("t", F.unix_timestamp("ts").alias("at"), "value")
    assert rows(df) == [(t, t * 300, None if not np.isfinite(a[t, 4]) else float(a[t, 4])) for t in range(60)]
    for name in ("plain.npz", "packed.npz"):
        z = A.read_series_archive(spark, f"{p}/{name}", split_bytes=400).where("node = 4").select("t", F.unix_timestamp("ts").alias("at"), "value")
        assert rows(z) == rows(df)


def test_more_than_two_gigabytes_in_many_tasks(spark, tmp_path):
    """A sparse file of 3.2 GB: more than one task, and a slice of it is read without the rest."""
    path = tmp_path / "big.npy"
    shape = (400_000, 2000)
    with open(path, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": shape})
        start = f.tell()
        f.truncate(start + shape[0] * shape[1] * 4)
        f.seek(start + (399_999 * 2000 + 1999) * 4)
        f.write(np.float32(7).tobytes())
    df = A.read_ndarray(spark, str(path), ["t", "node"])
    assert df.rdd.getNumPartitions() >= 40
    assert rows(df.where("t >= 399998 and node in (0, 1999)")) == [(399_998, 0, 0.0), (399_998, 1999, 0.0), (399_999, 0, 0.0), (399_999, 1999, 7.0)]


def test_blocks_written_by_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(53, 7)).astype("f4")
    panel = spark.createDataFrame([(t, n, float(a[t, n])) for t in range(53) for n in range(7) if (t, n) != (9, 3)], "t long, node long, value double").repartition(4)
    out = f"{tmp_path}/blocks/"
    m = A.write_ndarray_blocks(panel, out, 7, block_rows=10).collect()
    assert sorted((r["first"], r["rows"]) for r in m) == [(0, 10), (10, 10), (20, 10), (30, 10), (40, 10), (50, 3)]
    a[9, 3] = np.nan
    df = A.read_ndarray(spark, out, ["t", "node"], split_bytes=140)
    assert rows(df) == want(a) and df.rdd.getNumPartitions() == 11 and df.where("t between 20 and 24").rdd.getNumPartitions() == 1
    assert rows(df.where("t in (19, 51) and node = 2")) == [(19, 2, float(a[19, 2])), (51, 2, float(a[51, 2]))]
    with pytest.raises(Exception, match="no blocks"):
        A.read_ndarray(spark, f"{tmp_path}/", ["t", "node"]).count()


def test_refusals(tmp_path):
    np.save(tmp_path / "o.npy", np.array([{}, 1], dtype=object), allow_pickle=True)
    with pytest.raises(ValueError):
        A.layout_of(f"{tmp_path}/o.npy", ["i"])
    (tmp_path / "r.dat").write_bytes(b"12345")
    with pytest.raises(ValueError):
        A.layout_of(f"{tmp_path}/r.dat", ["a", "b"], shape="-1,2")
