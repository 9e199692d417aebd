import numpy as np

from sensorloom.sources.sample_stream import stream_samples


def test_no_sample_twice_over_a_restart(spark, tmp_path):
    """Two blocks, then a restart of the same query, then a third block: every window once."""
    a = np.arange(90, dtype="f4").reshape(30, 3)
    a[4, 1] = np.nan
    (tmp_path / "in").mkdir()

    def run():
        q = stream_samples(spark, f"{tmp_path}/in/", 4, 2, 5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return {(r.sample, r.node): (r.past, r.future) for r in spark.read.parquet(str(tmp_path / "out")).collect()}, spark.read.parquet(str(tmp_path / "out")).count()

    for n in range(2):
        np.save(tmp_path / "in" / f"block-{n}.npy", a[10 * n : 10 * n + 10])
    got, rows = run()
    assert rows == len(got) == 15 * 3
    assert run()[1] == rows
    np.save(tmp_path / "in" / "block-2.npy", a[20:])
    got, rows = run()
    assert rows == len(got) == 25 * 3
    clean = lambda x: [None if np.isnan(v) else float(v) for v in x]
    assert got == {(s, n): (clean(a[s : s + 4, n]), clean(a[s + 4 : s + 6, n])) for s in range(25) for n in range(3)}
