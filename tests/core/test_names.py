import datetime as dt

from pyspark.sql import functions as F

from sensorloom.operators import names as N


def test_fields(spark):
    rows = [(" mainline ", "7.0", "5N to 805 SB", "a/d04_2023_01_02.gz"), ("OffRamp", " 07", "CONN", "x"), (None, "x", "94-E", None), ("off ramp ", None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = df.select(N.sensor_type(F.col("a")).alias("a"), N.canonical_id(F.col("b")).alias("b"), N.routes(F.col("c")).alias("c"), N.file_date(F.col("d")).alias("d")).collect()
    assert [r.a for r in got] == ["ML", "FR", "", "OFF RAMP"] and [r.b for r in got] == [7, 7, None, None]
    assert [[tuple(x) for x in r.c] for r in got[:3]] == [[(5, "N"), (805, "S")], [], [(94, "E")]]
    assert [r.d for r in got[:3]] == [dt.date(2023, 1, 2), None, None]
