import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import timeseries as ts


def test_order_of_batches():
    b = pa.table({"time": [3, 1, 1, 2], "v": [0, 1, 2, 3]})
    assert not ts.is_sorted_by_time(b)
    s = ts.ensure_sorted_by_time(b)
    assert s.to_pydict() == {"time": [1, 1, 2, 3], "v": [1, 2, 3, 0]} and ts.is_sorted_by_time(s)
    assert ts.ensure_sorted_by_time(s) is s and ts.is_sorted_by_time(b.slice(0, 0))


def test_newest_and_ranges(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 1, 30)], "time long, lsn long, v long")
    assert sorted(map(tuple, ts.newest_per_time(df, "lsn").collect())) == [(1, 2, 20), (2, 1, 30)]
    assert sorted(map(tuple, ts.newest_per_time(df, F.col("lsn"), F.col("v")).select("v").collect())) == [(20,), (30,)]
    assert ts.between(df, 2, None).count() == 1 and ts.between(df, None, 2).count() == 2 and ts.between(df, 1, 3).count() == 3
