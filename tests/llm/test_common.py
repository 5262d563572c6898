import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common


def test_samples_are_the_first_by_hash(spark):
    rows = [(i, "abc"[i % 7 % 3]) for i in range(9000)] + [(5, "a"), (5, "b"), (5, "a"), (20_000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, label string").withColumn("_n", F.lit(1))
    order = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("h")).distinct().collect()}
    for n in (1, 10, 700, 50_000):
        got = sorted(map(tuple, common.sample_ids(df, n).select("doc_id", "label").collect()))
        want = []
        for label in "abcd":
            mine = sorted({i for i, x in rows if x == label}, key=lambda i: (order[i], i))
            want += [(i, label) for i in mine[:n]]
        assert got == sorted(want)
    assert common.sample_ids(df.limit(0), 5).collect() == []


def test_scratch_tables_go(spark, tmp_path):
    with common.released(spark):
        s = common.Scratch(spark, "gone")
        a, b, c = (s.put(spark.range(n), "t") for n in (1, 2, 3))
        s.drop(a)
        s.keep(c)
        assert c.count() == 3 and len(s.paths) == 1
        with pytest.raises(Exception):
            b.count()
    with pytest.raises(Exception):
        spark.read.parquet(s.root + "/2-t").count()
    assert common.shared_dir(spark)


def shuffled(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for d in dirs for p in Path(d).rglob("shuffle_*")}


def test_written_tables_leave_no_shuffle_files(spark):
    before, was = shuffled(spark), spark.conf.get(common.CLEANUP)
    s = common.Scratch(spark, "shuffles")
    s.put(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(5), F.col("k") == F.col("id")))
    until = time.time() + 20
    while (left := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(common.CLEANUP) == was


def test_slices_make_the_whole(spark):
    s = common.Scratch(spark, "slices")
    rows = spark.range(1000).withColumn("k", F.col("id") % 37)
    got = s.put_sliced(rows, "k", lambda part: part.groupBy("k").agg(F.sum("id").alias("n")), 4)
    assert sorted(map(tuple, got.collect())) == [(k, sum(range(k, 1000, 37))) for k in range(37)]
    assert 1 < len(paths := s.paths[id(got)][1]) and all(0 < spark.read.parquet(p).count() < 37 for p in paths)
    s.drop(got)
    assert not s.paths and not any(Path(p.removeprefix("file://")).exists() for p in paths)


def test_among_keeps_all_of_the_ids_and_few_others(spark):
    rows = spark.range(-20_000, 20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    ids = rows.filter("doc_id % 7 = 3").select("doc_id")
    found = common.among(rows, ids)
    assert found.columns == rows.columns
    got, want = {r["doc_id"] for r in found.collect()}, {r["doc_id"] for r in ids.collect()}
    assert want <= got and len(got - want) < 200
    assert common.among(rows, ids.limit(0)).collect() == []
    # What goes through the driver does not grow with the ids.
    many = spark.range(1_000_000).select(F.col("id").alias("doc_id"))
    sizes = common.among(rows, many)._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in sizes and common.FILTER_BITS // 8 <= 4 << 20
