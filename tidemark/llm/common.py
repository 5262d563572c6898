"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators of every operator here: space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
#: Ranges of hashes whose sizes tell where a sample ends.
PARTS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n: the folds of the label contracts."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is named, a local master gets one made; a cluster has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Spark deletes the shuffle files of a query at its end, not when the driver's collector happens to come by.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def unshuffled(spark: SparkSession):
    """Queries that run inside leave no shuffle files behind."""
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    ``put`` writes a frame and returns it as read back: what was shuffled for
    it is gone then; ``drop`` deletes one
    that no later plan reads. What a returned frame still reads has to stay
    until that frame is written: ``released`` deletes it then.
    """

    #: Folders of the scratches that each open ``released`` block has seen, innermost last.
    _blocks: ClassVar[list[list[str]]] = []

    def __init__(self, spark: SparkSession, owner: str, grows: bool = False) -> None:
        """grows: the tables grow with the input, so that none is broadcast for its file's size, which is a fraction of what it is in memory."""
        self.spark, self.grows = spark, grows
        self.root = f"{shared_dir(spark)}/{owner}-{uuid.uuid4().hex}"
        # The frames are held, so that none takes the id of another.
        self.paths: dict[int, tuple[DataFrame, list[str]]] = {}
        self.count = 0
        if self._blocks:
            self._blocks[-1].append(self.root)

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{self.count}-{name}"
        self.count += 1
        with unshuffled(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out = out.hint("merge") if self.grows else out
        self.paths[id(out)] = out, [path]
        return out

    def put_sliced(self, rows: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], n: int, name: str = "t") -> DataFrame:
        """step(rows), for a step that rows of different keys do not share: n parts of the keys one after another, so that a part of the rows is on disk at once."""
        part = F.pmod(F.xxhash64(key), F.lit(n))
        parts = [self.put(step(rows.filter(part == i)), f"{name}-{i}") for i in range(n)]
        out = reduce(DataFrame.union, parts)
        self.paths[id(out)] = out, [path for x in parts for path in self.paths.pop(id(x))[1]]
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            for path in self.paths.pop(id(df), (None, []))[1]:
                _delete(self.spark, path)


    def keep(self, *frames: DataFrame) -> None:
        """Drops all tables but these."""
        self.drop(*[df for df, _ in list(self.paths.values()) if all(df is not x for x in frames)])


@contextlib.contextmanager
def released(spark: SparkSession):
    """Deletes, at its end, the scratch tables of operators that were called inside: their results have to be written by then."""
    Scratch._blocks.append([])
    try:
        yield
    finally:
        for root in Scratch._blocks.pop():
            _delete(spark, root)


#: Bits of the filter of ``among``: 2 MB at most go through the driver.
FILTER_BITS = 1 << 24
_MAP = 1 << 15


def among(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is one of ids(key), and some others: a bitmap of hashes tells, whose size does not grow with the ids."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bit = F.pmod(at, F.lit(_MAP)).cast("int")
    maps = ids.select(F.floor(at / _MAP).alias("_map"), bit.cast("long").alias("_bit")).groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    found = rows.withColumns({"_map": F.floor(at / _MAP), "_bit": bit}).join(F.broadcast(maps), "_map")
    byte = F.conv(F.hex(F.expr("substring(_bits, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    return found.filter(F.call_function("shiftright", byte, F.col("_bit") % 8).bitwiseAND(1) == 1).select(*rows.columns)


def tidied(run: Callable) -> Callable:
    """A function over Arrow batches that hands memory back when its task ends: workers wait for the next task, and those of one stage for another's."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def sample_ids(rows: DataFrame, per_class: int, key: str = "doc_id", by: str = "label", seed: int = 7) -> DataFrame:
    """Up to per_class ids of each class, those first in the order of a hash.

    A class is first cut to the ids whose hashes lie below a bound. By the
    class's count, about twice per_class ids do, and fewer than per_class with
    a chance under 1e-20. Counts over PARTS ranges below the bound then tell
    the range in which the last id lies, and only that one is ranked: no
    class, and not even its sample, meets in a task.
    """
    ids = rows.select(key, by).distinct().withColumn("_h", F.xxhash64(key, F.lit(seed)))
    most = 2 * per_class + 400
    counts = ids.groupBy(by).agg(F.count("*").alias("_n")).withColumnRenamed(by, "_by")
    place = (F.col("_h").cast("double") / float(1 << 64) + 0.5) * F.col("_n") / most
    near = ids.join(counts, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_place", place).filter("_place <= 1")
    near = Scratch(rows.sparkSession, "sample").put(near.select(key, by, "_h", F.floor(F.col("_place") * PARTS).alias("_part")), "near")
    sizes = near.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_by").orderBy("_p")) - F.col("_c")
    sizes = sizes.withColumn("_room", per_class - before).filter("_room > 0")
    near = near.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    whole = near.filter("_c <= _room").select(key, by)
    rank = F.row_number().over(Window.partitionBy(by, "_part").orderBy("_h", key))
    return whole.union(near.filter("_c > _room").withColumn("_rn", rank).filter("_rn <= _room").select(key, by))
