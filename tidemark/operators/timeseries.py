"""Operators over time-keyed frames: the newest-row rule, and helpers for those who work without the engine."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIME = "time"


def newest_per_time(df: DataFrame, *recency: Column | str) -> DataFrame:
    """Of rows with one time, the one that comes last by recency (columns, the most telling first)."""
    w = Window.partitionBy(TIME).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in recency])
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def between(df: DataFrame, start, stop) -> DataFrame:
    """Rows with start <= time < stop; either may be None. A plain filter, so it reaches the Parquet scan."""
    if start is not None:
        df = df.filter(F.col(TIME) >= F.lit(start))
    return df if stop is None else df.filter(F.col(TIME) < F.lit(stop))


def is_sorted_by_time(batch: pa.Table | pa.RecordBatch) -> bool:
    t = pa.Table.from_batches([batch])[TIME] if isinstance(batch, pa.RecordBatch) else batch[TIME]
    return len(t) < 2 or not pc.any(pc.less(t.combine_chunks()[1:], t.combine_chunks()[:-1])).as_py()


def sort_by_time(batch: pa.Table) -> pa.Table:
    """Stable: rows of one time keep their order, so the later one still wins."""
    order = pc.sort_indices(pa.table({"t": batch[TIME], "i": pa.array(range(len(batch)))}), [("t", "ascending"), ("i", "ascending")])
    return batch.take(order)


def ensure_sorted_by_time(batch: pa.Table) -> pa.Table:
    return batch if is_sorted_by_time(batch) else sort_by_time(batch)
