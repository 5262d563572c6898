"""Scans: which files a table read touches, and where the newest-row rule needs work.

Files carry their range of times. Pruning by time is safe below the rule,
because time is the key. Files (and the buffer) whose ranges overlap no other
hold each time once, so they are read as they are: no exchange, no sort. Only
what overlaps goes through the window; with ingest in order of time nothing does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.store import HIDDEN, DataFile, Store, Table, newest, raw_times
from ..sources.types import TIME

Bounds = tuple[int | None, int | None]


@dataclass(frozen=True)
class Layout:
    """How a read is made up: files read as they are, files to be merged, and the buffer's part in it."""

    plain: list[DataFile]
    merged: list[DataFile]
    buffer: str  # "", "plain" or "merged"


def overlapping(spans: list[tuple[int, int]]) -> list[bool]:
    """Whether each span meets another, by one sweep in order of start."""
    out = [False] * len(spans)
    order = sorted(range(len(spans)), key=lambda i: spans[i])
    reach, holder = None, -1
    for i in order:
        lo, hi = spans[i]
        if reach is not None and lo <= reach:
            out[i] = out[holder] = True
        if reach is None or hi > reach:
            reach, holder = hi, i
    return out


def layout(files: list[DataFile], buffer: tuple[int, int] | None, bounds: Bounds = (None, None), elide: bool = True) -> Layout:
    lo, hi = bounds
    kept = [f for f in files if (lo is None or f.max_time >= lo) and (hi is None or f.min_time <= hi)]
    spans = [(f.min_time, f.max_time) for f in kept] + ([buffer] if buffer else [])
    meets = overlapping(spans) if elide else [True] * len(spans)
    plain = [f for f, m in zip(kept, meets) if not m]
    merged = [f for f, m in zip(kept, meets) if m]
    return Layout(plain, merged, "" if not buffer else "merged" if meets[-1] else "plain")


def scan(store: Store, table: Table, bounds: Bounds = (None, None), elide: bool = True, hidden: bool = False) -> DataFrame:
    """The visible rows of a table. elide=False sends all through the window, to compare."""
    with table.lock:
        files, data = list(table.files), store.buffered(table)
    span = None
    if data is not None:
        t = raw_times(data[TIME])
        span = (t[0].as_py(), t[-1].as_py())
    plan = layout(files, span, bounds, elide)
    spark, names = store.spark, [c.name for c in table.columns] + ([f.name for f in HIDDEN] if hidden else [])
    parts = [store.read_files(table, plan.plain)] if plan.plain else []
    merged = [store.read_files(table, plan.merged)] if plan.merged else []
    if plan.buffer:
        (merged if plan.buffer == "merged" else parts).append(spark.createDataFrame(data, table.stored))
    if merged:
        parts.append(newest(merged[0] if len(merged) == 1 else merged[0].unionByName(merged[1])))
    if not parts:
        return spark.createDataFrame([], table.stored).select(*names)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*names)
