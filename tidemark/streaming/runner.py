"""Streams of table changes, run by Structured Streaming.

A stream watches the files of its table as a file stream; hybrid ones watch the
files of unflushed writes too. What a micro-batch has met says up to which LSN
it goes. Its rows are those past the stream's LSN and up to that one: of the
table's files as the manifest has them (a listing may have met an LSN's files
halfway, missed what a flush moved, or met files that a compaction replaced),
and, of hybrid streams, of the unflushed writes that it has met. They go to the
sink in order, and the stream's LSN moves on. The checkpoint is the record of
what was met, the batch id makes commits repeatable, and the LSN keeps a row
from leaving twice when a flush or a compaction brings it again in another file.

A commit that fails is tried again, after a growing wait, until it succeeds or
the stream is dropped or its engine closed. Only a stream whose connector is
not there, or whose options its sink refuses, fails for good.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import FatalSinkError, StreamError
from ..functions.literals import Reader
from ..sources.store import LSN, ORD, Store
from ..sources.types import unquote
from .options import StreamDef, define, parse
from .sinks import classified, make_sink

FIRST_WAIT, LONGEST_WAIT = 0.1, 30.0


class Running:
    def __init__(self, definition: StreamDef) -> None:
        self.d = definition
        self.query: StreamingQuery | None = None
        self.phase, self.error, self.tries = "inactive", "", 0
        self.stopping, self.opened_ms = threading.Event(), 0


class Streams:
    def __init__(self, spark: SparkSession, store: Store) -> None:
        self.spark, self.store = spark, store
        self.running: dict[str, Running] = {}
        self.lock = threading.RLock()

    # ---- DDL --------------------------------------------------------------

    def create(self, sql: str) -> None:
        d, if_not_exists = parse(sql)
        with self.lock:
            if d.name in self.store.streams:
                if if_not_exists:
                    return
                raise StreamError(f"stream already exists: {d.name}")
            table = self.store.table(d.table)
            d.table = table.name
            # The history goes out first: what is buffered now is flushed, so that it is among the files.
            self.store.flush(table.name)
            self.store.streams[d.name] = {"table": d.table, "given": d.given, "acked_lsn": 0, "done": False}
            self.store.save()
            try:
                self._start(d)
            except Exception:
                self.store.streams.pop(d.name, None)
                self.store.save()
                raise

    def drop(self, name: str) -> None:
        with self.lock:
            if name not in self.store.streams:
                raise StreamError(f"stream not found: {name}")
            run = self.running.pop(name, None)
            if run and run.query:
                run.stopping.set()
                run.query.stop()
            del self.store.streams[name]
            self.store.save()
            path = f"{self.store.root}/_streams/{name}"
            if self.store._exists(path):
                self.store.fs.delete_dir(path)

    def resume(self) -> None:
        """Streams of the catalog go on where their checkpoints are."""
        for name, s in list(self.store.streams.items()):
            d = define(name, s["given"])
            d.table = s["table"]
            if s.get("done"):
                self.running[name] = run = Running(d)
                run.phase = "completed"
            else:
                self._start(d)

    def stop_all(self) -> None:
        for run in self.running.values():
            run.stopping.set()
            if run.query:
                run.query.stop()

    # ---- running ----------------------------------------------------------

    def _start(self, d: StreamDef) -> None:
        table = self.store.table(d.table)
        sink, run = make_sink(d), Running(d)
        schema = table.stored
        def read(folder: str, live: bool) -> DataFrame:
            source = self.spark.readStream.schema(schema).option("ignoreMissingFiles", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", self.store.config.stream_files)
            return source.parquet(f"{self.store.uri}/{table.name}/{folder}").withColumn("__live", F.lit(live))

        changes = read("data", False)
        if d.mode == "hybrid" and sink.live:
            changes = changes.union(read("wal", True))
            run.opened_ms = int(time.time() * 1000)
        names = [c.name for c in table.columns]

        def commit(batch: DataFrame, batch_id: int) -> None:
            state = self.store.streams.get(d.name)
            if state is None:
                return
            acked, held = state["acked_lsn"], f"{self.store.uri}/_streams/{d.name}/batch"
            # A load or flush that is under way holds the lock: after it, the manifest has all of its files, and none goes while they are read.
            with table.lock:
                top = batch.filter(F.col(LSN) > acked).agg(F.max(LSN)).first()[0]
                if top is None:
                    return
                past = (F.col(LSN) > acked) & (F.col(LSN) <= top)
                fresh = batch.filter(past & F.col("__live")).drop("__live")
                files = [f for f in table.files if f.lsn_max > acked and f.lsn_min <= top]
                if files:
                    fresh = fresh.union(self.store.read_files(table, files).select(*fresh.columns).filter(past))
                fresh.dropDuplicates([LSN, ORD]).write.mode("overwrite").parquet(f"{held}/sent")
            rows = self.spark.read.schema(schema).parquet(f"{held}/sent").orderBy(LSN, ORD).select(*names)
            wait, run.tries = FIRST_WAIT, 0
            while True:
                try:
                    sink.commit(rows, batch_id)
                    break
                except Exception as e:
                    error = classified(e)
                    run.error, run.tries = str(error), run.tries + 1
                    if isinstance(error, FatalSinkError):
                        run.phase = "failed"
                        raise error from e
                    if run.stopping.wait(wait):
                        raise error from e
                    wait = min(LONGEST_WAIT, wait * 2)
            run.error = ""
            with self.store.lock:
                state["acked_lsn"] = max(state["acked_lsn"], top)
                self.store.save()
            self.store.collect(table)

        out = changes.writeStream.foreachBatch(commit).option("checkpointLocation", f"{self.store.uri}/_streams/{d.name}/checkpoint").queryName(f"tidemark-{d.name}")
        run.phase = "syncingbatch"
        run.query = (out.trigger(availableNow=True) if d.auto_end else out.trigger(processingTime="1 second")).start()
        self.running[d.name] = run

    def wait(self, name: str, seconds: float = 60) -> None:
        """Until all that is written so far has left, or the stream has ended or failed."""
        run = self.running[name]
        if run.d.auto_end:
            run.query.awaitTermination(seconds)
        else:
            try:
                run.query.processAllAvailable()
            except Exception:
                if run.phase != "failed":
                    raise
        self.phase(name)

    def phase(self, name: str) -> str:
        run = self.running.get(name)
        if not run:
            return "inactive"
        if run.phase != "failed" and run.query:
            if run.query.exception():
                run.phase, run.error = "failed", run.error or str(run.query.exception())[:300]
            elif not run.query.isActive:
                run.phase = "completed" if run.d.auto_end else "suspended"
                if run.phase == "completed" and not self.store.streams[name].get("done"):
                    self.store.streams[name]["done"] = True
                    self.store.save()
            elif not run.query.status["isTriggerActive"] and run.query.lastProgress:
                run.phase = "active"
        return run.phase

    # ---- SHOW -------------------------------------------------------------

    def _named(self, name: str) -> StreamDef:
        if name not in self.store.streams:
            raise StreamError(f"stream not found: {name}")
        return self.running[name].d

    def show(self, kind: str, t: list[str]) -> DataFrame:
        if kind == "SHOW STREAMS":
            rows = [(n, r.d.sink, r.d.mode, r.d.table) for n, r in sorted(self.running.items())]
            return self.spark.createDataFrame(rows, "stream_name string, connector_type string, cdc_mode string, source_tables string")
        r = Reader(t)
        r.take("SHOW")
        r.take("STREAM")
        if kind == "SHOW STREAM":
            d = self._named(unquote(r.take()))
            return self.spark.createDataFrame([(d.name, d.statement(), d.plan())], "stream_name string, create_statement string, stream_plan string")
        r.take("STATUS")
        r.take("FOR")
        d = self._named(unquote(r.take()))
        state, run = self.store.streams[d.name], self.running[d.name]
        phase = self.phase(d.name)
        files = self.store.table(d.table).files
        done = sum(f.lsn_max <= state["acked_lsn"] for f in files)
        step = {"syncingbatch": "syncing_batch", "active": "tailing_log", "completed": "completed", "failed": run.error or "failed", "suspended": "suspended"}.get(phase, "pending")
        if run.tries and run.error and phase != "failed":
            phase, step = "restarting", run.error
        row = (d.name, phase, step, d.mode, str(d.auto_end).lower(), done, len(files), state["acked_lsn"], run.opened_ms)
        return self.spark.createDataFrame([row], "stream_name string, phase string, current_step string, cdc_mode string, auto_end string, batch_files_done long, batch_files_total long, acked_lsn long, log_channel_opened_ms long")
