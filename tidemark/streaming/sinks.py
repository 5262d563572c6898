"""Sinks of streams. ``commit`` takes one micro-batch and is safe to repeat with the same batch id."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FatalSinkError, StreamError, TransientSinkError
from .options import StreamDef, boolean

#: Words of an error that say that another try cannot help.
FATAL_WORDS = ("permission", "denied", "unauthorized", "authentication", "not available", "does not exist", "invalid", "unsupported", "schema")


def classified(e: Exception) -> StreamError:
    if isinstance(e, StreamError):
        return e
    text = str(e).lower()
    return (FatalSinkError if any(w in text for w in FATAL_WORDS) else TransientSinkError)(str(e)[:500])


class Sink:
    #: Whether rows of unflushed writes are taken; file sinks take files only.
    live = False

    def __init__(self, definition: StreamDef) -> None:
        self.d, self.o = definition, definition.options

    def commit(self, df: DataFrame, batch_id: int) -> None:
        raise NotImplementedError


class NoopSink(Sink):
    live = True

    def commit(self, df: DataFrame, batch_id: int) -> None:
        df.write.format("noop").mode("overwrite").save()


class ParquetFolder(Sink):
    """Writes a batch beside the folder, then moves its files in under names that carry the batch id."""

    def folder(self) -> tuple[pafs.FileSystem, str, str]:
        path = self.o["path"].replace("s3a://", "s3://").rstrip("/")
        if path.startswith("s3://"):
            scheme, fs = "s3a://", pafs.S3FileSystem(access_key=self.o.get("access.key"), secret_key=self.o.get("secret.key"), region=self.o["region"], endpoint_override=self.o.get("endpoint"))
            base = path.removeprefix("s3://")
        else:
            scheme, fs, base = "file://", pafs.LocalFileSystem(), path.removeprefix("file://")
        return fs, base, scheme + base

    def stage(self, df: DataFrame, batch_id: int) -> list[tuple[str, int, int]]:
        """(file, bytes, rows) of the batch, in place; files that an earlier try left are replaced."""
        fs, base, uri = self.folder()
        fs.create_dir(base, recursive=True)
        mark = f"{self.d.name}-{batch_id:010d}-"
        for old in fs.get_file_info(pafs.FileSelector(base)):
            if old.base_name.startswith(mark):
                fs.delete_file(old.path)
        tmp = f".tmp-{mark}{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{uri}/{tmp}")
        rows = {r["f"]: (r["b"], r["n"]) for r in df.sparkSession.read.schema(df.schema).parquet(f"{uri}/{tmp}").groupBy(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_size").alias("b")).agg(F.count("*").alias("n")).collect()}
        out = []
        for i, (f, (size, n)) in enumerate(sorted(rows.items())):
            name = f"{mark}{i:05d}.parquet"
            fs.move(f"{base}/{tmp}/{f}", f"{base}/{name}")
            out.append((name, size, n))
        fs.delete_dir(f"{base}/{tmp}")
        return out


class FilesystemSink(ParquetFolder):
    def commit(self, df: DataFrame, batch_id: int) -> None:
        self.stage(df, batch_id)


class DeltaSink(ParquetFolder):
    """Data files plus a commit of the open table protocol, written as JSON; a txn action makes repeats harmless."""

    ATTEMPTS = 5
    #: Of the log: the last version read, and this stream's last batch in it.
    _read = _last = -1

    def commit(self, df: DataFrame, batch_id: int) -> None:
        fs, base, _ = self.folder()
        log = f"{base}/_delta_log"
        fs.create_dir(log, recursive=True)
        version, committed = self._state(fs, log)
        if committed >= batch_id:
            return
        files = self.stage(df, batch_id)
        for attempt in range(self.ATTEMPTS):
            version, _ = self._state(fs, log)
            now = int(time.time() * 1000)
            actions: list[dict] = [{"commitInfo": {"timestamp": now, "operation": "WRITE", "operationParameters": {"mode": "Append"}}}]
            if version < 0:
                actions.append({"protocol": {"minReaderVersion": 1, "minWriterVersion": 1}})
                actions.append({"metaData": {"id": str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": json.dumps(plain_schema(df.schema)), "partitionColumns": [], "configuration": {}, "createdTime": now}})
            actions.append({"txn": {"appId": f"tidemark-{self.d.name}", "version": batch_id, "lastUpdated": now}})
            actions += [{"add": {"path": f, "partitionValues": {}, "size": b, "modificationTime": now, "dataChange": True, "stats": json.dumps({"numRecords": n})}} for f, b, n in files]
            if self._create(fs, f"{log}/{version + 1:020d}.json", "\n".join(map(json.dumps, actions)) + "\n"):
                return
            time.sleep(min(2.0, 0.05 * 2**attempt) * (0.5 + random.random() / 2))
        raise TransientSinkError("delta commit lost every race for the next version")

    def _state(self, fs: pafs.FileSystem, log: str) -> tuple[int, int]:
        """(latest version, last batch of this stream); versions that were read before are not read again."""
        names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(log)) if i.base_name.endswith(".json"))
        for n in names:
            if int(n[:20]) <= self._read:
                continue
            with fs.open_input_stream(f"{log}/{n}") as f:
                for line in f.read().decode().splitlines():
                    txn = json.loads(line).get("txn")
                    if txn and txn["appId"] == f"tidemark-{self.d.name}":
                        self._last = max(self._last, txn["version"])
            self._read = int(n[:20])
        return (int(names[-1][:20]) if names else -1), self._last

    def _create(self, fs: pafs.FileSystem, path: str, text: str) -> bool:
        if isinstance(fs, pafs.LocalFileSystem):
            try:
                with open(path, "x") as f:
                    f.write(text)
                return True
            except FileExistsError:
                return False
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            return False
        with fs.open_output_stream(path) as f:
            f.write(text.encode())
        return True


def plain_schema(schema: T.StructType) -> dict:
    out = schema.jsonValue()
    for f in out["fields"]:
        f["metadata"] = {}
    return out


def encoded(df: DataFrame, definition: StreamDef) -> DataFrame:
    """Rows (key, value): JSON of the row, and of its key fields if any are named, with the prefix taken off."""
    o = definition.options
    names = [c for c in df.columns if not c.startswith("__")]
    value = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    key: Column = F.lit(None).cast("string")
    if o.get("key.fields"):
        prefix = o.get("key.fields-prefix", "")
        fields = [f.strip() for f in o["key.fields"].replace(",", ";").split(";") if f.strip()]
        real = [f.removeprefix(prefix) for f in fields]
        missing = [f for f in real if f not in names]
        if missing:
            raise FatalSinkError(f"key field {missing[0]} does not exist")
        key = F.to_json(F.struct(*[F.col(f).alias(prefix + f) for f in real]), {"ignoreNullFields": "false"})
    return df.select(key.alias("key"), value.alias("value"))


#: Transports of message sinks by sink name: called with the options, they return a function that sends an iterator of
#: (key, value) and returns when all are acknowledged. Each partition of a batch calls one where it runs. Of an
#: exactly-once sink, options tell the transaction of the partition: transactional.id is its own, which a repeated try
#: of the batch has again, and transaction.batch is the batch; a batch that was committed under it is not sent again.
TRANSPORTS: dict[str, Callable[[dict], Callable]] = {}


class MessageSink(Sink):
    live = True

    def commit(self, df: DataFrame, batch_id: int) -> None:
        rows = encoded(df, self.d)
        if self.d.sink == "kafka" and "kafka" not in TRANSPORTS:
            self._spark_kafka(rows)
            return
        make = TRANSPORTS.get(self.d.sink)
        if not make:
            raise FatalSinkError(f"{self.d.sink} connector not available: register a transport")
        options = dict(self.o)
        exact = options.get("delivery-guarantee") == "exactly-once"
        if exact:
            # Partitions have to be the same when a batch is tried again: by order of all columns.
            rows = rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, "key", "value").sortWithinPartitions("key", "value")
            options.setdefault("transactional.id", self.d.name)

        def send(part):
            if exact:
                from pyspark import TaskContext

                own = {"transactional.id": f"{options['transactional.id']}-{TaskContext.get().partitionId()}", "transaction.batch": str(batch_id)}
                make(options | own)((r["key"], r["value"]) for r in part)
            else:
                make(options)((r["key"], r["value"]) for r in part)

        rows.foreachPartition(send)

    def _spark_kafka(self, rows: DataFrame) -> None:
        # Spark's writer has neither transactions nor a turn of partitions.
        if self.o["delivery-guarantee"] == "exactly-once" or self.o["partitioner"] == "round-robin":
            raise FatalSinkError("kafka: exactly-once and round-robin are not provided by the Spark writer: register a transport")
        if self.o["partitioner"] == "fixed":
            rows = rows.withColumn("partition", F.lit(0))
        out = rows.write.format("kafka").option("kafka.bootstrap.servers", self.o["brokers"]).option("topic", self.o["topic"])
        for k in ("compression.type", "batch.size", "linger.ms", "acks", "retries", "security.protocol", "sasl.mechanism"):
            if self.o.get(k):
                out = out.option(f"kafka.{k}", self.o[k])
        try:
            out.save()
        except Exception as e:
            if "Failed to find data source: kafka" in str(e) or "DATA_SOURCE_NOT_FOUND" in str(e):
                raise FatalSinkError("kafka connector not available: its package is not on the class path") from e
            raise


class IcebergSink(Sink):
    """Appends through a catalog of the session; the runtime package has to be on the class path."""

    def commit(self, df: DataFrame, batch_id: int) -> None:
        name = f"{self.o['catalog-name']}.{self.o['namespace']}.{self.o['table']}"
        try:
            if boolean("create-table-if-not-exists", self.o["create-table-if-not-exists"]) and not df.sparkSession.catalog.tableExists(name):
                df.writeTo(name).using("iceberg").create()
            else:
                df.writeTo(name).append()
        except Exception as e:
            raise FatalSinkError(f"iceberg connector not available or table unusable: {str(e)[:300]}") from e


def make_sink(definition: StreamDef) -> Sink:
    return {"noop": NoopSink, "filesystem": FilesystemSink, "delta": DeltaSink, "iceberg": IcebergSink}.get(definition.sink, MessageSink)(definition)
