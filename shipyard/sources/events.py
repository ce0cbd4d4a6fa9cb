"""Events as JSON lines in a sink whose readers see whole batches only.

A Spark data source (``shipyard_events``) for batch and stream. Each task writes its rows to a file of its own
under ``<path>/data`` and names it to the driver; when all tasks are done, one commit file under
``<path>/commits`` that lists them appears by a rename. A reader takes the listed files only, so neither a task
that dies or runs twice nor a job that fails is ever seen, and a batch that is written again
replaces its commit. Files are reached through Arrow's file systems; what the driver holds is one
name per task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

FORMAT = "shipyard_events"


def _system(path: str):
    from pyarrow import fs

    uri = f"file://{path}" if "://" not in path and not path.startswith("file:") else path
    uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its file (None without rows) and how many rows."""

    file: str | None
    rows: int


class _Sink:
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def put(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, base = _system(self.path)
        system.create_dir(f"{base}/data", recursive=True)
        name, out, n = f"{uuid.uuid4().hex}.json", None, 0
        try:
            for batch in batches:
                values = batch.column("value").to_pylist()
                if values:
                    out = out or system.open_output_stream(f"{base}/data/{name}")
                    out.write(("\n".join(values) + "\n").encode())
                    n += len(values)
        finally:
            if out is not None:
                out.close()
        return Written(name if n else None, n)

    def publish(self, batch: str, messages: list) -> None:
        system, base = _system(self.path)
        system.create_dir(f"{base}/commits", recursive=True)
        made = f"{base}/_{uuid.uuid4().hex}"
        with system.open_output_stream(made) as f:
            for m in messages:
                if m is not None and m.file:
                    f.write((json.dumps({"batch": batch, "file": m.file, "rows": m.rows}) + "\n").encode())
        system.move(made, f"{base}/commits/{batch}.json")  # readers see all of it or nothing

    def drop(self, messages: list) -> None:
        """Removes what tasks of a failed job wrote; a file that stays is listed nowhere."""
        system, base = _system(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{base}/data/{m.file}")


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str) -> None:
        self.sink, self.batch = _Sink(path), batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.sink.put(iterator)

    def commit(self, messages: list) -> None:
        self.sink.publish(self.batch, messages)

    def abort(self, messages: list) -> None:
        self.sink.drop(messages)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str) -> None:
        self.sink = _Sink(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.sink.put(iterator)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.sink.publish(str(batchId), messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.sink.drop(messages)


class EventSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: T.StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"], self.options["batch"])

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self.options["path"])


def _values(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def write_committed(events: DataFrame, path: str, batch_id: str) -> None:
    """Writes the rows as one batch; writing a batch id again replaces that batch."""
    spark = events.sparkSession
    spark.dataSource.register(EventSink)
    _values(events).write.format(FORMAT).mode("append").option("path", path).option("batch", str(batch_id)).save()


def stream_committed(events: DataFrame, path: str, checkpoint_location: str):
    """The writer of a stream, a commit per micro-batch (to be started with the trigger that is wanted)."""
    events.sparkSession.dataSource.register(EventSink)
    return _values(events).writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint_location)


def read_committed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all committed batches."""
    path = path.rstrip("/")
    listed = spark.read.schema("batch string, file string, rows long").json(f"{path}/commits")
    texts = spark.read.text(f"{path}/data").select("value", F.col("_metadata.file_name").alias("file"))
    rows = texts.join(listed.select("file"), "file", "left_semi")
    return rows.select(F.from_json("value", schema).alias("e")).select("e.*")
