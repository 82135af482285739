"""The event channel of searches as a log in a shared folder: a data source to append to and to read as a stream.

A log is a folder of segments, Parquet files of neighbouring messages. A message has an offset, its place in the log; a
segment is named by its first offset and its number of messages. An append writes its segments under other names
and gives them their offsets when all are complete, in the order of the writing tasks, so what was sorted
by time is read in the order of time. One append runs at a time.

A stream takes at most ``maxMessages`` at once. Each slice of a segment is read by a task of its own, however many
messages a channel has. A stream that starts anew goes on behind what its checkpoint has; how far it has come stands
in a small file in the folder named by ``progress`` as well, since a source is not told where its checkpoint ends.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

from pricewell.streaming.events import channel_messages

SCHEMA = "offset BIGINT, channel STRING, message STRING"
ARROW = pa.schema([("offset", pa.int64()), ("channel", pa.string()), ("message", pa.string())])
#: Messages of a segment, and of a batch unless the reader says otherwise.
SEGMENT_MESSAGES = 50_000
MAX_MESSAGES = 1_000_000
SEGMENT = "segment-"


@dataclass
class Segment(InputPartition):
    """Messages ``start`` to ``end`` (offsets, end exclusive) of the segment that begins at ``first``."""

    path: str
    first: int
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    part: int
    files: list[tuple[str, int]]


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The folder's file system and its path there."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), folder


class Log:
    """The segments of a log folder."""

    def __init__(self, folder: str) -> None:
        self.store, self.root = _store(folder)

    def segments(self) -> list[Segment]:
        listed = self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        names = sorted(x.base_name for x in listed if x.base_name.startswith(SEGMENT))
        found = []
        for name in names:
            first, count = (int(x) for x in name.removeprefix(SEGMENT).removesuffix(".parquet").split("-"))
            found.append(Segment(f"{self.root}/{name}", first, first, first + count))
        return found

    def end(self) -> int:
        return max((s.end for s in self.segments()), default=0)

    def slices(self, start: int, end: int) -> list[Segment]:
        inside = [Segment(s.path, s.first, max(s.start, start), min(s.end, end)) for s in self.segments()]
        return [s for s in inside if s.start < s.end]


def _messages(folder: str, part: Segment) -> Iterator[pa.RecordBatch]:
    at = part.first
    with _store(folder)[0].open_input_file(part.path) as source:
        for batch in pq.ParquetFile(source).iter_batches(batch_size=8_192):
            low, high = max(part.start - at, 0), min(part.end - at, batch.num_rows)
            if low < high:
                offsets = pa.array(range(at + low, at + high), pa.int64())
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([offsets, rows.column("channel"), rows.column("message")], schema=ARROW)
            at += batch.num_rows


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.most = int(options.get("segmentMessages", SEGMENT_MESSAGES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.folder)
        store.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out, held = None, 0
        for batch in iterator:
            rows = batch.select(["channel", "message"]).cast(pa.schema(list(ARROW)[1:]))
            while rows.num_rows:
                if out is None:
                    files.append((f"{root}/part-{uuid.uuid4().hex}", 0))
                    out, held = pq.ParquetWriter(files[-1][0], rows.schema, filesystem=store), 0
                taken = rows.slice(0, self.most - held)
                out.write_batch(taken)
                rows, held = rows.slice(taken.num_rows), held + taken.num_rows
                files[-1] = (files[-1][0], held)
                if held == self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(TaskContext.get().partitionId(), files)

    def commit(self, messages: list[Written | None]) -> None:
        """Gives the segments their offsets, one after the other: a reader sees whole segments, in order."""
        log = Log(self.folder)
        at = log.end()
        for done in sorted((m for m in messages if m), key=lambda m: m.part):
            for path, count in done.files:
                log.store.move(path, f"{log.root}/{SEGMENT}{at:020d}-{count:010d}.parquet")
                at += count

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.folder)
        for done in messages:
            for path, _ in done.files if done else ():
                store.delete_file(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]

    def partitions(self) -> list[Segment]:
        return Log(self.folder).segments()

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return _messages(self.folder, partition) if partition else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.most = int(options.get("maxMessages", MAX_MESSAGES))
        self.progress = options.get("progress")
        self.reached = self._remembered()

    def _remembered(self) -> int:
        if not self.progress:
            return 0
        store, root = _store(self.progress)
        listed = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return max((int(x.base_name.removeprefix("reached-")) for x in listed if x.base_name.startswith("reached-")), default=0)

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def latestOffset(self) -> dict:
        return {"offset": max(self.reached, min(Log(self.folder).end(), self.reached + self.most))}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        self.reached = max(self.reached, end["offset"])
        return Log(self.folder).slices(start["offset"], end["offset"])

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return _messages(self.folder, partition)

    def commit(self, end: dict) -> None:
        self.reached = max(self.reached, end["offset"])
        if self.progress:
            store, root = _store(self.progress)
            store.create_dir(root, recursive=True)
            before = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("reached-")]
            name = f"{root}/reached-{end['offset']:020d}"
            with store.open_output_stream(name) as out:
                out.write(json.dumps(end).encode())
            for path in before:
                if path < name:
                    store.delete_file(path)


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return _Writer(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def publish(events: DataFrame, folder: str, order: list[str], segment_messages: int = SEGMENT_MESSAGES) -> None:
    """Appends events as JSON messages on the channels of their searches, in the order of the given columns."""
    events.sparkSession.dataSource.register(EventLog)
    placed = events.repartitionByRange(*order).sortWithinPartitions(*order)
    sent = channel_messages(placed).select(F.lit(None).cast("bigint").alias("offset"), "channel", "message")
    sent.write.format("event_log").option("segmentMessages", segment_messages).mode("append").save(folder)


def subscribed(spark: SparkSession, folder: str, progress: str, max_messages: int = MAX_MESSAGES) -> DataFrame:
    """The messages of a log as a stream of at most so many a batch.

    ``progress`` is a folder that belongs to the stream's checkpoint: use the two together.
    """
    spark.dataSource.register(EventLog)
    stream = spark.readStream.format("event_log").option("maxMessages", max_messages).option("progress", progress)
    return stream.load(folder)
