"""A telemetry source and its sinks: append-only logs read by byte offsets, rejected rows set aside.

A collector appends JSON lines to files of one folder. The source's offset is how
far each file has been read; a batch is the whole lines between two offsets, a
part for each run of them. Offsets are in the query's checkpoint, so a restart
neither loses nor repeats a line, also of files that grew meanwhile; a line that
is not yet ended waits. The folder may be on any file system that pyarrow opens
from its address and that all executors reach.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from weir.streaming.live import ingest

#: Bytes of one part of a batch, and of one batch.
PART, BATCH = 1 << 24, 1 << 30


class Lines(InputPartition):
    """The whole lines of a file that begin in [start, end)."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.where = options["path"]
        self.part, self.batch = int(options.get("part", PART)), int(options.get("batch", BATCH))
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> dict[str, int]:
        system, root = fs.FileSystem.from_uri(self.where)
        found = system.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True))
        return {i.base_name: i.size for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))}

    def latestOffset(self) -> dict:
        """How far the files go, to the end of their last whole line; no further than one batch from the offset given last."""
        system, root = fs.FileSystem.from_uri(self.where)
        ahead, out = self.batch, dict(self.last or {})
        for name, size in sorted(self._files().items()):
            start = out.get(name, 0)
            end = min(size, start + ahead)
            with system.open_input_file(f"{root}/{name}") as f:
                end = _line_end(f, start, end, size)
            if end > start:
                out[name], ahead = end, ahead - (end - start)
            if ahead <= 0:
                break
        self.last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        self.last = end if self.last is None else self.last
        return [Lines(name, a, min(a + self.part, stop)) for name, stop in sorted(end.items()) for a in range(start.get(name, 0), stop, self.part)]

    def read(self, partition: Lines):
        system, root = fs.FileSystem.from_uri(self.where)
        with system.open_input_file(f"{root}/{partition.path}") as f:
            size = f.size()
            # a line belongs to the part in which it begins
            first = partition.start if partition.start == 0 or f.read_at(1, partition.start - 1) == b"\n" else _next_line(f, partition.start, size)
            if first >= partition.end:
                return
            last = partition.end if f.read_at(1, partition.end - 1) == b"\n" else _next_line(f, partition.end, size)
            at = first
            for line in f.read_at(last - first, first).split(b"\n")[:-1]:
                yield line.decode("utf-8", "replace"), partition.path, at
                at += len(line) + 1

    def commit(self, end: dict) -> None:
        """Nothing is held for what is done: the logs stay with their collector."""


def _next_line(f, at: int, size: int) -> int:
    """The first place after `at` where a line begins."""
    while at < size:
        block = f.read_at(min(1 << 16, size - at), at)
        hit = block.find(b"\n")
        if hit >= 0:
            return at + hit + 1
        at += len(block)
    return size


def _line_end(f, start: int, end: int, size: int) -> int:
    """The end of the last whole line up to `end`; of a longer line its own end, if it has one; else `start`."""
    at = end
    while at > start:
        low = max(start, at - (1 << 16))
        hit = f.read_at(at - low, low).rfind(b"\n")
        if hit >= 0:
            return low + hit + 1
        at = low
    stop = _next_line(f, end, size)
    return stop if stop > end and f.read_at(1, stop - 1) == b"\n" else start


class TelemetryLog(DataSource):
    """`spark.readStream.format("telemetry_log").load(folder)`: value, file, at (the byte where the line begins)."""

    @classmethod
    def name(cls) -> str:
        return "telemetry_log"

    def schema(self) -> str:
        return "value string, file string, at bigint"

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def telemetry_stream(spark: SparkSession, folder: str, width: int, **options) -> DataFrame:
    """Telemetry of a folder of logs as a stream: its fields, `error` (null: accepted), and each row's file, place and text."""
    spark.dataSource.register(TelemetryLog)
    where = folder if "://" in folder else "file://" + folder
    lines = spark.readStream.format("telemetry_log").options(path=where, **options).load()
    return ingest(lines, width, keep=("value", "file", "at"))


def write_batch(batch: DataFrame, number: int, path: str) -> None:
    """A batch under its number: written again after a failure, it takes its own place."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def store_telemetry(stream: DataFrame, accepted: str, rejected: str, checkpoint: str):
    """A query that writes accepted rows to one folder and rejected ones, with their text and error, to another, each batch once.

    Call `.start()` on it.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            write_batch(rows.where("error is null").drop("error", "value"), number, accepted)
            write_batch(rows.where("error is not null").select("file", "at", "value", "error"), number, rejected)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def merge_events(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends event rows by batch number; `sinks.latest_events` over the folder has each event's last version."""
    return stream.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, path)).option("checkpointLocation", checkpoint)


def rejected_counts(rejected: DataFrame) -> DataFrame:
    """error, n of the rows set aside."""
    return rejected.groupBy("error").agg(F.count("*").alias("n"))
