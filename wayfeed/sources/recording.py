"""A streaming data source over recorded JSON lines: name order, exact offsets, bounded batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..schemas import RECORDED

ROWS_PER_BATCH = 20_000
ROWS_PER_TASK = 5_000
#: Bytes looked at in one step, and lines handed to Spark in one batch of a task.
STEP_BYTES = 1 << 20
LINES_PER_STEP = 2_000


def _open(path: str):
    """File system and inner path of a folder, through Arrow: local, HDFS or an object store."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Lines(InputPartition):
    """Some whole lines of one file; ``line`` numbers the first, from 1; ``row`` in its micro-batch, from 0."""

    file: str
    line: int
    start: int
    end: int
    row: int = 0


class RecordingReader(DataSourceStreamReader):
    """Offsets are (file, line, byte): the file being read, how many of its lines are read, and where they end.

    A batch takes at most ``rowsPerBatch`` lines that follow its start, over file borders, in name order.  The driver
    only looks for line ends, once a batch; tasks read the lines.  Files must be whole when they appear and later files must
    have later names, as those of a recording by time do; a file that appears before the one being read is not seen.

    A micro-batch costs the same time whatever it holds, so a long recording read in small batches takes hours.  With
    ``lotsPerBatch`` one micro-batch takes up to that many batches at once, and a column ``lot`` tells which of them a
    line belongs to (from 0 in each micro-batch), for operators that must judge batch by batch.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")
        self.lot = int(options.get("rowsPerBatch", ROWS_PER_BATCH))
        self.lots = options.get("lotsPerBatch")
        self.most = self.lot * int(self.lots or 1)
        self.per_task = int(options.get("rowsPerTask", ROWS_PER_TASK))
        self.suffix = options.get("suffix", ".jsonl")
        self.at: dict | None = None
        self.planned: tuple | None = None  # start, end and parts of the batch that was looked for last

    def names(self) -> list[str]:
        """The recording's files below its folder, by name; what Spark has not finished writing is left out."""
        from pyarrow import fs

        system, root = _open(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = (f.path[len(root.rstrip("/")) + 1 :] for f in found if f.is_file)
        return sorted(f for f in files if f.endswith(self.suffix) and not any(p.startswith(("_", ".")) for p in f.split("/")))

    def initialOffset(self) -> dict:
        self.at = {"file": "", "line": 0, "byte": 0}
        return self.at

    def latestOffset(self) -> dict:
        if self.at is None:
            self.initialOffset()
        found = list(self._walk(self.at, None))
        end = found[-1][1] if found else self.at
        self.planned = (self.at, end, [part for part, _ in found])
        return end

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        self.at = end  # also on a restart, when Spark tells the last offset as an empty range
        if start == end:
            return []
        if self.planned is not None and self.planned[:2] == (start, end):
            return self.planned[2]
        return [part for part, _ in self._walk(start, end)]

    def _walk(self, start: dict, end: dict | None) -> Iterator[tuple[Lines, dict]]:
        """(part of at most ``rowsPerTask`` lines, offset behind it) from ``start`` to ``end``, without it to the next batch's end."""
        left = self.most if end is None else None
        row = 0
        for name in self.names():
            if name < start["file"] or (end is not None and name > end["file"]):
                continue
            byte, line = (start["byte"], start["line"]) if name == start["file"] else (0, 0)
            for n, upto in self._line_ends(name, byte, None if end is None or name != end["file"] else end["byte"], left):
                yield Lines(name, line + 1, byte, upto, row), {"file": name, "line": line + n, "byte": upto}
                byte, line, row = upto, line + n, row + n
                if left is not None:
                    left -= n
            if left == 0:
                break

    def _line_ends(self, name: str, byte: int, stop: int | None, most: int | None) -> Iterator[tuple[int, int]]:
        """(lines, byte behind them) of consecutive parts of a file; the last line may lack its line feed."""
        system, root = _open(self.path)
        with system.open_input_file(f"{root}/{name}") as file:
            size = file.size() if stop is None else stop
            at, lines, last = byte, 0, byte
            limit = self.per_task if most is None else min(self.per_task, most)
            while at < size:
                piece = file.read_at(min(STEP_BYTES, size - at), at)
                found = -1
                while lines + (n := piece.count(b"\n", found + 1)) >= limit:
                    for _ in range(limit - lines):
                        found = piece.find(b"\n", found + 1)
                    last = at + found + 1
                    yield limit, last
                    most = None if most is None else most - limit
                    if most == 0:
                        return
                    limit = self.per_task if most is None else min(self.per_task, most)
                    lines = 0
                if n:
                    lines, last = lines + n, at + piece.rfind(b"\n") + 1
                at += len(piece)
            if last < size:
                yield lines + 1, size
            elif lines:
                yield lines, last

    def read(self, partition: Lines) -> Iterator:
        import pyarrow as pa

        system, root = _open(self.path)
        with system.open_input_file(f"{root}/{partition.file}") as file:
            file.seek(partition.start)
            line, row, rest, left = partition.line, partition.row, b"", partition.end - partition.start
            while left or rest:
                piece = file.read(min(STEP_BYTES, left))
                left -= len(piece)
                *whole, rest = (rest + piece).split(b"\n")
                if not left and rest:
                    whole, rest = [*whole, rest], b""
                for k in range(0, len(whole), LINES_PER_STEP):
                    part = [(k + i, text) for i, text in enumerate(whole[k : k + LINES_PER_STEP]) if text.strip()]
                    values = pa.array([text.decode("utf-8", "replace") for _, text in part], pa.string())
                    columns = {"file": pa.array([partition.file] * len(part), pa.string()), "line": pa.array([line + i for i, _ in part], pa.int64()), "value": values}
                    if self.lots:
                        columns["lot"] = pa.array([(row + i) // self.lot for i, _ in part], pa.int64())
                    yield pa.RecordBatch.from_pydict(columns)
                line, row = line + len(whole), row + len(whole)

    def commit(self, end: dict) -> None:
        """Nothing is held for lines already read."""


class RecordingSource(DataSource):
    """``format("recorded_lines")``: file, line and text of every line of a folder that is not blank, with ``lotsPerBatch`` its lot."""

    @classmethod
    def name(cls) -> str:
        return "recorded_lines"

    def schema(self) -> str:
        return "file string, line long, value string" + (", lot long" if self.options.get("lotsPerBatch") else "")

    def streamReader(self, schema) -> RecordingReader:
        return RecordingReader(self.options)


def recorded_rows(lines: DataFrame) -> DataFrame:
    """Recorded columns with file and line (and lot); text that is no JSON object becomes the payload of a row without topic."""
    parsed = lines.withColumn("body", F.from_json("value", RECORDED))
    bad = F.col("body.topic").isNull() & F.col("body.payload").isNull() & F.col("body.received_at").isNull()
    return parsed.select(
        F.col("body.topic").alias("topic"),
        F.when(bad, F.trim("value")).otherwise(F.col("body.payload")).alias("payload"),
        F.col("body.received_at").alias("received_at"),
        "file",
        "line",
        *[c for c in ("lot",) if c in lines.columns],
    )


def stream_recording(spark: SparkSession, path: str, rows_per_batch: int = ROWS_PER_BATCH, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """A recording as a stream of topic, payload, received_at, file, line.

    Files are read in name order whatever their times, at most ``rows_per_batch`` lines a batch; a restart goes on behind
    the last line of the last finished batch and repeats a batch that did not finish with the very same lines.
    """
    spark.dataSource.register(RecordingSource)
    lines = spark.readStream.format("recorded_lines").option("path", path).option("rowsPerBatch", rows_per_batch).option("rowsPerTask", rows_per_task).load()
    return recorded_rows(lines)


def run_to_end(writer) -> StreamingQuery:
    """Run a stream batch by batch until its source has no more, and stop.

    A bounded trigger asks a source written in Python for its end once and takes all of it as one batch; this keeps the
    source's own batches.
    """
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        while True:
            ended = not query.isActive
            state, last = query.status, query.lastProgress
            # Idle, or in a batch that only cleans up state: either comes when the source had nothing new.
            idle = not state["isDataAvailable"] and not state["isTriggerActive"] and state["message"].startswith("Waiting for data")
            if ended or idle or (last is not None and last.numInputRows == 0):
                break
            query.awaitTermination(0.2)
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
    return query
