"""What a running stream says about itself: live heartbeats, and rows lost behind the watermark."""

from __future__ import annotations

import datetime as dt
import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..schemas import HEARTBEAT_EVERY_S
from ..sources.paths import children, write_text

HEARTBEAT = "session_id string, heartbeat_at timestamp, received_total bigint, dropped_total bigint, heartbeat_date date"
LOSS = "query string, run_id string, batch_id bigint, at timestamp, input_rows bigint, late_rows bigint, observed map<string, string>"


def _iso(seconds: float) -> str:
    return dt.datetime.fromtimestamp(seconds, dt.UTC).isoformat(timespec="microseconds")


def late_rows_of(progress) -> int:
    """Rows that the stateful operators of a batch dropped behind the watermark."""
    return sum(int(s.numRowsDroppedByWatermark) for s in progress.stateOperators)


class LiveHeartbeats(StreamingQueryListener):
    """Writes a heartbeat of a query at most every ``every_s`` seconds, also while its source is silent.

    A heartbeat carries the rows received and dropped since the query's start, under the run's id as Ingestion Session.
    The first is due at once.  While no rows come, Spark tells of idle triggers every
    ``spark.sql.streaming.noDataProgressEventInterval`` (10 s by default), so quiet and gone can be told apart.  Each
    heartbeat is a small file of one day's folder under ``path``; a folder of past days can be rewritten as one file.
    """

    def __init__(self, spark: SparkSession, path: str, query: str | None = None, every_s: float = HEARTBEAT_EVERY_S, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path, self.query, self.every_s, self.clock = spark, path, query, every_s, clock
        self.totals: dict[str, list[int]] = {}
        self.names: dict[str, str | None] = {}
        self.last: dict[str, float] = {}
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        run = str(event.runId)
        if self.query is None or event.name == self.query:
            self.totals[run] = [0, 0]
            self.beat(run)

    def onQueryProgress(self, event) -> None:
        run, p = str(event.progress.runId), event.progress
        if run in self.totals:
            self.totals[run][0] += int(p.numInputRows)
            self.totals[run][1] += late_rows_of(p)
            self.beat(run)

    def onQueryIdle(self, event) -> None:
        if str(event.runId) in self.totals:
            self.beat(str(event.runId))

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        if run in self.totals:
            self.beat(run, due=True)
            del self.totals[run]

    def beat(self, run: str, due: bool = False) -> None:
        with self.lock:
            now = self.clock()
            if not due and run in self.last and now - self.last[run] < self.every_s:
                return
            self.last[run] = now
            received, dropped = self.totals[run]
        at = _iso(now)
        row = {"session_id": run, "heartbeat_at": at, "received_total": received, "dropped_total": dropped}
        write_text(self.spark, f"{self.path}/heartbeat_date={at[:10]}/{at[11:].replace(':', '')}-{uuid.uuid4().hex[:8]}.json", json.dumps(row))


def read_live_heartbeats(spark: SparkSession, path: str) -> DataFrame:
    """Heartbeats written by :class:`LiveHeartbeats`; empty while there are none."""
    if not children(spark, path):
        return spark.createDataFrame([], HEARTBEAT)
    return spark.read.schema(HEARTBEAT).option("ignoreMissingFiles", True).json(path)


class LossLedger(StreamingQueryListener):
    """Writes a line for each batch in which rows fell behind the watermark or an observed rule counted something."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = late_rows_of(p)
        observed = {f"{name}.{k}": str(v) for name, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items()}
        if late or observed:
            row = {"query": p.name or str(p.id), "run_id": str(p.runId), "batch_id": int(p.batchId), "at": p.timestamp, "input_rows": int(p.numInputRows), "late_rows": late, "observed": observed}
            write_text(self.spark, f"{self.path}/{p.runId}-{int(p.batchId):012d}.json", json.dumps(row))


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """One row for each run and batch of a :class:`LossLedger`; a batch that was repeated counts once, as it ended last."""
    if not children(spark, path):
        return spark.createDataFrame([], LOSS)
    lines = spark.read.schema(LOSS).json(path)
    rest = [c for c in lines.columns if c not in ("query", "batch_id")]
    newest = lines.groupBy("query", "batch_id").agg(F.max_by(F.struct(*rest), "at").alias("newest"))
    return newest.select("query", "batch_id", "newest.*").select(*lines.columns)
