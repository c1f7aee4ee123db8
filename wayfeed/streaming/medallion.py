"""The streaming chain: raw rows, typed events, departures, current state.

Each table is written by one query with its own checkpoint.  Events are parsed
and deduplicated once into one table partitioned by date and by ``stream``
(position, stop, rejected), so later readers scan only their part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clock import use_utc
from ..operators.coverage import coverage_minutely
from ..operators.departures import build_departures
from ..operators.events import (
    dedup_keyed,
    normalize_events,
    observe_rules,
    parse_heartbeats,
    position_events,
    route_events,
    stop_events,
)
from ..operators.fleet import current_columns, latest_by_key
from ..schemas import ENVELOPE, LATENESS_PLAUSIBLE
from ..sources.feed import heartbeat_ledger, read_bronze, read_feed, with_envelope, with_received_date
from ..sources.paths import children
from ..sources.paths import read_text, write_text
from ..sources.tables import drop_old_versions, read_reference, read_version, reference_versions, versions, write_version
from .buckets import merge_buckets, read_buckets
from .late import COPY, LATE, tag_copies_and_late
from .listeners import read_live_heartbeats


def run(writer, trigger: str | None = None) -> StreamingQuery:
    """Start a stream: everything there is now and stop (default), or every ``trigger`` interval."""
    timed = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    return timed.start()


def write_bronze(raw: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Append raw rows as they are, partitioned by the date received."""
    writer = (
        with_received_date(raw)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("received_date")
    )
    return run(writer, trigger)


def write_silver(
    bronze: DataFrame, path: str, checkpoint: str, trigger: str | None = None, files: int = 8, show_late: bool = False
) -> StreamingQuery:
    """Typed, deduplicated, checked events, partitioned by event date and stream.

    ``show_late`` keeps rows behind the watermark, as ``rejected`` ones with the rule ``behind_watermark``; without it
    they are dropped and only counted (``listeners.LossLedger``).  Rows checked and those that break the warn rule are
    observed under the name ``quality``.

    Dedup leaves rows of every date in every task, and each task would write a
    file per partition and batch.  Rows are therefore brought together by
    partition first, in ``files`` parts each, so that today's partition, which
    gets nearly all rows, is still written by that many tasks.
    """
    typed = normalize_events(bronze)
    if show_late:
        tagged = tag_copies_and_late(typed).where(F.col("outcome") != COPY)
        late = F.col("outcome") == LATE
        rules = F.when(late, F.array_append("failed_rules", F.lit("behind_watermark"))).otherwise(F.col("failed_rules"))
        routed = route_events(tagged).withColumns({"failed_rules": rules, "stream": F.when(late, "rejected").otherwise(F.col("stream"))}).drop("outcome")
    else:
        # What has no key cannot have copies: it is rejected row by row.
        routed = route_events(dedup_keyed(typed))
    events = observe_rules(routed, "quality", LATENESS_PLAUSIBLE).withColumn("event_date", F.to_date("tst"))
    part = F.pmod(F.xxhash64("vehicle_id", "tst"), F.lit(files))
    writer = (
        events.repartition(F.col("event_date"), F.col("stream"), part)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("event_date", "stream")
    )
    return run(writer, trigger)


def silver_schema(spark: SparkSession):
    empty = spark.createDataFrame([], ENVELOPE)
    return (
        route_events(normalize_events(empty))
        .withColumn("event_date", F.to_date("tst"))
        .schema
    )


def read_silver(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).schema(silver_schema(spark))
    return reader.option("ignoreMissingFiles", True).parquet(path).drop("event_date")


def write_heartbeats(bronze: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    writer = (
        parse_heartbeats(bronze)
        .withColumn("heartbeat_date", F.to_date("heartbeat_at"))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("heartbeat_date")
    )
    return run(writer, trigger)


def read_heartbeats(spark: SparkSession, path: str) -> DataFrame:
    """The heartbeats table with those made after a replay; empty while nothing has been written.

    A stream's folder lists its own files, so the batch of a replay has a folder beside it.
    """
    found = parse_heartbeats(spark.createDataFrame([], ENVELOPE)).withColumn("heartbeat_date", F.to_date("heartbeat_at"))
    for folder in (path, replayed(path)):
        if children(spark, folder):
            found = found.unionByName(spark.read.schema(found.schema).option("ignoreMissingFiles", True).parquet(folder))
    return found.unionByName(read_live_heartbeats(spark, live(path))) if children(spark, live(path)) else found


def live(path: str) -> str:
    """Where ``listeners.LiveHeartbeats`` writes the heartbeats of running streams of this table."""
    return f"{path.rstrip('/')}_live"


def replayed(path: str) -> str:
    return f"{path.rstrip('/')}_replayed"


def add_heartbeats(spark: SparkSession, bronze_path: str, path: str) -> None:
    """Append the heartbeats of sessions in the raw table that have none; a second call adds nothing."""
    raw = read_bronze(spark, bronze_path)
    have = read_heartbeats(spark, path).select("session_id").distinct()
    events = raw.where("kind = 'event' and received_at is not null").join(have, "session_id", "left_anti")
    sessions = events.groupBy("session_id").agg(F.min("received_at").alias("started_at"), F.max("received_at").alias("ended_at"))
    beats = parse_heartbeats(heartbeat_ledger(events.select("session_id", "received_at"), sessions))
    beats.withColumn("heartbeat_date", F.to_date("heartbeat_at")).write.mode("append").partitionBy("heartbeat_date").parquet(replayed(path))


def write_departures(
    stop_stream: DataFrame, stops: DataFrame, routes: DataFrame, path: str, checkpoint: str, trigger: str | None = None
) -> StreamingQuery:
    """Stream-static join with the reference tables, partitioned by Operating Day."""
    writer = (
        build_departures(stop_stream, stops, routes)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("operating_day")
    )
    return run(writer, trigger)


def departures_of_batch(reference: str, path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that joins a batch with the newest reference load and appends it.

    Which load a batch used is recorded before its rows are written, so a batch that is repeated uses the same one even
    if another has come since.  Rows carry it as ``reference_version`` (NULL while nothing is loaded).  A batch owns the
    partitions (operating_day, batch), so writing it again replaces its rows and no others.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = f"{path.rstrip('/')}_reference/{batch_id:012d}"
        used = read_text(spark, mark)
        if used is None:
            ready = reference_versions(spark, reference)
            used = str(ready[-1]) if ready else "none"
            write_text(spark, mark, used)
        if used == "none":
            routes = spark.createDataFrame([], "feed_route_id string, route string, route_name string")
            stops = spark.createDataFrame([], "stop_id string, stop_name string, lat double, long double")
        else:
            routes, stops = read_reference(spark, reference, int(used))
        version = F.lit(None if used == "none" else int(used)).cast("bigint").alias("reference_version")
        rows = build_departures(batch, stops, routes).select("*", version, F.lit(batch_id).cast("bigint").alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("operating_day", "batch").parquet(path)

    return step


def write_departures_refreshed(stop_stream: DataFrame, reference: str, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Departures of a stream whose reference tables may be loaded anew while it runs.

    ``reference`` is the folder of ``tables.load_reference``.  Each micro-batch reads the newest whole load; see
    :func:`departures_of_batch`.
    """
    step = departures_of_batch(reference, path)
    return run(stop_stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint), trigger)


def merge_latest(path: str, keys: list[str], seq: str, keep: int = 3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that keeps the newest row per key in a versioned snapshot.

    Version = batch id: the step reads the newest version before it and writes
    its own, so a repeated batch gives the same result.  Only one row per key
    of the batch meets the snapshot.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_version(spark, path, before=batch_id)
        rows = batch if before is None else before.unionByName(batch)
        write_version(latest_by_key(rows, keys, seq), path, batch_id)
        drop_old_versions(spark, path, keep)

    return step


def write_current(positions: DataFrame, path: str, checkpoint: str, trigger: str | None = None, buckets: int | None = None) -> StreamingQuery:
    """Latest Position Event per vehicle; late events never replace newer ones.

    With ``buckets`` a batch rewrites only the hash buckets of its vehicles and writes their change rows
    (``buckets.read_changes``); without, each batch writes a snapshot of the whole fleet.
    """
    step = merge_buckets(path, ["vehicle_id"], "last_seen_at", buckets) if buckets else merge_latest(path, ["vehicle_id"], "last_seen_at")
    writer = current_columns(positions).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return run(writer, trigger)


def current_updates(positions: DataFrame) -> DataFrame:
    """For very large fleets: the same state as a streaming aggregate.

    Use with output mode ``update``: each batch gives only the vehicles that
    changed, and the state store keeps the rest.
    """
    return latest_by_key(current_columns(positions), ["vehicle_id"], "last_seen_at")


def replay(
    spark: SparkSession,
    feed: str | DataFrame,
    out: str,
    stops: DataFrame | None = None,
    routes: DataFrame | None = None,
    session_id: str | None = None,
    max_files_per_trigger: int | None = None,
    files: int = 8,
    reference: str | None = None,
    show_late: bool = False,
) -> dict[str, str]:
    """Run the whole chain over a recorded feed and stop; call again to continue where it ended.

    ``feed`` is a folder of recorded lines, or a stream of raw rows.  Each call
    is one Ingestion Session (``session_id``, by default a new one).  Sessions
    that brought no heartbeats, as recordings do not, get those that a reader
    would have written.

    Names come from ``stops`` and ``routes`` as they are at the start, or from the newest load in the folder
    ``reference`` at each batch.  ``show_late`` keeps late rows among the rejected ones.
    """
    use_utc(spark)
    session_id = session_id or f"replay-{uuid.uuid4().hex}"
    at = {name: f"{out}/{name}" for name in ("bronze", "silver", "heartbeats", "departures", "current")}
    mark = {name: f"{out}/_checkpoints/{name}" for name in at}
    raw = feed
    if isinstance(feed, str):
        raw = with_envelope(read_feed(spark, feed, True, max_files_per_trigger), session_id)
    write_bronze(raw, at["bronze"], mark["bronze"]).awaitTermination()
    first = [
        write_silver(read_bronze(spark, at["bronze"], True), at["silver"], mark["silver"], files=files, show_late=show_late),
        write_heartbeats(read_bronze(spark, at["bronze"], True), at["heartbeats"], mark["heartbeats"]),
    ]
    for query in first:
        query.awaitTermination()
    add_heartbeats(spark, at["bronze"], at["heartbeats"])
    silver = read_silver(spark, at["silver"], True)
    if reference is not None:
        departures = write_departures_refreshed(stop_events(silver), reference, at["departures"], mark["departures"])
    else:
        departures = write_departures(stop_events(silver), stops, routes, at["departures"], mark["departures"])
    second = [
        departures,
        write_current(position_events(silver), at["current"], mark["current"]),
    ]
    for query in second:
        query.awaitTermination()
    return at


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The current state, in either layout; None while there is none."""
    found = read_buckets(spark, path)
    return read_version(spark, path) if found is None else found


def coverage_of(spark: SparkSession, heartbeats_path: str, as_of=None, **options) -> DataFrame:
    """Minutes table recomputed from the heartbeats of its window."""
    return coverage_minutely(read_heartbeats(spark, heartbeats_path), as_of, **options)


__all__ = [
    "coverage_of",
    "current_updates",
    "merge_latest",
    "read_current",
    "read_silver",
    "replay",
    "run",
    "versions",
    "write_bronze",
    "write_current",
    "write_departures",
    "write_departures_refreshed",
    "write_heartbeats",
    "write_silver",
]
