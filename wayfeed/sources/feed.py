"""The recorded feed: replay source, envelope, topic filters, heartbeats, recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from ..functions.clock import instant, on_days
from ..operators.ordered import with_running_sum
from ..schemas import DEFAULT_TOPICS, ENVELOPE, HEARTBEAT_EVERY_S, RECORDED


UNREADABLE = "_unreadable"


def read_feed(
    spark: SparkSession, path: str, streaming: bool = False, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Recorded lines of a JSONL file or a folder of ``*.jsonl`` files.

    As a stream, the checkpoint remembers what was read, so a restart never
    replays a file twice.  Blank lines are skipped.  A line that is no JSON
    stays as a row without topic whose payload is the line, so the events made
    of it are rejected and not lost.
    """
    schema = StructType([*RECORDED.fields, StructField(UNREADABLE, StringType())])
    reader = (spark.readStream if streaming else spark.read).schema(schema).option("columnNameOfCorruptRecord", UNREADABLE)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.json(path)
    lines = lines.withColumn("payload", F.coalesce("payload", F.nullif(F.trim(UNREADABLE), F.lit("")))).drop(UNREADABLE)
    return lines.where(F.col("topic").isNotNull() | F.col("payload").isNotNull())


def with_envelope(recorded: DataFrame, session_id: str, keep: Sequence[str] = ()) -> DataFrame:
    """Raw table rows of kind ``event`` under one session id per reader start; columns in ``keep`` stay."""
    return recorded.select(
        F.lit("event").alias("kind"),
        "topic",
        "payload",
        "received_at",
        F.lit(session_id).alias("session_id"),
        *keep,
    )


def topic_list(option: str | None) -> list[str]:
    """Topic filters of a comma list; a blank one means the default eight."""
    return [t.strip() for t in (option or "").split(",") if t.strip()] or list(DEFAULT_TOPICS)


def _matches(topic: Column, wanted: str) -> Column:
    """A filter's levels must match; ``+`` stands for one level, a trailing ``#`` for the rest."""
    levels = wanted.split("/")
    open_end = levels[-1] == "#"
    fixed = levels[:-1] if open_end else levels
    if "+" not in fixed:
        start = "/".join(fixed)
        if not open_end:
            return topic == start
        return topic.startswith(start + "/") | (topic == start) if fixed else F.lit(True)
    have = F.split(topic, "/")
    size = F.size(have)
    matched = (size >= len(fixed)) if open_end else (size == len(fixed))
    for i, level in enumerate(fixed):
        if level != "+":
            matched = matched & (F.get(have, F.lit(i)) == level)
    return matched


def filter_topics(df: DataFrame, topics: str | None = None) -> DataFrame:
    """Rows whose topic a subscription to ``topics`` would deliver."""
    keep = F.lit(False)
    for wanted in topic_list(topics):
        keep = keep | _matches(F.col("topic"), wanted)
    return df.where(F.coalesce(keep, F.lit(False)))


def heartbeat_ledger(events: DataFrame, sessions: DataFrame, every_s: int = HEARTBEAT_EVERY_S) -> DataFrame:
    """Heartbeat rows of each session, every ``every_s`` seconds from its start, also in silence.

    ``sessions(session_id, started_at, ended_at)``, ``events(session_id,
    received_at)`` with an optional ``dropped`` count per row.  A heartbeat
    carries the totals received up to and including its instant.  The spine
    comes from the session, so quiet time keeps its rows.
    """
    step_us = every_s * 1_000_000
    start_us, end_us = F.unix_micros("started_at"), F.unix_micros("ended_at")
    last = F.floor((end_us - start_us) / F.lit(step_us))
    block = 86_400 // max(1, every_s)  # beats of a day, so that no array grows with a session
    days = sessions.select(
        "session_id", "started_at", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / block))).alias("day")
    )
    upto = F.least("last", (F.col("day") + 1) * block - 1)
    spine = days.select(
        "session_id", "started_at", F.explode(F.sequence(F.col("day") * block, upto)).alias("beat")
    ).select(
        "session_id",
        "beat",
        F.timestamp_micros(F.unix_micros("started_at") + F.col("beat") * step_us).alias("received_at"),
    )
    dropped = F.col("dropped") if "dropped" in events.columns else F.lit(0)
    offset = F.unix_micros("e.received_at") - F.unix_micros("s.started_at")
    arrived = (
        events.withColumn("dropped", dropped)
        .alias("e")
        .join(sessions.select("session_id", "started_at").alias("s"), "session_id")
        .select(
            "session_id",
            F.greatest(F.lit(0).cast("bigint"), F.ceil(offset / F.lit(step_us))).alias("beat"),
            F.col("e.dropped").alias("dropped"),
        )
        .groupBy("session_id", "beat")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("dropped").alias("d"))
    )
    beats = spine.join(arrived, ["session_id", "beat"], "left").na.fill(0, ["n", "d"])
    totals = with_running_sum(
        beats, ["session_id"], "received_at", {"received_total": "n", "dropped_total": "d"}, span_s=86_400
    )
    body = F.struct(
        F.col("received_total").cast("bigint").alias("received_total"),
        F.col("dropped_total").cast("bigint").alias("dropped_total"),
    )
    return totals.select(
        F.lit("heartbeat").alias("kind"),
        F.lit(None).cast("string").alias("topic"),
        F.to_json(body).alias("payload"),
        "received_at",
        "session_id",
    )


def record_by_minute(recorded: DataFrame, path: str, unit: str = "minute") -> None:
    """Write a feed as JSON lines, one folder per minute (or other ``unit``) received.

    Rows stay in the tasks that read them, so a busy minute is several files
    instead of one long task.
    """
    name = F.date_format(F.date_trunc(unit, "received_at"), "yyyyMMdd'T'HHmm")
    (
        recorded.withColumn("minute", name)
        .write.mode("append")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
        .partitionBy("minute")
        .json(path)
    )


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    """A recording made by :func:`record_by_minute`; the minute folders prune a time range."""
    schema = StructType([*RECORDED.fields, StructField("minute", StringType())])
    return spark.read.schema(schema).json(path)


def read_bronze(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The append-only raw table; whole old date partitions may have been dropped."""
    schema = StructType([*ENVELOPE.fields, StructField("received_date", DateType())])
    reader = (spark.readStream if streaming else spark.read).schema(schema)
    return reader.option("ignoreMissingFiles", True).parquet(path)


def with_received_date(df: DataFrame) -> DataFrame:
    return df.withColumn("received_date", F.to_date("received_at"))


def rows_since(df: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    """Rows younger than ``days`` days (the exact bound that partition drops leave open)."""
    since = instant(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    kept = df.where(F.col(ts) >= since)
    for column in ("received_date", "event_date", "heartbeat_date", "operating_day"):
        kept = on_days(kept, column, since)
    return kept
