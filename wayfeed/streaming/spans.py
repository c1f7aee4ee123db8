"""Covered intervals and the as-of snapshot as streams, with state cut by time.

State per session or vehicle would put a busy key into one task and keep it there for good.  Here the key is (session or
vehicle, time span).  What a span needs of the span before it lies within a known distance (the spacing limit, the
look-back), so rows that close to a border go to both spans, and a span's state ends when the watermark has passed it.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import span_of
from ..operators.reports import GONE_MESSAGE, MEASURED
from ..schemas import DEDUP_WATERMARK, MAX_HEARTBEAT_SPACING_S
from .medallion import run

LATE_REPORT_MESSAGE = "This report came too late to be compared with its vehicle."
_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _by_span(df: DataFrame, at: str, own_spans: Column, delay: str) -> DataFrame:
    """A row for each of ``own_spans`` (as ``_span``), under a watermark of ``at`` that drops none of them.

    Spark drops rows behind the watermark before a state with timeouts is asked.  So the instant that moves the watermark
    travels in a row of its own, which ends here, and the rows go on without one.
    """
    clock = F.col(at)
    rows = F.transform(own_spans, lambda s: F.struct(F.lit(None).cast("timestamp").alias("_clock"), s.cast("bigint").alias("_span")))
    tick = F.array(F.struct(clock.alias("_clock"), F.lit(None).cast("bigint").alias("_span")))
    entries = F.when(clock.isNull(), rows).otherwise(F.concat(rows, tick))
    return df.select("*", F.inline(entries)).withWatermark("_clock", delay).where(F.col("_clock").isNull())


# ---------------------------------------------------------------- covered intervals


def covered_intervals_stream(
    heartbeats: DataFrame, delay: str = DEDUP_WATERMARK, max_spacing_s: int = MAX_HEARTBEAT_SPACING_S, span_s: int = 3600
) -> DataFrame:
    """``coverage.covered_intervals`` of a stream: each interval is emitted once, when the watermark has passed its end.

    A heartbeat at or behind the watermark (to the millisecond) cannot change what was emitted: it comes out as a row of
    its own, ``late`` true and from_at = to_at, and covers nothing.  Without an instant it is dropped, as in the batch
    form; heartbeats without a session are one session.  Repeated heartbeats give intervals of no length.

    The state of a (session, span) holds its heartbeats after the watermark and the last one before it.  The newest
    heartbeats wait until the watermark passes them, whichever session moves it.
    """
    if not 0 <= max_spacing_s < span_s:
        raise ValueError("a span must be longer than the spacing limit")
    span_us = span_s * 1_000_000
    # An interval belongs to the span of its start; a heartbeat early in a span may end one that began in the span before.
    own = span_of(F.col("heartbeat_at"), span_s)
    before = F.floor((F.unix_seconds("heartbeat_at") - F.lit(max_spacing_s)) / F.lit(span_s))
    beats = heartbeats.select("session_id", "heartbeat_at").where(F.col("heartbeat_at").isNotNull())
    beats = _by_span(beats, "heartbeat_at", F.array_distinct(F.array(own, before)), delay).withColumn("_us", F.unix_micros("heartbeat_at"))

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, span = group[0], int(group[1])
        mark_ms = state.getCurrentWatermarkMs()
        last, waiting = state.get if state.exists else (None, [])
        fresh = [us for rows in parts for us in rows["_us"].tolist()]
        behind = [us for us in fresh if mark_ms > 0 and us // 1000 <= mark_ms]
        late = [(us, us, True) for us in behind if us // span_us == span]
        waiting = sorted([*waiting, *(us for us in fresh if not (mark_ms > 0 and us // 1000 <= mark_ms))])
        final = bisect_right(waiting, mark_ms * 1000 + 999) if mark_ms > 0 else 0
        chain = ([] if last is None else [last]) + waiting[:final]
        pairs = [
            (a, b, False)
            for a, b in zip(chain, chain[1:])
            if a // span_us == span and b // 1_000_000 - a // 1_000_000 <= max_spacing_s
        ]
        last, waiting = chain[-1] if chain else None, waiting[final:]
        end_ms = ((span + 1) * span_s + max_spacing_s + 1) * 1000
        if waiting or (last is not None and mark_ms < end_ms):
            state.update((last, waiting))
            state.setTimeoutTimestamp(waiting[-1] // 1000 if waiting else end_ms)
        elif state.exists:
            state.remove()
        if not pairs and not late:
            return
        found = pd.DataFrame(pairs + late, columns=["from_at", "to_at", "late"])
        for c in ("from_at", "to_at"):
            found[c] = pd.to_datetime(found[c], unit="us")
        yield found.assign(session_id=session)[["session_id", "from_at", "to_at", "late"]]

    schema = "session_id string, from_at timestamp, to_at timestamp, late boolean"
    return beats.groupBy("session_id", "_span").applyInPandasWithState(
        step, schema, "last bigint, waiting array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


def write_covered(heartbeats: DataFrame, path: str, checkpoint: str, trigger: str | None = None, **options) -> StreamingQuery:
    """The intervals of a stream of heartbeats as a table partitioned by the date of their start."""
    found = covered_intervals_stream(heartbeats, **options).withColumn("from_date", F.to_date("from_at"))
    writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return run(writer.partitionBy("from_date"), trigger)


# ---------------------------------------------------------------- reports as of their moment


def _tie(text: str) -> tuple:
    """Order of measured rows at one instant, that of a struct: unknown first, numbers before NaN and infinity."""
    values = json.loads(text)
    return tuple((values.get(c) is not None, isinstance(values.get(c), str), values.get(c)) for c in MEASURED)


def _with_state(rows: pd.DataFrame, text: str, kept: Sequence[list]) -> pd.DataFrame:
    """The lists of a state, as rows before the new ones."""
    before = pd.DataFrame({"_key": kept[0], "_us": kept[1], text: kept[2]})
    every = pd.concat([before.astype(object), rows[["_key", "_us", text]].astype(object)], ignore_index=True)
    return every.astype({"_us": "int64"})


def snapshot_reports_stream(
    reports: DataFrame, positions: DataFrame, delay: str = DEDUP_WATERMARK, look_back_s: int = 600, span_s: int = 3600, buckets: int = 256
) -> DataFrame:
    """``reports.snapshot_reports`` of two streams: each report with its vehicle's last position at or before it.

    A report waits until the watermark, the lower one of both streams, has passed it, so positions that arrive after it
    still count.  A position older than ``look_back_s`` (whole seconds) is not taken; the batch form has the same parameter.
    A report behind the watermark is given out at once, unmatched, with ``late`` true and the reason in ``rejected``; one
    without vehicle or time at once as on a vehicle not seen.  Late positions still serve reports that wait.

    Of each (vehicle, span) the state holds waiting reports, positions after the watermark and the best one before it.
    Vehicles are many and most are seen rarely, so a call of the state handles all (vehicle, span) of one of ``buckets``,
    by hash; the number never changes the result.
    """
    if not 0 < look_back_s <= span_s:
        raise ValueError("a span must be at least as long as the look-back")
    options = {"timestampFormat": _MICROS}
    report_columns = [c for c in reports.columns if c != "vehicle_id"]
    # A report whose instant is missing has no watermark to wait for; such rows spread by hash.
    placed = F.col("vehicle_id").isNotNull() & F.col("at").isNotNull()
    spread = F.array(-1 - F.pmod(F.xxhash64("report"), F.lit(64)))
    said = reports.select(
        "vehicle_id",
        F.col("reported_at").alias("at"),
        F.to_json(F.struct(*report_columns), options).alias("report"),
        F.lit(None).cast("string").alias("measured"),
    )
    own = span_of(F.col("at"), span_s)
    said = _by_span(said, "at", F.when(placed, F.array(own)).otherwise(spread), delay)
    seen = (
        positions.where(F.col("vehicle_id").isNotNull() & F.col("last_seen_at").isNotNull())
        .select(
            "vehicle_id",
            F.col("last_seen_at").alias("at"),
            F.lit(None).cast("string").alias("report"),
            F.to_json(F.struct(*MEASURED), options).alias("measured"),
        )
    )
    # A report early in the next span may ask for a position late in this one.
    after = F.floor((F.unix_seconds("at") + F.lit(look_back_s)) / F.lit(span_s))
    seen = _by_span(seen, "at", F.array_distinct(F.array(own, after)), delay)
    key = F.concat(F.col("_span").cast("string"), F.lit("|"), F.col("vehicle_id"))
    bucket = F.pmod(F.xxhash64("vehicle_id", "_span"), F.lit(buckets))
    columns = {"_key": F.when(placed, key), "_us": F.coalesce(F.unix_micros("at"), F.lit(0)), "_bucket": bucket}
    both = said.unionByName(seen).withColumns(columns).drop("at", "_span")

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark_ms = state.getCurrentWatermarkMs()
        passed = mark_ms * 1000 + 999 if mark_ms > 0 else -1
        rows = pd.concat([pd.DataFrame([], columns=["vehicle_id", "_key", "_us", "report", "measured"]), *parts], ignore_index=True)
        placed, is_report = rows["_key"].notna(), rows["report"].notna()
        late = is_report & placed & (rows["_us"].astype("int64") <= passed) & (mark_ms > 0)
        kept = state.get if state.exists else ([], [], [], [], [], [])
        waiting = _with_state(rows[is_report & placed & ~late], "report", kept[:3])
        known = _with_state(rows[~is_report], "measured", kept[3:]).drop_duplicates(ignore_index=True)
        # Several rows of a vehicle at one instant are ordered by their values.
        known["_tie"] = 0
        same = known.index[known.duplicated(["_key", "_us"], keep=False)]
        known.loc[sorted(same, key=lambda i: _tie(known.at[i, "measured"])), "_tie"] = range(len(same))
        known = known.sort_values(["_us", "_tie"], ignore_index=True).drop(columns="_tie")
        is_ready = waiting["_us"] <= passed
        ready, waiting = waiting[is_ready].sort_values("_us", kind="stable"), waiting[~is_ready]
        found = pd.merge_asof(ready, known.assign(_seen=known["_us"]), on="_us", by="_key")
        near = found["_seen"].notna() & (found["_us"] // 1_000_000 - found["_seen"].fillna(0).astype("int64") // 1_000_000 <= look_back_s)
        found = found.assign(vehicle_id=found["_key"].str.partition("|")[2] if len(found) else None, measured=found["measured"].where(near, None), late=False)
        at_once = rows.assign(measured=None, late=late)[is_report & (late | ~placed)]
        # Of the positions no waiting report can precede, only the last one can still be the answer, until its span ends.
        past = known["_us"] <= passed
        end_ms = (known["_key"].str.partition("|")[0].astype("int64") + 1) * span_s * 1000 if len(known) else known["_us"]
        open_keys = known["_key"].isin(waiting["_key"])
        known = known[(~past | ~known["_key"].where(past).duplicated(keep="last")) & (open_keys | (end_ms > mark_ms))]
        if len(waiting) or len(known):
            state.update(tuple(part[c].tolist() for part, c in ((waiting, "_key"), (waiting, "_us"), (waiting, "report"), (known, "_key"), (known, "_us"), (known, "measured"))))
            due = [*waiting["_us"] // 1000, *end_ms[known.index[~open_keys[known.index]]]]
            state.setTimeoutTimestamp(max(int(min(due)), mark_ms + 1))
        elif state.exists:
            state.remove()
        for out in (found, at_once):
            if len(out):
                yield out[["vehicle_id", "report", "measured", "late"]]

    matched = both.groupBy("_bucket").applyInPandasWithState(
        step,
        "vehicle_id string, report string, measured string, late boolean",
        "report_key array<string>, report_us array<bigint>, reports array<string>, seen_key array<string>, seen_us array<bigint>, seen array<string>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    report_type = reports.select(F.struct(*report_columns)).schema[0].dataType
    measured_type = positions.select(F.struct(*MEASURED)).schema[0].dataType
    read = matched.withColumns(
        {"report": F.from_json("report", report_type, options), "asof": F.from_json("measured", measured_type, options)}
    )
    why = F.when(F.col("late"), LATE_REPORT_MESSAGE).when(F.col("asof").isNull(), GONE_MESSAGE)
    rejected = F.coalesce(F.col("report.rejected"), why) if "rejected" in report_columns else why
    return read.select(
        *[F.col("report")[c].alias(c) for c in report_columns if c != "rejected"],
        "vehicle_id",
        F.col("asof.mode").alias("mode"),
        F.col("asof.route").alias("route"),
        F.col("asof.direction").alias("direction"),
        F.col("asof.lateness_s").alias("measured_lateness_s"),
        F.col("asof.last_seen_at").alias("measured_last_seen_at"),
        F.col("asof.lat").alias("lat"),
        F.col("asof.long").alias("long"),
        rejected.alias("rejected"),
        "late",
    )


def write_snapshots(reports: DataFrame, positions: DataFrame, path: str, checkpoint: str, trigger: str | None = None, **options) -> StreamingQuery:
    """Reports matched as they stream in, as a table partitioned by the date of the report."""
    found = snapshot_reports_stream(reports, positions, **options).withColumn("report_date", F.to_date("reported_at"))
    writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return run(writer.partitionBy("report_date"), trigger)
