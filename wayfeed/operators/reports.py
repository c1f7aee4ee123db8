"""Rider Reports: cleaning, the as-of snapshot, rate limits, comparison with measurements."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import instant, on_days, seconds
from ..functions.status import ON_TIME_EARLY_S, ON_TIME_LATE_S, age_fraction_s, on_time, squash
from ..schemas import NOTE_MAX, REPORT_CATEGORIES
from ..sources.paths import shared_dir
from .ordered import with_last_known

# Limits and the texts a rider sees.
PER_HOUR_LIMIT = 20
LIMIT_WINDOW_S = 3600
SAME_VEHICLE_WINDOW_S = 120
RECENT_S = 1800
RECENT_MAX = 200
VEHICLE_MESSAGE = "You reported this vehicle in the last {minutes} minutes. Try again shortly."
HOURLY_MESSAGE = "You've sent {limit} reports in the last hour, the limit. Try again later."
GONE_MESSAGE = "That vehicle is no longer on the map."

MEASURED = ["mode", "route", "direction", "lateness_s", "last_seen_at", "lat", "long"]


def clean_reports(reports: DataFrame) -> DataFrame:
    """Hash the reporter, tidy the note, check the category.

    ``email`` never leaves this operator.  Rows with an unknown category, or
    without reporter or time, stay, with ``rejected`` saying why.
    """
    email = F.lower(F.regexp_replace("email", r"^\s+|\s+$", ""))
    note = F.nullif(F.substring(squash(F.col("note")), 1, NOTE_MAX), F.lit(""))
    known = F.coalesce(F.col("category").isin(REPORT_CATEGORIES), F.lit(False))
    unsigned = F.col("email").isNull()
    if "reported_at" in reports.columns:
        unsigned = unsigned | F.col("reported_at").isNull()
    return reports.withColumns(
        {
            "reporter_id": F.sha2(email, 256),
            "note": note,
            "rejected": F.when(
                ~known, F.concat(F.lit("Unknown category "), F.coalesce("category", F.lit("")), F.lit("."))
            ).when(unsigned, F.lit(NO_REPORTER_MESSAGE)),
        }
    ).drop("email")


def snapshot_reports(reports: DataFrame, positions: DataFrame, span_s: int = 3600, look_back_s: int | None = None) -> DataFrame:
    """Each report with what was measured for its vehicle at that moment (an as-of join).

    Reports and positions are interleaved in time per vehicle and the last
    position is carried forward; a busy vehicle is cut into time spans.
    ``positions`` are current-state rows (see ``current_columns``).  A report
    on a vehicle not seen before it gets ``rejected``.

    With ``look_back_s`` a position more than that many whole seconds older than its report does not count, and
    only positions of the reports' own time, and that much before it, are read (whole dates where there is an
    ``event_date``).
    """
    if look_back_s is not None:
        when = F.unix_seconds("reported_at")
        ends = reports.agg(F.min(when).alias("first"), F.max(when).alias("last"))
        since = F.timestamp_seconds(ends.select("first").scalar() - F.lit(look_back_s))
        until = F.timestamp_seconds(ends.select("last").scalar() + F.lit(1))
        at = F.col("last_seen_at")
        positions = on_days(positions.where((at >= since) & (at < until)), "event_date", since, until)
    report_columns = [c for c in reports.columns if c != "vehicle_id"]
    said = reports.select(
        "vehicle_id",
        F.col("reported_at").alias("at"),
        F.lit(1).alias("is_report"),
        F.struct(*report_columns).alias("report"),
        F.lit(None).cast(positions.select(F.struct(*MEASURED)).schema[0].dataType).alias("measured"),
    )
    seen = positions.where(F.col("vehicle_id").isNotNull()).select(
        "vehicle_id",
        F.col("last_seen_at").alias("at"),
        F.lit(0).alias("is_report"),
        F.lit(None).cast(said.schema["report"].dataType).alias("report"),
        F.struct(*MEASURED).alias("measured"),
    )
    # Positions at the very instant of a report count; the measured row breaks their ties.
    carried = with_last_known(
        said.unionByName(seen),
        ["vehicle_id"],
        "at",
        F.col("measured"),
        "asof",
        span_s,
        tie=["is_report", "measured"],
    ).where("is_report = 1")
    if look_back_s is not None:
        age = F.unix_seconds("at") - F.unix_seconds("asof.last_seen_at")
        carried = carried.withColumn("asof", F.when(age <= look_back_s, F.col("asof")))
    gone = F.when(F.col("asof").isNull(), F.lit(GONE_MESSAGE))
    rejected = F.coalesce(F.col("report.rejected"), gone) if "rejected" in reports.columns else gone
    keep = [F.col(f"report.{c}").alias(c) for c in report_columns if c != "rejected"]
    return carried.select(
        *keep,
        "vehicle_id",
        F.col("asof.mode").alias("mode"),
        F.col("asof.route").alias("route"),
        F.col("asof.direction").alias("direction"),
        F.col("asof.lateness_s").alias("measured_lateness_s"),
        F.col("asof.last_seen_at").alias("measured_last_seen_at"),
        F.col("asof.lat").alias("lat"),
        F.col("asof.long").alias("long"),
        rejected.alias("rejected"),
    )


# ---------------------------------------------------------------- rate limits

_VERDICTS = T.StructType(
    [
        T.StructField("report_id", T.LongType()),
        T.StructField("reporter_id", T.StringType()),
        T.StructField("vehicle_id", T.StringType()),
        T.StructField("reported_at", T.TimestampType()),
        T.StructField("verdict", T.StringType()),
    ]
)
NO_REPORTER_MESSAGE = "A report needs a reporter and a time."


_STATE = T.StructType(
    [
        T.StructField("segment", T.LongType()),
        T.StructField("accepted", T.ArrayType(T.LongType())),
        T.StructField("vehicles", T.ArrayType(T.StringType())),
        T.StructField("last_us", T.ArrayType(T.LongType())),
    ]
)
_JUDGED = T.StructType([*_VERDICTS.fields, *_STATE.fields])


def _judge_in_order(limit: int, window_s: float, vehicle_s: float):
    """Sequential rule over rows in order of (reporter, segment, time, id).

    What it keeps is one segment's accepted reports of the last window and its
    last accepted report per vehicle, so memory does not grow with a segment.
    A row with ``accepted`` set, before a segment's reports, is the state it
    begins with; behind each segment comes such a row with the state it ends with.
    """
    hour_us, vehicle_us = int(window_s * 1_000_000), int(vehicle_s * 1_000_000)
    columns = [f.name for f in _JUDGED]

    def ending(segment, now, accepted, by_vehicle) -> pd.DataFrame:
        kept = [t for t in accepted if t > now - hour_us]
        live = {v: t for v, t in by_vehicle.items() if t > now - vehicle_us}
        row = dict.fromkeys(columns) | {"reporter_id": segment[0], "segment": segment[1], "accepted": kept, "vehicles": list(live), "last_us": list(live.values())}
        return pd.DataFrame([row]).astype({"report_id": "Int64", "reported_at": "datetime64[us, UTC]"})

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, now, accepted, by_vehicle = None, 0, deque(), {}
        for rows in batches:
            at = rows["at_us"]
            verdicts, ended = [], []
            for own, t, vehicle, counts, state in zip(
                zip(rows["reporter_id"], rows["segment"]), at, rows["vehicle_id"], rows["counts"], zip(rows["accepted"], rows["vehicles"], rows["last_us"])
            ):
                if own != segment:
                    if segment is not None:
                        ended.append(ending(segment, now, accepted, by_vehicle))
                    segment, accepted, by_vehicle = own, deque(), {}
                if state[0] is not None:
                    accepted, by_vehicle = deque(int(x) for x in state[0]), dict(zip(state[1], (int(x) for x in state[2])))
                    verdicts.append(None)
                    continue
                now = t
                while accepted and accepted[0] <= now - hour_us:
                    accepted.popleft()
                before = by_vehicle.get(vehicle)
                if before is not None and before > now - vehicle_us:
                    verdict = "vehicle_limit"
                elif len(accepted) >= limit:
                    verdict = "hourly_limit"
                else:
                    verdict = "accepted"
                    if counts:
                        accepted.append(now)
                        by_vehicle[vehicle] = now
                        if len(by_vehicle) > 2 * limit + 1000:
                            by_vehicle = {v: x for v, x in by_vehicle.items() if x > now - vehicle_us}
                verdicts.append(verdict)
            judged = rows.assign(verdict=verdicts, accepted=None, vehicles=None, last_us=None)[columns]
            yield judged[judged["verdict"].notna()]
            yield from ended
        if segment is not None:
            yield ending(segment, now, accepted, by_vehicle)

    return judge


def _judged(rows: DataFrame, rule) -> DataFrame:
    """Rows judged in order, each reporter's segment by one task."""
    own = ["reporter_id", "segment"]
    ready = rows.withColumn("at_us", F.coalesce(F.unix_micros("reported_at"), F.lit(0)))
    ordered = ready.repartition(*own).sortWithinPartitions(*own, F.col("accepted").isNull(), "reported_at", "report_id")
    return ordered.mapInPandas(rule, _JUDGED)


def _in_rounds(rows: DataFrame, rule, out: list[str]) -> DataFrame:
    """Verdicts of segments cut into parts: a round judges the next part of every segment, from the state the last one left.

    ``rows`` have ``chunk``; parts are numbered per segment.  Rows, verdicts and states of a round are tables in the
    shared folder.  There are as many rounds as the longest segment has parts.
    """
    spark, own = rows.sparkSession, ["reporter_id", "segment"]
    path = shared_dir(spark, "rate-limit")
    parts = rows.select(*own, "chunk").distinct()
    numbered = parts.withColumn("part", F.row_number().over(Window.partitionBy(*own).orderBy("chunk")) - 1)
    rows.join(numbered, [*own, "chunk"]).drop("chunk").write.partitionBy("part").parquet(f"{path}/rows")
    todo = spark.read.schema(T.StructType([*[f for f in rows.schema.fields if f.name != "chunk"], T.StructField("part", T.IntegerType())])).parquet(f"{path}/rows")
    last = todo.agg(F.max("part")).first()[0]
    state = None
    for part in range(0 if last is None else last + 1):
        now = todo.where(F.col("part") == part).drop("part")
        if state is not None:
            now = now.unionByName(state.join(now.select(*own).distinct(), own, "left_semi"), allowMissingColumns=True)
        _judged(now, rule).write.parquet(f"{path}/judged/part={part}")
        done = spark.read.schema(_JUDGED).parquet(f"{path}/judged/part={part}")
        state = done.where("accepted is not null").select("reporter_id", *[f.name for f in _STATE])
    if last is None:
        return spark.createDataFrame([], _VERDICTS)
    return spark.read.schema(T.StructType([*_JUDGED.fields, T.StructField("part", T.IntegerType())])).parquet(f"{path}/judged").where("verdict is not null").select(out)


def _timeline(rows: DataFrame, limit: int, window_s: int, vehicle_s: int) -> DataFrame:
    """Per reporter and time slot: its segment, and whether a limit can bite in it.

    Built from counts per (reporter, vehicle, slot), so its size depends on the
    time covered and not on how many reports a reporter sends.  A slot is as
    long as the same-vehicle window.  Segments are separated by more than both
    windows without reports, hence independent of each other.
    """
    look_back = max(ceil(window_s / vehicle_s), 1)
    slots = rows.groupBy("reporter_id", "vehicle_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    per_vehicle = Window.partitionBy("reporter_id", "vehicle_id").orderBy("slot")
    close = (F.col("n") > 1) | F.coalesce(F.col("slot") - F.lag("slot").over(per_vehicle) <= 1, F.lit(False))
    per_slot = (
        slots.withColumn("close", close)
        .groupBy("reporter_id", "slot")
        .agg(F.sum("n").alias("n"), F.max("close").alias("close"))
    )
    in_time = Window.partitionBy("reporter_id").orderBy("slot")
    busy = F.sum("n").over(in_time.rangeBetween(-look_back, 0)) > limit
    opens = F.coalesce(F.col("slot") - F.lag("slot").over(in_time) > look_back, F.lit(True))
    segments = (
        per_slot.withColumn("risky", F.col("close") | busy)
        .withColumn("opens", opens.cast("bigint"))
        .withColumn("segment", F.sum("opens").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    )
    whole = Window.partitionBy("reporter_id", "segment")
    earlier = whole.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return segments.select(
        "reporter_id", "slot", "segment", F.max("risky").over(whole).alias("risky"),
        F.col("n").alias("in_slot"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("in_segment"),
    )


def rate_limit(
    reports: DataFrame,
    limit: int = PER_HOUR_LIMIT,
    window_s: int = LIMIT_WINDOW_S,
    vehicle_window_s: int = SAME_VEHICLE_WINDOW_S,
    per_task: int = 500_000,
) -> DataFrame:
    """Verdict per report: accepted, vehicle_limit or hourly_limit; rejected reports do not count.

    The rule is sequential: whether a report counts depends on the verdicts
    before it.  Most reporters never come near a limit, and counts of submitted
    reports prove it: those segments are accepted in plain columns.  Only
    segments where a limit can bite are judged in order: Spark sorts them (and
    spills), and a task streams over them with the state of one segment.  A
    segment of more than ``per_task`` reports is cut in time into parts of about
    that many (twice at most, but for reports of one millisecond) and judged in
    rounds: each part begins with what the part before left, at most ``limit`` accepted
    reports and the vehicles among them.  So no task gets more than a part,
    whatever share of the rows one reporter has; the rounds follow each other.

    A report without reporter or time is ``unknown`` and takes no part.  An
    optional boolean column ``counts`` marks reports that are judged but never
    stored (their vehicle is unknown), so they use up no allowance.
    """
    rows = reports if "counts" in reports.columns else reports.withColumn("counts", F.lit(True))
    slot_us = F.lit(int(vehicle_window_s * 1_000_000))
    rows = rows.select("report_id", "reporter_id", "vehicle_id", "reported_at", "counts")
    whole = F.col("reporter_id").isNotNull() & F.col("reported_at").isNotNull()
    known = rows.where(whole).withColumn("slot", F.floor(F.unix_micros("reported_at") / slot_us))
    placed = known.join(_timeline(known, limit, window_s, vehicle_window_s), ["reporter_id", "slot"])
    out = [f.name for f in _VERDICTS]
    clear = placed.where(~F.col("risky")).withColumn("verdict", F.lit("accepted")).select(out)
    rule = _judge_in_order(limit, window_s, vehicle_window_s)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in _STATE.fields if f.name != "segment"]
    risky = placed.where("risky").select(
        "reporter_id", "segment", "report_id", "vehicle_id", "reported_at", "counts", "in_slot", "before", "in_segment", "slot", *empty
    )
    base = ["reporter_id", "segment", "report_id", "vehicle_id", "reported_at", "counts", *[f.name for f in _STATE.fields if f.name != "segment"]]
    judged = _judged(risky.where(F.col("in_segment") <= per_task).select(base), rule).where("verdict is not null").select(out)
    # Slots of a part follow each other; a slot that is a part and more is cut where its counts by millisecond say so.
    placed_ms = risky.where(F.col("in_segment") > per_task).withColumn("ms", F.floor((F.unix_micros("reported_at") - F.col("slot") * slot_us) / 1000))
    counts = placed_ms.where(F.col("in_slot") > per_task).groupBy("reporter_id", "slot", "ms").count()
    sooner = Window.partitionBy("reporter_id", "slot").orderBy("ms").rowsBetween(Window.unboundedPreceding, -1)
    pieces = counts.select("reporter_id", "slot", "ms", F.floor(F.coalesce(F.sum("count").over(sooner), F.lit(0)) / per_task).alias("piece"))
    chunk = F.struct(F.floor(F.col("before") / per_task).alias("part"), F.coalesce("piece", F.lit(0)).alias("piece"))
    long = placed_ms.join(pieces, ["reporter_id", "slot", "ms"], "left").select(*base, chunk.alias("chunk"))
    if known.groupBy("reporter_id").count().where(F.col("count") > per_task).limit(1).count():
        judged = judged.unionByName(_in_rounds(long, rule, out))
    unknown = rows.where(~whole).withColumn("verdict", F.lit("unknown")).select(out)
    verdict = F.col("verdict")
    message = (
        F.when(
            verdict == "vehicle_limit",
            F.lit(VEHICLE_MESSAGE.format(minutes=f"{vehicle_window_s / 60:g}")),
        )
        .when(verdict == "hourly_limit", F.lit(HOURLY_MESSAGE.format(limit=limit)))
        .when(verdict == "unknown", F.lit(NO_REPORTER_MESSAGE))
    )
    return clear.unionByName(judged).unionByName(unknown).withColumn("message", message)


def add_reports(reports: DataFrame, positions: DataFrame, span_s: int = 3600, **limits) -> DataFrame:
    """The whole intake: clean, look up, limit.  ``rejected`` is NULL for stored reports.

    Checks come in this order: category, rate limits, vehicle on the map.
    """
    looked_up = snapshot_reports(clean_reports(reports), positions, span_s)
    known = looked_up.where(F.col("rejected").isNull() | (F.col("rejected") == GONE_MESSAGE))
    verdicts = rate_limit(known.withColumn("counts", F.col("rejected").isNull()), **limits)
    return (
        looked_up.join(verdicts.select("report_id", "message"), "report_id", "left")
        .withColumn("rejected", F.coalesce("message", "rejected"))
        .drop("message")
    )


def recent_reports(reports: DataFrame, as_of, within_s: int = RECENT_S, k: int = RECENT_MAX) -> DataFrame:
    """The newest reports of the last half hour with their age."""
    now = instant(as_of)
    return (
        reports.where(F.col("reported_at") > now - seconds(within_s))
        .withColumn("age_s", age_fraction_s(F.col("reported_at"), now))
        .orderBy(F.desc("reported_at"), F.desc("report_id"))
        .limit(k)
    )


def reports_vs_measured(reports: DataFrame, early_s: int = ON_TIME_EARLY_S, late_s: int = ON_TIME_LATE_S) -> DataFrame:
    """Per category: what was measured for the reported vehicles."""
    measured = F.col("measured_lateness_s")
    return (
        reports.groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("reports"),
            F.round(F.avg(measured)).alias("avg_measured_lateness_s"),
            F.count_if(on_time(measured, early_s, late_s)).alias("measured_on_time"),
            F.count_if(measured > late_s).alias("measured_late"),
            F.count_if(measured.isNull()).alias("lateness_not_published"),
        )
        .orderBy(F.desc("reports"), "category")
    )
