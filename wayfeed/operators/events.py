"""Raw feed rows to typed, routed, checked and deduplicated events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import (
    DEDUP_KEYS,
    DEDUP_WATERMARK,
    HEARTBEAT_BODY,
    INSIDE_REGION,
    PAYLOAD,
    ROW_REQUIRED,
    STOP_EVENT_TYPES,
    STOP_ONLY_COLUMNS,
)


def parse_topic(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Add event_type and mode (levels 5 and 6) and whether the topic has the feed's form."""
    level = F.split(F.col(topic), "/")
    return df.withColumns(
        {
            "event_type": F.get(level, F.lit(5)),
            "mode": F.get(level, F.lit(6)),
            "topic_valid": F.coalesce(
                (F.size(level) >= 7) & (F.get(level, F.lit(1)) == "hfp") & (F.get(level, F.lit(2)) == "v2"),
                F.lit(False),
            ),
        }
    )


def parse_payload(df: DataFrame, payload: str = "payload", into: str = "body") -> DataFrame:
    """Add the body of the one-key payload map as a struct; NULL when unreadable."""
    bodies = F.map_values(F.from_json(F.col(payload), PAYLOAD))
    return df.withColumn(into, F.get(bodies, F.lit(0)))


def timetable_lateness(event_type: Column, tst: Column, arrival: Column, departure: Column) -> Column:
    """Whole seconds behind the timetable, half up; arrivals against the arrival time."""
    planned = F.when(event_type == "arr", arrival).otherwise(departure)
    return F.round((F.unix_micros(tst) - F.unix_micros(planned)) / F.lit(1e6)).cast("int")


def normalize_events(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed events from raw rows of kind ``event``; works on batch and stream.

    Values that cannot be read become NULL, so one bad row never stops a job.  Columns in ``keep`` stay as they are.
    """
    parsed = parse_payload(parse_topic(raw.where(F.col("kind") == "event")))
    b = parsed["body"]
    typed = parsed.select(
        F.when(F.col("topic_valid"), F.col("event_type")).alias("event_type"),
        "mode",
        b["tst"].try_cast("timestamp").alias("tst"),
        F.concat(b["oper"].cast("string"), F.lit("/"), b["veh"].cast("string")).alias("vehicle_id"),
        b["desi"].alias("route"),
        b["dir"].alias("direction"),
        b["oday"].try_cast("date").alias("operating_day"),
        b["start"].alias("journey_start"),
        F.concat_ws("|", b["desi"], b["dir"], b["oday"], b["start"]).alias("journey_id"),
        b["route"].alias("feed_route_id"),
        b["lat"].alias("lat"),
        b["long"].alias("long"),
        b["spd"].alias("speed_ms"),
        b["hdg"].alias("heading"),
        # The feed says how far ahead a vehicle is; Lateness is positive when late.
        (-b["dl"]).alias("lateness_s"),
        b["stop"].alias("stop_id"),
        b["ttarr"].try_cast("timestamp").alias("scheduled_arrival"),
        b["ttdep"].try_cast("timestamp").alias("scheduled_departure"),
        b["loc"].alias("location_source"),
        b["drst"].alias("door_status"),
        b["occu"].alias("occupancy"),
        "received_at",
        "session_id",
        *keep,
    )
    return typed.withColumn(
        "timetable_lateness_s",
        timetable_lateness(
            F.col("event_type"), F.col("tst"), F.col("scheduled_arrival"), F.col("scheduled_departure")
        ),
    )


def parse_heartbeats(raw: DataFrame) -> DataFrame:
    """Heartbeat rows with their running totals."""
    totals = F.from_json("payload", HEARTBEAT_BODY)
    return raw.where(F.col("kind") == "heartbeat").select(
        "session_id",
        F.col("received_at").alias("heartbeat_at"),
        totals["received_total"].alias("received_total"),
        totals["dropped_total"].alias("dropped_total"),
    )


def dedup_events(events: DataFrame) -> DataFrame:
    """One row per (vehicle, event type, event time).

    A stream keeps two minutes of state and drops what is later than that.  A
    batch keeps the copy received first, whatever the order of the input.
    """
    if events.isStreaming:
        return events.withWatermark("tst", DEDUP_WATERMARK).dropDuplicatesWithinWatermark(DEDUP_KEYS)
    others = [c for c in events.columns if c not in DEDUP_KEYS and c != "received_at"]
    first = F.min(F.struct("received_at", *others)).alias("first")
    return events.groupBy(*DEDUP_KEYS).agg(first).select(
        *[F.col(c) if c in DEDUP_KEYS else F.col(f"first.{c}").alias(c) for c in events.columns]
    )


def dedup_keyed(events: DataFrame) -> DataFrame:
    """The stream of :func:`dedup_events` for rows with all keys; what lacks one cannot have copies and stays, row by row.

    Both kinds come out of one exchange, so each row is parsed once.  A filter on columns would move below the exchange and
    make two of it; on columns of a generator (the mark, and the type that ``route_events`` asks for) it stays above.
    """
    known = F.col(DEDUP_KEYS[0]).isNotNull()
    for c in DEDUP_KEYS[1:]:
        known = known & F.col(c).isNotNull()
    marks = F.inline(F.array(F.struct(known.alias("__keyed"), F.col("event_type").alias("__type"))))
    dealt = events.repartition(*DEDUP_KEYS).select("*", marks)
    keyed, others = dealt.where("__keyed"), dealt.where("not __keyed").withColumn("event_type", F.col("__type"))
    # Fresh names, else the union would hold on to columns of its first side and the exchanges would differ in them.
    kept = dedup_events(keyed.drop("__keyed", "__type")).select(*[F.col(c).alias(c) for c in events.columns])
    return kept.unionByName(others.drop("__keyed", "__type"))


def _broken(rules: Mapping[str, str]) -> Column:
    """Names of the rules a row breaks; a rule that is NULL counts as broken."""
    named = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return F.array_compact(F.array(*named))


def expect_or_drop(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rows that keep all rules."""
    return df.where(F.size(_broken(rules)) == 0)


def quarantine(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rows that break a rule, with the names of the broken ones."""
    return df.withColumn("failed_rules", _broken(rules)).where(F.size("failed_rules") > 0)


def expect_warn(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Per rule, how many rows were checked and how many broke it; one pass, nothing dropped."""
    counted = df.agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(f"broken_{i}") for i, r in enumerate(rules.values())],
    )
    per_rule = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.col(f"broken_{i}").alias("failed")) for i, n in enumerate(rules)]
    )
    return counted.select("checked", F.inline(per_rule)).select("rule", "checked", "failed")


def observe_rules(df: DataFrame, name: str, rules: Mapping[str, str]) -> DataFrame:
    """The streaming twin of :func:`expect_warn`: counts show up in the query's progress."""
    return df.observe(
        name,
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(n) for n, r in rules.items()],
    )


def event_stream_name(event_type: Column) -> Column:
    """Which typed table an event belongs to."""
    return F.when(event_type == "vp", "position").when(event_type.isin(STOP_EVENT_TYPES), "stop")


def route_events(events: DataFrame) -> DataFrame:
    """Tag each event with its table and the drop rules it breaks.

    One parse and one dedup feed both tables; a sink partitioned by
    ``stream`` lets each reader scan only its own part.  ``rejected`` rows
    stay visible, those with a malformed topic among them.  Event types outside
    the feed's four are left out.
    """
    named = F.when(F.col("event_type").isNull(), F.lit("rejected")).otherwise(event_stream_name(F.col("event_type")))
    routed = events.withColumn("stream", named).where(F.col("stream").isNotNull())
    broken = F.when(F.col("stream") == "position", _broken({**ROW_REQUIRED, **INSIDE_REGION})).otherwise(
        _broken(ROW_REQUIRED)
    )
    return routed.withColumn("failed_rules", broken).withColumn(
        "stream", F.when(F.size("failed_rules") > 0, "rejected").otherwise(F.col("stream"))
    )


def position_events(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("stream") == "position").drop("stream", "failed_rules", *STOP_ONLY_COLUMNS)


def stop_events(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("stream") == "stop").drop("stream", "failed_rules")
