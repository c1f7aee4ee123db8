"""Raw messages: topics, payloads, typing, dedup, quality, heartbeats, recordings, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from ..operators import events as ev
from ..schemas import LATENESS_PLAUSIBLE, ROW_REQUIRED
from ..sources import feed
from ..sources.paths import shared_dir
from .departures import SQL_ENRICHED, enriched
from .registry import query
from .views import (
    PARSED_COLUMNS,
    SQL_HEARTBEATS,
    SQL_PARSED,
    heartbeat_rows,
    load,
    messages,
    sql_sec,
)


def _n():
    return F.count(F.lit(1)).alias("n")


@query(
    "topic_parse",
    f"""WITH {SQL_PARSED}
SELECT event_type, mode, event_type IN ('vp', 'arr', 'pde', 'dep') AS topic_valid, count(*) AS n
FROM copies GROUP BY 1, 2, 3
UNION ALL SELECT NULL, NULL, false, count(*) FROM events""",
)
def topic_parse(spark, sf_dir):
    """All message topics, and one short foreign topic per event that must be refused."""
    short = load(spark, sf_dir, "events").select(F.concat(F.lit("/gtfsrt/vp/"), "event_type").alias("topic"))
    topics = messages(spark, sf_dir).select("topic").unionAll(short)
    return ev.parse_topic(topics).groupBy("event_type", "mode", "topic_valid").agg(_n())


@query(
    "topic_filter",
    f"""WITH {SQL_PARSED}
SELECT 'default' AS subscription, mode, event_type, count(*) AS n FROM copies GROUP BY 2, 3
UNION ALL SELECT 'two', mode, event_type, count(*) FROM copies
  WHERE (event_type = 'dep' AND mode = 'tram') OR event_type = 'arr' GROUP BY 2, 3""",
)
def topic_filter(spark, sf_dir):
    rows = messages(spark, sf_dir).select("topic")

    def under(name, option):
        kept = ev.parse_topic(feed.filter_topics(rows, option))
        return kept.groupBy("mode", "event_type").agg(_n()).withColumn("subscription", F.lit(name))

    two = " /hfp/v2/journey/ongoing/dep/tram/# , /hfp/v2/journey/ongoing/arr/+/#"
    return under("default", "").unionByName(under("two", two))


@query(
    "payload_json",
    f"""WITH {SQL_PARSED}
SELECT route AS desi, direction AS dir, CAST(40 AS INTEGER) AS oper,
       CASE WHEN vehicle_id IS NOT NULL THEN CAST(split_part(vehicle_id, '/', 2) AS INTEGER) END AS veh,
       lat, long, speed_ms AS spd, -lateness_s AS dl, stop_id AS stop, received_at
FROM copies""",
)
def payload_json(spark, sf_dir):
    body = ev.parse_payload(messages(spark, sf_dir))
    fields = ["desi", "dir", "oper", "veh", "lat", "long", "spd", "dl", "stop"]
    return body.select(*[F.col(f"body.{f}").alias(f) for f in fields], "received_at")


@query("normalize_events", f"WITH {SQL_PARSED} SELECT {PARSED_COLUMNS} FROM copies")
def normalize_events(spark, sf_dir):
    return ev.normalize_events(messages(spark, sf_dir))


@query("dedup_events", f"""WITH {SQL_PARSED}
SELECT * EXCLUDE (rn) FROM (
  SELECT {PARSED_COLUMNS}, row_number() OVER (
    PARTITION BY vehicle_id, event_type, tst
    ORDER BY received_at, mode, route, direction, operating_day, journey_start) AS rn
  FROM copies) WHERE rn = 1""")
def dedup_events(spark, sf_dir):
    """Rows without a vehicle or time share one key and collapse like any other key."""
    return ev.dedup_events(ev.normalize_events(messages(spark, sf_dir)))


@query(
    "lateness_sign",
    f"""WITH {SQL_PARSED}
SELECT event_type, count(*) AS n, count(lateness_s) AS known, min(lateness_s) AS least, max(lateness_s) AS most,
       CAST(sum(lateness_s) AS BIGINT) AS total
FROM copies GROUP BY 1""",
)
def lateness_sign(spark, sf_dir):
    late = F.col("lateness_s")
    return (
        ev.normalize_events(messages(spark, sf_dir))
        .groupBy("event_type")
        .agg(
            _n(),
            F.count(late).alias("known"),
            F.min(late).alias("least"),
            F.max(late).alias("most"),
            F.sum(late).alias("total"),
        )
    )


@query(
    "timetable_lateness",
    f"""WITH {SQL_PARSED}
SELECT event_type, timetable_lateness_s, count(*) AS n FROM copies WHERE event_type <> 'vp' GROUP BY 1, 2""",
)
def timetable_lateness(spark, sf_dir):
    typed = ev.normalize_events(messages(spark, sf_dir)).where(F.col("event_type") != "vp")
    return typed.groupBy("event_type", "timetable_lateness_s").agg(_n())


_ROUTED = f"""{SQL_PARSED},
deduped AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY vehicle_id, event_type, tst
      ORDER BY received_at, mode, route, direction, operating_day, journey_start) AS rn FROM copies) WHERE rn = 1
),
routed AS (
  SELECT *, tst IS NOT NULL AND vehicle_id IS NOT NULL AS complete,
         event_type <> 'vp' OR (lat BETWEEN 59.9 AND 60.6 AND long BETWEEN 24.2 AND 25.6) AS inside
  FROM deduped
)"""


def routed(spark, sf_dir):
    return ev.route_events(ev.dedup_events(ev.normalize_events(messages(spark, sf_dir))))


@query(
    "event_routing",
    f"""WITH {_ROUTED}
SELECT CASE WHEN NOT (complete AND inside) THEN 'rejected' WHEN event_type = 'vp' THEN 'position' ELSE 'stop' END AS stream,
       event_type, mode, count(*) AS n, count(DISTINCT vehicle_id) AS vehicles
FROM routed GROUP BY 1, 2, 3""",
)
def event_routing(spark, sf_dir):
    return (
        routed(spark, sf_dir)
        .groupBy("stream", "event_type", "mode")
        .agg(_n(), F.count_distinct("vehicle_id").alias("vehicles"))
    )


@query(
    "position_events",
    f"""WITH {_ROUTED}
SELECT event_type, mode, tst, vehicle_id, route, direction, operating_day, journey_start, journey_id, feed_route_id,
       lat, long, speed_ms, heading, lateness_s, location_source, door_status, occupancy, received_at, session_id
FROM routed WHERE event_type = 'vp' AND complete AND inside""",
)
def position_events(spark, sf_dir):
    return ev.position_events(routed(spark, sf_dir))


@query(
    "stop_events",
    f"WITH {_ROUTED} SELECT {PARSED_COLUMNS} FROM routed WHERE event_type <> 'vp' AND complete",
)
def stop_events(spark, sf_dir):
    return ev.stop_events(routed(spark, sf_dir))


@query(
    "quality_drop",
    f"""WITH {_ROUTED}
SELECT event_type, concat_ws(',', CASE WHEN tst IS NULL THEN 'tst_present' END,
         CASE WHEN vehicle_id IS NULL THEN 'vehicle_id_present' END,
         CASE WHEN NOT inside THEN 'inside_helsinki_region' END) AS failed_rules, count(*) AS n
FROM routed WHERE NOT (complete AND inside) GROUP BY 1, 2""",
)
def quality_drop(spark, sf_dir):
    rejected = routed(spark, sf_dir).where(F.col("stream") == "rejected")
    named = F.array_join("failed_rules", ",").alias("failed_rules")
    return rejected.groupBy("event_type", named).agg(_n())


@query(
    "quality_metrics",
    f"""WITH {SQL_PARSED}
SELECT 'lateness_plausible' AS rule, count(*) AS checked,
       count(*) FILTER (WHERE NOT (lateness_s IS NULL OR abs(lateness_s) <= 3600)) AS failed FROM copies
UNION ALL SELECT 'tst_present', count(*), count(*) FILTER (WHERE tst IS NULL) FROM copies
UNION ALL SELECT 'vehicle_id_present', count(*), count(*) FILTER (WHERE vehicle_id IS NULL) FROM copies""",
)
def quality_metrics(spark, sf_dir):
    return ev.expect_warn(ev.normalize_events(messages(spark, sf_dir)), {**LATENESS_PLAUSIBLE, **ROW_REQUIRED})


@query("heartbeat_parse", f"WITH {SQL_HEARTBEATS} SELECT * FROM heartbeats")
def heartbeat_parse(spark, sf_dir):
    return ev.parse_heartbeats(heartbeat_rows(spark, sf_dir))


_LEDGER_STEP = 600


@query(
    "heartbeat_ledger",
    f"""WITH sessions AS (
  SELECT event_type AS session_id, min(ts) - INTERVAL 1 HOUR AS started_at, max(ts) + INTERVAL 1 HOUR AS ended_at
  FROM events GROUP BY 1
),
spine AS (
  SELECT session_id, unnest(generate_series(started_at, ended_at, INTERVAL {_LEDGER_STEP} SECOND)) AS received_at
  FROM sessions
),
running AS (
  SELECT event_type AS session_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n,
         sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts) AS d
  FROM events
)
SELECT 'heartbeat' AS kind, s.session_id, s.received_at,
       '{{"received_total":' || coalesce(r.n, 0) || ',"dropped_total":' || coalesce(r.d, 0) || '}}' AS payload
FROM spine s ASOF LEFT JOIN running r ON s.session_id = r.session_id AND s.received_at >= r.ts""",
)
def heartbeat_ledger(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(
        F.col("event_type").alias("session_id"),
        F.col("ts").alias("received_at"),
        (F.col("value") < 5).cast("int").alias("dropped"),
    )
    sessions = e.groupBy("session_id").agg(
        (F.min("received_at") - F.expr("INTERVAL 1 HOUR")).alias("started_at"),
        (F.max("received_at") + F.expr("INTERVAL 1 HOUR")).alias("ended_at"),
    )
    return feed.heartbeat_ledger(e, sessions, every_s=_LEDGER_STEP).drop("topic")


@query(
    "envelope",
    f"""WITH {SQL_PARSED}
SELECT 'event' AS kind, 's1' AS session_id, count(*) AS n, min(received_at) AS first_at, max(received_at) AS last_at
FROM copies""",
)
def envelope(spark, sf_dir):
    recorded = messages(spark, sf_dir).select("topic", "payload", "received_at")
    return (
        feed.with_envelope(recorded, "s1")
        .groupBy("kind", "session_id")
        .agg(_n(), F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"))
    )


@query(
    "record_by_minute",
    f"""WITH {SQL_PARSED}
SELECT strftime(received_at, '%Y%m%dT%H%M') AS minute, event_type, count(*) AS n, max(received_at) AS last_at
FROM copies GROUP BY 1, 2""",
)
def record_by_minute(spark, sf_dir):
    """Write the messages to one folder per hour received, and read the recording back."""
    path = shared_dir(spark, "recording")
    recorded = messages(spark, sf_dir).select("topic", "payload", "received_at")
    feed.record_by_minute(recorded, path, unit="hour")
    back = ev.parse_topic(feed.read_recording(spark, path))
    exact = F.date_format("received_at", "yyyyMMdd'T'HHmm").alias("minute")
    return back.groupBy(exact, "event_type").agg(_n(), F.max("received_at").alias("last_at"))


@query(
    "bronze_counts",
    f"""WITH {SQL_PARSED}
SELECT (SELECT count(*) FROM copies) AS events, (SELECT count(*) FROM events) AS heartbeats,
       (SELECT count(DISTINCT event_type) FROM events) AS sessions""",
)
def bronze_counts(spark, sf_dir):
    return checks.bronze_counts(messages(spark, sf_dir).unionByName(heartbeat_rows(spark, sf_dir)))


@query(
    "feed_profile",
    f"""WITH {SQL_PARSED},
grid AS (SELECT e AS event_type, m AS mode FROM (VALUES ('vp'), ('arr'), ('pde'), ('dep')) a(e), (VALUES ('tram'), ('metro')) b(m)),
seen AS (
  SELECT event_type, mode, count(*) AS n, count(DISTINCT coalesce(vehicle_id, '40')) AS v,
         count(*) FILTER (WHERE lateness_s IS NULL) AS u FROM copies GROUP BY 1, 2
)
SELECT event_type, mode, coalesce(n, 0) AS messages, round(coalesce(n, 0) / 2592000.0, 2) AS per_s,
       coalesce(v, 0) AS distinct_vehicles, round(100 * u / n, 1) AS pct_lateness_null, coalesce(n, 0) > 0 AS has_messages,
       CASE WHEN event_type = 'vp' THEN coalesce(round(100 * u / n, 1), 100) < 5 END AS has_lateness
FROM grid LEFT JOIN seen USING (event_type, mode)""",
)
def feed_profile(spark, sf_dir):
    return checks.feed_profile(messages(spark, sf_dir), elapsed_s=30 * 86_400)


@query(
    "duplicate_ratio",
    f"""WITH {SQL_PARSED}
SELECT mode, count(*) AS messages, count(DISTINCT event_id) AS distinct_payloads,
       round(count(*) / count(DISTINCT event_id), 2) AS copies_per_payload
FROM copies WHERE event_type = 'vp' GROUP BY 1""",
)
def duplicate_ratio(spark, sf_dir):
    """Bodies with an unreadable time may be equal by chance only when all else is equal too."""
    return checks.duplicate_ratio(messages(spark, sf_dir))


@query(
    "match_rates",
    f"""WITH {SQL_ENRICHED}
SELECT count(*) AS departures, round(100 * count(stop_name) / count(*), 1) AS pct_stop_matched,
       round(100 * count(route_name) / count(*), 1) AS pct_route_matched,
       count(DISTINCT CASE WHEN stop_name IS NULL THEN stop_id END) AS unmatched_stops,
       count(DISTINCT CASE WHEN route_name IS NULL THEN route END) AS unmatched_routes
FROM departures""",
)
def match_rates(spark, sf_dir):
    return checks.match_rates(enriched(spark, sf_dir))


@query(
    "unmatched_ids",
    f"""WITH {SQL_ENRICHED}
SELECT 'stop' AS kind, stop_id AS id, count(*) AS departures FROM departures
WHERE stop_name IS NULL AND stop_id IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'route', route, count(*) FROM departures WHERE route_name IS NULL AND route IS NOT NULL GROUP BY 2""",
)
def unmatched_ids(spark, sf_dir):
    return checks.unmatched_ids(enriched(spark, sf_dir))


@query(
    "lateness_agreement",
    f"""WITH {_ROUTED},
s AS (
  SELECT event_type, lateness_s, {sql_sec('tst')} - {sql_sec("CASE WHEN event_type = 'arr' THEN scheduled_arrival ELSE scheduled_departure END")} AS plan_s
  FROM routed WHERE event_type <> 'vp' AND complete AND lateness_s IS NOT NULL
)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE lateness_s = plan_s) AS exact,
       count(*) FILTER (WHERE abs(lateness_s - plan_s) <= 5) AS within_5s,
       quantile_cont(CAST(lateness_s - plan_s AS DOUBLE), 0.5) AS median_diff,
       quantile_cont(CAST(lateness_s - plan_s AS DOUBLE), 0.1) AS p10_diff,
       quantile_cont(CAST(lateness_s - plan_s AS DOUBLE), 0.9) AS p90_diff, round(corr(lateness_s, plan_s), 3) AS corr
FROM s GROUP BY 1""",
)
def lateness_agreement(spark, sf_dir):
    return checks.lateness_agreement(ev.stop_events(routed(spark, sf_dir)))
