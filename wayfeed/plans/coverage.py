"""Recording coverage, Data Gaps and feed health over V1 heartbeats."""

from __future__ import annotations

from ..operators import coverage as c
from ..operators.fleet import latest_by_key
from .registry import query
from .views import SQL_CURRENT, SQL_HEARTBEATS, SQL_NOW, heartbeats, last_instant, positions, sql_day, sql_sec

# Events are minutes apart, so the spacing limit is scaled from 30 s to 10 min.
SPACING_S = 600

_INTERVALS = f"""{SQL_HEARTBEATS},
intervals AS (
  SELECT session_id, from_at, to_at FROM (
    SELECT session_id, heartbeat_at AS from_at,
           lead(heartbeat_at) OVER (PARTITION BY session_id ORDER BY heartbeat_at) AS to_at FROM heartbeats)
  WHERE to_at IS NOT NULL AND {sql_sec('to_at')} - {sql_sec('from_at')} <= {SPACING_S}
)"""
_MINUTES = f"""{_INTERVALS},
touched AS (
  SELECT from_at, to_at, unnest(generate_series(date_trunc('minute', from_at), date_trunc('minute', to_at),
         INTERVAL 1 MINUTE)) AS minute_start FROM intervals
),
covered AS (
  SELECT minute_start, sum(greatest(epoch_us(least(to_at, minute_start + INTERVAL 1 MINUTE))
         - epoch_us(greatest(from_at, minute_start)), 0)) AS us FROM touched GROUP BY 1
),
spine AS (
  SELECT unnest(generate_series((SELECT date_trunc('minute', min(heartbeat_at)) FROM heartbeats),
         (SELECT date_trunc('minute', max(heartbeat_at)) FROM heartbeats), INTERVAL 1 MINUTE)) AS minute_start
),
cov0 AS (
  SELECT s.minute_start, round(least(coalesce(c.us, 0), 60000000) / 1000000, 1) AS covered_s
  FROM spine s LEFT JOIN covered c ON s.minute_start = c.minute_start
),
coverage AS (SELECT *, round(covered_s / 60, 3) AS coverage FROM cov0)"""
_GAPS = f"""{_MINUTES},
numbered AS (
  SELECT minute_start, minute_start - to_minutes(row_number() OVER (ORDER BY minute_start)) AS island
  FROM coverage WHERE coverage = 0
),
gaps AS (
  SELECT min(minute_start) AS gap_start, max(minute_start) + INTERVAL 1 MINUTE AS gap_end, count(*) AS gap_minutes
  FROM numbered GROUP BY island
)"""


def minutes(spark, sf_dir):
    return c.coverage_minutely(heartbeats(spark, sf_dir), max_spacing_s=SPACING_S)


@query(
    "ingestion_sessions",
    f"""WITH {SQL_HEARTBEATS}
SELECT session_id, min(heartbeat_at) AS started_at, max(heartbeat_at) AS last_heartbeat_at,
       max(received_total) AS events_received, max(dropped_total) AS events_dropped
FROM heartbeats GROUP BY 1""",
)
def ingestion_sessions(spark, sf_dir):
    return c.ingestion_sessions(heartbeats(spark, sf_dir))


@query("covered_intervals", f"WITH {_INTERVALS} SELECT * FROM intervals")
def covered_intervals(spark, sf_dir):
    return c.covered_intervals(heartbeats(spark, sf_dir), SPACING_S)


@query("coverage_minutely", f"WITH {_MINUTES} SELECT * FROM coverage")
def coverage_minutely(spark, sf_dir):
    """With the 30-day window of the table, which here spans all heartbeats."""
    hb = heartbeats(spark, sf_dir)
    return c.coverage_minutely(hb, as_of=last_instant(spark, sf_dir), max_spacing_s=SPACING_S)


@query("data_gaps", f"WITH {_GAPS} SELECT * FROM gaps")
def data_gaps(spark, sf_dir):
    return c.gap_intervals(minutes(spark, sf_dir))


_SINCE, _UNTIL = "2024-01-03 10:20:30", "2024-01-27 08:00:00"


@query(
    "window_coverage",
    f"""WITH {_MINUTES},
w AS (
  SELECT CAST(coalesce(sum(CAST(round(covered_s * 10) AS BIGINT)), 0) / 10.0 AS DOUBLE) AS covered_s,
         epoch(TIMESTAMP '{_UNTIL}') - epoch(TIMESTAMP '{_SINCE}') AS window_s
  FROM coverage WHERE minute_start >= date_trunc('minute', TIMESTAMP '{_SINCE}') AND minute_start < TIMESTAMP '{_UNTIL}'
)
SELECT *, greatest(0.0, least(1.0, covered_s / window_s)) AS coverage,
       greatest(0.0, least(1.0, covered_s / window_s)) < 0.9 AS incomplete FROM w""",
)
def window_coverage(spark, sf_dir):
    return c.window_coverage(minutes(spark, sf_dir), _SINCE, _UNTIL)


@query(
    "coverage_last_hour",
    f"""WITH {_MINUTES}
SELECT round(coalesce(sum(covered_s), 0) / 3600, 3) AS coverage FROM coverage
WHERE minute_start >= date_trunc('minute', {SQL_NOW} - INTERVAL 1 HOUR)""",
)
def coverage_last_hour(spark, sf_dir):
    return c.coverage_last_hour(minutes(spark, sf_dir), last_instant(spark, sf_dir))


def _sql_start(day: str) -> str:
    return f"((CAST({day} AS TIMESTAMP) + INTERVAL 270 MINUTE) AT TIME ZONE 'Europe/Helsinki') AT TIME ZONE 'UTC'"


@query(
    "coverage_by_day",
    f"""WITH {_MINUTES},
d AS (
  SELECT {sql_day('minute_start')} AS operating_day,
         CAST(sum(CAST(round(covered_s * 10) AS BIGINT)) / 10.0 AS DOUBLE) AS covered_s
  FROM coverage GROUP BY 1
),
w AS (
  SELECT operating_day, covered_s, {sql_sec(f"least({SQL_NOW}, {_sql_start('operating_day + 1')})")}
         - {sql_sec(_sql_start('operating_day'))} AS window_s FROM d
)
SELECT *, covered_s / window_s AS coverage FROM w""",
)
def coverage_by_day(spark, sf_dir):
    return c.coverage_by_operating_day(minutes(spark, sf_dir), last_instant(spark, sf_dir))


@query(
    "feed_live",
    f"""WITH {SQL_HEARTBEATS}
SELECT max(heartbeat_at) >= {SQL_NOW} - INTERVAL 30 SECOND AS feed_live FROM heartbeats""",
)
def feed_live(spark, sf_dir):
    return c.feed_live(heartbeats(spark, sf_dir), last_instant(spark, sf_dir))


@query(
    "health",
    f"""WITH {SQL_CURRENT}, {_GAPS},
latest AS (SELECT session_id, heartbeat_at FROM heartbeats ORDER BY heartbeat_at DESC LIMIT 1),
minute AS (
  SELECT (max(h.received_total) - min(h.received_total))
         / nullif({sql_sec('max(h.heartbeat_at)')} - {sql_sec('min(h.heartbeat_at)')}, 0) AS events_per_s
  FROM heartbeats h JOIN latest l ON h.session_id = l.session_id
  WHERE h.heartbeat_at >= l.heartbeat_at - INTERVAL 60 SECOND
)
SELECT (SELECT heartbeat_at FROM latest) AS last_heartbeat_at, (SELECT events_per_s FROM minute) AS events_per_s,
       (SELECT max(last_seen_at) FROM vehicle_current) AS last_event_at,
       (SELECT gap_start FROM gaps ORDER BY gap_start DESC LIMIT 1) AS last_gap_start,
       (SELECT gap_minutes FROM gaps ORDER BY gap_start DESC LIMIT 1) AS last_gap_minutes, {SQL_NOW} AS now""",
)
def health(spark, sf_dir):
    current = latest_by_key(positions(spark, sf_dir), ["vehicle_id"], "last_seen_at")
    return c.health(heartbeats(spark, sf_dir), current, minutes(spark, sf_dir), last_instant(spark, sf_dir))
