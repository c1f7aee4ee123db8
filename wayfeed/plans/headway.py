"""Headway and Bunching over V1 and V2."""

from __future__ import annotations

from ..operators import headway as h
from ..operators.coverage import feed_live
from ..operators.fleet import latest_by_key
from .registry import query
from .views import (
    SQL_CURRENT,
    SQL_DEPARTURES,
    SQL_DEPARTURES_ONLY,
    SQL_NOW,
    SQL_SHIPMENTS,
    departures,
    heartbeats,
    last_instant,
    positions,
    shipments,
    sql_diff_s,
    sql_route_number,
)

DAY = 86_400
# Departures of a stop are hours apart here: a plan is a median per day, gaps up to 2 days count.
V1 = {"max_gap_s": 2 * DAY, "look_back_s": DAY, "span_s": 7 * DAY, "per": "day"}
# Shipping dates are whole days over seven years.
V2 = {"max_gap_s": 30 * DAY, "look_back_s": 30 * DAY, "span_s": 365 * DAY, "per": "month"}
V1_WINDOW = ("2024-01-01 00:00:00", "2024-02-01 00:00:00")
V2_WINDOW = ("1995-01-01 00:00:00", "2002-01-01 00:00:00")
PLACE = "route, direction, stop_id"


def _gaps(source: str, max_gap: int) -> str:
    gap = sql_diff_s("before", "scheduled_departure")
    return f"""sched AS (
  SELECT *, CASE WHEN {gap} > 0 AND {gap} <= {max_gap} THEN {gap} END AS scheduled_gap_s FROM (
    SELECT *, lag(scheduled_departure) OVER (PARTITION BY {PLACE} ORDER BY scheduled_departure, departed_at, vehicle_id) AS before
    FROM {source} WHERE scheduled_departure IS NOT NULL)
  UNION ALL BY NAME SELECT *, NULL AS scheduled_gap_s FROM {source} WHERE scheduled_departure IS NULL
)"""


def _plan(options: dict) -> str:
    return f"""{_gaps('d', options['max_gap_s'])},
plan AS (
  SELECT {PLACE}, date_trunc('{options['per']}', scheduled_departure) AS planned_hour,
         CAST(quantile_disc(scheduled_gap_s, 0.5) AS INTEGER) AS planned_headway_s
  FROM sched GROUP BY ALL HAVING planned_headway_s IS NOT NULL
)"""


def sql_pairs(since: str, until: str, options: dict, share: float = 0.25, name: str = "pairs") -> str:
    """Pairs by plain whole-partition windows, as a CTE list that needs ``departures``."""
    return f"""d AS (
  SELECT * FROM departures WHERE departed_at >= {since} - INTERVAL {options['look_back_s']} SECOND AND departed_at < {until}
),
{_plan(options)},
led AS (
  SELECT *, lag(vehicle_id) OVER w AS leader_vehicle_id, lag(journey_id) OVER w AS leader_journey_id,
         lag(departed_at) OVER w AS leader_departed_at, lag(lateness_s) OVER w AS leader_lateness_s
  FROM d WINDOW w AS (PARTITION BY {PLACE} ORDER BY departed_at, vehicle_id, journey_id)
),
{name} AS (
  SELECT l.route, l.direction, l.stop_id, stop_name, stop_lat, stop_long, leader_vehicle_id,
         vehicle_id AS follower_vehicle_id, leader_departed_at, departed_at AS follower_departed_at,
         CAST({sql_diff_s('leader_departed_at', 'departed_at')} AS INTEGER) AS headway_s,
         nullif(planned_headway_s, 0) AS scheduled_headway_s, leader_lateness_s, lateness_s AS follower_lateness_s,
         coalesce(planned_headway_s > 0 AND
           {sql_diff_s('leader_departed_at', 'departed_at')} < CAST({share} AS DOUBLE) * planned_headway_s, false) AS bunching
  FROM led l LEFT JOIN plan p ON l.route = p.route AND l.direction = p.direction AND l.stop_id = p.stop_id
       AND date_trunc('{options['per']}', l.scheduled_departure) = p.planned_hour
  WHERE leader_vehicle_id <> vehicle_id AND leader_journey_id <> journey_id AND departed_at >= {since}
)"""


def _ts(text: str) -> str:
    return f"TIMESTAMP '{text}'"


_PAIRS_V1 = f"{SQL_DEPARTURES}, {sql_pairs(_ts(V1_WINDOW[0]), _ts(V1_WINDOW[1]), V1)}"
_PAIRS_V2 = f"{SQL_SHIPMENTS}, {sql_pairs(_ts(V2_WINDOW[0]), _ts(V2_WINDOW[1]), V2)}"


def pairs_v1(spark, sf_dir):
    return h.bunching_pairs(departures(spark, sf_dir), *V1_WINDOW, **V1)


def pairs_v2(spark, sf_dir):
    # The day of this view is made from departed_at, row by row: cutting by it after the instants prunes nothing.
    return h.bunching_pairs(shipments(spark, sf_dir).drop("operating_day"), *V2_WINDOW, **V2)


@query(
    "scheduled_gaps",
    f"""WITH {SQL_DEPARTURES}, {_gaps('departures', V1['max_gap_s'])}
SELECT {PLACE}, vehicle_id, departed_at, scheduled_departure, scheduled_gap_s FROM sched""",
)
def scheduled_gaps(spark, sf_dir):
    columns = ["route", "direction", "stop_id", "vehicle_id", "departed_at", "scheduled_departure"]
    return h.scheduled_gaps(departures(spark, sf_dir).select(*columns), V1["max_gap_s"], V1["span_s"])


@query(
    "planned_headway",
    f"""WITH {SQL_SHIPMENTS}, d AS (SELECT * FROM departures), {_plan(V2)} SELECT * FROM plan""",
)
def planned_headway(spark, sf_dir):
    return h.planned_headway(shipments(spark, sf_dir), V2["max_gap_s"], V2["span_s"], V2["per"])


@query("bunching_pairs", f"WITH {_PAIRS_V1} SELECT * FROM pairs")
def bunching_pairs(spark, sf_dir):
    return pairs_v1(spark, sf_dir)


@query("bunching_pairs_shipments", f"WITH {_PAIRS_V2} SELECT * FROM pairs")
def bunching_pairs_shipments(spark, sf_dir):
    return pairs_v2(spark, sf_dir)


_BY_ROUTE = """
by_route AS (
  SELECT route, direction, count(*) AS departures, count(*) FILTER (WHERE bunching) AS bunched_departures,
         count(*) FILTER (WHERE bunching) / count(*) AS share,
         count(DISTINCT CASE WHEN bunching THEN leader_vehicle_id || '>' || follower_vehicle_id END) AS tram_pairs,
         CAST(trunc(median(CASE WHEN bunching THEN headway_s END)) AS INTEGER) AS median_headway_s
  FROM pairs WHERE scheduled_headway_s IS NOT NULL GROUP BY 1, 2
)"""


@query("bunching_by_route", f"WITH {_PAIRS_V1}, {_BY_ROUTE} SELECT * FROM by_route")
def bunching_by_route(spark, sf_dir):
    return h.bunching_by_route(pairs_v1(spark, sf_dir))


@query("bunching_by_route_shipments", f"WITH {_PAIRS_V2}, {_BY_ROUTE} SELECT * FROM by_route")
def bunching_by_route_shipments(spark, sf_dir):
    return h.bunching_by_route(pairs_v2(spark, sf_dir))


@query(
    "bunching_totals",
    f"""WITH {_PAIRS_V1}, {_BY_ROUTE}
SELECT CAST(sum(departures) AS BIGINT) AS departures, CAST(sum(bunched_departures) AS BIGINT) AS bunched_departures,
       sum(bunched_departures) / sum(departures) AS share, CAST(sum(tram_pairs) AS BIGINT) AS tram_pairs
FROM by_route""",
)
def bunching_totals(spark, sf_dir):
    return h.bunching_totals(h.bunching_by_route(pairs_v1(spark, sf_dir)))


@query(
    "bunching_by_stop",
    f"""WITH {_PAIRS_V1}
SELECT stop_id, stop_name, stop_lat AS lat, stop_long AS long, CAST(sum(n) AS BIGINT) AS bunching,
       string_agg(route, ', ' ORDER BY {sql_route_number('route')}, route) AS routes
FROM (SELECT stop_id, stop_name, stop_lat, stop_long, route, count(*) AS n FROM pairs WHERE bunching GROUP BY ALL)
WHERE stop_name IS NOT NULL AND stop_lat IS NOT NULL AND stop_long IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def bunching_by_stop(spark, sf_dir):
    return h.bunching_by_stop(pairs_v1(spark, sf_dir))


NOW_S = 10 * DAY
_NOW_PAIRS = f"""{SQL_DEPARTURES},
{sql_pairs(f"({SQL_NOW} - INTERVAL {NOW_S} SECOND)", SQL_NOW, V1)},
latest AS (
  SELECT * FROM pairs WHERE bunching QUALIFY row_number() OVER (
    PARTITION BY route, direction, leader_vehicle_id, follower_vehicle_id ORDER BY follower_departed_at DESC) = 1
)"""


def now_pairs(spark, sf_dir, route=None):
    as_of = last_instant(spark, sf_dir)
    live = feed_live(heartbeats(spark, sf_dir), as_of)
    return h.bunching_now(departures(spark, sf_dir), live, as_of, route, within_s=NOW_S, **V1)


@query(
    "bunching_now",
    f"""WITH {_NOW_PAIRS}
SELECT true AS feed_live, route, direction, stop_name, leader_vehicle_id, follower_vehicle_id, headway_s,
       scheduled_headway_s, leader_lateness_s, follower_lateness_s, follower_departed_at,
       {sql_diff_s('follower_departed_at', SQL_NOW)} AS age_s
FROM latest""",
)
def bunching_now(spark, sf_dir):
    return now_pairs(spark, sf_dir)


@query(
    "bunching_now_none",
    """SELECT max(ts) >= max(ts) AS feed_live, CAST(NULL AS VARCHAR) AS route, CAST(NULL AS VARCHAR) AS direction,
       CAST(NULL AS VARCHAR) AS stop_name, CAST(NULL AS VARCHAR) AS leader_vehicle_id,
       CAST(NULL AS VARCHAR) AS follower_vehicle_id, CAST(NULL AS INTEGER) AS headway_s,
       CAST(NULL AS INTEGER) AS scheduled_headway_s, CAST(NULL AS INTEGER) AS leader_lateness_s,
       CAST(NULL AS INTEGER) AS follower_lateness_s, CAST(NULL AS TIMESTAMP) AS follower_departed_at,
       CAST(NULL AS BIGINT) AS age_s FROM events""",
)
def bunching_now_none(spark, sf_dir):
    """A route without Bunching still gives the feed's state."""
    return now_pairs(spark, sf_dir, route=" no such route ")


@query(
    "pair_lines",
    f"""WITH {SQL_CURRENT}, {SQL_DEPARTURES_ONLY}, {sql_pairs(_ts(V1_WINDOW[0]), _ts(V1_WINDOW[1]), V1)},
fleet AS (SELECT * FROM vehicle_current WHERE last_seen_at > {SQL_NOW} - INTERVAL 2 DAY)
SELECT p.route, leader_vehicle_id, follower_vehicle_id, headway_s, a.long AS from_long, a.lat AS from_lat,
       b.long AS to_long, b.lat AS to_lat
FROM pairs p JOIN fleet a ON a.vehicle_id = leader_vehicle_id JOIN fleet b ON b.vehicle_id = follower_vehicle_id""",
)
def pair_lines(spark, sf_dir):
    """Pairs whose vehicles were both seen in the last two days."""
    from ..operators.fleet import live_fleet

    current = latest_by_key(positions(spark, sf_dir), ["vehicle_id"], "last_seen_at")
    fleet = live_fleet(current, last_instant(spark, sf_dir), hidden_s=2 * DAY)
    return h.pair_lines(pairs_v1(spark, sf_dir), fleet)
