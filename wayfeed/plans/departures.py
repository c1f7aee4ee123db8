"""Punctuality, stop lateness and the dashboard datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import window_bounds, window_filter
from ..functions.status import lateness_band, route_number, route_order
from ..operators import departures as d
from ..operators.events import dedup_events, normalize_events, route_events, stop_events
from .registry import query
from .views import (
    SQL_DEPARTURES,
    SQL_NOW,
    SQL_PARSED,
    SQL_REFERENCE,
    SQL_SHIPMENTS,
    departures,
    last_instant,
    load,
    messages,
    routes_of_regions,
    shipments,
    sql_day,
    sql_local,
    sql_ok,
    sql_route_number,
    stops_of_nations,
    text,
)

_PUNCTUALITY = f"""
SELECT route, direction, max(route_name) AS route_name, count(*) AS departures,
       count(*) FILTER (WHERE {sql_ok()}) / count(*) AS punctuality, avg(lateness_s) AS avg_lateness_s,
       quantile_disc(lateness_s, 0.9) AS p90_lateness_s, count(*) FILTER (WHERE lateness_s IS NULL) AS lateness_unknown
FROM departures GROUP BY route, direction"""


@query("punctuality", f"WITH {SQL_DEPARTURES} {_PUNCTUALITY}")
def punctuality(spark, sf_dir):
    return d.in_route_order(d.punctuality(departures(spark, sf_dir)))


@query("punctuality_shipments", f"WITH {SQL_SHIPMENTS} {_PUNCTUALITY}")
def punctuality_shipments(spark, sf_dir):
    return d.punctuality(shipments(spark, sf_dir))


@query(
    "punctuality_overall",
    f"""WITH {SQL_DEPARTURES}
SELECT count(*) FILTER (WHERE {sql_ok()}) / count(*) AS punctuality, count(*) AS departures, count(DISTINCT route) AS routes
FROM departures""",
)
def punctuality_overall(spark, sf_dir):
    return d.punctuality_overall(departures(spark, sf_dir))


_STOP_LATENESS = """
SELECT stop_id, max(stop_name) AS stop_name, max(stop_lat) AS lat, max(stop_long) AS long, count(*) AS departures,
       avg(lateness_s) AS avg_lateness_s, string_agg(DISTINCT route, ', ' ORDER BY route) AS routes
FROM departures WHERE stop_lat IS NOT NULL GROUP BY stop_id"""


@query("stop_lateness", f"WITH {SQL_DEPARTURES} {_STOP_LATENESS}")
def stop_lateness(spark, sf_dir):
    return d.stop_lateness(departures(spark, sf_dir))


@query("stop_lateness_shipments", f"WITH {SQL_SHIPMENTS} {_STOP_LATENESS}")
def stop_lateness_shipments(spark, sf_dir):
    return d.stop_lateness(shipments(spark, sf_dir))


@query(
    "departures_over_time",
    f"""WITH {SQL_DEPARTURES}
SELECT time_bucket(INTERVAL 5 MINUTE, departed_at, TIMESTAMP '1970-01-01') AS bucket_start, count(*) AS departures,
       count(*) FILTER (WHERE {sql_ok()}) AS on_time
FROM departures GROUP BY 1""",
)
def departures_over_time(spark, sf_dir):
    return d.departures_over_time(departures(spark, sf_dir))


_DATASET = f"""dataset AS (
  SELECT operating_day, route, direction, route_name, stop_id, stop_name, stop_lat, stop_long, departed_at_local,
         date_trunc('hour', departed_at_local) AS hour_local, lateness_s,
         CASE WHEN {sql_ok()} THEN 'On-time' ELSE 'Not on-time' END AS status,
         CASE WHEN {sql_ok()} THEN 1 ELSE 0 END AS on_time
  FROM departures
)"""


@query("departures_dataset", f"WITH {SQL_DEPARTURES}, {_DATASET} SELECT * FROM dataset")
def departures_dataset(spark, sf_dir):
    return d.departures_dataset(departures(spark, sf_dir))


@query(
    "departures_hourly",
    f"""WITH {SQL_DEPARTURES}, {_DATASET}
SELECT hour_local, status, count(*) AS departures FROM dataset GROUP BY 1, 2""",
)
def departures_hourly(spark, sf_dir):
    return d.departures_hourly(d.departures_dataset(departures(spark, sf_dir)))


@query(
    "kpi_daily",
    f"""WITH {SQL_DEPARTURES}, {_DATASET}
SELECT operating_day, count(*) AS departures, count(DISTINCT route) AS routes, avg(on_time) AS punctuality,
       avg(lateness_s) AS avg_lateness_s
FROM dataset GROUP BY 1""",
)
def kpi_daily(spark, sf_dir):
    return d.kpi_daily(d.departures_dataset(departures(spark, sf_dir)))


@query(
    "route_kpi",
    f"""WITH {SQL_DEPARTURES}, {_DATASET}
SELECT route, count(*) AS departures, avg(on_time) AS punctuality FROM dataset GROUP BY 1""",
)
def route_kpi(spark, sf_dir):
    return d.route_kpi(d.departures_dataset(departures(spark, sf_dir)))


@query(
    "stop_map",
    f"""WITH {SQL_DEPARTURES}
SELECT stop_lat, stop_long, count(*) AS departures, avg(lateness_s) AS avg_lateness_s
FROM departures GROUP BY 1, 2""",
)
def stop_map(spark, sf_dir):
    return d.stop_map(d.departures_dataset(departures(spark, sf_dir)))


@query(
    "worst_stops",
    f"""WITH {SQL_DEPARTURES}
SELECT stop_name, stop_id, count(*) AS departures, round(avg(lateness_s)) AS avg_lateness_s,
       string_agg(DISTINCT route, ', ' ORDER BY route) AS routes
FROM departures WHERE departed_at >= TIMESTAMP '2024-01-01' GROUP BY 1, 2 HAVING count(*) >= 3
ORDER BY avg_lateness_s DESC NULLS LAST, stop_name NULLS FIRST, stop_id LIMIT 10""",
)
def worst_stops(spark, sf_dir):
    return d.worst_stops(departures(spark, sf_dir), since="2024-01-01 00:00:00")


@query(
    "routes_most_late",
    f"""WITH {SQL_DEPARTURES}
SELECT route, direction, max(route_name) AS route_name, count(*) AS departures,
       round(100 * count(*) FILTER (WHERE {sql_ok()}) / count(*), 1) AS punctuality_pct, round(avg(lateness_s)) AS avg_lateness_s
FROM departures WHERE operating_day = {sql_day(SQL_NOW)} GROUP BY 1, 2""",
)
def routes_most_late(spark, sf_dir):
    return d.routes_most_late(departures(spark, sf_dir), last_instant(spark, sf_dir))


@query(
    "window_filter",
    f"""WITH {SQL_DEPARTURES}
SELECT 'last_hour' AS viewer_window, journey_id, vehicle_id, departed_at FROM departures
WHERE departed_at >= {SQL_NOW} - INTERVAL 1 HOUR AND departed_at < {SQL_NOW}
UNION ALL
SELECT 'operating_day', journey_id, vehicle_id, departed_at FROM departures
WHERE operating_day = {sql_day(SQL_NOW)} AND departed_at < {SQL_NOW}""",
)
def both_windows(spark, sf_dir):
    dep, now = departures(spark, sf_dir), last_instant(spark, sf_dir)

    def rows(window):
        columns = ["journey_id", "vehicle_id", "departed_at"]
        return window_filter(dep, window, now).select(F.lit(window).alias("viewer_window"), *columns)

    return rows("last_hour").unionByName(rows("operating_day"))


@query(
    "window_bounds",
    f"""SELECT event_id, ts - INTERVAL 1 HOUR AS hour_since,
       ((CAST({sql_day('ts')} AS TIMESTAMP) + INTERVAL 270 MINUTE) AT TIME ZONE 'Europe/Helsinki') AT TIME ZONE 'UTC'
         AS day_since
FROM events""",
)
def bounds(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(
        "event_id",
        window_bounds("last_hour", F.col("ts"))[0].alias("hour_since"),
        window_bounds("operating_day", F.col("ts"))[0].alias("day_since"),
    )


@query("local_time", f"SELECT event_id, {sql_local('ts')} AS local_ts FROM events")
def local(spark, sf_dir):
    from ..functions.clock import local_time

    return load(spark, sf_dir, "events").select("event_id", local_time(F.col("ts")).alias("local_ts"))


@query(
    "operating_day",
    f"SELECT {sql_day('ts')} AS operating_day, count(*) AS events, min(ts) AS first_at FROM events GROUP BY 1",
)
def days(spark, sf_dir):
    from ..functions.clock import operating_day

    e = load(spark, sf_dir, "events")
    return e.groupBy(operating_day(F.col("ts")).alias("operating_day")).agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_at")
    )


@query(
    "lateness_band",
    f"""WITH {SQL_DEPARTURES}
SELECT CASE WHEN lateness_s IS NULL THEN 'unknown' WHEN lateness_s < -60 THEN 'early' WHEN lateness_s <= 180 THEN 'on_time'
            WHEN lateness_s <= 600 THEN 'late' ELSE 'very_late' END AS band,
       count(*) AS departures, min(lateness_s) AS least, max(lateness_s) AS most
FROM departures GROUP BY 1""",
)
def bands(spark, sf_dir):
    return (
        departures(spark, sf_dir)
        .groupBy(lateness_band(F.col("lateness_s")).alias("band"))
        .agg(
            F.count(F.lit(1)).alias("departures"), F.min("lateness_s").alias("least"), F.max("lateness_s").alias("most")
        )
    )


@query(
    "route_order",
    f"""WITH labels AS (
  SELECT CASE WHEN p_partkey % 11 = 0 THEN 'M' ELSE '' END || CAST(p_partkey % 60 AS VARCHAR) ||
         CASE WHEN p_size % 5 = 0 THEN 'T' ELSE '' END AS route FROM part
  UNION ALL SELECT p_type FROM part
)
SELECT route, {sql_route_number('route')} AS number, count(*) AS n FROM labels GROUP BY 1, 2""",
)
def natural_order(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    key = F.col("p_partkey")
    labels = part.select(
        F.concat(
            F.when(key % 11 == 0, "M").otherwise(""),
            text(key % 60),
            F.when(F.col("p_size") % 5 == 0, "T").otherwise(""),
        ).alias("route")
    )
    counted = labels.unionAll(part.select("p_type")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("number", route_number(F.col("route"))).orderBy(*route_order(F.col("route")))


_ENRICHED = f"""
stop_rows AS (
  SELECT * FROM parsed WHERE event_type = 'dep' AND mode = 'tram' AND tst IS NOT NULL AND vehicle_id IS NOT NULL
),
fallback AS (SELECT route, min(route_name) AS route_name_by_route FROM routes GROUP BY route),
departures AS (
  SELECT e.operating_day, e.route, coalesce(r.route_name, f.route_name_by_route) AS route_name, e.direction,
         e.journey_id, e.vehicle_id, e.stop_id, s.stop_name, s.lat AS stop_lat, s.long AS stop_long,
         e.tst AS departed_at, {sql_local('e.tst')} AS departed_at_local, e.scheduled_departure, e.lateness_s,
         e.timetable_lateness_s
  FROM stop_rows e LEFT JOIN stops s ON e.stop_id = s.stop_id
  LEFT JOIN routes r ON e.feed_route_id = r.feed_route_id LEFT JOIN fallback f ON e.route = f.route
)"""
SQL_ENRICHED = f"{SQL_PARSED}, {SQL_REFERENCE}, {_ENRICHED}"


def enriched(spark, sf_dir):
    """From raw messages to departures with names, in batch."""
    events = stop_events(route_events(dedup_events(normalize_events(messages(spark, sf_dir)))))
    return d.build_departures(events, stops_of_nations(spark, sf_dir), routes_of_regions(spark, sf_dir))


@query("departures_enriched", f"WITH {SQL_ENRICHED} SELECT * FROM departures")
def departures_enriched(spark, sf_dir):
    return enriched(spark, sf_dir)


@query(
    "departures_enriched_shipments",
    f"""WITH fallback AS (
  SELECT 'N' || CAST(s_nationkey AS VARCHAR) AS route, min(s_name) AS route_name FROM supplier GROUP BY 1
)
SELECT {sql_day('l_shipdate')} AS operating_day, 'N' || CAST(l_suppkey % 25 AS VARCHAR) AS route,
       coalesce(s.s_name, f.route_name) AS route_name, CAST(l_linenumber % 2 + 1 AS VARCHAR) AS direction,
       CAST(l_orderkey AS VARCHAR) AS journey_id, CAST(l_suppkey AS VARCHAR) AS vehicle_id,
       CAST(l_partkey AS VARCHAR) AS stop_id, p_name AS stop_name, p_retailprice AS stop_lat,
       CAST(p_size AS DOUBLE) AS stop_long, l_shipdate AS departed_at, {sql_local('l_shipdate')} AS departed_at_local,
       l_shipdate AS scheduled_departure, l_linenumber AS lateness_s, CAST(NULL AS INTEGER) AS timetable_lateness_s
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
LEFT JOIN supplier s ON s.s_suppkey = l_suppkey AND l_linenumber <> 3
LEFT JOIN fallback f ON f.route = 'N' || CAST(l_suppkey % 25 AS VARCHAR)""",
)
def departures_enriched_shipments(spark, sf_dir):
    """The same joins at volume: parts as stops, suppliers as routes, a fallback name per nation."""
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
    line = load(spark, sf_dir, "lineitem").select(*columns)
    supplier = F.col("l_suppkey")
    events = line.select(
        F.lit("dep").alias("event_type"),
        F.lit("tram").alias("mode"),
        F.to_date(F.from_utc_timestamp("l_shipdate", "Europe/Helsinki") - F.expr("INTERVAL 270 MINUTES")).alias(
            "operating_day"
        ),
        F.concat(F.lit("N"), text(supplier % 25)).alias("route"),
        text(F.col("l_linenumber") % 2 + 1).alias("direction"),
        text(F.col("l_orderkey")).alias("journey_id"),
        text(supplier).alias("vehicle_id"),
        text(F.col("l_partkey")).alias("stop_id"),
        F.when(F.col("l_linenumber") != 3, text(supplier)).alias("feed_route_id"),
        F.col("l_shipdate").alias("tst"),
        F.col("l_shipdate").alias("scheduled_departure"),
        F.col("l_linenumber").alias("lateness_s"),
        F.lit(None).cast("int").alias("timetable_lateness_s"),
    )
    stops = load(spark, sf_dir, "part").select(
        text(F.col("p_partkey")).alias("stop_id"),
        F.col("p_name").alias("stop_name"),
        F.col("p_retailprice").alias("lat"),
        F.col("p_size").cast("double").alias("long"),
    )
    routes = load(spark, sf_dir, "supplier").select(
        text(F.col("s_suppkey")).alias("feed_route_id"),
        F.concat(F.lit("N"), text(F.col("s_nationkey"))).alias("route"),
        F.col("s_name").alias("route_name"),
    )
    return d.build_departures(events, stops, routes)


@query(
    "route_fallback",
    """SELECT p_brand AS route, min(p_name) AS route_name_by_route FROM part GROUP BY p_brand""",
)
def fallback(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return d.route_fallback(part.select(F.col("p_brand").alias("route"), F.col("p_name").alias("route_name")))
