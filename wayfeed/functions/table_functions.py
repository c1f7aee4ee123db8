"""SQL table functions over the tables of a session.

Each function filters a temporary view that an operator defines, so SQL users
and DataFrame users share one definition.  Views are lazy: calling a function
plans the operator together with the filter.  "Now" is the query's own
``current_timestamp()`` unless ``as_of`` fixes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advice, coverage, fleet, headway
from .clock import instant, use_utc


def _create(spark: SparkSession, name: str, parameters: str, result: DataFrame, source: str, rest: str) -> None:
    columns = ", ".join(f"`{c}` {t}" for c, t in result.dtypes)
    names = ", ".join(f"`{c}`" for c in result.columns)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) "
        f"RETURN SELECT {names} FROM {source} {rest}"
    )


def register_find_stop(spark: SparkSession, stops: DataFrame) -> None:
    """``find_stop(name)``: the ten best stops for one name or its start.

    For a table of names use ``operators.advice.find_stops``.
    """
    found = stops.select(
        "stop_id",
        "stop_name",
        "stop_code",
        "lat",
        F.col("long").alias("lon"),
        (F.col("main_vehicle_type") == 0).alias("is_tram_stop"),
    )
    found.createOrReplaceTempView("wayfeed_stops")
    wanted = "lower(trim(find_stop.name))"
    _create(
        spark,
        "find_stop",
        "name STRING",
        found,
        "wayfeed_stops",
        f"WHERE startswith(lower(stop_name), {wanted}) "
        f"ORDER BY lower(stop_name) = {wanted} DESC, is_tram_stop DESC, stop_name, stop_id LIMIT 10",
    )


def register_vehicle_functions(
    spark: SparkSession, current: DataFrame, departures: DataFrame, heartbeats: DataFrame, as_of=None
) -> None:
    """``tram_lateness(route_name)`` and ``bunching_now(route_name)``; a blank route means all in the latter."""
    use_utc(spark)
    now = F.current_timestamp() if as_of is None else instant(as_of)
    columns = ["vehicle_id", "mode", "route", "direction", "journey_id", "lateness_s", "last_seen_at"]
    lateness = fleet.vehicle_freshness(current.select(*columns), now)
    lateness.createOrReplaceTempView("wayfeed_lateness")
    _create(
        spark,
        "tram_lateness",
        "route_name STRING",
        lateness,
        "wayfeed_lateness",
        "WHERE route = trim(tram_lateness.route_name) ORDER BY direction, last_seen_at DESC",
    )
    live = coverage.feed_live(heartbeats, now)
    live.createOrReplaceTempView("wayfeed_feed_live")
    pairs = headway.bunching_now(departures, live, now)
    pairs.createOrReplaceTempView("wayfeed_bunching_now")
    # One row of feed state, with the pairs of the last minutes hung on it, if there are any.
    names = ", ".join("f.feed_live" if c == "feed_live" else f"p.`{c}`" for c in pairs.columns)
    columns = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION bunching_now(route_name STRING) RETURNS TABLE ({columns}) "
        f"RETURN SELECT {names} FROM wayfeed_feed_live f LEFT JOIN wayfeed_bunching_now p ON p.route IS NOT NULL "
        "AND (coalesce(trim(bunching_now.route_name), '') = '' OR p.route = trim(bunching_now.route_name))"
    )


def tram_bunching(spark: SparkSession, departures: DataFrame, since, until, max_share: float | None = None) -> DataFrame:
    """Pairs of a window, by the operator that splits busy stops over tasks; ``register_tram_bunching`` is its SQL twin."""
    return headway.bunching_pairs(departures, since, until, max_share)


def register_tram_bunching(spark: SparkSession, departures: DataFrame) -> None:
    """``tram_bunching(since, until[, max_share])``: rows of ``headway.bunching_pairs`` for any window.

    The function's arguments cut the departures, by day and by instant, below everything that is ordered, so a call reads
    and shuffles its window and an hour before it.  Meant for a viewer's window of hours or days, in which a stop's departures fit
    a task; for long spans use the operator.
    """
    use_utc(spark)
    result = headway.bunching_pairs(departures, "2000-01-01 00:00:00", "2000-01-02 00:00:00")
    own = ["stop_name", "stop_lat", "stop_long", "vehicle_id", "journey_id", "departed_at", "scheduled_departure", "lateness_s"]
    place = ", ".join(headway.PLACE)
    view = departures.select(*headway.PLACE, *own, *[c for c in departures.columns if c == "operating_day"])
    view.createOrReplaceTempView("wayfeed_departures")
    days = "AND operating_day BETWEEN to_date(tram_bunching.since) - INTERVAL 2 DAYS AND to_date(tram_bunching.until) + INTERVAL 1 DAY" if "operating_day" in view.columns else ""
    tie = "departed_at, vehicle_id, journey_id"
    window_rows = f"""
        SELECT {place}, {", ".join(own)},
               lag(vehicle_id) OVER run AS leader_vehicle_id, lag(journey_id) OVER run AS leader_journey_id,
               lag(departed_at) OVER run AS leader_departed_at, lag(lateness_s) OVER run AS leader_lateness_s,
               (unix_micros(scheduled_departure) - unix_micros(lag(scheduled_departure) OVER plan)) DIV 1000000 AS gap_s
        FROM wayfeed_departures
        WHERE departed_at >= tram_bunching.since - INTERVAL {headway.LOOK_BACK_S} SECONDS AND departed_at < tram_bunching.until {days}
        WINDOW run AS (PARTITION BY {place} ORDER BY {tie}),
               plan AS (PARTITION BY {place}, scheduled_departure IS NULL ORDER BY scheduled_departure, {tie})"""
    planned = f"""
        SELECT *, CAST(percentile_approx(CASE WHEN gap_s BETWEEN 1 AND {headway.MAX_PLANNED_GAP_S} THEN gap_s END, 0.5)
                       OVER (PARTITION BY {place}, date_trunc('HOUR', scheduled_departure)) AS INT) AS planned_s,
               CAST((unix_micros(departed_at) - unix_micros(leader_departed_at)) DIV 1000000 AS INT) AS headway_s
        FROM ({window_rows})"""
    columns = ", ".join(f"`{c}` {t}" for c, t in result.dtypes)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION tram_bunching(since TIMESTAMP, until TIMESTAMP, max_share DOUBLE DEFAULT {headway.BUNCHING_SHARE})
        RETURNS TABLE ({columns})
        RETURN SELECT {place}, stop_name, stop_lat, stop_long, leader_vehicle_id, vehicle_id, leader_departed_at, departed_at, headway_s,
            nullif(planned_s, 0), leader_lateness_s, lateness_s,
            coalesce(planned_s > 0 AND headway_s < coalesce(tram_bunching.max_share, {headway.BUNCHING_SHARE}) * planned_s, false)
        FROM ({planned})
        WHERE leader_vehicle_id <> vehicle_id AND leader_journey_id <> journey_id AND departed_at >= tram_bunching.since"""
    )


def register_trip_functions(
    spark: SparkSession,
    requests: DataFrame,
    stops: DataFrame,
    plans: DataFrame,
    weather_bodies: DataFrame,
    heartbeats: DataFrame,
    current: DataFrame,
    as_of,
    **names,
) -> None:
    """``weather_outlook(point_id)``, ``trip_options(request_id)`` and ``bike_walk_or_wait(from_stop, to_stop)``.

    They answer from stored responses; fetching those is the caller's part.
    """
    use_utc(spark)
    weather = advice.parse_weather(weather_bodies)
    options = advice.parse_trip_plans(plans, as_of)
    weather.createOrReplaceTempView("wayfeed_weather")
    options.createOrReplaceTempView("wayfeed_trip_options")
    live = coverage.feed_live(heartbeats, as_of)
    asked = requests.select("request_id", F.col("from_stop").alias("asked_from"), F.col("to_stop").alias("asked_to"))
    advised = advice.advise(requests, stops, plans, weather, live, current, as_of, **names)
    advised.join(asked, "request_id").createOrReplaceTempView("wayfeed_advice")
    point = dict(weather.dtypes)["point_id"]
    request = dict(options.dtypes)["request_id"]
    _create(
        spark,
        "weather_outlook",
        f"point {point}",
        weather,
        "wayfeed_weather",
        "WHERE point_id = weather_outlook.point ORDER BY forecast_at",
    )
    _create(spark, "trip_options", f"request {request}", options, "wayfeed_trip_options", "WHERE request_id = trip_options.request")
    _create(
        spark,
        "bike_walk_or_wait",
        "start STRING, goal STRING",
        advised,
        "wayfeed_advice",
        "WHERE asked_from = bike_walk_or_wait.start AND asked_to = bike_walk_or_wait.goal",
    )


def register_parse_trip_options(spark: SparkSession) -> None:
    """``parse_trip_options(body[, at])``: the rows of ``advice.parse_trip_plans`` for one planner answer.

    ``at`` is the instant that ``arrive_in_s`` counts from, by default now.  The function reads no table, so it
    takes any body, also one for each row of a table (``FROM answers, LATERAL parse_trip_options(body)``): Spark then parses each
    different body once and joins the options back.  The operator parses in place and is the one for large tables.
    """
    use_utc(spark)
    times = {
        "leave_at": "try_to_timestamp({0}.start)",
        "arrive_at": "try_to_timestamp({0}.end)",
        "arrive_in_s": "timestampdiff(SECOND, coalesce(parse_trip_options.at, current_timestamp()), try_to_timestamp({0}.end))",
    }
    starts = "ride.trip.departureStoptime.scheduledDeparture"
    planned, estimated = "try_to_timestamp(ride.start.scheduledTime)", "ride.start.estimated.time"
    fields = {
        "tram": {
            "route": "ride.route.shortName",
            "direction": "try_cast(ride.trip.directionId AS INT) + 1",
            "operating_day": "ride.serviceDate",
            "journey_start": f"format_string('%02d:%02d', CAST({starts} DIV 3600 AS BIGINT), CAST(pmod({starts}, 3600) DIV 60 AS BIGINT))",
            "board_stop": "ride.from.name",
            "scheduled_departure": planned,
            "expected_departure": f"coalesce(try_to_timestamp({estimated}), {planned})",
            "realtime": f"{estimated} IS NOT NULL",
        },
        "walk": {},
        "bike": {
            "bike_station": "cycle.from.vehicleRentalStation.name",
            "bikes_available": "cycle.from.vehicleRentalStation.availableVehicles.total",
            "dock_station": "cycle.to.vehicleRentalStation.name",
            "docks_free": "cycle.to.vehicleRentalStation.availableSpaces.total",
        },
    }
    fields["tram"]["journey_start"] = f"CASE WHEN {starts} IS NOT NULL THEN {fields['tram']['journey_start']} END"

    def option(name: str, own: dict[str, str], present: str) -> str:
        own = {"option": f"'{name}'", **own}
        columns = ", ".join(f"'{c}', CAST({own.get(c, 'NULL')} AS {t})" for c, t in advice.OPTION_TYPES.items())
        return f"CASE WHEN {present} THEN named_struct({columns}) END"

    rows = [option(k, {c: t.format(k) for c, t in times.items()} | own, f"{k} IS NOT NULL") for k, own in fields.items()]
    messages = "coalesce(array_join(transform(r.errors, e -> e.message), '; '), 'unreadable response')"
    rows.append(option("error", {"error": messages}, "r.errors IS NOT NULL OR r.data IS NULL"))
    riding = "get(filter(r.data.{0}.edges, e -> exists(e.node.legs, leg -> leg.mode = '{1}')), 0).node"
    leg = "get(filter({0}.legs, leg -> leg.mode = '{1}'), 0)"
    schema = " ".join(advice.PLAN_SCHEMA.split())
    columns = ", ".join(f"`{c}` {t}" for c, t in advice.OPTION_TYPES.items())
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION parse_trip_options(body STRING, at TIMESTAMP DEFAULT NULL)
        RETURNS TABLE ({columns})
        RETURN SELECT inline(array_compact(array({", ".join(rows)})))
        FROM (SELECT *, {leg.format("tram", "TRAM")} AS ride, {leg.format("bike", "BICYCLE")} AS cycle
              FROM (SELECT r, {riding.format("tram", "TRAM")} AS tram, get(r.data.walk.edges, 0).node AS walk, {riding.format("bike", "BICYCLE")} AS bike
                    FROM (SELECT from_json(parse_trip_options.body, '{schema}') AS r)))"""
    )
