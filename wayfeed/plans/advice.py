"""Trip advice: stop search, forecasts, planner answers, the rule, the whole batch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.clock import operating_day
from ..operators import advice as a
from ..operators.coverage import feed_live
from ..operators.fleet import latest_by_key
from .registry import query
from .views import (
    SQL_CURRENT,
    SQL_REFERENCE,
    heartbeats,
    last_instant,
    load,
    positions,
    sql_day,
    sql_diff_s,
    stops_of_nations,
    text,
)

# ---------------------------------------------------------------- stop search


def part_stops(spark, sf_dir):
    key = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        text(key).alias("stop_id"),
        F.col("p_name").alias("stop_name"),
        F.concat(F.lit("P"), text(key)).alias("stop_code"),
        F.lit(60.0).alias("lat"),
        F.lit(25.0).alias("long"),
        F.when(key % 5 != 0, key % 3).alias("main_vehicle_type"),
    )


@query(
    "find_stops",
    """WITH q AS (
  SELECT p_partkey AS query_id, CASE WHEN p_partkey % 9 = 0 THEN upper(p_name) || ' '
         WHEN p_partkey % 9 = 1 THEN '%' ELSE '  ' || left(p_name, CAST(1 + p_partkey % 6 AS BIGINT)) END AS name FROM part
),
t AS (SELECT DISTINCT lower(trim(name)) AS prefix FROM q),
s AS (
  SELECT CAST(p_partkey AS VARCHAR) AS stop_id, p_name AS stop_name, 'P' || CAST(p_partkey AS VARCHAR) AS stop_code,
         CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 3 = 0 END AS is_tram_stop FROM part
),
m AS (
  SELECT prefix, s.*, row_number() OVER (PARTITION BY prefix ORDER BY (lower(stop_name) = prefix) DESC,
         is_tram_stop DESC NULLS LAST, stop_name, stop_id) AS rank
  FROM t JOIN s ON starts_with(lower(stop_name), prefix)
)
SELECT q.query_id, m.stop_id, m.stop_name, m.stop_code, CAST(60 AS DOUBLE) AS lat, CAST(25 AS DOUBLE) AS lon,
       m.is_tram_stop, CAST(m.rank AS INTEGER) AS rank
FROM q JOIN m ON lower(trim(q.name)) = m.prefix WHERE rank <= 10""",
)
def find_stops(spark, sf_dir):
    """A query per part: whole names in capitals, prefixes of one to six letters, a literal percent sign."""
    key, name = F.col("p_partkey"), F.col("p_name")
    prefix = F.substring(name, F.lit(1), (key % 6 + 1).cast("int"))
    asked = (
        F.when(key % 9 == 0, F.concat(F.upper(name), F.lit(" ")))
        .when(key % 9 == 1, "%")
        .otherwise(F.concat(F.lit("  "), prefix))
    )
    queries = load(spark, sf_dir, "part").select(key.alias("query_id"), asked.alias("name"))
    return a.find_stops(queries, part_stops(spark, sf_dir))


# ---------------------------------------------------------------- weather

_PARAMETERS = ("Precipitation1h", "PoP", "WindSpeedMS", "HourlyMaximumGust", "Temperature")


def base(spark, sf_dir) -> Column:
    """The newest second of the data."""
    return F.date_trunc("second", last_instant(spark, sf_dir))


SQL_BASE = "date_trunc('second', (SELECT max(ts) FROM events))"


def weather_bodies(df, key: Column, point: Column, now: Column):
    """XML answers for three hours and five parameters; every seventh value is NaN, every eleventh no number."""

    def value(h: Column, p: int) -> Column:
        n = key * 7 + h * 3 + p
        return F.when(n % 7 == 0, "NaN").when(n % 11 == 0, "n/a").otherwise(text((n % 200) / F.lit(10.0)))

    def element(h: Column, p: int) -> Column:
        at = F.date_format(
            F.timestamp_seconds(F.col("hour_s") + h * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'"
        )
        return F.concat(
            F.lit("<m:member><b:Element><b:Time>"),
            at,
            F.lit(f"</b:Time><b:ParameterName>{_PARAMETERS[p]}</b:ParameterName><b:ParameterValue>"),
            value(h, p),
            F.lit("</b:ParameterValue></b:Element></m:member>"),
        )

    hours = F.sequence(F.lit(0), F.lit(2))
    members = F.transform(hours, lambda h: F.concat(*[element(h, p) for p in range(len(_PARAMETERS))]))
    body = F.concat(
        F.lit('<?xml version="1.0"?><m:All xmlns:m="urn:m" xmlns:b="urn:b">'), F.array_join(members, ""), F.lit("</m:All>")
    )
    # A table may be one row group, read by one task; the keys are dealt out before they become text.
    dealt = df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)
    timed = dealt.withColumn("hour_s", F.unix_seconds(F.date_trunc("hour", now)))
    return timed.select(point.alias("point_id"), body.alias("body"))


def sql_weather(table: str, key: str, point: str, where: str = "true") -> str:
    def value(p: int) -> str:
        n = f"({key} * 7 + h * 3 + {p})"
        return f"CASE WHEN {n} % 7 <> 0 AND {n} % 11 <> 0 THEN ({n} % 200) / CAST(10 AS DOUBLE) END"

    return f"""weather AS (
  SELECT {point} AS point_id, date_trunc('hour', {SQL_BASE}) + to_hours(h) AS forecast_at,
         {value(0)} AS precipitation_mm_h, {value(1)} AS rain_probability_pct, {value(2)} AS wind_ms,
         {value(3)} AS gust_ms, {value(4)} AS temperature_c
  FROM {table}, (VALUES (0), (1), (2)) hours(h) WHERE {where}
)"""


def _customer_weather(spark, sf_dir):
    key = F.col("c_custkey")
    return a.parse_weather(weather_bodies(load(spark, sf_dir, "customer").select(key), key, key, base(spark, sf_dir)))


@query("weather_parse", f"WITH {sql_weather('customer', 'c_custkey', 'c_custkey')} SELECT * FROM weather")
def weather_parse(spark, sf_dir):
    return _customer_weather(spark, sf_dir)


_NEXT_HOUR = f"""SELECT point_id, max(precipitation_mm_h) AS precipitation_mm_h,
       max(rain_probability_pct) AS rain_probability_pct, max(gust_ms) AS gust_ms, min(temperature_c) AS temperature_c
FROM weather WHERE forecast_at <= {SQL_BASE} + INTERVAL 1 HOUR GROUP BY 1"""


@query("weather_next_hour", f"WITH {sql_weather('customer', 'c_custkey', 'c_custkey')} {_NEXT_HOUR}")
def weather_next_hour(spark, sf_dir):
    return a.weather_next_hour(_customer_weather(spark, sf_dir), base(spark, sf_dir))


# ---------------------------------------------------------------- planner answers

_ROUTES = ("4", "10", "4T", "1", "M1")


def plan_responses(spark, sf_dir, now: Column):
    """A stored planner answer per order, with every kind of missing part."""
    o = F.col("o_orderkey")
    kind = o % 20

    def at(minutes) -> Column:
        minutes = minutes if isinstance(minutes, Column) else F.lit(minutes)
        return F.date_format(
            F.timestamp_seconds(F.unix_seconds(now) + minutes * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'"
        )

    walk_leg = F.struct(F.lit("WALK").alias("mode"))
    ride = F.struct(
        F.lit("TRAM").alias("mode"),
        text(operating_day(now)).alias("serviceDate"),
        F.struct(
            at(3 + o % 5).alias("scheduledTime"),
            F.when(o % 3 != 0, F.struct(at(4 + o % 7).alias("time"))).alias("estimated"),
        ).alias("start"),
        F.struct(F.element_at(F.array(*[F.lit(r) for r in _ROUTES]), (o % 5 + 1).cast("int")).alias("shortName")).alias("route"),
        F.struct(
            text(o % 2).alias("directionId"),
            F.struct((o % 30 * 3600 + o % 4 * 60).alias("scheduledDeparture")).alias("departureStoptime"),
        ).alias("trip"),
        F.struct(F.concat(F.lit("Board "), text(o % 100)).alias("name")).alias("from"),
    )

    def json(*columns: Column) -> Column:
        return F.to_json(F.struct(*columns))

    def node(start: Column, end: Column, *legs: Column) -> Column:
        # Legs differ in their fields, so they are joined as text.
        legs_json = F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(leg) for leg in legs]), F.lit("]"))
        return F.concat(
            F.lit('{"node":{"start":"'), start, F.lit('","end":"'), end, F.lit('","legs":'), legs_json, F.lit("}}")
        )

    cycle = F.struct(
        F.lit("BICYCLE").alias("mode"),
        F.struct(
            F.struct(
                F.concat(F.lit("Bikes "), text(o % 40)).alias("name"),
                F.struct((o % 9).alias("total")).alias("availableVehicles"),
            ).alias("vehicleRentalStation")
        ).alias("from"),
        F.struct(
            F.struct(
                F.concat(F.lit("Dock / "), text(o % 30)).alias("name"),
                F.struct((o % 6).alias("total")).alias("availableSpaces"),
            ).alias("vehicleRentalStation")
        ).alias("to"),
    )

    def edges(*nodes: Column) -> Column:
        return F.concat(F.lit('{"edges":['), F.concat_ws(",", *nodes), F.lit("]}"))

    tram = edges(
        node(at(0), at(9), walk_leg), F.when(kind != 0, node(at(1), at(10 + o % 30), walk_leg, ride))
    )
    walk = edges(F.when(kind != 1, node(at(0), at(5 + o % 40), walk_leg)))
    bike = edges(
        node(at(0), at(8), walk_leg), F.when(kind != 2, node(at(2), at(6 + o % 25), walk_leg, cycle, walk_leg))
    )
    good = F.concat(
        F.lit('{"data":{"tram":'), tram, F.lit(',"walk":'), walk, F.lit(',"bike":'), bike, F.lit("}}")
    )
    messages = F.array(
        F.struct(F.lit("bad").alias("message")), F.struct(F.concat(F.lit("worse "), text(o)).alias("message"))
    )
    body = (
        F.when(kind == 3, json(messages.alias("errors")))
        .when(kind == 4, F.repeat(F.lit("Server trouble. "), 30))
        .when(kind == 5, "not a document")
        .otherwise(good)
    )
    # As in weather_bodies, keys are dealt out before they become text.
    orders = load(spark, sf_dir, "orders").select("o_orderkey").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    return orders.select(
        o.alias("request_id"), F.when(kind == 4, 500).otherwise(200).alias("status"), body.alias("body")
    )


_R = "[" + ", ".join(f"'{r}'" for r in _ROUTES) + "][o % 5 + 1]"


def sql_options(now: str = SQL_BASE) -> str:
    none = {
        "route": "VARCHAR", "direction": "VARCHAR", "operating_day": "VARCHAR", "journey_start": "VARCHAR",
        "board_stop": "VARCHAR", "scheduled_departure": "TIMESTAMP", "expected_departure": "TIMESTAMP",
        "realtime": "BOOLEAN", "bike_station": "VARCHAR", "bikes_available": "INTEGER", "dock_station": "VARCHAR",
        "docks_free": "INTEGER", "error": "VARCHAR",
    }

    def row(option: str, leave: str, arrive: str, fields: dict[str, str], where: str) -> str:
        cells = [f"CAST({fields.get(c, 'NULL')} AS {t}) AS {c}" for c, t in none.items()]
        times = (
            f"n + to_minutes({leave}) AS leave_at, n + to_minutes({arrive}) AS arrive_at, "
            f"CAST(({arrive}) * 60 AS INTEGER) AS arrive_in_s"
            if leave
            else "CAST(NULL AS TIMESTAMP) AS leave_at, CAST(NULL AS TIMESTAMP) AS arrive_at, CAST(NULL AS INTEGER) AS arrive_in_s"
        )
        return f"SELECT o AS request_id, '{option}' AS option, {times}, {', '.join(cells)} FROM asked WHERE {where}"

    tram = {
        "route": _R,
        "direction": "o % 2 + 1",
        "operating_day": sql_day("n"),
        "journey_start": "lpad(CAST(o % 30 AS VARCHAR), 2, '0') || ':0' || CAST(o % 4 AS VARCHAR)",
        "board_stop": "'Board ' || CAST(o % 100 AS VARCHAR)",
        "scheduled_departure": "n + to_minutes(3 + o % 5)",
        "expected_departure": "CASE WHEN o % 3 <> 0 THEN n + to_minutes(4 + o % 7) ELSE n + to_minutes(3 + o % 5) END",
        "realtime": "o % 3 <> 0",
    }
    bike = {
        "bike_station": "'Bikes ' || CAST(o % 40 AS VARCHAR)",
        "bikes_available": "o % 9",
        "dock_station": "'Dock / ' || CAST(o % 30 AS VARCHAR)",
        "docks_free": "o % 6",
    }
    error = {
        "error": "CASE o % 20 WHEN 3 THEN 'bad; worse ' || CAST(o AS VARCHAR) "
        "WHEN 4 THEN 'planner HTTP 500: ' || left(repeat('Server trouble. ', 30), 200) ELSE 'unreadable response' END"
    }
    return f"""asked AS (SELECT o_orderkey AS o, {now} AS n FROM orders),
options AS (
  {row('tram', '1', '10 + o % 30', tram, 'o % 20 NOT IN (0, 3, 4, 5)')}
  UNION ALL {row('walk', '0', '5 + o % 40', {}, 'o % 20 NOT IN (1, 3, 4, 5)')}
  UNION ALL {row('bike', '2', '6 + o % 25', bike, 'o % 20 NOT IN (2, 3, 4, 5)')}
  UNION ALL {row('error', '', '', error, 'o % 20 IN (3, 4, 5)')}
)"""


@query("trip_parse", f"WITH {sql_options()} SELECT * FROM options")
def trip_parse(spark, sf_dir):
    now = base(spark, sf_dir)
    return a.parse_trip_plans(plan_responses(spark, sf_dir, now), now)


_PIVOT = """trips AS (
  SELECT request_id, max(CASE WHEN option = 'tram' THEN arrive_in_s END) AS tram_arrive_s,
         max(CASE WHEN option = 'walk' THEN arrive_in_s END) AS walk_arrive_s,
         max(CASE WHEN option = 'bike' THEN arrive_in_s END) AS bike_arrive_s, max(route) AS route,
         max(direction) AS direction, max(operating_day) AS operating_day, max(journey_start) AS journey_start,
         max(expected_departure) AS expected_departure, bool_or(realtime) AS realtime, max(bike_station) AS bike_station,
         max(bikes_available) AS bikes_available, max(dock_station) AS dock_station, max(docks_free) AS docks_free,
         max(error) AS error
  FROM options GROUP BY 1
)"""


@query("trip_pivot", f"WITH {sql_options()}, {_PIVOT} SELECT * FROM trips")
def trip_pivot(spark, sf_dir):
    now = base(spark, sf_dir)
    return a.pivot_trips(a.parse_trip_plans(plan_responses(spark, sf_dir, now), now))


def riding(spark, sf_dir):
    """The current fleet on journeys named the planner's way."""
    user = F.regexp_replace("vehicle_id", "^40/", "").cast("int")
    start = F.format_string("%02d:%02d", user % 30, user % 4)
    day = text(operating_day(F.col("last_seen_at")))
    return latest_by_key(positions(spark, sf_dir), ["vehicle_id"], "last_seen_at").withColumn(
        "journey_id", F.concat_ws("|", "route", "direction", day, start)
    )


def sql_ours(now: str = SQL_BASE) -> str:
    return f"""riding AS (
  SELECT *, concat_ws('|', route, direction, CAST({sql_day('last_seen_at')} AS VARCHAR),
         lpad(CAST(u % 30 AS VARCHAR), 2, '0') || ':0' || CAST(u % 4 AS VARCHAR)) AS journey
  FROM (SELECT *, CAST(split_part(vehicle_id, '/', 2) AS INTEGER) AS u FROM vehicle_current)
),
ours AS (
  SELECT t.request_id, arg_max(r.lateness_s, r.last_seen_at) FILTER (WHERE r.last_seen_at = top) AS our_lateness_s,
         min({sql_diff_s('r.last_seen_at', now)}) AS our_age_s
  FROM trips t JOIN (SELECT *, max(last_seen_at) OVER (PARTITION BY journey) AS top FROM riding) r
    ON r.journey = concat_ws('|', t.route, t.direction, t.operating_day, t.journey_start)
  GROUP BY 1
)"""


@query(
    "journey_match",
    f"""WITH {SQL_CURRENT}, {sql_options()}, {_PIVOT}, {sql_ours()}
SELECT t.request_id, t.route, t.direction, t.journey_start, our_lateness_s, our_age_s
FROM trips t LEFT JOIN ours o ON t.request_id = o.request_id""",
)
def journey_match(spark, sf_dir):
    now = base(spark, sf_dir)
    trips = a.pivot_trips(a.parse_trip_plans(plan_responses(spark, sf_dir, now), now))
    matched = a.measured_lateness(trips, riding(spark, sf_dir), now)
    return matched.select("request_id", "route", "direction", "journey_start", "our_lateness_s", "our_age_s")


# ---------------------------------------------------------------- the rule


def sql_decide(source: str) -> str:
    def mins(c: str) -> str:
        return f"CAST(CAST(round_even({c} / 60.0, 0) AS INTEGER) AS VARCHAR) || ' min'"

    wet = "(coalesce(precipitation_mm_h >= 0.5, false) OR coalesce(rain_probability_pct >= 70, false))"
    t, w, b = mins("tram_arrive_s"), mins("walk_arrive_s"), mins("bike_arrive_s")
    return f"""blocked AS (
  SELECT *, CASE WHEN NOT in_bike_season THEN 'city bikes are out of season (April to October only)'
      WHEN bike_arrive_s IS NULL THEN 'no city bike nearby with a free bike and a free dock at the other end'
      WHEN {wet} THEN 'rain is forecast'
      WHEN gust_ms >= 10 THEN 'gusts up to ' || CAST(CAST(round_even(gust_ms, 0) AS BIGINT) AS VARCHAR) || ' m/s are forecast'
      WHEN temperature_c <= 0 THEN 'it is freezing, roads may be icy' END AS nb,
    CASE WHEN walk_arrive_s IS NULL THEN 'no walking route'
      WHEN {wet} AND walk_arrive_s > 600 THEN 'it is a long walk in the rain' END AS nw
  FROM {source}
),
decided AS (
  SELECT *, CASE
    WHEN tram_arrive_s IS NULL AND nb IS NOT NULL AND nw IS NOT NULL THEN 'none'
    WHEN tram_arrive_s IS NULL AND nb IS NULL AND (nw IS NOT NULL OR bike_arrive_s <= walk_arrive_s) THEN 'bike'
    WHEN tram_arrive_s IS NULL THEN 'walk'
    WHEN nw IS NULL AND walk_arrive_s <= tram_arrive_s THEN
      CASE WHEN nb IS NULL AND bike_arrive_s + 120 <= walk_arrive_s THEN 'bike' ELSE 'walk' END
    WHEN nb IS NULL AND bike_arrive_s + 120 <= tram_arrive_s THEN 'bike' ELSE 'wait' END AS choice
  FROM blocked
),
reasoned AS (
  SELECT *, CASE
    WHEN tram_arrive_s IS NULL AND choice = 'none' THEN 'no tram found, and ' || nb
    WHEN tram_arrive_s IS NULL AND choice = 'bike' THEN 'no tram found; you arrive in ' || {b} || ' by bike'
    WHEN tram_arrive_s IS NULL THEN 'no tram found; you arrive in ' || {w} || ' by walk'
    WHEN choice = 'bike' AND nw IS NULL AND walk_arrive_s <= tram_arrive_s
      THEN 'the bike gets you there in ' || {b} || ', walking takes ' || {w} || ' and the tram ' || {t}
    WHEN choice = 'walk' THEN 'walking gets you there in ' || {w} || ', no later than the tram (' || {t} || ')'
    WHEN choice = 'bike' THEN 'the bike gets you there in ' || {b} || ', the tram in ' || {t}
    ELSE 'the tram gets you there in ' || {t} || '; no bike: ' || coalesce(nb, 'the bike would save less than 2 min')
    END AS reason
  FROM decided
)"""


_TRIPS = {
    "tram_arrive_s": (7, "300 + o * 37 % 1500"),
    "walk_arrive_s": (11, "200 + o * 53 % 1700"),
    "bike_arrive_s": (5, "150 + o * 29 % 1400"),
    "precipitation_mm_h": (13, "o % 23 / 30.0D"),
    "rain_probability_pct": (17, "o * 7 % 101 / 1.0D"),
    "gust_ms": (19, "o * 3 % 141 / 10.0D"),
    "temperature_c": (23, "o % 41 / 1.0D - 5"),
}


def _trip_sql(engine: str) -> str:
    cells = []
    for c, (gap, value) in _TRIPS.items():
        kind = "INT" if c.endswith("_s") and "gust" not in c else "DOUBLE"
        if engine == "duckdb":
            value = value.replace("30.0D", "CAST(30 AS DOUBLE)").replace("10.0D", "CAST(10 AS DOUBLE)")
            value = value.replace("1.0D", "CAST(1 AS DOUBLE)")
        cells.append(f"CAST(CASE WHEN o % {gap} <> 0 THEN {value} END AS {kind}) AS {c}")
    return ", ".join(["o AS request_id", *cells, "o % 6 <> 0 AS in_bike_season"])


@query(
    "trip_decision",
    f"""WITH keys AS (SELECT o_orderkey AS o FROM orders), trips AS (SELECT {_trip_sql('duckdb')} FROM keys),
{sql_decide('trips')} SELECT * EXCLUDE (nb, nw) FROM reasoned""",
)
def trip_decision(spark, sf_dir):
    """A trip per order whose figures hit every branch and every unknown."""
    keys = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"))
    return a.decide(keys.selectExpr(*_split(_trip_sql("spark"))))


def _split(columns: str) -> list[str]:
    return columns.split(", ")


# ---------------------------------------------------------------- the whole batch


def advice_inputs(spark, sf_dir, now: Column):
    o = F.col("o_orderkey")
    requests = load(spark, sf_dir, "orders").select(
        o.alias("request_id"),
        F.when(o % 50 == 0, "nowhere").otherwise(F.concat(F.lit("NATION_"), text(o % 25))).alias("from_stop"),
        F.when(o % 9 == 0, " nation_")
        .when(o % 51 == 0, "Nope")
        .otherwise(F.concat(F.lit("nation_"), text(o % 24), F.lit(" ")))
        .alias("to_stop"),
    )
    nations = load(spark, sf_dir, "nation").where(F.col("n_nationkey") % 6 != 5)
    bodies = weather_bodies(nations, F.col("n_nationkey"), text(F.col("n_nationkey")), base(spark, sf_dir))
    return requests, bodies


def advice(spark, sf_dir, now: Column):
    requests, bodies = advice_inputs(spark, sf_dir, now)
    return a.advise(
        requests,
        stops_of_nations(spark, sf_dir),
        plan_responses(spark, sf_dir, now),
        a.parse_weather(bodies),
        feed_live(heartbeats(spark, sf_dir), now),
        riding(spark, sf_dir),
        now,
    )


def sql_advice(now: str, live: str, season: str) -> str:
    whole = "CAST(floor({} / 60.0 + 0.5) AS INTEGER)"
    trip_columns = (
        "tram_arrive_s walk_arrive_s bike_arrive_s route direction expected_departure realtime bike_station "
        "bikes_available dock_station docks_free error"
    ).split()
    kept = ", ".join(f"CASE WHEN f IS NOT NULL AND g IS NOT NULL THEN t.{c} END AS {c}" for c in trip_columns)
    ours = ", ".join(
        f"CASE WHEN f IS NOT NULL AND g IS NOT NULL THEN u.{c} END AS {c}" for c in ("our_lateness_s", "our_age_s")
    )
    return f"""WITH {SQL_CURRENT}, {SQL_REFERENCE}, {sql_options(now)}, {_PIVOT}, {sql_ours(now)},
{sql_weather('nation', 'n_nationkey', 'CAST(n_nationkey AS VARCHAR)', 'n_nationkey % 6 <> 5')},
sky AS ({_NEXT_HOUR.replace(f"{SQL_BASE} + INTERVAL 1 HOUR", f"{now} + INTERVAL 1 HOUR")}),
requests AS (
  SELECT o_orderkey AS o, CASE WHEN o_orderkey % 50 <> 0 THEN 'NATION_' || CAST(o_orderkey % 25 AS VARCHAR) END AS f,
         CASE WHEN o_orderkey % 9 = 0 THEN 'NATION_0' WHEN o_orderkey % 51 <> 0
              THEN 'NATION_' || CAST(o_orderkey % 24 AS VARCHAR) END AS g FROM orders
),
facts AS (
  SELECT r.o, r.f, r.g, {kept}, {ours}, s.precipitation_mm_h, s.rain_probability_pct, s.gust_ms, s.temperature_c,
         {live} AS feed_live, {season} AS in_bike_season
  FROM requests r LEFT JOIN trips t ON t.request_id = r.o LEFT JOIN ours u ON u.request_id = r.o
  LEFT JOIN sky s ON s.point_id = CASE WHEN r.f IS NOT NULL THEN CAST(r.o % 25 AS VARCHAR) END
),
{sql_decide('facts')},
down AS (SELECT *, error IS NOT NULL AND coalesce(tram_arrive_s, walk_arrive_s, bike_arrive_s) IS NULL AS is_down FROM reasoned)
SELECT o AS request_id, CASE WHEN f IS NULL OR g IS NULL OR is_down THEN 'none' ELSE choice END AS choice,
       CASE WHEN f IS NULL THEN 'no Stop called "nowhere"' WHEN g IS NULL THEN 'no Stop called "Nope"'
            WHEN is_down THEN 'the journey planner did not answer, so there is nothing to compare' ELSE reason END AS reason,
       f AS from_stop, g AS to_stop, route AS tram_route, direction AS tram_direction,
       {whole.format(sql_diff_s(now, 'expected_departure'))} AS tram_departs_in_min,
       {whole.format('tram_arrive_s')} AS tram_arrives_in_min, realtime AS tram_departure_realtime,
       CASE WHEN feed_live AND our_age_s <= 300 THEN our_lateness_s END AS measured_lateness_s,
       our_age_s AS measured_age_s, feed_live, {whole.format('walk_arrive_s')} AS walk_arrives_in_min,
       {whole.format('bike_arrive_s')} AS bike_arrives_in_min, bike_station, bikes_available, dock_station, docks_free,
       precipitation_mm_h, rain_probability_pct, gust_ms, temperature_c, in_bike_season,
       nullif(concat_ws('; ', error, CASE WHEN precipitation_mm_h IS NULL AND gust_ms IS NULL THEN 'no weather forecast' END,
         CASE WHEN NOT feed_live THEN 'our feed is not running, so measured Lateness is unknown' END), '') AS problems
FROM down"""


@query("trip_advice", sql_advice(SQL_BASE, "true", "false"))
def trip_advice(spark, sf_dir):
    """In January, with the feed running."""
    return advice(spark, sf_dir, base(spark, sf_dir))


_SUMMER = f"({SQL_BASE} + INTERVAL 180 DAY)"


@query("trip_advice_summer", sql_advice(_SUMMER, "false", "true"))
def trip_advice_summer(spark, sf_dir):
    """180 days later: bikes are in season, the feed is down."""
    return advice(spark, sf_dir, base(spark, sf_dir) + F.expr("INTERVAL 180 DAYS"))
