"""Trip advice over tables: stop search, forecasts, planner answers, the decision rule."""

from __future__ import annotations

from itertools import zip_longest
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import instant, whole_seconds
from ..functions.status import HIDDEN_S

# Thresholds of the rule.
RAIN_MM_H = 0.5
RAIN_PROBABILITY_PCT = 70
GUST_MS = 10.0
FREEZING_C = 0.0
WALK_IN_RAIN_MAX_S = 600
BIKE_MIN_SAVING_S = 120
BIKE_SEASON_MONTHS = (4, 10)

# Texts of the rule.
OUT_OF_SEASON = "city bikes are out of season (April to October only)"
NO_BIKE = "no city bike nearby with a free bike and a free dock at the other end"
RAIN = "rain is forecast"
ICE = "it is freezing, roads may be icy"
NO_WALK = "no walking route"
LONG_WET_WALK = "it is a long walk in the rain"

# The planner's answer and the parts of it that are read.
PLAN_SCHEMA = """
    data STRUCT<
      tram: STRUCT<edges: ARRAY<STRUCT<node: STRUCT<start: STRING, `end`: STRING, legs: ARRAY<STRUCT<
        mode: STRING, serviceDate: STRING,
        start: STRUCT<scheduledTime: STRING, estimated: STRUCT<time: STRING>>,
        route: STRUCT<shortName: STRING>,
        trip: STRUCT<directionId: STRING, departureStoptime: STRUCT<scheduledDeparture: INT>>,
        `from`: STRUCT<name: STRING>>>>>>>,
      walk: STRUCT<edges: ARRAY<STRUCT<node: STRUCT<start: STRING, `end`: STRING>>>>,
      bike: STRUCT<edges: ARRAY<STRUCT<node: STRUCT<start: STRING, `end`: STRING, legs: ARRAY<STRUCT<
        mode: STRING,
        `from`: STRUCT<vehicleRentalStation: STRUCT<name: STRING, availableVehicles: STRUCT<total: INT>>>,
        `to`: STRUCT<vehicleRentalStation: STRUCT<name: STRING, availableSpaces: STRUCT<total: INT>>>>>>>>>>,
    errors ARRAY<STRUCT<message: STRING>>
"""
# Parameters of a forecast and the columns they become.
WEATHER_PARAMETERS = {
    "Precipitation1h": "precipitation_mm_h",
    "PoP": "rain_probability_pct",
    "WindSpeedMS": "wind_ms",
    "HourlyMaximumGust": "gust_ms",
    "Temperature": "temperature_c",
}


# ---------------------------------------------------------------- stop search


def find_stops(queries: DataFrame, stops: DataFrame, k: int = 10) -> DataFrame:
    """The k best stops for each query text: exact names first, tram stops first, then by name.

    ``queries(query_id, name)``; a stop matches when its name starts with the
    trimmed query, case ignored.  ``%`` and ``_`` in a query stand for
    themselves.  Only prefixes someone asked for are kept, and each is reduced
    to its k best stops (limited on the map side too) before queries join it,
    so a short prefix shared by many stops never multiplies rows.  That first
    limit sorts what a task holds, so stops are dealt out before they become
    prefixes; queries are never collected, whatever the size of their table.
    """
    asked = queries.select("query_id", F.lower(F.trim("name")).alias("prefix"))
    wanted = asked.where(F.col("prefix").isNotNull()).select("prefix").distinct()
    lower = F.lower("stop_name")
    prefixes = stops.where(F.col("stop_name").isNotNull()).repartition("stop_id", "stop_name").select(
        "stop_id",
        "stop_name",
        "stop_code",
        "lat",
        F.col("long").alias("lon"),
        (F.col("main_vehicle_type") == 0).alias("is_tram_stop"),
        F.explode(
            F.transform(F.sequence(F.lit(0), F.length(lower)), lambda n: F.substring(lower, F.lit(1), n))
        ).alias("prefix"),
    )
    best = Window.partitionBy("prefix").orderBy(
        F.desc(F.lower("stop_name") == F.col("prefix")), F.desc("is_tram_stop"), "stop_name", "stop_id"
    )
    top = (
        prefixes.join(wanted, "prefix", "left_semi")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
    )
    # A prefix has at most k stops, so its side is the one to keep in memory.
    return asked.join(top.hint("shuffle_hash"), "prefix").drop("prefix")


# ---------------------------------------------------------------- weather


_MEMBERS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in "tnv"]))


@F.pandas_udf(_MEMBERS)
def _weather_members(bodies: pd.Series) -> pd.Series:
    """Texts of the elements Time, ParameterName and ParameterValue of XML answers, in their order, side by side."""

    def members(body: str | None) -> list[dict] | None:
        if not body:
            return None
        found, open_elements, pieces = {"Time": [], "ParameterName": [], "ParameterValue": []}, [], []

        def end_of_text(*_) -> None:
            # A text ends where an element, a comment or an instruction begins or ends.
            if pieces and open_elements[-1] in found:
                found[open_elements[-1]].append("".join(pieces))
            pieces.clear()

        def start(name: str, _) -> None:
            end_of_text()
            open_elements.append(name.rpartition(":")[2])

        def end(_) -> None:
            end_of_text()
            open_elements.pop()

        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, pieces.append
        parser.CommentHandler = parser.ProcessingInstructionHandler = end_of_text
        parser.Parse(body, True)
        return [dict(zip("tnv", texts)) for texts in zip_longest(*found.values())]

    return bodies.map(members)


def parse_weather(responses: DataFrame, key: str = "point_id", body: str = "body") -> DataFrame:
    """Hourly forecast rows from XML answers: one row per key and hour, NaN as NULL.

    Answers are parsed once each, in the tasks that hold them.  A body that is no XML stops the job.
    """
    long = responses.select(key, F.inline(_weather_members(body)).alias("t", "n", "v")).select(
        key,
        F.try_to_timestamp("t").alias("forecast_at"),
        "n",
        F.nullif(F.col("v").try_cast("double"), F.lit(float("nan"))).alias("value"),
    )
    return long.groupBy(key, "forecast_at").agg(
        *[F.max(F.when(F.col("n") == name, F.col("value"))).alias(c) for name, c in WEATHER_PARAMETERS.items()]
    )


def weather_next_hour(weather: DataFrame, as_of, key: str = "point_id") -> DataFrame:
    """Worst of the forecast up to one hour ahead, per point."""
    return (
        weather.where(F.col("forecast_at") <= instant(as_of) + F.expr("INTERVAL 1 HOUR"))
        .groupBy(key)
        .agg(
            F.max("precipitation_mm_h").alias("precipitation_mm_h"),
            F.max("rain_probability_pct").alias("rain_probability_pct"),
            F.max("gust_ms").alias("gust_ms"),
            F.min("temperature_c").alias("temperature_c"),
        )
    )


# ---------------------------------------------------------------- planner answers


def response_body(status: Column, text: Column, label: str = "planner HTTP") -> Column:
    """The body of a good answer; a failed one becomes an errors document."""
    message = F.concat(F.lit(f"{label} "), status.cast("string"), F.lit(": "), F.substring(text, 1, 200))
    errors = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("errors")))
    return F.when(status == 200, text).otherwise(errors)


OPTION_TYPES = {
    "option": "string",
    "leave_at": "timestamp",
    "arrive_at": "timestamp",
    "arrive_in_s": "int",
    "route": "string",
    "direction": "string",
    "operating_day": "string",
    "journey_start": "string",
    "board_stop": "string",
    "scheduled_departure": "timestamp",
    "expected_departure": "timestamp",
    "realtime": "boolean",
    "bike_station": "string",
    "bikes_available": "int",
    "dock_station": "string",
    "docks_free": "int",
    "error": "string",
}


def _option(name: str, fields: dict[str, Column]) -> Column:
    """One option row with all columns of the result, absent ones NULL."""
    fields = {"option": F.lit(name), **fields}
    return F.struct(
        *[fields.get(c, F.lit(None)).cast(t).alias(c) for c, t in OPTION_TYPES.items()]
    )


def _times(node: Column, as_of) -> dict[str, Column]:
    arrive = F.try_to_timestamp(node["end"])
    return {
        "leave_at": F.try_to_timestamp(node["start"]),
        "arrive_at": arrive,
        "arrive_in_s": whole_seconds(instant(as_of), arrive).cast("int"),
    }


def _first_riding(edges: Column, mode: str) -> Column:
    """The first itinerary that has a leg of the mode."""
    riding = F.filter(edges, lambda e: F.exists(e["node"]["legs"], lambda leg: leg["mode"] == mode))
    return F.get(riding, F.lit(0))["node"]


def _leg(node: Column, mode: str) -> Column:
    return F.get(F.filter(node["legs"], lambda leg: leg["mode"] == mode), F.lit(0))


def clock_text(secs: Column) -> Column:
    """HH:MM of seconds since the start of the service day; hours may pass 24."""
    return F.format_string("%02d:%02d", F.floor(secs / 3600), F.floor(F.pmod(secs, F.lit(3600)) / 60))


def parse_trip_plans(responses: DataFrame, as_of, label: str = "planner HTTP") -> DataFrame:
    """One row per option (tram, walk, bike, error) of each stored planner answer.

    ``responses(request_id, status, body)``.  Each body is parsed once; the
    options are rows of an array, so there is no self-join and no union.
    """
    doc = responses.select(
        "request_id",
        F.from_json(response_body(F.col("status"), F.col("body"), label), PLAN_SCHEMA).alias("r"),
    )
    data = F.col("r.data")
    picked = doc.select(
        "request_id",
        "r",
        _first_riding(data["tram"]["edges"], "TRAM").alias("tram"),
        F.get(data["walk"]["edges"], F.lit(0))["node"].alias("walk"),
        _first_riding(data["bike"]["edges"], "BICYCLE").alias("bike"),
    ).withColumns({"ride": _leg(F.col("tram"), "TRAM"), "cycle": _leg(F.col("bike"), "BICYCLE")})

    tram, walk, bike = F.col("tram"), F.col("walk"), F.col("bike")
    ride, cycle = F.col("ride"), F.col("cycle")
    planned = F.try_to_timestamp(ride["start"]["scheduledTime"])
    estimated = ride["start"]["estimated"]["time"]
    starts_s = ride["trip"]["departureStoptime"]["scheduledDeparture"]
    rental, dock = cycle["from"]["vehicleRentalStation"], cycle["to"]["vehicleRentalStation"]
    messages = F.array_join(F.transform(F.col("r.errors"), lambda e: e["message"]), "; ")
    failed = F.col("r.errors").isNotNull() | F.col("r.data").isNull()

    options = F.array(
        F.when(
            tram.isNotNull(),
            _option(
                "tram",
                {
                    **_times(tram, as_of),
                    "route": ride["route"]["shortName"],
                    "direction": ride["trip"]["directionId"].try_cast("int") + 1,
                    "operating_day": ride["serviceDate"],
                    "journey_start": F.when(starts_s.isNotNull(), clock_text(starts_s)),
                    "board_stop": ride["from"]["name"],
                    "scheduled_departure": planned,
                    "expected_departure": F.coalesce(F.try_to_timestamp(estimated), planned),
                    "realtime": estimated.isNotNull(),
                },
            ),
        ),
        F.when(walk.isNotNull(), _option("walk", _times(walk, as_of))),
        F.when(
            bike.isNotNull(),
            _option(
                "bike",
                {
                    **_times(bike, as_of),
                    "bike_station": rental["name"],
                    "bikes_available": rental["availableVehicles"]["total"],
                    "dock_station": dock["name"],
                    "docks_free": dock["availableSpaces"]["total"],
                },
            ),
        ),
        F.when(failed, _option("error", {"error": F.coalesce(messages, F.lit("unreadable response"))})),
    )
    return picked.select("request_id", F.inline(F.array_compact(options)))


def pivot_trips(options: DataFrame) -> DataFrame:
    """One row per request with the figures of its options side by side."""

    def of(option: str, column: str) -> Column:
        return F.max(F.when(F.col("option") == option, F.col(column)))

    tram_columns = ["route", "direction", "operating_day", "journey_start", "expected_departure", "realtime"]
    return options.groupBy("request_id").agg(
        *[of(o, "arrive_in_s").alias(f"{o}_arrive_s") for o in ("tram", "walk", "bike")],
        *[of("tram", c).alias(c) for c in tram_columns],
        F.max("bike_station").alias("bike_station"),
        F.max("bikes_available").alias("bikes_available"),
        F.max("dock_station").alias("dock_station"),
        F.max("docks_free").alias("docks_free"),
        F.max("error").alias("error"),
    )


def measured_lateness(trips: DataFrame, current: DataFrame, as_of) -> DataFrame:
    """Our own Lateness for the journey a trip rides: newest value, smallest age.

    The fleet is reduced to one row per journey before the join, so a journey
    shared by many vehicles or trips adds no rows.
    """
    parts = [F.col(c).cast("string") for c in ("route", "direction", "operating_day", "journey_start")]
    journey = F.when(F.col("route").isNotNull(), F.concat_ws("|", *parts))
    per_journey = current.groupBy("journey_id").agg(
        F.max(F.struct("last_seen_at", "vehicle_id", "lateness_s")).alias("newest")
    )
    measured = per_journey.select(
        "journey_id",
        F.col("newest.lateness_s").alias("our_lateness_s"),
        whole_seconds(F.col("newest.last_seen_at"), instant(as_of)).alias("our_age_s"),
    )
    return trips.withColumn("journey_id", journey).join(measured, "journey_id", "left").drop("journey_id")


# ---------------------------------------------------------------- the rule


def _minutes(secs: Column) -> Column:
    """'12 min'; half minutes round to even."""
    return F.concat(F.bround(secs / F.lit(60.0)).cast("int").cast("string"), F.lit(" min"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def decide(trips: DataFrame) -> DataFrame:
    """Add choice (wait, walk, bike, none) and reason.

    Needs tram_arrive_s, walk_arrive_s, bike_arrive_s, precipitation_mm_h,
    rain_probability_pct, gust_ms, temperature_c, in_bike_season.  An unknown
    forecast blocks nothing.
    """
    tram, walk, bike = F.col("tram_arrive_s"), F.col("walk_arrive_s"), F.col("bike_arrive_s")
    wet = F.coalesce(F.col("precipitation_mm_h") >= RAIN_MM_H, F.lit(False)) | F.coalesce(
        F.col("rain_probability_pct") >= RAIN_PROBABILITY_PCT, F.lit(False)
    )
    gust = F.col("gust_ms")
    gusts = _text("gusts up to ", F.bround(gust).cast("bigint").cast("string"), " m/s are forecast")
    ruled = trips.withColumns(
        {
            "__no_bike": F.when(~F.coalesce("in_bike_season", F.lit(False)), OUT_OF_SEASON)
            .when(bike.isNull(), NO_BIKE)
            .when(wet, RAIN)
            .when(gust >= GUST_MS, gusts)
            .when(F.col("temperature_c") <= FREEZING_C, ICE),
            "__no_walk": F.when(walk.isNull(), NO_WALK).when(wet & (walk > WALK_IN_RAIN_MAX_S), LONG_WET_WALK),
        }
    )
    no_bike, no_walk = F.col("__no_bike"), F.col("__no_walk")
    # NULL when ruled out, so comparisons with it are never true.
    ride, stroll = F.when(no_bike.isNull(), bike), F.when(no_walk.isNull(), walk)

    def bike_saves(over: Column) -> Column:
        return F.coalesce(ride + BIKE_MIN_SAVING_S <= over, F.lit(False))

    walk_wins = F.coalesce(stroll <= tram, F.lit(False))
    choice = (
        F.when(
            tram.isNull(),
            F.when(ride.isNull() & stroll.isNull(), "none")
            .when(stroll.isNull() | (ride <= stroll), "bike")
            .otherwise("walk"),
        )
        .when(walk_wins & bike_saves(walk), "bike")
        .when(walk_wins, "walk")
        .when(bike_saves(tram), "bike")
        .otherwise("wait")
    )
    by_tram, by_walk, by_bike = _minutes(tram), _minutes(walk), _minutes(bike)
    small_saving = f"the bike would save less than {BIKE_MIN_SAVING_S // 60} min"
    chosen = F.col("choice")
    reason = (
        F.when(tram.isNull() & (chosen == "none"), _text("no tram found, and ", F.coalesce(no_bike, no_walk)))
        .when(
            tram.isNull(),
            _text(
                "no tram found; you arrive in ", F.when(chosen == "bike", by_bike).otherwise(by_walk), " by ", chosen
            ),
        )
        .when(
            (chosen == "bike") & walk_wins,
            _text("the bike gets you there in ", by_bike, ", walking takes ", by_walk, " and the tram ", by_tram),
        )
        .when(chosen == "walk", _text("walking gets you there in ", by_walk, ", no later than the tram (", by_tram, ")"))
        .when(chosen == "bike", _text("the bike gets you there in ", by_bike, ", the tram in ", by_tram))
        .otherwise(
            _text("the tram gets you there in ", by_tram, "; no bike: ", F.coalesce(no_bike, F.lit(small_saving)))
        )
    )
    return ruled.withColumn("choice", choice).withColumn("reason", reason).drop("__no_bike", "__no_walk")


def in_bike_season(as_of) -> Column:
    return F.month(instant(as_of)).between(*BIKE_SEASON_MONTHS)


def _whole_minutes(secs: Column) -> Column:
    """Minutes, half up."""
    return F.round(secs / F.lit(60.0)).cast("int")


def advise(
    requests: DataFrame,
    stops: DataFrame,
    plans: DataFrame,
    weather: DataFrame,
    live: DataFrame,
    current: DataFrame,
    as_of,
    planner: str = "journey planner",
    feed: str = "feed",
    label: str = "planner HTTP",
) -> DataFrame:
    """Bike, walk or wait for each request.

    ``requests(request_id, from_stop, to_stop)`` name stops; ``plans(request_id,
    status, body)`` are stored planner answers; ``weather(point_id, ...)``
    forecasts keyed by origin stop id; ``live`` the one-row feed_live result.
    ``planner`` and ``feed`` name the services in the texts.
    """
    # Each side of a trip is one lookup; equal names are looked up once.
    names = (
        requests.select(F.col("from_stop").alias("name"))
        .union(requests.select(F.col("to_stop").alias("name")))
        .where(F.col("name").isNotNull())
        .distinct()
    )
    found = find_stops(names.select(F.col("name").alias("query_id"), "name"), stops, k=1).select(
        F.col("query_id").alias("asked"), "stop_id", "stop_name"
    )

    def endpoint(side: str) -> DataFrame:
        return found.withColumnsRenamed(
            {"asked": f"{side}_stop", "stop_id": f"{side}_stop_id", "stop_name": f"{side}_name"}
        )

    trips = measured_lateness(pivot_trips(parse_trip_plans(plans, as_of, label)), current, as_of)
    sky = weather_next_hour(weather, as_of).withColumnRenamed("point_id", "from_stop_id")
    facts = (
        requests.select("request_id", "from_stop", "to_stop")
        .join(endpoint("from"), "from_stop", "left")
        .join(endpoint("to"), "to_stop", "left")
        .join(sky, "from_stop_id", "left")
        .join(trips, "request_id", "left")
    )
    # Without both stops no trip is planned, whatever answer is stored.
    both = F.col("from_name").isNotNull() & F.col("to_name").isNotNull()
    trip_columns = [c for c in trips.columns if c != "request_id"]
    facts = facts.withColumns({c: F.when(both, F.col(c)) for c in trip_columns}).withColumns(
        {
            "feed_live": live.select("feed_live").scalar(),
            "in_bike_season": in_bike_season(as_of),
        }
    )
    arrivals = F.coalesce("tram_arrive_s", "walk_arrive_s", "bike_arrive_s")
    planner_down = F.col("error").isNotNull() & arrivals.isNull()
    decided = decide(facts)
    is_live = F.col("feed_live")
    problems = F.concat_ws(
        "; ",
        F.col("error"),
        F.when(F.col("precipitation_mm_h").isNull() & F.col("gust_ms").isNull(), "no weather forecast"),
        F.when(~is_live, f"our {feed} is not running, so measured Lateness is unknown"),
    )
    return decided.select(
        "request_id",
        F.when(F.col("from_name").isNull() | F.col("to_name").isNull() | planner_down, "none")
        .otherwise(F.col("choice"))
        .alias("choice"),
        F.when(F.col("from_name").isNull(), _text('no Stop called "', F.coalesce("from_stop", F.lit("")), '"'))
        .when(F.col("to_name").isNull(), _text('no Stop called "', F.coalesce("to_stop", F.lit("")), '"'))
        .when(planner_down, f"the {planner} did not answer, so there is nothing to compare")
        .otherwise(F.col("reason"))
        .alias("reason"),
        F.col("from_name").alias("from_stop"),
        F.col("to_name").alias("to_stop"),
        F.col("route").alias("tram_route"),
        F.col("direction").alias("tram_direction"),
        _whole_minutes(whole_seconds(instant(as_of), F.col("expected_departure"))).alias("tram_departs_in_min"),
        _whole_minutes(F.col("tram_arrive_s")).alias("tram_arrives_in_min"),
        F.col("realtime").alias("tram_departure_realtime"),
        F.when(is_live & (F.col("our_age_s") <= HIDDEN_S), F.col("our_lateness_s")).alias("measured_lateness_s"),
        F.col("our_age_s").alias("measured_age_s"),
        "feed_live",
        _whole_minutes(F.col("walk_arrive_s")).alias("walk_arrives_in_min"),
        _whole_minutes(F.col("bike_arrive_s")).alias("bike_arrives_in_min"),
        "bike_station",
        "bikes_available",
        "dock_station",
        "docks_free",
        "precipitation_mm_h",
        "rain_probability_pct",
        "gust_ms",
        "temperature_c",
        "in_bike_season",
        F.nullif(problems, F.lit("")).alias("problems"),
    )
