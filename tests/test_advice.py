import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayfeed.operators import advice as a

NOW = "2026-07-01 15:25:00"
DRY = (0.0, 10.0, 5.0, 12.0, True)
SCHEMA = (
    "n int, tram_arrive_s int, walk_arrive_s int, bike_arrive_s int, precipitation_mm_h double, "
    "rain_probability_pct double, gust_ms double, temperature_c double, in_bike_season boolean"
)
FIELD = {"rain": 0, "prob": 1, "gust": 2, "temp": 3, "season": 4}

# Around each threshold: the last value on one side, the first on the other.  Arrivals by tram, on foot, by bike.
FAR, TIED = (2000, 2600, 900), (1000, 1000, None)
CASES = [
    (FAR, {}, "bike"),
    (FAR, {"rain": a.RAIN_MM_H - 0.01}, "bike"),
    (FAR, {"rain": a.RAIN_MM_H}, "wait"),
    (FAR, {"prob": a.RAIN_PROBABILITY_PCT - 0.1}, "bike"),
    (FAR, {"prob": float(a.RAIN_PROBABILITY_PCT)}, "wait"),
    (FAR, {"gust": a.GUST_MS - 0.1}, "bike"),
    (FAR, {"gust": 17.6}, "wait"),
    (FAR, {"temp": a.FREEZING_C + 0.1}, "bike"),
    (FAR, {"temp": a.FREEZING_C}, "wait"),
    (FAR, {"season": False}, "wait"),
    ((2000, 2600, None), {}, "wait"),
    ((2000, 2600, 2000 - a.BIKE_MIN_SAVING_S), {}, "bike"),
    ((2000, 2600, 2001 - a.BIKE_MIN_SAVING_S), {}, "wait"),
    (TIED, {}, "walk"),
    ((1000, 1001, None), {}, "wait"),
    ((2000, 1300, 1300 - a.BIKE_MIN_SAVING_S), {}, "bike"),
    ((2000, 1300, 1301 - a.BIKE_MIN_SAVING_S), {}, "walk"),
    ((1900, a.WALK_IN_RAIN_MAX_S, 200), {"rain": 4.0}, "walk"),
    ((1900, a.WALK_IN_RAIN_MAX_S + 1, 200), {"rain": 4.0}, "wait"),
    ((None, 1400, 1400), {}, "bike"),
    ((None, 1400, 1401), {}, "walk"),
    ((None, 1400, 300), {"temp": -8.0}, "walk"),
    ((None, a.WALK_IN_RAIN_MAX_S + 1, 300), {"prob": 95.0}, "none"),
    ((None, None, None), {}, "none"),
    (FAR, {"rain": None, "prob": None, "gust": None, "temp": None}, "bike"),
]


@pytest.fixture(scope="module")
def decided(spark):
    data = []
    for n, (arrivals, weather, _) in enumerate(CASES):
        sky = list(DRY)
        for k, v in weather.items():
            sky[FIELD[k]] = v
        data.append((n, *arrivals, *sky))
    return rows(a.decide(spark.createDataFrame(data, SCHEMA)), "n")


def test_choices(decided):
    assert [r["choice"] for r in decided] == [c for _, _, c in CASES]


def test_reasons(decided):
    reason = [r["reason"] for r in decided]
    assert reason[0] == "the bike gets you there in 15 min, the tram in 33 min"
    assert reason[2] == "the tram gets you there in 33 min; no bike: rain is forecast"
    assert reason[6] == "the tram gets you there in 33 min; no bike: gusts up to 18 m/s are forecast"
    assert reason[12] == "the tram gets you there in 33 min; no bike: the bike would save less than 2 min"
    assert reason[13] == "walking gets you there in 17 min, no later than the tram (17 min)"
    assert reason[15] == "the bike gets you there in 20 min, walking takes 22 min and the tram 33 min"
    assert reason[19] == "no tram found; you arrive in 23 min by bike"
    assert reason[23].startswith("no tram found, and no city bike nearby")


def itinerary(leaves, arrives, *legs):
    """An edge that leaves and arrives so many minutes from now."""
    when = lambda m: f"2026-07-01T{15 + (25 + m) // 60}:{(25 + m) % 60:02}:00Z"
    return {"node": {"start": when(leaves), "end": when(arrives), "legs": list(legs)}}


def tram_leg(line, at, late=None):
    leg = {"mode": "TRAM", "serviceDate": "2026-07-01", "route": {"shortName": line}, "from": {"name": "Pier 4"}}
    leg["trip"] = {"directionId": "0", "departureStoptime": {"scheduledDeparture": (15 * 60 + at) * 60}}
    leg["start"] = {"scheduledTime": f"2026-07-01T15:{at}:00Z"}
    if late is not None:
        leg["start"]["estimated"] = {"time": f"2026-07-01T15:{at + late}:00Z"}
    return leg


def plan():
    """A bus, two trams of which the first counts, a walk, and a bike ride without a name of its dock."""
    hire = {"name": "Pier", "availableVehicles": {"total": 3}}
    cycle = {"mode": "BICYCLE", "from": {"vehicleRentalStation": hire}, "to": {"vehicleRentalStation": {"availableSpaces": {"total": 1}}}}
    trams = [itinerary(2, 19, {"mode": "BUS"}), itinerary(4, 21, tram_leg("7T", 30, 1)), itinerary(9, 40, tram_leg("5", 39))]
    body = {"tram": trams, "walk": [itinerary(0, 33), itinerary(0, 50)], "bike": [itinerary(0, 14, cycle)]}
    return json.dumps({"data": {name: {"edges": edges} for name, edges in body.items()}})


def walk_only():
    return json.dumps({"data": {"tram": {"edges": []}, "walk": {"edges": [itinerary(1, 70)]}}})


@pytest.fixture(scope="module")
def answers(spark):
    data = [(1, 200, plan()), (2, 200, '{"errors":[{"message":"bad"},{"message":"worse"}]}'), (3, 200, "<html>"), (4, 503, "x" * 300), (5, 200, None), (6, 200, walk_only())]
    return spark.createDataFrame(data, "request_id int, status int, body string")


def test_planner_answers(answers):
    found = {(r["request_id"], r["option"]): r for r in rows(a.parse_trip_plans(answers, NOW))}
    tram = found[1, "tram"]
    assert (tram["route"], tram["direction"], tram["journey_start"], tram["board_stop"]) == ("7T", "1", "15:30", "Pier 4")
    assert str(tram["scheduled_departure"]) == "2026-07-01 15:30:00" and str(tram["expected_departure"]) == "2026-07-01 15:31:00"
    assert tram["realtime"] and tram["arrive_in_s"] == 1260
    assert found[1, "walk"]["arrive_in_s"] == 1980
    bike = found[1, "bike"]
    assert (bike["arrive_in_s"], bike["bikes_available"], bike["docks_free"]) == (840, 3, 1) and bike["dock_station"] is None
    assert found[2, "error"]["error"] == "bad; worse"
    assert found[3, "error"]["error"] == "unreadable response" == found[5, "error"]["error"]
    assert found[4, "error"]["error"] == "planner HTTP 503: " + "x" * 200
    assert found[6, "walk"]["arrive_in_s"] == 4200
    assert len(found) == 8


def test_clock_text_passes_midnight(spark):
    assert spark.range(1).select(a.clock_text(F.lit(90_060))).first()[0] == "25:01"


STOPS = "stop_id string, stop_name string, stop_code string, lat double, long double, main_vehicle_type int"


def stops(spark):
    return spark.createDataFrame(
        [
            ("1", "Harbour", "A", 60.1, 24.9, 3), ("2", "Harbour", "B", 60.1, 24.9, 0), ("3", "Harbour Street", "C", 60.1, 24.9, 0),
            ("4", "Square", "D", 60.2, 24.9, None), ("5", "100% Square", "E", 60.2, 24.9, 1), ("6", None, "F", 60.2, 24.9, 0),
        ],
        STOPS,
    )


def test_stop_search(spark):
    queries = spark.createDataFrame([(1, " harbour "), (2, "HARB"), (3, "%"), (4, "100%"), (5, None), (6, "")], "query_id int, name string")
    found = {}
    for r in rows(a.find_stops(queries, stops(spark)), "query_id", "rank"):
        found.setdefault(r["query_id"], []).append(r["stop_id"])
    assert found == {1: ["2", "1", "3"], 2: ["2", "3", "1"], 4: ["5"], 6: ["2", "3", "5", "1", "4"]}
    assert a.find_stops(queries, stops(spark), k=1).count() == 4


def test_weather(spark):
    def e(t, n, v):
        return f"<m><b:E xmlns:b='u'><b:Time>{t}</b:Time><b:ParameterName>{n}</b:ParameterName><b:ParameterValue>{v}</b:ParameterValue></b:E></m>"

    body = "<r>" + e("2026-07-01T15:00:00Z", "PoP", "80.5") + e("2026-07-01T15:00:00Z", "Temperature", "NaN") + e("2026-07-01T17:00:00Z", "PoP", "90") + e("2026-07-01T16:00:00Z", "HourlyMaximumGust", "x") + "</r>"
    df = spark.createDataFrame([("p", body)], "point_id string, body string")
    hours = rows(a.parse_weather(df), "forecast_at")
    assert [(str(r["forecast_at"])[11:13], r["rain_probability_pct"], r["temperature_c"], r["gust_ms"]) for r in hours] == [
        ("15", 80.5, None, None),
        ("16", None, None, None),
        ("17", 90.0, None, None),
    ]
    assert rows(a.weather_next_hour(a.parse_weather(df), NOW))[0]["rain_probability_pct"] == 80.5


def test_weather_is_parsed_once_by_the_same_rules_as_xpath(spark):
    bodies = [
        None,
        "",
        "<r/>",
        '<?xml version="1.0" encoding="ISO-8859-1"?><r xmlns="urn:x"><Time>2026-07-01T15:00:00Z</Time><ParameterName>PoP</ParameterName><ParameterValue> 1 </ParameterValue></r>',
        "<r><a:Time xmlns:a='u'>2026-07-01T15:00:00Z<x>no</x>2026-07-01T16:00:00Z</a:Time><ParameterName/><ParameterName>Po<!-- c -->P</ParameterName><ParameterValue>&#53;&lt;</ParameterValue></r>",
        "<r><Time>\n </Time><Time>2026-07-01T15:00:00Z</Time><ParameterName>PoP</ParameterName><ParameterName>Temperature</ParameterName><ParameterValue>-0</ParameterValue><ParameterValue>7</ParameterValue></r>",
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "point_id int, body string")
    texts = {c: F.xpath("body", F.lit(f'//*[local-name()="{e}"]/text()')) for c, e in (("t", "Time"), ("n", "ParameterName"), ("v", "ParameterValue"))}
    members = F.arrays_zip(*[x.alias(c) for c, x in texts.items()])
    want = rows(df.select("point_id", F.inline(members).alias("t", "n", "v")))
    got = rows(df.select("point_id", F.inline(a._weather_members("body"))))
    assert got == want and len(want) > 4
    plan = a.parse_weather(df)._jdf.queryExecution().executedPlan().toString()
    assert "xpath" not in plan


def test_advice(spark, answers):
    requests = spark.createDataFrame(
        [(1, "harbour", "square"), (2, "Harbour", "Square"), (3, "Nowhere", "Square"), (4, "Harbour", "Nope"), (9, "Square", "Harbour")],
        "request_id int, from_stop string, to_stop string",
    )
    current = spark.sql("""SELECT v AS vehicle_id, '7T|1|2026-07-01|15:30' AS journey_id, l AS lateness_s, timestamp(t) AS last_seen_at
        FROM VALUES ('a', 100, '2026-07-01 15:24:00'), ('b', 240, '2026-07-01 15:24:50') AS x(v, l, t)""")
    sky = spark.sql("""SELECT '2' AS point_id, timestamp('2026-07-01 15:00:00') AS forecast_at, 0.0D AS precipitation_mm_h,
        10.0D AS rain_probability_pct, 3.0D AS wind_ms, 5.0D AS gust_ms, 15.0D AS temperature_c""")
    live = spark.sql("SELECT true AS feed_live")
    found = {r["request_id"]: r for r in rows(a.advise(requests, stops(spark), answers, sky, live, current, NOW))}
    one = found[1]
    assert (one["choice"], one["tram_departs_in_min"], one["tram_arrives_in_min"], one["bike_arrives_in_min"]) == ("bike", 6, 21, 14)
    assert (one["measured_lateness_s"], one["measured_age_s"], one["problems"]) == (240, 10, None)
    assert found[2]["reason"] == "the journey planner did not answer, so there is nothing to compare"
    assert found[3]["reason"] == 'no Stop called "Nowhere"' and found[3]["problems"] == "no weather forecast"
    assert found[4]["reason"] == 'no Stop called "Nope"' and found[4]["to_stop"] is None
    assert found[9]["choice"] == "none" and found[9]["reason"].startswith("no tram found, and")
    dead = rows(a.advise(requests, stops(spark), answers, sky, spark.sql("SELECT false AS feed_live"), current, NOW), "request_id")
    assert dead[0]["measured_lateness_s"] is None and dead[0]["measured_age_s"] == 10
    assert dead[0]["problems"] == "our feed is not running, so measured Lateness is unknown"


def test_planner_answers_of_one_row_group_are_built_by_many_tasks(spark, tmp_path):
    from wayfeed.plans.advice import plan_responses

    spark.range(400).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    answers = plan_responses(spark, str(tmp_path), F.lit(NOW).cast("timestamp"))
    busy = answers.select(F.spark_partition_id().alias("task")).distinct().count()
    assert busy > 1 and answers.select("request_id").distinct().count() == 400


def test_stops_of_one_row_group_become_prefixes_in_many_tasks(spark, tmp_path):
    stops(spark).coalesce(1).write.parquet(f"{tmp_path}/stops")
    queries = spark.createDataFrame([(n, "harb") for n in range(50)], "query_id int, name string")
    found = a.find_stops(queries, spark.read.parquet(f"{tmp_path}/stops"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Stops are dealt out before they are sorted as prefixes, and no side of the last join is collected.
    assert "Exchange hashpartitioning(stop_id" in plan.split("Generate explode", 1)[1]
    assert "ShuffledHashJoin [prefix" in plan and "BuildRight" in plan
    assert found.count() == 150
