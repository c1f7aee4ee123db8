import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayfeed.operators import checks
from wayfeed.operators import departures as dep
from wayfeed.operators import events as ev
from wayfeed.schemas import DEFAULT_TOPICS, ENVELOPE, LATENESS_PLAUSIBLE
from wayfeed.sources import feed


def message(kind, mode, oper, veh, route, direction, start, dl, stop=None, tst="2026-09-26T18:28:32.446Z", plan=None, **more):
    body = {
        "desi": route, "dir": direction, "oper": oper, "veh": veh, "tst": tst, "tsi": 1790447311, "spd": 3.0, "hdg": 90,
        "lat": 60.18, "long": 24.93, "acc": None, "dl": dl, "odo": 5, "drst": 0, "oday": "2026-09-26", "start": start,
        "loc": "GPS", "stop": stop, "route": f"100{route}", "occu": 0, **({"ttarr": plan, "ttdep": plan} if plan else {}), **more,
    }
    topic = f"/hfp/v2/journey/ongoing/{kind}/{mode}/00{oper}/{veh}/100{route}/{direction}/Somewhere/{start}/999/4/x"
    return topic, json.dumps({kind.upper(): body})


PLAN = "2026-09-26T18:28:00.000Z"
SAMPLE = [
    message("vp", "metro", 50, 169, "M1", "2", "20:52", None, stop=2211602, loc="MAN"),
    *[message("vp", "tram", 40, 75, "3", "2", "21:14", -19)] * 3,
    message("arr", "tram", 40, 603, "15", "2", "21:09", -46, 2118301, "2026-09-26T18:28:31.813Z", PLAN),
    message("pde", "tram", 40, 81, "8", "2", "21:10", 0, 1140451, "2026-09-26T18:28:32.443Z", PLAN),
    message("dep", "tram", 40, 81, "8", "2", "21:10", 0, 1140451, "2026-09-26T18:28:32.446Z", PLAN),
    message("dep", "tram", 40, 609, "15", "1", "20:48", -1, 2118405, "2026-09-26T18:28:32.773Z", PLAN),
    message("arr", "tram", 40, 467, "9", "2", "20:49", -171, 1203413, "2026-09-26T18:28:34.392Z", "2026-09-26T18:26:00.000Z"),
]


def bronze(spark, messages, kind="event"):
    data = [(kind, t, p, f"2026-09-26 18:28:{40 + i // 10}.{i % 10}", "s1") for i, (t, p) in enumerate(messages)]
    strings = "kind string, topic string, payload string, received_at string, session_id string"
    return spark.createDataFrame(data, strings).withColumn("received_at", F.col("received_at").cast("timestamp")).to(ENVELOPE)


@pytest.fixture(scope="module")
def sample(spark):
    return bronze(spark, SAMPLE)


def test_typed_columns(spark, sample):
    found = {(r["event_type"], r["vehicle_id"]): r for r in rows(ev.normalize_events(sample))}
    arr = found["arr", "40/603"]
    assert arr["journey_id"] == "15|2|2026-09-26|21:09"
    assert (arr["lateness_s"], arr["timetable_lateness_s"]) == (46, 32)
    assert arr["feed_route_id"] == "10015" and arr["stop_id"] == "2118301"
    assert found["dep", "40/609"]["timetable_lateness_s"] == 33
    assert found["arr", "40/467"]["lateness_s"] == 171 and found["arr", "40/467"]["timetable_lateness_s"] == 154
    assert found["vp", "50/169"]["lateness_s"] is None
    assert found["pde", "40/81"]["lateness_s"] == 0


def test_timetable_lateness_rounds_half_up(spark):
    late = ev.timetable_lateness(F.lit("dep"), F.col("a"), F.col("b"), F.col("b"))
    df = spark.sql("""SELECT timestamp(x) a, timestamp('2026-01-01 00:00:10') b FROM VALUES
        ('2026-01-01 00:00:11.500'), ('2026-01-01 00:00:11.499'), ('2026-01-01 00:00:08.500') AS t(x)""")
    assert [r[0] for r in df.select(late).collect()] == [2, 1, -2]


def test_dedup_and_routing(spark, sample):
    routed = ev.route_events(ev.dedup_events(ev.normalize_events(sample)))
    assert ev.position_events(routed).count() == 2
    assert ev.stop_events(routed).count() == 5
    assert "stop_id" not in ev.position_events(routed).columns


def test_dedup_keeps_the_first_copy_in_any_order(spark, sample):
    typed = ev.normalize_events(sample)
    for seed in (1, 2):
        kept = rows(ev.dedup_events(typed.orderBy(F.rand(seed))).where("vehicle_id = '40/75'"))
        assert [str(r["received_at"]) for r in kept] == ["2026-09-26 18:28:40.100000"]


def test_bad_rows_are_quarantined_and_never_fatal(spark):
    good = message("vp", "tram", 40, 1, "3", "2", "21:14", 5)
    bad_time = message("vp", "tram", 40, 2, "3", "2", "21:14", 5, tst="yesterday")
    no_vehicle = message("dep", "tram", 40, None, "3", "2", "21:14", 5)
    outside = message("vp", "tram", 40, 4, "3", "2", "21:14", 5, lat=61.0)
    no_place = message("vp", "tram", 40, 5, "3", "2", "21:14", 5, lat=None)
    late = message("vp", "tram", 40, 6, "3", "2", "21:14", -4000)
    garbage = (good[0], "not json")
    df = bronze(spark, [good, bad_time, no_vehicle, outside, no_place, late, garbage, ("/gtfsrt/vp/", good[1])])
    routed = ev.route_events(ev.normalize_events(df))
    assert {r["vehicle_id"] for r in rows(ev.position_events(routed))} == {"40/1", "40/6"}
    failed = {r["vehicle_id"]: r["failed_rules"] for r in rows(routed.where("stream = 'rejected'"))}
    assert failed["40/2"] == ["tst_present"]
    assert failed["40/4"] == ["inside_helsinki_region"] == failed["40/5"]
    warned = rows(ev.expect_warn(ev.normalize_events(df), LATENESS_PLAUSIBLE))
    assert warned == [{"rule": "lateness_plausible", "checked": 8, "failed": 1}]


def test_drop_and_quarantine_split_all_rows(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    rules = {"positive": "v > 0"}
    assert ev.expect_or_drop(df, rules).count() == 1
    assert ev.quarantine(df, rules).count() == 2


def test_heartbeats(spark):
    df = bronze(spark, [(None, '{"received_total": 12, "dropped_total": 3}')], kind="heartbeat")
    assert rows(ev.parse_heartbeats(df))[0]["received_total"] == 12
    assert ev.normalize_events(df).count() == 0


def test_topic_filters(spark):
    assert feed.topic_list("  ") == DEFAULT_TOPICS == feed.topic_list(None)
    assert len(DEFAULT_TOPICS) == 8
    assert feed.topic_list(" a/# , b/# ") == ["a/#", "b/#"]
    df = spark.createDataFrame([(t,) for t in ("a/b/c", "a", "ab/c", "x/y/z", None)], "topic string")
    kept = [r[0] for r in feed.filter_topics(df, "a/#,x/+/z").collect()]
    assert kept == ["a/b/c", "a", "x/y/z"]


def test_departures_get_names_once(spark, sample):
    routed = ev.route_events(ev.dedup_events(ev.normalize_events(sample)))
    stops = spark.createDataFrame(
        [("1140451", "Museum", 60.1, 24.9), ("1140451", "Museum", 60.1, 24.9)], "stop_id string, stop_name string, lat double, long double"
    )
    routes = spark.createDataFrame(
        [("1008", "8", "by id"), ("1015X", "15", "b fallback"), ("1015Y", "15", "a fallback")],
        "feed_route_id string, route string, route_name string",
    )
    found = rows(dep.build_departures(ev.stop_events(routed), stops, routes), "vehicle_id")
    assert [(r["vehicle_id"], r["stop_name"], r["route_name"]) for r in found] == [
        ("40/609", None, "a fallback"),
        ("40/81", "Museum", "by id"),
    ]
    assert str(found[1]["departed_at_local"]) == "2026-09-26 21:28:32.446000"
    rates = rows(checks.match_rates(dep.build_departures(ev.stop_events(routed), stops, routes)))[0]
    assert rates["pct_stop_matched"] == 50.0 and rates["unmatched_stops"] == 1


def test_unknown_lateness_stays_in_the_denominator(spark):
    data = [("4", "n", "1", 0), ("4", "n", "1", None), ("4", "n", "1", 181), ("4", "n", "1", -60)]
    df = spark.createDataFrame(data, "route string, route_name string, direction string, lateness_s int")
    r = rows(dep.punctuality(df))[0]
    assert (r["departures"], r["punctuality"], r["lateness_unknown"]) == (4, 0.5, 1)
    assert rows(dep.punctuality_overall(df))[0] == {"punctuality": 0.5, "departures": 4, "routes": 1}


def test_feed_profile_lists_silent_combinations(spark, sample):
    found = {(r["event_type"], r["mode"]): r for r in rows(checks.feed_profile(sample, 10))}
    assert len(found) == 8 and found["dep", "metro"]["messages"] == 0
    assert found["vp", "tram"]["messages"] == 3 and found["vp", "tram"]["has_lateness"]
    assert not found["vp", "metro"]["has_lateness"]
    assert rows(checks.duplicate_ratio(sample), "mode")[1]["copies_per_payload"] == 3.0
