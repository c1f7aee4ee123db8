import random

from conftest import rows
from pyspark.sql import functions as F

from wayfeed.operators import coverage as cov
from wayfeed.operators import headway as h


def beats(spark, data):
    df = spark.createDataFrame(data, "session_id string, at string, received_total bigint")
    return df.select(
        "session_id",
        F.col("at").cast("timestamp").alias("heartbeat_at"),
        "received_total",
        F.lit(0).cast("bigint").alias("dropped_total"),
    )


def minutes(spark, data):
    df = spark.createDataFrame(data, "m string, covered_s double")
    return df.select(F.col("m").cast("timestamp").alias("minute_start"), "covered_s", F.round(F.col("covered_s") / 60, 3).alias("coverage"))


def test_interval_spacing_uses_whole_seconds(spark):
    hb = beats(spark, [("a", "2026-01-01 00:00:00.000", 1), ("a", "2026-01-01 00:00:30.900", 2), ("a", "2026-01-01 00:01:01.000", 3)])
    found = rows(cov.covered_intervals(hb))
    assert [str(r["to_at"]) for r in found] == ["2026-01-01 00:00:30.900000"]


def test_minutes_cap_overlapping_sessions_and_keep_holes(spark):
    first = [("a", f"2026-01-01 23:5{8 + s // 60}:{s % 60:02d}", s) for s in range(0, 120, 10)]
    second = [("b", f"2026-01-01 23:58:{s:02d}", s) for s in range(0, 60, 5)]
    late = [("c", "2026-01-02 00:02:00", 1), ("c", "2026-01-02 00:02:10", 2)]
    found = {str(r["minute_start"]): r["covered_s"] for r in rows(cov.coverage_minutely(beats(spark, first + second + late)))}
    assert found == {
        "2026-01-01 23:58:00": 60.0,
        "2026-01-01 23:59:00": 50.0,
        "2026-01-02 00:00:00": 0.0,
        "2026-01-02 00:01:00": 0.0,
        "2026-01-02 00:02:00": 10.0,
    }


def test_coverage_never_exceeds_a_minute_and_gaps_complete_it(spark):
    rng = random.Random(3)
    data = [(rng.choice("abc"), f"2026-01-0{rng.randrange(1, 4)} {rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}", i) for i in range(4000)]
    table = cov.coverage_minutely(beats(spark, data), max_spacing_s=120).cache()
    assert table.where("covered_s > 60 OR covered_s < 0").count() == 0
    zero = table.where("coverage = 0").count()
    gaps = rows(cov.gap_intervals(table), "gap_start")
    assert sum(r["gap_minutes"] for r in gaps) == zero > 0
    assert all(a["gap_end"] < b["gap_start"] for a, b in zip(gaps, gaps[1:]))


def test_gaps_merge_also_over_midnight(spark):
    day = [f"2026-10-03 13:{m}:00" for m in (40, 38, 39)] + ["2026-10-03 14:00:00"]
    night = ["2026-10-03 23:59:00", "2026-10-05 00:00:00"]
    whole = [f"2026-10-04 {m // 60:02d}:{m % 60:02d}:00" for m in range(1440)]
    found = rows(cov.gap_intervals(minutes(spark, [(m, 0.0) for m in day + night + whole])), "gap_start")
    assert [(str(r["gap_start"]), str(r["gap_end"]), r["gap_minutes"]) for r in found] == [
        ("2026-10-03 13:38:00", "2026-10-03 13:41:00", 3),
        ("2026-10-03 14:00:00", "2026-10-03 14:01:00", 1),
        ("2026-10-03 23:59:00", "2026-10-05 00:01:00", 1442),
    ]


def test_window_coverage_is_clamped(spark):
    table = minutes(spark, [(f"2026-10-03 15:{m:02d}:00", 60.0 if m < 30 else 0.0) for m in range(60)])
    share = lambda a, b: rows(cov.window_coverage(table, a, b))[0]["coverage"]
    assert share("2026-10-03 15:00:00", "2026-10-03 16:00:00") == 0.5
    assert share("2026-10-03 15:00:40", "2026-10-03 15:01:00") == 1.0  # the whole first minute counts
    assert share("2026-10-03 17:00:00", "2026-10-03 18:00:00") == 0.0
    assert share("2026-10-03 16:00:00", "2026-10-03 15:00:00") is None


def test_feed_live(spark):
    hb = beats(spark, [("a", "2026-10-03 15:00:00", 1)])
    live = lambda now: rows(cov.feed_live(hb, now))[0]["feed_live"]
    assert live("2026-10-03 15:00:30") and not live("2026-10-03 15:00:31") and not live("2026-10-04 15:00:00")


def test_health(spark):
    hb = beats(spark, [("old", "2026-10-03 14:00:00", 900), ("new", "2026-10-03 15:00:00", 10), ("new", "2026-10-03 15:00:50", 110)])
    table = minutes(spark, [("2026-10-03 14:58:00", 0.0), ("2026-10-03 14:59:00", 0.0), ("2026-10-03 15:00:00", 50.0)])
    current = spark.sql("SELECT timestamp('2026-10-03 15:00:49') AS last_seen_at")
    r = rows(cov.health(hb, current, table, "2026-10-03 15:01:00"))[0]
    assert r["events_per_s"] == 2.0 and r["last_gap_minutes"] == 2
    assert str(r["last_heartbeat_at"]) == "2026-10-03 15:00:50" and str(r["last_event_at"]) == "2026-10-03 15:00:49"


PAIR = (
    "route string, direction string, stop_id string, stop_name string, stop_lat double, stop_long double, "
    "leader_vehicle_id string, follower_vehicle_id string, headway_s int, scheduled_headway_s int, bunching boolean"
)


def pair(route, stop, leader, follower, headway, planned, bunching, name="x"):
    return (route, "1", stop, stop.upper() if name else None, 61.5, 23.7, leader, follower, headway, planned, bunching)


def test_bunching_by_route_counts_judged_pairs(spark):
    judged = [pair("1", s, "a1", "a2", n, 480, True) for s, n in (("k", 30), ("l", 50))]
    judged += [pair("1", "l", "a2", "a3", 80, 480, True), pair("1", "k", "a3", "a4", 470, 480, False), pair("1", "l", "a3", "a4", 455, 480, False)]
    unjudged = [pair("1", "k", "a4", "a5", 20, None, False), pair("15", "k", "b1", "b2", 15, None, False)]
    pairs = spark.createDataFrame([*unjudged, *judged, pair("15", "l", "b2", "b3", 900, 840, False)], PAIR)
    found = {r["route"]: r for r in rows(h.bunching_by_route(pairs))}
    one, other = found["1"], found["15"]
    assert (one["departures"], one["bunched_departures"], one["share"], one["tram_pairs"], one["median_headway_s"]) == (5, 3, 0.6, 2, 50)
    assert (other["departures"], other["bunched_departures"], other["tram_pairs"], other["median_headway_s"]) == (1, 0, 0, None)
    totals = rows(h.bunching_totals(h.bunching_by_route(pairs)))[0]
    assert (totals["departures"], totals["bunched_departures"], totals["tram_pairs"]) == (6, 3, 2)


def test_bunching_by_route_equals_plain_aggregates(spark):
    rng = random.Random(3)
    data = [
        pair(rng.choice(["1", "2", "10"]), rng.choice("kl"), rng.choice([None, "a", "b", "c"]), rng.choice("abc"), rng.choice([None, *range(9)]), rng.choice([None, 9, 9]), rng.random() < 0.6)
        for _ in range(400)
    ]
    pairs = spark.createDataFrame([*data, *data[:50], pair("3", "k", "a", "b", 7, 9, False)], PAIR)
    b = F.col("bunching")
    plain = pairs.where("scheduled_headway_s IS NOT NULL").groupBy("route", "direction").agg(
        F.count(F.lit(1)).alias("departures"),
        F.count_if(b).alias("bunched_departures"),
        (F.count_if(b) / F.count(F.lit(1))).alias("share"),
        F.count_distinct(F.when(b, F.struct("leader_vehicle_id", "follower_vehicle_id"))).alias("tram_pairs"),
        F.percentile(F.when(b, F.col("headway_s")), 0.5).cast("int").alias("median_headway_s"),
    )
    found = h.bunching_by_route(pairs)
    assert found.dtypes == plain.dtypes and rows(found, "route") == rows(plain, "route")


def test_bunching_by_route_keeps_no_median_per_pair(spark):
    """The median is taken per route and direction; pairs are only counted, by hash."""
    pairs = spark.createDataFrame([pair("1", "k", "a", "b", 30, 480, True)], PAIR)
    plan = h.bunching_by_route(pairs)._jdf.queryExecution().executedPlan().toString()
    medians = [line for line in plan.splitlines() if "percentile(" in line and "Aggregate" in line]
    assert medians and not [line for line in medians if "vehicle_id" in line]


def test_bunching_by_stop_lists_routes_in_natural_order(spark):
    at_p = [pair(r, "p", f"{r}a", f"{r}b", 40 + k, 500, True) for k, r in enumerate(["11", "2", "11", "2A"])]
    pairs = spark.createDataFrame([*at_p, pair("3", "q", "c1", "c2", 40, 500, True, name=None), pair("3", "r", "c1", "c2", 490, 500, False)], PAIR)
    found = {r["stop_id"]: r for r in rows(h.bunching_by_stop(pairs))}
    assert set(found) == {"p"} and (found["p"]["stop_name"], found["p"]["bunching"], found["p"]["routes"]) == ("P", 4, "2, 2A, 11")


def departures(spark, data):
    df = spark.createDataFrame(data, "vehicle_id string, at string, plan string, lateness_s int")
    return df.select(
        F.lit("4").alias("route"),
        F.lit("1").alias("direction"),
        F.lit("s").alias("stop_id"),
        F.lit("S").alias("stop_name"),
        F.lit(60.0).alias("stop_lat"),
        F.lit(25.0).alias("stop_long"),
        "vehicle_id",
        F.concat(F.lit("j"), "vehicle_id", "plan").alias("journey_id"),
        F.concat(F.lit("2026-10-03 "), "at").cast("timestamp").alias("departed_at"),
        F.concat(F.lit("2026-10-03 "), "plan").cast("timestamp").alias("scheduled_departure"),
        "lateness_s",
    )


def test_pairs_compare_neighbours_only(spark):
    dep = departures(
        spark,
        [
            ("v1", "09:50:00", "09:50:00", 0),
            ("v2", "10:00:30", "10:00:00", 30),
            ("v3", "10:02:00", "10:10:00", -480),
            ("v3", "10:02:05", "10:20:00", 0),  # the same vehicle again: no pair, and v2 is not tried
            ("v4", "10:30:00", "10:30:00", 0),
        ],
    )
    found = rows(h.bunching_pairs(dep, "2026-10-03 10:00:00", "2026-10-03 11:00:00"), "follower_departed_at")
    assert [(r["leader_vehicle_id"], r["follower_vehicle_id"], r["headway_s"], r["scheduled_headway_s"], r["bunching"]) for r in found] == [
        ("v1", "v2", 630, 600, False),
        ("v2", "v3", 90, 600, True),
        ("v3", "v4", 1675, 600, False),
    ]


def test_a_long_planned_gap_is_no_plan(spark):
    dep = departures(spark, [("v1", "08:00:00", "08:00:00", 0), ("v2", "10:00:00", "10:00:00", 0)])
    found = rows(h.bunching_pairs(dep, "2026-10-03 09:00:00", "2026-10-03 11:00:00", look_back_s=7200))
    assert [(r["scheduled_headway_s"], r["bunching"]) for r in found] == [(None, False)]


def test_the_plan_orders_each_instant_once(spark, tmp_path):
    """Equal to gaps of all rows, ties and fractions of a second included, with one read and no sort of the pairs by place."""
    rng = random.Random(5)
    data = [(f"v{i}", f"{rng.randrange(8, 12):02}:{rng.randrange(60):02}:00", f"{rng.randrange(8, 12):02}:{rng.randrange(0, 60, 4):02}:00.{rng.choice('005')}", 0) for i in range(200)]
    dep = departures(spark, [*data, ("v", "10:00:00", None, None)])
    hour = F.date_trunc("hour", "scheduled_departure").alias("planned_hour")
    for max_gap, span in ((3600, 3600), (300, 60), (600, 86_400)):
        gaps = h.scheduled_gaps(dep, max_gap, span).groupBy(*h.PLACE, hour)
        plain = gaps.agg(F.percentile_approx("scheduled_gap_s", 0.5).cast("int").alias("planned_headway_s")).where("planned_headway_s IS NOT NULL")
        found = h.planned_headway(dep, max_gap, span)
        assert found.dtypes == plain.dtypes and rows(found, "planned_hour") == rows(plain, "planned_hour") != []
    dep.write.parquet(str(tmp_path / "dep"))
    stored = spark.read.parquet(str(tmp_path / "dep"))
    assert h.planned_headway(stored)._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    pairs = h.bunching_pairs(stored, "2026-10-03 09:00:00", "2026-10-03 11:00:00")
    plan = pairs._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Relation") == 3 and "SortMergeJoin" not in plan.executedPlan().toString()


def test_bunching_now_keeps_the_latest_stop_and_always_a_row(spark):
    dep = departures(
        spark,
        [("v0", "09:40:00", "09:40:00", 0), ("v1", "09:50:00", "09:50:00", 0), ("v2", "10:00:00", "10:00:00", 0), ("v3", "10:00:40", "10:10:00", 0)],
    )
    live = spark.sql("SELECT true AS feed_live")
    found = rows(h.bunching_now(dep, live, "2026-10-03 10:01:00", " 4 "))
    assert [(r["feed_live"], r["follower_vehicle_id"], r["headway_s"], r["age_s"]) for r in found] == [(True, "v3", 40, 20)]
    empty = rows(h.bunching_now(dep, live, "2026-10-03 12:00:00"))
    assert len(empty) == 1 and empty[0]["feed_live"] and empty[0]["route"] is None


def test_pair_lines_need_both_vehicles(spark):
    pairs = spark.createDataFrame(
        [("4", "v1", "v2", 60), ("7", "v5", "gone", 80)], "route string, leader_vehicle_id string, follower_vehicle_id string, headway_s int"
    )
    fleet = spark.createDataFrame([("v1", 60.1, 24.9), ("v2", 60.11, 24.91), ("v5", 60.2, 24.8)], "vehicle_id string, lat double, long double")
    found = rows(h.pair_lines(pairs, fleet))
    assert [(r["route"], r["from_long"], r["to_lat"]) for r in found] == [("4", 24.9, 60.11)]
