import random
from collections import deque

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayfeed.functions.clock import instant
from wayfeed.operators import fleet as f
from wayfeed.operators import reports as rep
from wayfeed.operators.watchlist import reconcile_watchlist

NOW = "2026-10-03 16:00:00"
CURRENT = (
    "vehicle_id string, mode string, route string, direction string, journey_id string, lat double, long double, "
    "heading int, speed_ms double, lateness_s int, age double"
)


def vehicles(spark, data):
    """(vehicle, route, lateness, age in seconds)"""
    full = [(v, "metro" if r.startswith("M") else "tram", r, "1", "j", 60.1, 24.9, 0, 1.0, late, float(age)) for v, r, late, age in data]
    df = spark.createDataFrame(full, CURRENT)
    at = F.timestamp_micros(F.unix_micros(instant(NOW)) - (F.col("age") * 1_000_000).cast("bigint"))
    return df.withColumn("last_seen_at", at).drop("age")


def test_latest_is_independent_of_order_and_ties(spark):
    data = [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("a", 2, "w"), ("b", None, "q")]
    for seed in range(3):
        df = spark.createDataFrame(random.Random(seed).sample(data, len(data)), "k string, seq int, v string")
        assert rows(f.latest_by_key(df, ["k"], "seq"), "k") == [
            {"k": "a", "seq": 3, "v": "z"},
            {"k": "b", "seq": None, "v": "q"},
        ]


def test_live_fleet_and_kpis(spark):
    fleet = vehicles(spark, [("a", "4", 30, 5), ("b", "4", 250, 12), ("c", "M1", None, 120), ("d", "9", 0, 400), ("e", "9", 0, 300)])
    live = f.live_fleet(fleet, NOW)
    assert {r["vehicle_id"] for r in rows(live)} == {"a", "b", "c"}  # strictly younger than 300 s
    assert rows(f.fleet_kpis(live)) == [{"vehicles": 3, "fresh": 2, "newest_age_s": 5.0}]
    watched = spark.createDataFrame([("4",), ("M1",)], "route string")
    mine = f.live_fleet(fleet, NOW, modes=["tram", "metro"], routes="4, 9,", watched=watched)
    assert {r["route"] for r in rows(mine)} == {"4"}
    assert rows(f.route_lateness(fleet, " 9 ", NOW), "age_s")[1]["freshness"] == "hidden"
    status = rows(f.route_status_now(fleet, NOW, route="4"), "lateness_s")
    assert [r["status"] for r in status] == ["on-time", "late"]


def test_watch_summary(spark):
    fleet = vehicles(spark, [("a", "4", 30, 5), ("b", "4", 250, 5), ("c", "M1", None, 5)])
    reports = spark.createDataFrame([("4",), ("4",), ("9",)], "route string")
    watched = spark.createDataFrame([("4",), ("M1",), ("10",)], "route string")
    found = {r["route"]: (r["vehicles"], r["worst_lateness_s"], r["reports"]) for r in rows(f.watch_summary(watched, fleet, reports))}
    assert found == {"4": (2, 250, 2), "M1": (1, None, 0), "10": (0, None, 0)}


def test_snapshot_diff(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    after = spark.createDataFrame([("a", 1), ("b", 3), ("d", 4), ("c", None)], "k string, v int")
    found = {(r["k"], r["_change_type"], r["v"]) for r in rows(f.snapshot_diff(before, after, ["k"]))}
    assert found == {("b", "update_preimage", 2), ("b", "update_postimage", 3), ("d", "insert", 4)}
    gone = rows(f.snapshot_diff(before, after.where("k <> 'a'"), ["k"]))
    assert ("a", "delete") in {(r["k"], r["_change_type"]) for r in gone}


def test_watchlist(spark):
    saved = spark.sql("SELECT u AS user_id, r AS route, timestamp('2026-01-01') AS added_at FROM VALUES ('a','4'),('a','9'),('b','1'),('c','7') AS t(u, r)")
    asked = spark.createDataFrame([("a", " 4 "), ("a", "10"), ("a", " 10"), ("a", None), ("c", "  ")], "user_id string, route string")
    found = {(r["user_id"], r["route"], str(r["added_at"])[:10]) for r in rows(reconcile_watchlist(saved, asked, NOW))}
    assert found == {("a", "4", "2026-01-01"), ("a", "10", "2026-10-03"), ("b", "1", "2026-01-01")}


def test_clean_reports(spark):
    df = spark.createDataFrame(
        [("Rider@Example.com ", "  hi  ", "late"), ("rider@example.com", " \t ", "late"), ("x", "n" * 500, "rude"), ("x", None, None)],
        "email string, note string, category string",
    )
    found = [r.asDict() for r in rep.clean_reports(df).collect()]
    assert found[0]["reporter_id"] == found[1]["reporter_id"] and len(found[0]["reporter_id"]) == 64
    assert [r["note"] for r in found] == ["hi", None, "n" * 280, None]
    assert [r["rejected"] is None for r in found] == [True, True, False, False]
    assert "email" not in rep.clean_reports(df).columns


def test_report_takes_the_measurement_of_its_moment(spark):
    seen = vehicles(spark, [("a", "4", 30, 100), ("a", "4", 60, 50), ("a", "4", 90, 10)])
    said = spark.sql("""SELECT id AS report_id, v AS vehicle_id, timestamp(t) AS reported_at FROM VALUES
        (1, 'a', '2026-10-03 15:59:20'), (2, 'a', '2026-10-03 15:59:10'), (3, 'a', '2026-10-03 15:00:00'), (4, 'z', '2026-10-03 16:00:00') AS x(id, v, t)""")
    for span in (7, 3600):
        found = {r["report_id"]: (r["measured_lateness_s"], r["rejected"]) for r in rows(rep.snapshot_reports(said, seen, span))}
        assert found == {1: (60, None), 2: (60, None), 3: (None, rep.GONE_MESSAGE), 4: (None, rep.GONE_MESSAGE)}


def brute_force(reports, limit, window, vehicle_window):
    """(id, reporter, vehicle, second, counts) -> verdict, one after the other."""
    kept, verdicts = {}, {}
    for rid, who, vehicle, at, counts in sorted(reports, key=lambda r: (r[3], r[0])):
        mine = kept.setdefault(who, deque())
        recent = [(t, v) for t, v in mine if t > at - window]
        if any(v == vehicle and t > at - vehicle_window for t, v in recent):
            verdicts[rid] = "vehicle_limit"
        elif len(recent) >= limit:
            verdicts[rid] = "hourly_limit"
        else:
            verdicts[rid] = "accepted"
            if counts:
                mine.append((at, vehicle))
    return verdicts


@pytest.mark.parametrize("batch_rows", [10_000, 7])
def test_rate_limit_equals_the_sequential_rule(spark, batch_rows):
    rng = random.Random(11)
    data = []
    for rid in range(900):
        who = rng.choice(["hot"] * 5 + ["b", "c", "quiet"])
        # A third of the hot reporter's reports fall into one minute.
        at = rng.choice([rng.randrange(0, 20_000), rng.randrange(0, 20_000), rng.randrange(7_000, 7_060)])
        at = rid * 10_000 if who == "quiet" else at
        data.append((rid, who, f"v{rng.randrange(40)}", at, rng.random() > 0.1))
    df = spark.createDataFrame(data, "report_id bigint, reporter_id string, vehicle_id string, s bigint, counts boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        found = rep.rate_limit(df.withColumn("reported_at", F.timestamp_seconds("s"))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    verdicts = {r["report_id"]: r["verdict"] for r in found}
    expected = brute_force(data, 20, 3600, 120)
    assert verdicts == expected
    assert set(expected.values()) == {"accepted", "vehicle_limit", "hourly_limit"}


@pytest.mark.parametrize("per_task, windows", [(40, (20, 3600, 120)), (25, (3, 2000, 500))])
def test_a_hot_reporter_is_judged_in_bounded_parts(spark, monkeypatch, per_task, windows):
    rng = random.Random(12)
    data = []
    for rid in range(260):
        who = "hot" if rid % 3 else rng.choice("abcd")
        at = rng.choice([rng.randrange(0, 9_000), rng.randrange(4_000, 4_030)])
        data.append((rid, who, rng.choice([None, *(f"v{k}" for k in range(60))]), at, rng.random() > 0.1))
    df = spark.createDataFrame(data, "report_id bigint, reporter_id string, vehicle_id string, s bigint, counts boolean").withColumn("reported_at", F.timestamp_seconds("s"))
    sizes, judged = [], rep._judged

    def watched(rows, rule):
        found = rows.groupBy("reporter_id", "segment").agg(F.count_if(F.col("accepted").isNull()).alias("n")).agg(F.max("n")).first()[0]
        sizes.append(found or 0)
        return judged(rows, rule)

    monkeypatch.setattr(rep, "_judged", watched)
    found = rep.rate_limit(df, *windows, per_task=per_task).collect()
    assert {r["report_id"]: r["verdict"] for r in found} == brute_force(data, *windows) and len(found) == len(data)
    assert len(sizes) > 3 and max(sizes) <= 2 * per_task + 15  # seconds are whole here: many reports of one instant


def test_rate_limit_with_a_vehicle_window_beyond_the_other(spark):
    data = [(k, "a", f"v{k % 3}", 700 * k, True) for k in range(40)] + [(100 + k, "b", "v", 0, True) for k in range(300)]
    df = spark.createDataFrame(data, "report_id bigint, reporter_id string, vehicle_id string, s bigint, counts boolean")
    found = rep.rate_limit(df.withColumn("reported_at", F.timestamp_seconds("s")), 20, 2000, 20_000).collect()
    # Each of three vehicles again after 20,000 s at the earliest; of the reports at one instant only the first.
    assert {r["report_id"] for r in found if r["verdict"] == "accepted"} == {0, 1, 2, 30, 31, 32, 100}
    assert {r["verdict"] for r in found} == {"accepted", "vehicle_limit"} and len(found) == 340


def test_reports_without_reporter_or_time_are_told_and_not_stored(spark):
    df = spark.sql("""SELECT * FROM VALUES (1L, 'a', 'v', timestamp('2026-01-01')), (2L, NULL, 'v', timestamp('2026-01-01')),
        (3L, 'a', 'v', NULL) AS x(report_id, reporter_id, vehicle_id, reported_at)""")
    assert {r["report_id"]: r["verdict"] for r in rep.rate_limit(df).collect()} == {1: "accepted", 2: "unknown", 3: "unknown"}
    said = spark.sql("SELECT 1L AS report_id, 'a' AS vehicle_id, CAST(NULL AS STRING) AS email, 'late' AS category, '' AS note, timestamp('2026-10-03 16:00:00') AS reported_at")
    found = rows(rep.add_reports(said, vehicles(spark, [("a", "4", 30, 100)])))
    assert [r["rejected"] for r in found] == [rep.NO_REPORTER_MESSAGE]


def test_rate_limit_bounds_are_strict(spark):
    data = [(1, "a", "v", 0), (2, "a", "v", 119), (3, "a", "v", 120)] + [(10 + i, "b", f"v{i}", i) for i in range(20)]
    data += [(40, "b", "x", 3599), (41, "b", "y", 3600)]
    df = spark.createDataFrame(data, "report_id bigint, reporter_id string, vehicle_id string, s bigint")
    found = {r["report_id"]: r for r in rep.rate_limit(df.withColumn("reported_at", F.timestamp_seconds("s"))).collect()}
    assert [found[i]["verdict"] for i in (1, 2, 3)] == ["accepted", "vehicle_limit", "accepted"]
    assert [found[i]["verdict"] for i in (40, 41)] == ["hourly_limit", "accepted"]
    assert found[2]["message"] == "You reported this vehicle in the last 2 minutes. Try again shortly."
    assert found[40]["message"] == "You've sent 20 reports in the last hour, the limit. Try again later."


def test_intake_checks_category_then_limits_then_vehicle(spark):
    seen = vehicles(spark, [("a", "4", 30, 100)])
    said = spark.sql("""SELECT bigint(id) AS report_id, v AS vehicle_id, 'r@x.org' AS email, c AS category, '' AS note,
        timestamp('2026-10-03 16:00:00') + make_dt_interval(0, 0, 0, id) AS reported_at FROM VALUES
        (1, 'a', 'late'), (2, 'a', 'late'), (3, 'a', 'bogus'), (4, 'z', 'late'), (5, 'z', 'late') AS x(id, v, c)""")
    found = {r["report_id"]: r["rejected"] for r in rows(rep.add_reports(said, seen))}
    assert found[1] is None and found[2].startswith("You reported this vehicle")
    assert found[3].startswith("Unknown category")
    assert found[4] == found[5] == rep.GONE_MESSAGE  # a report that is not stored uses up nothing
