from conftest import rows
from test_advice import NOW as TRIP_NOW
from test_advice import answers, stops  # noqa: F401
from test_coverage_headway import beats, departures
from test_fleet_reports import NOW, vehicles
from pyspark.sql import functions as F

from wayfeed.functions import table_functions as tf
from wayfeed.operators import advice


def test_find_stop(spark):
    tf.register_find_stop(spark, stops(spark))
    found = [r["stop_id"] for r in spark.sql("SELECT * FROM find_stop(' harbour')").collect()]
    assert found == ["2", "1", "3"]
    assert [r["stop_id"] for r in spark.sql("SELECT * FROM find_stop('100%')").collect()] == ["5"]
    assert spark.sql("SELECT * FROM find_stop('Nope')").count() == 0


def test_vehicle_functions(spark):
    dep = departures(
        spark,
        [("v0", "15:40:00", "15:40:00", 0), ("v1", "15:50:00", "15:50:00", 0), ("v2", "15:58:00", "16:00:00", 0), ("v3", "15:58:40", "16:10:00", 0)],
    )
    hb = beats(spark, [("a", "2026-10-03 15:59:50", 1)])
    tf.register_vehicle_functions(spark, vehicles(spark, [("a", "4", 30, 5), ("b", "9", 1, 5)]), dep, hb, NOW)
    late = rows(spark.sql("SELECT * FROM tram_lateness(' 4 ')"))
    assert [(r["vehicle_id"], r["age_s"], r["freshness"]) for r in late] == [("a", 5, "fresh")]
    for route in ("''", "NULL", "'4'"):
        found = rows(spark.sql(f"SELECT * FROM bunching_now({route})"))
        assert [(r["feed_live"], r["follower_vehicle_id"]) for r in found] == [(True, "v3")]
    none = rows(spark.sql("SELECT * FROM bunching_now('7')"))
    assert len(none) == 1 and none[0]["feed_live"] and none[0]["route"] is None


def test_trip_functions(spark, answers):  # noqa: F811
    requests = spark.createDataFrame([(1, "harbour", "square")], "request_id int, from_stop string, to_stop string")
    weather = spark.createDataFrame([("2", "<r><m><Time>2026-07-01T15:00:00Z</Time><ParameterName>PoP</ParameterName><ParameterValue>20</ParameterValue></m></r>")], "point_id string, body string")
    current = vehicles(spark, [("a", "4", 30, 5)])
    tf.register_trip_functions(spark, requests, stops(spark), answers, weather, beats(spark, [("a", TRIP_NOW, 1)]), current, TRIP_NOW)
    assert rows(spark.sql("SELECT * FROM weather_outlook('2')"))[0]["rain_probability_pct"] == 20.0
    assert {r["option"] for r in rows(spark.sql("SELECT * FROM trip_options(1)"))} == {"tram", "walk", "bike"}
    advised = rows(spark.sql("SELECT * FROM bike_walk_or_wait('harbour', 'square')"))
    assert advised[0]["choice"] == "bike" and advised[0]["feed_live"]


def test_tram_bunching_for_any_window(spark, tmp_path):
    dep = departures(
        spark,
        [("v0", "14:10:00", "14:10:00", 0), ("v0", "14:20:00", "14:20:00", 0), ("v1", "15:40:00", "15:40:00", 0), ("v1", "15:50:00", "15:50:00", 0), ("v2", "15:58:00", "16:00:00", 0), ("v3", "15:58:40", "16:10:00", 0), ("v4", "15:59:00", None, None)],
    )
    path = str(tmp_path / "departures")
    dep.withColumn("operating_day", F.to_date("departed_at")).write.partitionBy("operating_day").parquet(path)
    held = spark.read.parquet(path)
    tf.register_tram_bunching(spark, held)
    for since, until, share in (("14:00:00", "17:00:00", None), ("15:45:00", "15:59:00", 0.9), ("15:58:30", "16:00:00", 0.01)):
        ends = [f"timestamp'2026-10-03 {t}'" for t in (since, until)]
        call = f"SELECT * FROM tram_bunching({', '.join(ends + ([str(share)] if share else []))})"
        want = tf.tram_bunching(spark, held, f"2026-10-03 {since}", f"2026-10-03 {until}", share)
        assert rows(spark.sql(call), "follower_departed_at") == rows(want, "follower_departed_at")
    assert len(rows(spark.sql(call))) > 0
    plan = spark.sql(call)._jdf.queryExecution().executedPlan().toString()
    assert "operating_day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert plan.index("Exchange hashpartitioning") < plan.rindex("Filter ") and "PushedFilters: [IsNotNull(departed_at), GreaterThanOrEqual(departed_at,2026-10-03 14:58:30.0)" in plan


def test_parse_trip_options_of_any_body(spark, answers):  # noqa: F811
    tf.register_parse_trip_options(spark)
    good = answers.where("status = 200")
    good.createOrReplaceTempView("stored_answers")
    call = f"SELECT request_id, o.* FROM stored_answers, LATERAL parse_trip_options(body, timestamp'{TRIP_NOW}') o"
    want = advice.parse_trip_plans(good, TRIP_NOW)
    found = spark.sql(call)
    assert found.dtypes == want.dtypes
    assert rows(found, "request_id", "option") == rows(want, "request_id", "option") and len(rows(want)) == 7
    body = good.where("request_id = 1").first()["body"].replace("'", "\\'")
    now = rows(spark.sql(f"SELECT * FROM parse_trip_options('{body}')"), "option")
    assert [r["option"] for r in now] == ["bike", "tram", "walk"] and now[0]["arrive_in_s"] != 840
