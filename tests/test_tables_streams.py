import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_events import PLAN, SAMPLE, bronze, message

from wayfeed.operators import coverage as cov
from wayfeed.operators import departures as dep
from wayfeed.operators import events as ev
from wayfeed.operators import fleet as f
from wayfeed.sources import feed, paths, tables
from wayfeed.streaming import medallion as m


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


ROUTES = ["route_id,route_short_name,route_long_name,route_type"] + [
    "r1,4, Harbour - Square ,0", "r2,15,Ring,900", "r3,M1, ,1", "r4,550,Bus,700", "r5,X,No type,"
]
STOPS = ["stop_id,stop_code,stop_name,stop_lat,stop_lon,vehicle_type,zone_id,platform_code,parent_station,location_type"] + [
    "1, ,Harbour,60.1,24.9,0,A, , ,0", "2,H2,Square,60.2,x,3,,,, ", "3,H3,Station,60.3,24.7,1,B,,,1"
]


def test_reference_load_refuses_broken_files(spark, tmp_path):
    write(tmp_path / "routes.txt", ROUTES)
    write(tmp_path / "stops.txt", STOPS)
    out = str(tmp_path / "ref")
    args = (spark, str(tmp_path / "routes.txt"), str(tmp_path / "stops.txt"), out, "2026-01-01 00:00:00")
    assert tables.load_reference(*args, version=1, min_routes=3, min_stops=2) == {"routes": 3, "stops": 2}
    with pytest.raises(tables.ReferenceRejected):
        tables.load_reference(*args, version=2, min_routes=4, min_stops=2)
    assert tables.versions(spark, f"{out}/routes") == [1]
    tables.write_version(spark.range(1), f"{out}/routes", 2)  # a load that broke off between its tables
    both = tables.read_reference(spark, out)
    assert [df.count() for df in both] == [3, 2] and tables.read_reference(spark, str(tmp_path / "none")) is None
    tables.delete(spark, f"{out}/routes/v={2:012d}")
    routes = rows(tables.read_version(spark, f"{out}/routes"), "route")
    assert [(r["route"], r["route_name"], r["mode"]) for r in routes] == [("15", "Ring", "tram"), ("4", "Harbour - Square", "tram"), ("M1", None, "metro")]
    stops = rows(tables.read_version(spark, f"{out}/stops"), "stop_id")
    assert [(r["stop_id"], r["stop_code"], r["long"], r["zone_id"]) for r in stops] == [("1", None, 24.9, "A"), ("2", "H2", None, None)]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_version(spark, path) is None
    for v in range(5):
        tables.write_version(spark.range(v), path, v)
    tables.write_version(spark.range(9), path, 4)  # a retry replaces its own version only
    assert tables.read_version(spark, path).count() == 9
    assert tables.read_version(spark, path, before=4).count() == 3
    assert tables.drop_old_versions(spark, path, keep=2) == [0, 1, 2]
    assert tables.versions(spark, path) == [3, 4]


def test_retention_drops_whole_days_and_filters_the_boundary(spark, tmp_path):
    path = str(tmp_path / "bronze")
    df = spark.sql("SELECT timestamp(t) AS received_at FROM VALUES ('2026-01-01 10:00:00'), ('2026-01-05 11:59:59'), ('2026-01-05 12:00:00'), ('2026-01-09 00:00:00') AS x(t)")
    feed.with_received_date(df).write.partitionBy("received_date").parquet(path)
    as_of = dt.datetime(2026, 1, 10, 12, tzinfo=dt.UTC)
    dropped = tables.apply_retention(spark, [(path, "received_date", 5), (str(tmp_path / "missing"), "d", 5)], as_of)
    assert dropped == {path: ["received_date=2026-01-01"], str(tmp_path / "missing"): []}
    assert spark.read.parquet(path).count() == 3
    assert tables.retained(spark.read.parquet(path), "received_at", 5, as_of).count() == 2


def test_retention_keeps_an_operating_day_until_its_last_departure(spark, tmp_path):
    path = str(tmp_path / "departures")
    df = spark.sql("SELECT date(d) AS operating_day, 1 AS x FROM VALUES ('2024-01-07'), ('2024-01-08'), ('2024-01-10'), ('2024-01-11') AS v(d)")
    df.write.partitionBy("operating_day").parquet(path)
    # The bound is 2024-01-11 01:00 UTC; a departure at 01:30 UTC still belongs to the 10th.
    dropped = tables.apply_retention(spark, [(path, "operating_day", 30)], dt.datetime(2024, 2, 10, 1, tzinfo=dt.UTC))
    assert dropped[path] == ["operating_day=2024-01-07", "operating_day=2024-01-08"]


def test_day_predicates_reach_the_partitions(spark, tmp_path):
    path = str(tmp_path / "beats")
    df = spark.sql("SELECT timestamp(t) AS heartbeat_at, date(t) AS heartbeat_date FROM VALUES ('2026-01-01 10:00:00'), ('2026-01-09 10:00:00') AS x(t)")
    df.write.partitionBy("heartbeat_date").parquet(path)
    recent = cov.feed_live(spark.read.parquet(path), "2026-01-09 10:00:05")
    assert recent.first()["feed_live"]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(heartbeat_date" in plan


def test_unreadable_lines_and_malformed_topics_are_rejected_rows(spark, tmp_path):
    bad = message("vp", "tram", 40, 3, "3", "2", "21:14", 1)
    lines = recorded_lines(SAMPLE[:2]) + ["{not json", "{not json", "also none", ""]
    lines += [line.replace("/hfp/", "/gtfsrt/") for line in recorded_lines([bad])]
    write(tmp_path / "in" / "a.jsonl", lines)
    at = m.replay(spark, str(tmp_path / "in"), str(tmp_path / "out"), *dims(spark))
    silver = m.read_silver(spark, at["silver"])
    assert silver.where("stream = 'rejected'").count() == 4
    minutes = m.coverage_of(spark, at["heartbeats"])
    assert minutes.count() >= 1
    beats = m.read_heartbeats(spark, at["heartbeats"]).count()
    m.add_heartbeats(spark, at["bronze"], at["heartbeats"])
    assert m.read_heartbeats(spark, at["heartbeats"]).count() == beats >= 1


def test_recording_round_trip(spark, tmp_path):
    sample = bronze(spark, SAMPLE).select("topic", "payload", "received_at")
    feed.record_by_minute(sample, str(tmp_path / "rec"))
    back = feed.read_recording(spark, str(tmp_path / "rec"))
    assert rows(back.drop("minute"), "received_at") == rows(sample, "received_at")
    assert {r["minute"] for r in rows(back)} == {"20260926T1828"}


def test_heartbeats_go_on_in_silence(spark):
    sessions = spark.sql("SELECT 's' AS session_id, timestamp('2026-01-01 00:00:00') AS started_at, timestamp('2026-01-01 00:00:45') AS ended_at")
    events = spark.sql("SELECT 's' AS session_id, timestamp(t) AS received_at FROM VALUES ('2026-01-01 00:00:01'), ('2026-01-01 00:00:10'), ('2026-01-01 00:00:31') AS x(t)")
    raw = feed.heartbeat_ledger(events, sessions)
    found = rows(ev.parse_heartbeats(raw), "heartbeat_at")
    assert [(r["heartbeat_at"].second, r["received_total"], r["dropped_total"]) for r in found] == [(0, 0, 0), (10, 2, 0), (20, 2, 0), (30, 2, 0), (40, 3, 0)]


# ---------------------------------------------------------------- streams


def recorded_lines(messages):
    import json

    return [json.dumps({"topic": t, "payload": p, "received_at": f"2026-09-26T18:28:{40 + i // 10}.{i % 10}00000+00:00"}) for i, (t, p) in enumerate(messages)]


def dims(spark):
    stops = spark.createDataFrame([("1140451", "Museum", 60.1, 24.9)], "stop_id string, stop_name string, lat double, long double")
    routes = spark.createDataFrame([("1008", "8", "Eight")], "feed_route_id string, route string, route_name string")
    return stops, routes


def batch_departures(spark, messages):
    routed = ev.route_events(ev.dedup_events(ev.normalize_events(bronze(spark, messages))))
    return dep.build_departures(ev.stop_events(routed), *dims(spark))


@pytest.mark.parametrize("files, per_trigger", [(1, None), (3, 1)])
def test_replay_equals_batch_and_resumes(spark, tmp_path, files, per_trigger):
    lines = recorded_lines(SAMPLE)
    source = tmp_path / "in"
    for i in range(files):
        write(source / f"part-{i:03d}.jsonl", lines[i::files] + [""])
    out = str(tmp_path / "out")
    at = m.replay(spark, str(source), out, *dims(spark), max_files_per_trigger=per_trigger)

    def departures():
        found = spark.read.parquet(at["departures"]).withColumn("operating_day", F.col("operating_day").cast("date"))
        return rows(found.select(*sorted(found.columns)), "vehicle_id")

    expected = batch_departures(spark, SAMPLE)
    assert departures() == rows(expected.select(*sorted(expected.columns)), "vehicle_id")
    assert {r["vehicle_id"] for r in rows(m.read_current(spark, at["current"]))} == {"50/169", "40/75"}

    # Started again without new files: nothing is counted twice.
    m.replay(spark, str(source), out, *dims(spark), max_files_per_trigger=per_trigger)
    assert len(departures()) == 2

    # One more file: a new departure, an older position, and a copy from before the watermark.
    more = [
        message("dep", "tram", 40, 90, "8", "2", "21:10", 0, 1140451, "2026-09-26T18:29:00.000Z", PLAN),
        message("vp", "tram", 40, 75, "3", "2", "21:14", -99, tst="2026-09-26T18:27:00.000Z"),
        message("dep", "tram", 40, 91, "8", "2", "21:10", 0, 1140451, "2026-09-26T18:20:00.000Z", PLAN),
    ]
    write(source / "part-999.jsonl", recorded_lines(more))
    m.replay(spark, str(source), out, *dims(spark), max_files_per_trigger=per_trigger)
    assert [r["vehicle_id"] for r in departures()] == ["40/609", "40/81", "40/90"]
    tram = rows(m.read_current(spark, at["current"]).where("vehicle_id = '40/75'"))
    assert tram[0]["lateness_s"] == 19  # the older event did not overwrite the newer one


def test_streaming_quality_counts(spark, tmp_path):
    write(tmp_path / "in" / "a.jsonl", recorded_lines([message("vp", "tram", 40, 1, "3", "2", "21:14", -4000), *SAMPLE[:2]]))
    typed = ev.normalize_events(feed.with_envelope(feed.read_feed(spark, str(tmp_path / "in"), True), "s"))
    watched = ev.observe_rules(typed, "quality", {"lateness_plausible": "lateness_s IS NULL OR abs(lateness_s) <= 3600"})
    query = m.run(watched.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")))
    query.awaitTermination()
    seen = [p.observedMetrics["quality"] for p in query.recentProgress if p.observedMetrics]
    assert sum(s["checked"] for s in seen) == 3 and sum(s["lateness_plausible"] for s in seen) == 1


def test_current_state_as_a_streaming_aggregate(spark, tmp_path):
    positions = ev.position_events(ev.route_events(ev.normalize_events(bronze(spark, SAMPLE))))
    path = str(tmp_path / "positions")
    positions.write.parquet(path)
    stream = spark.readStream.schema(positions.schema).parquet(path)
    query = m.run(m.current_updates(stream).writeStream.outputMode("update").format("memory").queryName("current_updates"))
    query.awaitTermination()
    assert rows(spark.table("current_updates"), "vehicle_id") == rows(f.vehicle_current(positions), "vehicle_id")


def test_paths_follow_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    made = paths.shared_dir(spark, "x")
    assert made.startswith(root) if root else "wayfeed" in made


def reference_load(spark, out, version, name):
    tables.write_version(spark.createDataFrame([("1008", "8", name)], "feed_route_id string, route string, route_name string"), f"{out}/routes", version)
    tables.write_version(dims(spark)[0].withColumn("stop_name", F.lit(name)), f"{out}/stops", version)
    tables.write_version(spark.range(1), f"{out}/loaded", version)


def test_a_new_reference_load_holds_from_the_next_batch_on(spark, tmp_path):
    events = ev.stop_events(ev.route_events(ev.dedup_events(ev.normalize_events(bronze(spark, SAMPLE)))))
    source, ref, out = str(tmp_path / "stop"), str(tmp_path / "ref"), str(tmp_path / "departures")

    def advance():
        events.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        m.write_departures_refreshed(stream, ref, out, str(tmp_path / "mark")).awaitTermination()

    def found():
        return sorted({(r["batch"], r["reference_version"], r["stop_name"], r["route_name"]) for r in rows(spark.read.parquet(out)) if r["stop_id"] == "1140451"}, key=str)

    advance()  # nothing loaded yet
    reference_load(spark, ref, 1, "one")
    advance()
    tables.write_version(spark.range(1), f"{ref}/routes", 2)  # a load that broke off
    advance()
    reference_load(spark, ref, 3, "three")
    advance()
    want = [(0, None, None, None), (1, 1, "one", "one"), (2, 1, "one", "one"), (3, 3, "three", "three")]
    assert [(b, v, s) for b, v, s, _ in found()] == [(b, v, s) for b, v, s, _ in want]
    before = spark.read.parquet(out).count()
    m.departures_of_batch(ref, out)(events, 1)  # a repeated batch: its own load, its own rows
    assert [(b, v, s) for b, v, s, _ in found()] == [(b, v, s) for b, v, s, _ in want] and spark.read.parquet(out).count() == before


def test_the_chain_with_late_rows_and_a_reference_folder(spark, tmp_path):
    late = message("dep", "tram", 40, 91, "8", "2", "21:10", 0, 1140451, "2026-09-26T18:20:00.000Z", PLAN)
    reference_load(spark, str(tmp_path / "ref"), 1, "one")
    write(tmp_path / "in" / "a.jsonl", recorded_lines(SAMPLE))
    at = m.replay(spark, str(tmp_path / "in"), str(tmp_path / "out"), reference=str(tmp_path / "ref"), show_late=True)
    first = spark.read.parquet(at["departures"]).count()
    write(tmp_path / "in" / "b.jsonl", recorded_lines([late, SAMPLE[0]]))
    at = m.replay(spark, str(tmp_path / "in"), str(tmp_path / "out"), reference=str(tmp_path / "ref"), show_late=True)
    silver = m.read_silver(spark, at["silver"])
    lost = rows(silver.where("array_contains(failed_rules, 'behind_watermark')"))
    assert ("40/91", "rejected") in {(r["vehicle_id"], r["stream"]) for r in lost}
    assert spark.read.parquet(at["departures"]).count() == first and first > 0


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    from wayfeed.streaming import buckets as bk

    path = str(tmp_path / "current")
    step = bk.merge_buckets(path, ["k"], "s", buckets=8, keep=2)
    table = lambda values: spark.createDataFrame(values, "k string, s int, v string")
    assert bk.read_buckets(spark, path) is None and bk.read_changes(spark, path) is None
    states, first = [], table([(f"k{i}", 5, "a") for i in range(60)])
    batches = [first, table([("k7", 6, "b"), ("k7", 4, "old")]), table([("k7", 1, "older"), ("new", 1, "n")]), table([]), table([("k8", 9, "z")])]
    for k, batch in enumerate(batches):
        before = bk.read_buckets(spark, path) or table([])
        step(batch, k)
        after = bk.read_buckets(spark, path)
        want = f.latest_by_key(before.unionByName(batch), ["k"], "s")
        assert rows(after, "k") == rows(want, "k")
        changed = bk.read_changes(spark, path).where(F.col("version") == k).drop("version")
        assert rows(changed, "k", "_change_type") == rows(f.snapshot_diff(spark.createDataFrame(states[-1] if states else [], batch.schema), after, ["k"]), "k", "_change_type")
        states.append(after.collect())
    assert len(paths.children(spark, f"{path}/data/__version=4")) == 2  # one bucket and the marker of success
    assert len(paths.children(spark, f"{path}/data/__version=0")) < 10 and len(paths.children(spark, f"{path}/manifest")) == 2
    step(batches[4], 4)  # a repeated batch gives the same state and changes
    assert rows(bk.read_buckets(spark, path), "k") == sorted([r.asDict() for r in states[-1]], key=lambda r: (r["k"] is not None, r["k"]))
    assert bk.read_changes(spark, path).where("version = 4").count() == 2


def test_silver_parses_each_row_once_and_keeps_rows_without_a_key(spark, tmp_path):
    bad = [(topic, "no json") for topic, _ in SAMPLE[:2]] * 2
    bronze(spark, SAMPLE + bad).withColumn("received_date", F.to_date("received_at")).write.parquet(f"{tmp_path}/bronze")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # the plan of the batch with the rows is wanted
    try:
        query = m.write_silver(feed.read_bronze(spark, f"{tmp_path}/bronze", True), f"{tmp_path}/silver", f"{tmp_path}/mark")
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    plan = query._jsq.explainInternal(False)
    assert plan.count("from_json") == 1 and "ReusedExchange" in plan
    # Three copies of a position are one row; rows without vehicle and time stay, equal or not.
    found = {r["stream"]: r["count"] for r in m.read_silver(spark, f"{tmp_path}/silver").groupBy("stream").count().collect()}
    assert found == {"position": 2, "stop": 5, "rejected": 4}


def test_messages_of_one_row_group_are_made_in_order_by_many_tasks(spark, tmp_path):
    from wayfeed.plans.views import heartbeat_rows, messages

    events = spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).alias("ts"), (F.col("id") % 9).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 5}').alias("props"),
    )
    events.orderBy(F.rand(3)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    for made, n in ((messages(spark, str(tmp_path), in_order=True), 700), (heartbeat_rows(spark, str(tmp_path), in_order=True), 400)):
        parts = made.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.min("received_at").alias("a"), F.max("received_at").alias("z"))
        parts = sorted(parts.collect(), key=lambda r: r["part"])
        assert len(parts) > 1 and sum(r["n"] for r in parts) == n
        assert all(a["z"] < b["a"] for a, b in zip(parts, parts[1:]))
