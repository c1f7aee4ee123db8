"""Covered intervals and the as-of snapshot as streams: against brute force, in several runs, with late rows."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayfeed.operators import coverage as cov
from wayfeed.operators import reports as rep
from wayfeed.streaming import spans

START = dt.datetime(2026, 1, 1, 11, 58, tzinfo=dt.UTC)
BEATS = "session_id string, heartbeat_at timestamp"
SAID = "report_id long, reported_at timestamp, vehicle_id string, note string"
SEEN = "vehicle_id string, mode string, route string, direction string, lateness_s int, last_seen_at timestamp, lat double, long double"


def at(s, us=0):
    return START + dt.timedelta(seconds=s, microseconds=us)


def floor_ms(t):
    return t.replace(microsecond=t.microsecond // 1000 * 1000)


def beats(seed=5, n=240):
    """Arrival order; one session has most heartbeats, spacings lie around the limit, some repeat, some come very late."""
    rng, out = random.Random(seed), []
    for session, share in (("hot", 1.0), ("b", 0.2), (None, 0.2)):
        s = 0
        for _ in range(int(n * share)):
            s += rng.choice([0, 1, 10, 29, 30, 31, 75])
            out.append((s + rng.choice([0, 0, 0, 20, 400]), (session, at(s, rng.choice([0, 7, 999_999])))))
    return [r for _, r in sorted(out, key=lambda r: r[0])]


def test_covered_intervals_of_a_stream(spark, tmp_path):
    data = beats()
    batches = [data[k : k + 80] for k in range(0, len(data), 80)] + [[("closing", at(10**6)), ("x", None)]]
    used, late, mark = {}, [], None
    for batch in batches:
        for session, t in batch:
            if t is not None and mark is not None and floor_ms(t) <= mark:
                late.append((session, t, t, True))
            elif t is not None:
                used.setdefault(session, []).append(t)
        newest = floor_ms(max(t for _, t in batch if t is not None)) - dt.timedelta(seconds=60)
        mark = newest if mark is None else max(mark, newest)
    want = list(late)
    for session, times in used.items():
        times.sort()
        want += [(session, a, b, False) for a, b in zip(times, times[1:]) if int(b.timestamp()) - int(a.timestamp()) <= 30]
    assert len(late) > 5 and len(want) > 150

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:  # each run goes on from the checkpoint of the one before
        spark.createDataFrame(batch, BEATS).coalesce(1).write.mode("append").parquet(source)
        query = spans.write_covered(spark.readStream.schema(BEATS).parquet(source), out, f"{out}-mark", delay="60 seconds", span_s=120)
        query.awaitTermination()
    found = [(r["session_id"], r["from_at"], r["to_at"], r["late"]) for r in rows(spark.read.parquet(out))]
    order = lambda r: (str(r[0]), r[1], r[2], r[3])
    utc = [(s, a.replace(tzinfo=dt.UTC), b.replace(tzinfo=dt.UTC), late) for s, a, b, late in found]
    assert sorted(utc, key=order) == sorted(want, key=order)
    # Spans behind the watermark are forgotten; the closing session's own remain.
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 2
    # Without the late heartbeats the batch form gives the same minutes.
    kept = spark.createDataFrame([(s, t) for s, ts in used.items() if s != "closing" for t in ts], BEATS)
    streamed = cov.minutes_of(spark.read.parquet(out).where("NOT late"), kept)
    assert rows(streamed, "minute_start") == rows(cov.coverage_minutely(kept), "minute_start")


def journeys(seed=2, n=300):
    rng, said, seen = random.Random(seed), [], []
    for k in range(n):
        v, s = rng.choice(["hot", "hot", "hot", "a", "b"]), 4 * k
        if rng.random() < 0.6 and not (v == "hot" and 300 < s < 600):
            moment = at(s, rng.choice([0, 250]))
            for late in (1, 2)[: rng.choice([1, 1, 2])]:  # two at one instant
                seen.append((s + rng.choice([0, 0, 30]), (v, "tram", f"{k % 5}", None if k % 7 == 0 else "1", late, moment, 60.1 + k / 7, 24.9)))
        said.append((s + rng.choice([0, 0, 20]), (k, at(s, rng.choice([0, 250])), v if k % 11 else "gone", None if k % 3 else "")))
    return said, seen


def test_reports_and_positions_as_two_streams(spark, tmp_path):
    said, seen = journeys()
    said += [(700, (1000 + k, at(5 * k), "hot", "very late")) for k in range(4)]
    said += [(500, (2000, None, "a", "no time")), (500, (2001, at(500), None, "no vehicle")), (500, (2002, None, None, None))]
    end = 10**6
    said.append((end, (-1, at(end), "closing", None)))
    seen.append((end, ("closing", "tram", "1", "1", 0, at(end), 1.0, 1.0)))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((-1, 400), (400, 650), (650, 2000), (2000, end + 1)):
        streams = []
        for name, data, schema in (("said", said, SAID), ("seen", seen, SEEN)):
            part = [r for s, r in data if low < s <= high]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}/{name}")
            streams.append(spark.readStream.schema(schema).parquet(f"{source}/{name}"))
        query = spans.write_snapshots(*streams, out, f"{out}-mark", delay="60 seconds", look_back_s=120, span_s=180)
        query.awaitTermination()
    found = {r["report_id"]: r for r in rows(spark.read.parquet(out).drop("report_date"))}
    assert len(found) == len(said) - 1 and -1 not in found  # the closing report still waits
    assert {k for k, r in found.items() if r["late"]} == {1000, 1001, 1002, 1003}
    assert all(found[k]["rejected"] == spans.LATE_REPORT_MESSAGE and found[k]["route"] is None for k in range(1000, 1004))
    assert all(found[k]["rejected"] == rep.GONE_MESSAGE and not found[k]["late"] for k in range(2000, 2003))

    batch = rep.snapshot_reports(
        spark.createDataFrame([r for _, r in said if 0 <= r[0] < 1000], SAID), spark.createDataFrame([r for _, r in seen], SEEN), look_back_s=120
    )
    want = rows(batch, "report_id")
    assert [{k: v for k, v in found[r["report_id"]].items() if k != "late"} for r in want] == want
    # Brute force of the batch form with its look-back.
    for _, (k, t, v, _) in said[:300]:
        earlier = [r for _, r in seen if r[0] == v and r[5] <= t]
        best = max(earlier, key=lambda r: (r[5], r[4]), default=None)
        if best is not None and int(t.timestamp()) - int(best[5].timestamp()) > 120:
            best = None
        assert (found[k]["measured_lateness_s"], found[k]["lat"]) == ((best[4], best[6]) if best else (None, None))
        assert found[k]["rejected"] == (None if best else rep.GONE_MESSAGE)
    assert sum(r["rejected"] is None for r in want) > 100 and sum(r["rejected"] is not None and r["vehicle_id"] == "hot" for r in want) > 5


def test_state_calls_of_snapshots_do_not_grow_with_vehicles(spark, tmp_path):
    """Many vehicles seen once: the state holds a row a bucket, not one a vehicle; the result is that of the batch form."""
    moment = at(0)
    spark.createDataFrame([(k, moment, f"v{k}", None) for k in range(500)] + [(-1, at(10**6), "closing", None)], SAID).coalesce(1).write.parquet(f"{tmp_path}/said")
    spark.createDataFrame([(f"v{k}", "tram", f"{k}", "1", k, moment, 60.0, 24.0) for k in range(0, 500, 2)] + [("closing", "tram", "1", "1", 0, at(10**6), 1.0, 1.0)], SEEN).coalesce(1).write.parquet(f"{tmp_path}/seen")
    streams = [spark.readStream.schema(s).parquet(f"{tmp_path}/{n}") for n, s in (("said", SAID), ("seen", SEEN))]
    out = str(tmp_path / "out")
    tagged = spans.snapshot_reports_stream(*streams, delay="1 minute", look_back_s=120, span_s=180, buckets=8)
    query = tagged.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-mark").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert 0 < max(states) <= 8 * 2  # a bucket has a row for its state and one for its time to end
    found = {r["report_id"]: (r["route"], r["rejected"]) for r in rows(spark.read.parquet(out))}
    assert found == {k: (f"{k}", None) if k % 2 == 0 else (None, rep.GONE_MESSAGE) for k in range(500)}


def test_limits_of_spans(spark):
    hb = spark.createDataFrame([], BEATS)
    with pytest.raises(ValueError):
        spans.covered_intervals_stream(hb, max_spacing_s=60, span_s=60)
    with pytest.raises(ValueError):
        spans.snapshot_reports_stream(hb, hb, look_back_s=61, span_s=60)


def test_look_back_of_an_empty_table(spark):
    said, seen = spark.createDataFrame([], SAID), spark.createDataFrame([], SEEN)
    assert rep.snapshot_reports(said, seen, look_back_s=60).count() == 0
    one = spark.createDataFrame([(1, at(0), "a", None)], SAID)
    assert [r["rejected"] for r in rows(rep.snapshot_reports(one, seen, look_back_s=60))] == [rep.GONE_MESSAGE]
    near = spark.createDataFrame([("a", "tram", "1", "1", 5, at(-60), 1.0, 2.0)], SEEN).withColumn("event_date", F.to_date("last_seen_at"))
    assert rows(rep.snapshot_reports(one, near, look_back_s=60))[0]["measured_lateness_s"] == 5
    assert rows(rep.snapshot_reports(one, near, look_back_s=59))[0]["measured_lateness_s"] is None
