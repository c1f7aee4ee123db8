"""Late rows, live heartbeats and the loss ledger."""

import datetime as dt
import json
import random
import time
from collections import Counter

from conftest import rows
from pyspark.sql import functions as F

from wayfeed.operators import coverage as cov
from wayfeed.operators import events as ev
from wayfeed.schemas import ENVELOPE
from wayfeed.sources import recording
from wayfeed.streaming import late, listeners
from wayfeed.streaming import medallion as m

EVENT = "vehicle_id string, event_type string, tst timestamp, received_at timestamp, route string"
START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def brute(batches, delay_s=120):
    seen, newest, counts = set(), None, Counter()
    for batch in batches:
        mark = None if newest is None else newest - dt.timedelta(seconds=delay_s)
        for vehicle, kind, tst, _, _ in batch:
            if None in (vehicle, kind, tst):
                counts["kept"] += 1
            elif mark is not None and tst.replace(microsecond=tst.microsecond // 1000 * 1000) <= mark:
                counts["late"] += 1
            else:
                counts["copy" if (vehicle, kind, tst) in seen else "kept"] += 1
                seen.add((vehicle, kind, tst))
        newest = max([t for _, _, t, _, _ in batch if t is not None] + ([newest] if newest else []), default=None)
        newest = newest and newest.replace(microsecond=newest.microsecond // 1000 * 1000)
    return counts


def shuffled(seed=3, n=400):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        tst = START + dt.timedelta(seconds=3 * k, microseconds=rng.choice([0, 500]))
        for _ in range(rng.choice([1, 1, 4])):
            delay = rng.choice([0, 0, 0, 1, 90, 400])
            out.append((rng.choice(["a", "a", "b", None]) if rng.random() < 0.3 else "hot", "vp", tst if rng.random() > 0.02 else None, START + dt.timedelta(seconds=3 * k + delay), "4"))
    return sorted(out, key=lambda r: r[3])


def streamed(spark, tmp_path, batches, name, tag=late.tag_copies_and_late, more=()):
    """Each list of rows is one batch, through recorded lines."""
    size = max(map(len, batches))
    text = lambda r: json.dumps([None if v is None else v.isoformat() if isinstance(v, dt.datetime) else v for v in r])
    folder = tmp_path / f"{name}-in"
    folder.mkdir()
    for k, batch in enumerate(batches):
        lines = [text(r) for r in batch] + [""] * (size - len(batch))
        (folder / f"{k:04d}.jsonl").write_text("\n".join(lines) + "\n")
    spark.dataSource.register(recording.RecordingSource)
    lines = spark.readStream.format("recorded_lines").option("path", str(folder)).option("rowsPerBatch", size).load()
    v = F.from_json("value", "array<string>")
    events = lines.select(*[v[i].cast(t).alias(n) for i, (n, t) in enumerate(c.split() for c in EVENT.split(", "))])
    out = str(tmp_path / name)
    writer = tag(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-mark").queryName(name)
    recording.run_to_end(writer)
    return spark.read.parquet(out)


def test_kept_copies_and_late_rows_add_up(spark, tmp_path):
    data = shuffled()
    batches = [data[k : k + 90] for k in range(0, len(data), 90)]
    want = brute(batches)
    assert min(want[k] for k in ("kept", "copy", "late")) > 5
    for name, options in (("fine", {}), ("coarse", {"buckets": 1})):
        got = streamed(spark, tmp_path, batches, name, lambda e, o=options: late.tag_copies_and_late(e, **o))
        counts = {r["outcome"]: r["n"] for r in rows(late.outcome_counts(got).groupBy("outcome").agg(F.sum("n").alias("n")))}
        assert counts == dict(want) and sum(counts.values()) == len(data)


def test_lots_of_one_micro_batch_are_judged_as_batches(spark, tmp_path):
    data = shuffled(11)
    lots = [data[k : k + 30] for k in range(0, len(data), 30)]
    want = brute(lots)
    assert min(want[k] for k in ("kept", "copy", "late")) > 5
    columns = f"{EVENT}, lot bigint"
    for name, per_batch in (("one", len(lots)), ("three", 3)):
        source, out = str(tmp_path / f"{name}-in"), str(tmp_path / name)
        for k in range(0, len(lots), per_batch):
            part = [(*r, n) for n, lot in enumerate(lots[k : k + per_batch]) for r in lot]
            spark.createDataFrame(part, columns).repartition(3).write.mode("append").parquet(source)
            tagged = late.tag_copies_and_late(spark.readStream.schema(columns).parquet(source), buckets=4, lot="lot")
            m.run(tagged.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-mark")).awaitTermination()
        got = spark.read.schema(tagged.schema).parquet(out)
        counts = {r["outcome"]: r["n"] for r in rows(late.outcome_counts(got).groupBy("outcome").agg(F.sum("n").alias("n")))}
        assert counts == dict(want) and sum(counts.values()) == len(data)


def test_batch_table_has_copies_and_no_late_rows(spark):
    data = shuffled(5, 60)
    got = rows(late.tag_copies_and_late(spark.createDataFrame(data, EVENT)))
    unique = {r[:3] for r in data if None not in r[:3]}
    assert Counter(r["outcome"] for r in got)["kept"] == len(unique) + sum(None in r[:3] for r in data) and len(got) == len(data)
    assert not any(r["outcome"] == "late" for r in got)
    assert late.tag_copies_and_late(spark.createDataFrame([], EVENT)).count() == 0


def test_the_ledger_tells_what_the_built_in_dedup_drops(spark, tmp_path):
    data = shuffled(7, 300)
    batches = [data[k : k + 80] for k in range(0, len(data), 80)]
    ledger = listeners.LossLedger(spark, str(tmp_path / "ledger"))
    spark.streams.addListener(ledger)
    keyed = "vehicle_id is not null and tst is not null"
    try:
        kept = streamed(spark, tmp_path, batches, "builtin", lambda e: ev.dedup_events(ev.observe_rules(e.where(keyed), "rules", {"on_time": "route = '5'"}))).count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        for _ in range(50):
            found = rows(listeners.read_losses(spark, str(tmp_path / "ledger")))
            if sum(r["input_rows"] for r in found) >= len(data):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(ledger)
    dropped = sum(r["late_rows"] for r in found)
    assert dropped > 0 and {r["query"] for r in found} == {"builtin"}
    assert sum(int(r["observed"].get("rules.checked", 0)) for r in found) == sum(r[0] is not None and r[2] is not None for r in data)
    # What was neither kept nor late is a copy.
    assert 0 < kept < len(data) - dropped
    assert listeners.read_losses(spark, str(tmp_path / "none")).count() == 0


def test_heartbeats_of_a_silent_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table = str(tmp_path / "heartbeats")
    spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "300ms")
    beats = listeners.LiveHeartbeats(spark, m.live(table), query="silent", every_s=1)
    spark.streams.addListener(beats)
    try:
        stream = spark.readStream.schema(ENVELOPE).parquet(str(tmp_path / "in"))
        query = stream.writeStream.format("noop").queryName("silent").option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="100 milliseconds").start()
        query.awaitTermination(6)
        seen = rows(m.read_heartbeats(spark, table), "heartbeat_at")
        live = cov.feed_live(m.read_heartbeats(spark, table), dt.datetime.now(dt.UTC)).first()["feed_live"]
        query.stop()
    finally:
        spark.streams.removeListener(beats)
        spark.conf.unset("spark.sql.streaming.noDataProgressEventInterval")
    assert live and len(seen) >= 3 and {r["received_total"] for r in seen} == {0} and len({r["session_id"] for r in seen}) == 1
    at = [r["heartbeat_at"] for r in seen]
    assert all((b - a).total_seconds() >= 0.99 for a, b in zip(at, at[1:]))
