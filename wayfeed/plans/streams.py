"""Streaming twins, run to their end over messages derived from the events table.

Each query writes its input and its tables to the shared folder of the session
(see ``sources.paths``) and returns the resulting table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as cov
from ..operators import events as ev
from ..schemas import ENVELOPE
from ..sources import feed, recording, tables
from ..sources.paths import shared_dir
from ..streaming import buckets, late, spans
from ..streaming import medallion as m
from .coverage import _MINUTES, SPACING_S
from .departures import SQL_ENRICHED
from .feed import _ROUTED
from .registry import query
from .reports import _ASOF, cleaned
from .views import SQL_PARSED, SQL_POSITIONS, heartbeat_rows, heartbeats, load, messages, positions, routes_of_regions, stops_of_nations


def _as_stream(spark, df, name):
    """The rows as a file stream, a file for each partition; all files make one micro-batch, so none is late.

    Partitions are in the order received where their rows were made from events in order: to order the finished
    messages would build the text of each twice, once to find the borders.
    """
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(ENVELOPE).parquet(path)


def _replay(spark, sf_dir):
    raw = messages(spark, sf_dir, in_order=True).unionByName(heartbeat_rows(spark, sf_dir, in_order=True))
    return m.replay(
        spark,
        _as_stream(spark, raw, "raw"),
        shared_dir(spark, "replay"),
        stops_of_nations(spark, sf_dir),
        routes_of_regions(spark, sf_dir),
        files=1,  # a month of partitions, few rows each
    )


_DEDUP_KEPT = "vehicle_id, event_type, tst, lat, long, lateness_s, stop_id"


@query(
    "dedup_stream",
    f"""WITH {_ROUTED} SELECT {_DEDUP_KEPT} FROM deduped WHERE vehicle_id IS NOT NULL AND tst IS NOT NULL""",
)
def dedup_stream(spark, sf_dir):
    """Dedup within the watermark; copies of a row differ only in when they were received."""
    out = shared_dir(spark, "dedup")
    stream = _as_stream(spark, messages(spark, sf_dir, in_order=True), "dedup-raw")
    typed = ev.normalize_events(stream).where("vehicle_id IS NOT NULL AND tst IS NOT NULL")
    kept = ev.dedup_events(typed).select(*_DEDUP_KEPT.split(", "))
    writer = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-mark")
    m.run(writer).awaitTermination()
    return spark.read.schema(kept.schema).parquet(out)


@query(
    "vehicle_current_stream",
    f"""WITH {_ROUTED}
SELECT vehicle_id, mode, route, direction, journey_id, lat, long, heading, speed_ms, lateness_s, tst AS last_seen_at
FROM routed WHERE event_type = 'vp' AND complete AND inside
QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY tst DESC) = 1""",
)
def vehicle_current_stream(spark, sf_dir):
    return m.read_current(spark, _replay(spark, sf_dir)["current"])


@query("feed_replay", f"WITH {SQL_ENRICHED} SELECT * FROM departures")
def feed_replay(spark, sf_dir):
    """The whole chain, raw rows to departures."""
    path = _replay(spark, sf_dir)["departures"]
    return spark.read.parquet(path).withColumn("operating_day", F.col("operating_day").cast("date"))


# ---------------------------------------------------------------- recordings in arrival order

_PER_BATCH = 4_000
# Batches that one micro-batch takes at once: a month is a few micro-batches, each of bounded size.
_LOTS = 250
# Every seventh event arrives an hour late; the last copy of every fifth event 100 seconds after the others.
_DELAYED = "CASE WHEN event_id % 7 = 3 THEN 3600 ELSE 0 END + CASE WHEN n = 3 AND event_id % 5 = 0 THEN 100 ELSE 0 END"


def arrivals(spark, sf_dir):
    """The messages as recorded lines, a folder for each day of arrival, files and rows in the order of arrival."""
    rows = messages(spark, sf_dir, numbered=True).withColumnRenamed("copy", "n")
    rows = rows.withColumn("arrived_at", F.timestamp_micros(F.unix_micros("received_at") + F.expr(_DELAYED).cast("bigint") * 1_000_000))
    path = shared_dir(spark, "arrivals")
    day = F.to_date("arrived_at")
    recorded = rows.select("topic", "payload", F.col("arrived_at").alias("received_at"), "event_id", "n", day.cast("string").alias("day"))
    # Names of a write's files go by task, so the files of a busy day that several tasks share keep the order of arrival.
    order = ("received_at", "event_id", "n")
    ordered = recorded.repartitionByRange(*order).sortWithinPartitions("day", *order)
    ordered.drop("event_id", "n").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").partitionBy("day").json(path)
    return path


_ARRIVALS = f"""{SQL_PARSED},
arrived AS (
  SELECT *, row_number() OVER (ORDER BY CAST(arrived_at AS DATE), arrived_at, event_id, n) AS position FROM (
    SELECT p.*, c.n, p.first_received_at + to_milliseconds(c.n) + to_seconds({_DELAYED}) AS arrived_at
    FROM parsed p JOIN (VALUES (0), (1), (2), (3)) c(n) ON c.n = 0 OR p.event_type = 'vp')
),
batched AS (SELECT *, (position - 1) // {_PER_BATCH} AS batch FROM arrived)"""


def _recorded(spark, path, lots=_LOTS):
    spark.dataSource.register(recording.RecordingSource)
    reader = spark.readStream.format("recorded_lines").option("path", path).option("rowsPerBatch", _PER_BATCH).option("suffix", ".json")
    return reader.option("lotsPerBatch", lots).load()


@query(
    "recording_stream",
    f"""WITH {_ARRIVALS}
SELECT strftime(arrived_at, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(*) AS lines, min(arrived_at) AS first_at, max(arrived_at) AS last_at
FROM arrived GROUP BY 1, 2""",
)
def recording_stream(spark, sf_dir):
    """The recording through the streaming data source, stopped after its first batch and started again from its checkpoint."""
    out, path = shared_dir(spark, "recording-stream"), arrivals(spark, sf_dir)
    for lots in (1, _LOTS):
        lines = recording.recorded_rows(_recorded(spark, path, lots)).drop("lot")
        writer = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-mark")
        # A bounded run takes the one batch it asked for.
        m.run(writer).awaitTermination() if lots == 1 else recording.run_to_end(writer)
    got = ev.parse_topic(spark.read.schema(lines.schema).parquet(out))
    day = F.regexp_extract("file", "day=([0-9-]+)", 1).alias("day")
    return got.groupBy(day, "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("file", "line").alias("lines"), F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at")
    )


@query(
    "late_rows",
    f"""WITH {_ARRIVALS},
marks AS (
  SELECT batch, max(max(epoch_us(tst) // 1000)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 120000 AS mark
  FROM batched GROUP BY batch
),
judged AS (
  SELECT b.*, vehicle_id IS NOT NULL AND tst IS NOT NULL AS keyed, coalesce(epoch_us(tst) // 1000 <= mark, false) AS late FROM batched b JOIN marks USING (batch)
)
SELECT event_type, outcome, count(*) AS n FROM (
  SELECT event_type, CASE WHEN NOT keyed THEN 'kept' WHEN late THEN 'late'
    WHEN row_number() OVER (PARTITION BY keyed, late, vehicle_id, event_type, tst ORDER BY position) = 1 THEN 'kept' ELSE 'copy' END AS outcome
  FROM judged) GROUP BY 1, 2""",
)
def late_rows(spark, sf_dir):
    """Events kept, copies and late rows of a late-shuffled recording; the counts add up to its lines."""
    out = shared_dir(spark, "late")
    raw = feed.with_envelope(recording.recorded_rows(_recorded(spark, arrivals(spark, sf_dir))), "s1", keep=["lot"])
    tagged = late.tag_copies_and_late(ev.normalize_events(raw, keep=["lot"]), buckets=16, lot="lot").select("event_type", "outcome")
    recording.run_to_end(tagged.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-mark"))
    return late.outcome_counts(spark.read.schema(tagged.schema).parquet(out))


# ---------------------------------------------------------------- reference data that changes under a stream

_HALF = "(SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


@query(
    "departures_refreshed",
    f"""WITH {SQL_ENRICHED}, half AS (SELECT {_HALF} AS middle)
SELECT * EXCLUDE (middle) REPLACE (CASE WHEN departed_at > half.middle THEN 'New ' || stop_name ELSE stop_name END AS stop_name,
                  CASE WHEN departed_at > half.middle THEN NULL ELSE route_name END AS route_name),
       CAST(CASE WHEN departed_at > half.middle THEN 2 ELSE 1 END AS BIGINT) AS reference_version
FROM departures, half""",
)
def departures_refreshed(spark, sf_dir):
    """Departures streamed in two batches; between them the stops are loaded under new names and the routes get lost."""
    from .feed import routed

    base = shared_dir(spark, "refreshed")
    events = ev.stop_events(routed(spark, sf_dir))
    half = F.col("tst") > load(spark, sf_dir, "events").agg(F.expr("timestamp_micros((min(unix_micros(ts)) + max(unix_micros(ts))) div 2)")).scalar()
    stops, routes = stops_of_nations(spark, sf_dir), routes_of_regions(spark, sf_dir)
    loads = [(routes, stops), (routes.limit(0), stops.withColumn("stop_name", F.concat(F.lit("New "), "stop_name")))]
    for version, (part, (some_routes, some_stops)) in enumerate(zip((~half, half), loads), start=1):
        events.where(part).write.mode("append").parquet(f"{base}/stop-events")
        tables.write_version(some_routes, f"{base}/reference/routes", version)
        tables.write_version(some_stops, f"{base}/reference/stops", version)
        tables.write_version(spark.range(1), f"{base}/reference/loaded", version)
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/stop-events")
        m.write_departures_refreshed(stream, f"{base}/reference", f"{base}/departures", f"{base}/mark").awaitTermination()
    return spark.read.parquet(f"{base}/departures").drop("batch").withColumn("operating_day", F.col("operating_day").cast("date"))


@query(
    "current_changes_stream",
    f"""WITH {SQL_POSITIONS}, half AS (SELECT {_HALF} AS middle),
b AS (SELECT positions.* FROM positions, half WHERE last_seen_at <= middle QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY last_seen_at DESC) = 1),
a AS (SELECT * FROM positions QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY last_seen_at DESC) = 1)
SELECT b.*, 'insert' AS _change_type, 0 AS version FROM b
UNION ALL SELECT a.*, 'insert', 1 FROM a WHERE vehicle_id NOT IN (SELECT vehicle_id FROM b)
UNION ALL SELECT b.*, 'update_preimage', 1 FROM b JOIN a USING (vehicle_id) WHERE b.last_seen_at <> a.last_seen_at
UNION ALL SELECT a.*, 'update_postimage', 1 FROM b JOIN a USING (vehicle_id) WHERE b.last_seen_at <> a.last_seen_at""",
)
def current_changes_stream(spark, sf_dir):
    """The change feed of the current state, streamed in two batches; the second also brings older positions again."""
    base = shared_dir(spark, "current")
    p = positions(spark, sf_dir).withColumnRenamed("last_seen_at", "tst")
    half = load(spark, sf_dir, "events").agg(F.expr("timestamp_micros((min(unix_micros(ts)) + max(unix_micros(ts))) div 2)")).scalar()
    for part in (p.where(F.col("tst") <= half), p):
        part.write.mode("append").parquet(f"{base}/positions")
        stream = spark.readStream.schema(p.schema).parquet(f"{base}/positions")
        m.write_current(stream, f"{base}/current", f"{base}/mark", buckets=16).awaitTermination()
    return buckets.read_changes(spark, f"{base}/current")


# ---------------------------------------------------------------- state cut by time

_LOOK_BACK_S = 2 * 86_400


def _middle(spark, sf_dir):
    return load(spark, sf_dir, "events").agg(F.expr("timestamp_micros((min(unix_micros(ts)) + max(unix_micros(ts))) div 2)")).scalar()


def _closing(df, key, at):
    """One row of a key of its own, ten days after all others: it moves the watermark past them."""
    end = df.agg(F.timestamp_micros(F.unix_micros(F.max(at)) + 10 * 86_400_000_000).alias(at))
    return end.select(*[F.col(c) if c == at else F.lit("closing" if c == key else None).cast(t).alias(c) for c, t in df.dtypes])


@query("coverage_stream", f"WITH {_MINUTES} SELECT * FROM coverage")
def coverage_stream(spark, sf_dir):
    """Coverage of each minute, from intervals that a stream emitted in two runs."""
    base = shared_dir(spark, "covered")
    hb = heartbeats(spark, sf_dir)
    half = F.col("heartbeat_at") > _middle(spark, sf_dir)
    for part in (hb.where(~half), hb.where(half).unionByName(_closing(hb, "session_id", "heartbeat_at"))):
        part.write.mode("append").parquet(f"{base}/heartbeats")
        stream = spark.readStream.schema(hb.schema).parquet(f"{base}/heartbeats")
        options = {"delay": "1 minute", "max_spacing_s": SPACING_S, "span_s": 86_400}
        spans.write_covered(stream, f"{base}/intervals", f"{base}/mark", **options).awaitTermination()
    return cov.minutes_of(spark.read.parquet(f"{base}/intervals").where("NOT late"), hb)


@query(
    "report_asof_stream",
    f"""WITH {_ASOF},
near AS (SELECT *, coalesce(epoch_us(reported_at) // 1000000 - epoch_us(measured_last_seen_at) // 1000000 <= {_LOOK_BACK_S}, false) AS is_near FROM seen)
SELECT report_id, reported_at, reporter_id, vehicle_id, category, note, CASE WHEN is_near THEN mode END AS mode, CASE WHEN is_near THEN route END AS route,
  CASE WHEN is_near THEN direction END AS direction, CASE WHEN is_near THEN measured_lateness_s END AS measured_lateness_s,
  CASE WHEN is_near THEN measured_last_seen_at END AS measured_last_seen_at, CASE WHEN is_near THEN lat END AS lat, CASE WHEN is_near THEN long END AS long,
  coalesce(rejected, CASE WHEN NOT is_near THEN 'That vehicle is no longer on the map.' END) AS rejected, false AS late
FROM near""",
)
def report_asof_stream(spark, sf_dir):
    """Reports and positions as two streams, in two runs; a report waits for the positions of its time."""
    base = shared_dir(spark, "asof")
    middle = _middle(spark, sf_dir)
    sources = {"reports": (cleaned(spark, sf_dir), "reported_at"), "positions": (positions(spark, sf_dir), "last_seen_at")}
    for second in (False, True):
        streams = {}
        for name, (df, at) in sources.items():
            part = df.where((F.col(at) > middle) == F.lit(second))
            part = part.unionByName(_closing(df, "vehicle_id", at)) if second else part
            part.write.mode("append").parquet(f"{base}/{name}")
            streams[name] = spark.readStream.schema(df.schema).parquet(f"{base}/{name}")
        options = {"delay": "1 minute", "look_back_s": _LOOK_BACK_S, "span_s": _LOOK_BACK_S}
        spans.write_snapshots(streams["reports"], streams["positions"], f"{base}/matched", f"{base}/mark", **options).awaitTermination()
    return spark.read.parquet(f"{base}/matched").where(~F.col("vehicle_id").eqNullSafe("closing")).drop("report_date")
