"""Rider Reports over V1: every event is a report about its vehicle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as r
from .registry import query
from .views import SQL_NOW, SQL_POSITIONS, last_instant, positions, text, transit

LABELS = ("late", "early", "crowded", "skipped_stop", "breakdown", "other", "bogus")
_CATEGORY = "[" + ", ".join(f"'{c}'" for c in LABELS) + "][k % 7 + 1]"
# Limits scaled to reports that are hours apart.
LIMITS = {"limit": 2, "window_s": 12 * 3600, "vehicle_window_s": 6 * 3600}


def raw_reports(spark, sf_dir):
    """The reporter writes about a vehicle 30 seconds after the event, which may be another event's vehicle."""
    names = F.array(*[F.lit(c) for c in LABELS])
    user, k = F.col("user_id"), F.col("k")
    note = (
        F.when(k % 4 == 0, "   ")
        .when(k % 4 == 1, F.concat(F.lit("  late again "), text(k), F.lit(" ")))
        .when(k % 4 == 2, F.repeat(F.lit("abcdefg "), 60))
    )
    return transit(spark, sf_dir).select(
        F.col("event_id").alias("report_id"),
        F.timestamp_micros(F.unix_micros("at") + 30_000_000).alias("reported_at"),
        F.concat(
            F.when(k % 2 == 0, " U").otherwise("u"), text(user % 50), F.lit("@x.org"), F.when(k % 3 == 0, " ").otherwise("")
        ).alias("email"),
        F.concat(F.lit("40/"), text(F.when(k == 13, user + 100_000).otherwise((user * 7 + k % 3) % 150))).alias("vehicle_id"),
        F.element_at(names, k % 7 + 1).alias("category"),
        note.alias("note"),
    )


_RAW = f"""
raw AS (
  SELECT event_id AS report_id, "at" + INTERVAL 30 SECOND AS reported_at,
         sha256('u' || CAST(user_id % 50 AS VARCHAR) || '@x.org') AS reporter_id,
         '40/' || CAST(CASE WHEN k = 13 THEN user_id + 100000 ELSE (user_id * 7 + k % 3) % 150 END AS VARCHAR) AS vehicle_id,
         {_CATEGORY} AS category,
         CASE k % 4 WHEN 1 THEN 'late again ' || CAST(k AS VARCHAR) WHEN 2 THEN left(repeat('abcdefg ', 60), 280) END AS note,
         CASE WHEN k % 7 = 6 THEN 'Unknown category bogus.' END AS rejected
  FROM transit
)"""
_ASOF = f"""{SQL_POSITIONS}, {_RAW},
seen AS (
  SELECT r.report_id, r.reported_at, r.reporter_id, r.vehicle_id, r.category, r.note, p.mode, p.route, p.direction,
         p.lateness_s AS measured_lateness_s, p.last_seen_at AS measured_last_seen_at, p.lat, p.long,
         coalesce(r.rejected, CASE WHEN p.vehicle_id IS NULL THEN 'That vehicle is no longer on the map.' END) AS rejected
  FROM raw r ASOF LEFT JOIN positions p ON r.vehicle_id = p.vehicle_id AND r.reported_at >= p.last_seen_at
)"""


def cleaned(spark, sf_dir):
    return r.clean_reports(raw_reports(spark, sf_dir))


def snapshots(spark, sf_dir):
    return r.snapshot_reports(cleaned(spark, sf_dir), positions(spark, sf_dir), span_s=3 * 86_400)


@query("report_clean", f"WITH {SQL_POSITIONS}, {_RAW} SELECT * FROM raw")
def report_clean(spark, sf_dir):
    return cleaned(spark, sf_dir)


@query("report_asof", f"WITH {_ASOF} SELECT * FROM seen")
def report_asof(spark, sf_dir):
    return snapshots(spark, sf_dir)


@query(
    "reports_vs_measured",
    f"""WITH {_ASOF}
SELECT category, count(*) AS reports, round(avg(measured_lateness_s)) AS avg_measured_lateness_s,
       count(*) FILTER (WHERE measured_lateness_s BETWEEN -60 AND 180) AS measured_on_time,
       count(*) FILTER (WHERE measured_lateness_s > 180) AS measured_late,
       count(*) FILTER (WHERE measured_lateness_s IS NULL) AS lateness_not_published
FROM seen WHERE rejected IS NULL GROUP BY 1""",
)
def reports_vs_measured(spark, sf_dir):
    return r.reports_vs_measured(snapshots(spark, sf_dir).where(F.col("rejected").isNull()))


@query(
    "recent_reports",
    f"""WITH {_ASOF}
SELECT report_id, reported_at, vehicle_id, category, measured_lateness_s,
       (epoch_us({SQL_NOW}) - epoch_us(reported_at)) / 1000000 AS age_s
FROM seen WHERE rejected IS NULL AND reported_at > {SQL_NOW} - INTERVAL 2 DAY
ORDER BY reported_at DESC, report_id DESC LIMIT 200""",
)
def recent_reports(spark, sf_dir):
    stored = snapshots(spark, sf_dir).where(F.col("rejected").isNull())
    columns = ["report_id", "reported_at", "vehicle_id", "category", "measured_lateness_s"]
    return r.recent_reports(stored.select(*columns), last_instant(spark, sf_dir), within_s=2 * 86_400)


# The rule step by step: the n-th report of every reporter per iteration, with the accepted ones carried in lists.
_US = 1_000_000
_RATE = f"""
ordered AS (
  SELECT report_id, reporter_id, vehicle_id, epoch_us(reported_at) AS t, reported_at,
         row_number() OVER (PARTITION BY reporter_id ORDER BY reported_at, report_id) AS n FROM judged_input
),
steps AS (
  SELECT reporter_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS report_id, CAST(NULL AS VARCHAR) AS verdict,
         CAST([] AS STRUCT(t BIGINT, v VARCHAR)[]) AS kept
  FROM (SELECT DISTINCT reporter_id FROM ordered)
  UNION ALL
  SELECT reporter_id, n, report_id, verdict,
         CASE WHEN verdict = 'accepted' THEN list_append(recent, {{'t': t, 'v': vehicle_id}}) ELSE recent END AS kept
  FROM (
    SELECT *, CASE WHEN len(list_filter(recent, lambda x: x.v = vehicle_id AND x.t > t - {LIMITS['vehicle_window_s'] * _US})) > 0
                     THEN 'vehicle_limit'
                   WHEN len(recent) >= {LIMITS['limit']} THEN 'hourly_limit' ELSE 'accepted' END AS verdict
    FROM (
      SELECT o.reporter_id, o.n, o.report_id, o.vehicle_id, o.t,
             list_filter(s.kept, lambda x: x.t > o.t - {LIMITS['window_s'] * _US}) AS recent
      FROM steps s JOIN ordered o ON o.reporter_id = s.reporter_id AND o.n = s.n + 1
    )
  )
)"""


@query(
    "report_rate_limit",
    f"""WITH RECURSIVE {SQL_POSITIONS}, {_RAW}, judged_input AS (SELECT * FROM raw), {_RATE}
SELECT o.report_id, o.reporter_id, o.vehicle_id, o.reported_at, s.verdict,
       CASE s.verdict WHEN 'vehicle_limit' THEN 'You reported this vehicle in the last {LIMITS['vehicle_window_s'] // 60} minutes. Try again shortly.'
                      WHEN 'hourly_limit' THEN 'You''ve sent {LIMITS['limit']} reports in the last hour, the limit. Try again later.' END AS message
FROM steps s JOIN ordered o ON s.report_id = o.report_id""",
)
def report_rate_limit(spark, sf_dir):
    return r.rate_limit(cleaned(spark, sf_dir), **LIMITS)
