"""Time: UTC instants, local time, Operating Day, viewer windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The service's zone and the start of its Operating Day (04:30 local).
SERVICE_TZ = "Europe/Helsinki"
DAY_START_MINUTES = 270
WINDOWS = ("last_hour", "operating_day")


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC; every operator reads timestamps as UTC instants."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def instant(value) -> Column:
    """A timestamp column from a datetime, an ISO string or a Column (e.g. a scalar subquery)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.UTC).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp")


def seconds(n: int | float) -> Column:
    """A day-time interval of ``n`` seconds."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))


def local_time(ts: Column, tz: str = SERVICE_TZ) -> Column:
    return F.from_utc_timestamp(ts, tz)


def operating_day(ts: Column, tz: str = SERVICE_TZ) -> Column:
    """The local date; before 04:30 local the instant belongs to the day before."""
    return F.to_date(local_time(ts, tz) - F.expr(f"INTERVAL {DAY_START_MINUTES} MINUTES"))


def operating_day_start(day: Column, tz: str = SERVICE_TZ) -> Column:
    """04:30 local of ``day`` as a UTC instant (right on DST days too)."""
    local = day.cast("timestamp") + F.expr(f"INTERVAL {DAY_START_MINUTES} MINUTES")
    return F.to_utc_timestamp(local, tz)


def whole_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end, truncated to whole seconds."""
    return F.timestamp_diff("SECOND", start, end)


def on_days(df: DataFrame, column: str, since: Column, until: Column | None = None) -> DataFrame:
    """Add the day predicate that prunes date partitions to a filter on instants, where the column exists.

    A column of UTC dates is exact.  ``operating_day`` gets a day of slack on
    both sides, because a late journey keeps the day that it started on.
    """
    if column not in df.columns:
        return df
    if column == "operating_day":
        low, high = F.date_sub(operating_day(since), 1), None if until is None else F.date_add(operating_day(until), 1)
    else:
        low, high = F.to_date(since), None if until is None else F.to_date(until)
    kept = df.where(F.col(column) >= low)
    return kept if high is None else kept.where(F.col(column) <= high)


def window_bounds(window: str, as_of) -> tuple[Column, Column]:
    """(since, until) of a viewer window."""
    now = instant(as_of)
    if window == "last_hour":
        return now - F.expr("INTERVAL 1 HOUR"), now
    if window == "operating_day":
        return operating_day_start(operating_day(now)), now
    raise ValueError(f"unknown window {window!r}, expected one of {WINDOWS}")


def window_filter(df: DataFrame, window: str, as_of, ts: str = "departed_at", day: str = "operating_day") -> DataFrame:
    """Rows of a viewer window.

    ``operating_day`` filters on the day column (a partition column of the
    departures table), which keeps journeys after midnight together.
    """
    since, until = window_bounds(window, as_of)
    if window == "last_hour":
        return on_days(df.where((F.col(ts) >= since) & (F.col(ts) < until)), day, since, until)
    return df.where((F.col(day) == operating_day(instant(as_of))) & (F.col(ts) < until))
