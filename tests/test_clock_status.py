import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayfeed.functions import clock, status


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "instant, day",
    [
        ("2026-10-03 01:00:00", dt.date(2026, 10, 2)),  # 04:00 local, still the day before
        ("2026-10-03 01:29:59", dt.date(2026, 10, 2)),
        ("2026-10-03 01:30:00", dt.date(2026, 10, 3)),
        ("2026-10-03 02:00:00", dt.date(2026, 10, 3)),
        ("2026-01-15 02:29:59", dt.date(2026, 1, 14)),  # winter: UTC+2
        ("2026-01-15 02:30:00", dt.date(2026, 1, 15)),
    ],
)
def test_operating_day(spark, instant, day):
    assert one(spark, clock.operating_day(clock.instant(instant))) == day


def test_instant_takes_zoned_datetimes(spark, utc):
    helsinki = utc("2026-10-03 16:00:00").astimezone(dt.timezone(dt.timedelta(hours=3)))
    same = one(spark, clock.instant(helsinki) == clock.instant("2026-10-03 16:00:00"))
    assert same


def test_operating_day_window_starts_at_0430_local(spark):
    since, _ = clock.window_bounds("operating_day", "2026-10-03 16:00:00")
    assert one(spark, since.cast("string")) == "2026-10-03 01:30:00"


def test_operating_day_start_on_clock_change_days(spark):
    # Clocks go forward on 2026-03-29 and back on 2026-10-25, both before 04:30.
    assert one(spark, clock.operating_day_start(F.lit("2026-03-29").cast("date")).cast("string")) == "2026-03-29 01:30:00"
    assert one(spark, clock.operating_day_start(F.lit("2026-10-25").cast("date")).cast("string")) == "2026-10-25 02:30:00"


def test_unknown_window_is_an_error(spark):
    with pytest.raises(ValueError):
        clock.window_bounds("week", "2026-10-03 16:00:00")


def test_windows_select_rows(spark):
    df = spark.sql("""SELECT timestamp(a) AS departed_at, date(b) AS operating_day FROM VALUES
        ('2026-10-03 15:00:00', '2026-10-03'), ('2026-10-03 16:00:00', '2026-10-03'),
        ('2026-10-03 14:59:59', '2026-10-03'), ('2026-10-03 15:30:00', '2026-10-02') AS t(a, b)""")
    now = "2026-10-03 16:00:00"
    hour = {str(r[0]) for r in clock.window_filter(df, "last_hour", now).select("departed_at").collect()}
    day = {str(r[0]) for r in clock.window_filter(df, "operating_day", now).select("departed_at").collect()}
    assert hour == {"2026-10-03 15:00:00", "2026-10-03 15:30:00"}
    assert day == {"2026-10-03 15:00:00", "2026-10-03 14:59:59"}


@pytest.mark.parametrize(
    "lateness, band",
    [(None, "unknown"), (-61, "early"), (-60, "on_time"), (0, "on_time"), (180, "on_time"), (181, "late"), (600, "late"), (601, "very_late")],
)
def test_bands_at_their_edges(spark, lateness, band):
    value = F.lit(lateness).cast("int")
    assert one(spark, status.lateness_band(value)) == band
    assert one(spark, status.on_time(value)) == (band == "on_time")


def test_freshness_edges(spark):
    found = [one(spark, status.freshness(F.lit(a))) for a in (30, 31, 300, 301)]
    assert found == ["fresh", "fading", "fading", "hidden"]


def test_natural_route_order(spark):
    df = spark.createDataFrame([(r,) for r in ("10", "4T", "2", "10H", "1", "X")], "route string")
    assert [r[0] for r in df.orderBy(*status.route_order(F.col("route"))).collect()] == ["1", "2", "4T", "10", "10H", "X"]
