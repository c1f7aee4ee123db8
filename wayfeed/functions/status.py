"""Lateness bands, the On-time predicate, freshness and the natural route order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import instant, whole_seconds

# Default On-time window and the thresholds of bands and freshness, in seconds.
ON_TIME_EARLY_S = -60
ON_TIME_LATE_S = 180
VERY_LATE_S = 600
FRESH_S = 30
HIDDEN_S = 300
NO_DIGITS_ORDER = 1_000_000


def on_time(lateness: Column, early_s: int = ON_TIME_EARLY_S, late_s: int = ON_TIME_LATE_S) -> Column:
    """Inside the On-time window, bounds included; unknown Lateness is never on time."""
    return F.coalesce(lateness.between(early_s, late_s), F.lit(False))


def lateness_band(lateness: Column) -> Column:
    return (
        F.when(lateness.isNull(), "unknown")
        .when(lateness < ON_TIME_EARLY_S, "early")
        .when(lateness <= ON_TIME_LATE_S, "on_time")
        .when(lateness <= VERY_LATE_S, "late")
        .otherwise("very_late")
    )


def lateness_text(lateness: Column) -> Column:
    """The band as riders read it."""
    return F.replace(
        F.when(lateness.isNull(), F.lit("lateness not published")).otherwise(
            F.replace(lateness_band(lateness), F.lit("on_time"), F.lit("on-time"))
        ),
        F.lit("_"),
        F.lit(" "),
    )


def age_s(last_seen: Column, as_of) -> Column:
    """Whole seconds since ``last_seen``."""
    return whole_seconds(last_seen, instant(as_of))


def age_fraction_s(last_seen: Column, as_of) -> Column:
    """Seconds since ``last_seen`` with their fraction."""
    return (F.unix_micros(instant(as_of)) - F.unix_micros(last_seen)) / F.lit(1e6)


def freshness(age: Column) -> Column:
    return F.when(age <= FRESH_S, "fresh").when(age <= HIDDEN_S, "fading").otherwise("hidden")


def route_number(route: Column) -> Column:
    """All digits of a route name as one number; names without digits come last."""
    digits = F.nullif(F.regexp_replace(route, "[^0-9]", ""), F.lit(""))
    return F.coalesce(digits.try_cast("bigint"), F.lit(NO_DIGITS_ORDER).cast("bigint"))


def route_order(route: Column) -> list[Column]:
    """Sort keys of the natural order 1, 2, 4T, 10, 10H."""
    return [route_number(route), route]


def natural_route_list(routes: Column, sep: str = ", ") -> Column:
    """An array of route names, in natural order, joined into one text."""
    keyed = F.transform(routes, lambda r: F.struct(route_number(r).alias("n"), r.alias("r")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["r"]), sep)


def squash(text: Column) -> Column:
    """Trim white space of any kind; an empty text becomes NULL."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))
