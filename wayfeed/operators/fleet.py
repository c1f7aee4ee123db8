"""The current fleet: latest state, live view, map figures, watchlist summary, lookups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import instant, local_time, seconds
from ..functions.status import (
    FRESH_S,
    HIDDEN_S,
    age_fraction_s,
    age_s,
    freshness,
    lateness_band,
    lateness_text,
    route_order,
)
from ..schemas import CURRENT_COLUMNS


def latest_by_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The newest row per key.  The whole row breaks ties, so input order never matters.

    A max over structs is combined on the map side: one row per key and task is
    shuffled, however many events a key has.  As a streaming aggregate it is
    the same operator with its state kept by the state store.
    """
    rest = [c for c in df.columns if c not in keys and c != seq]
    newest = df.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("newest"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"newest.{c}").alias(c) for c in df.columns])


def current_columns(positions: DataFrame) -> DataFrame:
    return positions.withColumn("last_seen_at", F.col("tst")).select(*CURRENT_COLUMNS)


def vehicle_current(positions: DataFrame) -> DataFrame:
    """Latest Position Event per vehicle; an older event never replaces a newer one."""
    return latest_by_key(current_columns(positions), ["vehicle_id"], "last_seen_at")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Row changes from one snapshot to the next, as change-feed rows.

    An update gives two rows, its pre- and post-image; unchanged rows give none.
    """
    values = [c for c in after.columns if c not in keys]
    old = before.select(*keys, F.struct(*values).alias("__old"))
    new = after.select(*keys, F.struct(*values).alias("__new"))
    both = old.join(new, keys, "full_outer").where(~F.col("__old").eqNullSafe(F.col("__new")))

    def change(kind: str, image: str) -> Column:
        return F.struct(F.lit(kind).alias("_change_type"), F.col(image).alias("image"))

    changes = (
        F.when(F.col("__old").isNull(), F.array(change("insert", "__new")))
        .when(F.col("__new").isNull(), F.array(change("delete", "__old")))
        .otherwise(F.array(change("update_preimage", "__old"), change("update_postimage", "__new")))
    )
    return both.select(*keys, F.inline(changes)).select(
        *keys, *[F.col(f"image.{c}").alias(c) for c in values], "_change_type"
    )


def cdc_inserts(history: DataFrame, change_type: str = "_change_type") -> DataFrame:
    """Rows of an insert-only table from its change history."""
    return history.where(F.col(change_type) == "insert").drop(change_type)


def vehicle_freshness(current: DataFrame, as_of) -> DataFrame:
    """Age in whole seconds and its freshness class."""
    age = age_s(F.col("last_seen_at"), as_of)
    return current.withColumn("age_s", age).withColumn("freshness", freshness(F.col("age_s")))


def route_set(routes: str | None) -> list[str]:
    """Route names of a comma list, trimmed, blanks out."""
    return sorted({r.strip() for r in (routes or "").split(",") if r.strip()})


def live_fleet(
    current: DataFrame,
    as_of,
    modes: Iterable[str] | None = None,
    routes: str | None = None,
    watched: DataFrame | None = None,
    hidden_s: int = HIDDEN_S,
) -> DataFrame:
    """Vehicles seen within ``hidden_s`` seconds, with age, band and freshness.

    ``routes`` is a comma list; ``watched`` (a column ``route``) narrows it to
    the viewer's own routes.
    """
    now = instant(as_of)
    rows = current.where(F.col("last_seen_at") > now - seconds(hidden_s))
    if modes is not None:
        rows = rows.where(F.col("mode").isin(list(modes)))
    wanted = route_set(routes)
    if wanted:
        rows = rows.where(F.col("route").isin(wanted))
    if watched is not None:
        rows = rows.join(watched.select("route").distinct(), "route", "left_semi")
    age = age_fraction_s(F.col("last_seen_at"), now)
    return rows.withColumns(
        {
            "age_s": age,
            "band": lateness_band(F.col("lateness_s")),
            "freshness": freshness(age),
        }
    )


def fleet_kpis(fleet: DataFrame) -> DataFrame:
    """Vehicles on the map, how many are fresh, age of the newest."""
    return fleet.agg(
        F.count(F.lit(1)).alias("vehicles"),
        F.count_if(F.col("age_s") <= FRESH_S).alias("fresh"),
        F.min("age_s").alias("newest_age_s"),
    )


def route_lateness(current: DataFrame, route: str, as_of) -> DataFrame:
    """Current Lateness of each vehicle of a route; rows too old to be live are kept and say so."""
    rows = current.where(F.col("route") == route.strip()).select(
        "vehicle_id", "mode", "route", "direction", "journey_id", "lateness_s", "last_seen_at"
    )
    return vehicle_freshness(rows, as_of).orderBy("direction", F.desc("last_seen_at"), "vehicle_id")


def route_status_now(current: DataFrame, as_of, mode: str = "tram", route: str | None = None, within_s: int = 300):
    """Band in words, local time and age of the vehicles seen in the last minutes."""
    now = instant(as_of)
    rows = current.where((F.col("mode") == mode) & (F.col("last_seen_at") > now - seconds(within_s)))
    if route is not None:
        rows = rows.where(F.col("route") == route)
    return rows.select(
        "route",
        "direction",
        "vehicle_id",
        "lateness_s",
        lateness_text(F.col("lateness_s")).alias("status"),
        local_time(F.col("last_seen_at")).alias("last_seen_local"),
        age_s(F.col("last_seen_at"), now).alias("seconds_since_last_seen"),
    ).orderBy("direction", F.desc_nulls_last("lateness_s"))


def watch_summary(watched: DataFrame, fleet: DataFrame, reports: DataFrame) -> DataFrame:
    """Per watched route: vehicles on the map, worst known Lateness, recent reports.

    ``watched`` may carry a user column next to ``route``; both other sides are
    aggregated to one row per route before the join.
    """
    on_map = fleet.groupBy("route").agg(
        F.count(F.lit(1)).alias("vehicles"), F.max("lateness_s").alias("worst_lateness_s")
    )
    said = reports.groupBy("route").agg(F.count(F.lit(1)).alias("reports"))
    return (
        watched.join(on_map, "route", "left")
        .join(said, "route", "left")
        .withColumns(
            {
                "vehicles": F.coalesce("vehicles", F.lit(0)),
                "reports": F.coalesce("reports", F.lit(0)),
            }
        )
    )


def lookup_lists(current: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Picker lists as (list, value): routes seen, tram routes, tram stop names."""

    def named(name: str, values: DataFrame) -> DataFrame:
        return values.select(F.lit(name).alias("list"), F.col(values.columns[0]).alias("value")).distinct()

    return (
        named("known_routes", current.select("route"))
        .unionByName(named("tram_routes", routes.where(F.col("mode") == "tram").select("route")))
        .unionByName(named("tram_stops", stops.where(F.col("main_vehicle_type") == 0).select("stop_name")))
        .orderBy("list", *route_order(F.col("value")))
    )


def route_options(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Routes a viewer can pick: known now or saved before, in natural order."""
    both = current.select("route").union(saved.select("route")).distinct()
    return both.orderBy(*route_order(F.col("route")))
