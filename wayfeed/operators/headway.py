"""Headway between consecutive departures at a stop, and Bunching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import instant, on_days, seconds, whole_seconds
from ..functions.status import natural_route_list, route_order
from .ordered import join_null_safe, with_neighbour_instant, with_previous, with_previous_instant_within

# A planned gap beyond an hour is missing data, not a plan; the default Bunching share.
MAX_PLANNED_GAP_S = 3600
BUNCHING_SHARE = 0.25
LOOK_BACK_S = 3600

PLACE = ["route", "direction", "stop_id"]
HOUR_SPAN_S = 3600


def _gap(before: Column, max_gap_s: int) -> Column:
    gap = whole_seconds(before, F.col("scheduled_departure"))
    return F.when((gap > 0) & (gap <= max_gap_s), gap)


def scheduled_gaps(dep: DataFrame, max_gap_s: int = MAX_PLANNED_GAP_S, span_s: int = HOUR_SPAN_S) -> DataFrame:
    """Seconds to the scheduled departure before, per route, direction and stop.

    Gaps of zero or more than ``max_gap_s`` become NULL.  A departure without a
    scheduled time stays with a NULL gap and is no one's predecessor.
    """
    scheduled = dep.where(F.col("scheduled_departure").isNotNull())
    tie = [c for c in ("departed_at", "vehicle_id", "journey_id") if c in dep.columns]
    ahead = with_neighbour_instant(scheduled, PLACE, "scheduled_departure", "__before", span_s, tie=tie)
    found = ahead.withColumn("scheduled_gap_s", _gap(F.col("__before"), max_gap_s)).drop("__before")
    kind = found.schema["scheduled_gap_s"].dataType
    none = dep.where(F.col("scheduled_departure").isNull()).withColumn("scheduled_gap_s", F.lit(None).cast(kind))
    return found.unionByName(none)


def planned_headway(
    dep: DataFrame, max_gap_s: int = MAX_PLANNED_GAP_S, span_s: int = HOUR_SPAN_S, per: str = "hour"
) -> DataFrame:
    """Median scheduled gap per route, direction, stop and hour of the scheduled departure.

    Departures scheduled at the same instant have a gap of zero, which is none,
    but for the first of them; so each instant of a place is ordered once.
    """
    instants = dep.where(F.col("scheduled_departure").isNotNull()).select(*PLACE, "scheduled_departure").distinct()
    ahead = with_previous_instant_within(instants, PLACE, "scheduled_departure", "__before", max_gap_s, span_s)
    gaps = ahead.withColumn("scheduled_gap_s", _gap(F.col("__before"), max_gap_s)).where(F.col("scheduled_gap_s").isNotNull())
    return (
        gaps.groupBy(*PLACE, F.date_trunc(per, "scheduled_departure").alias("planned_hour"))
        .agg(F.percentile_approx("scheduled_gap_s", 0.5).cast("int").alias("planned_headway_s"))
        .where(F.col("planned_headway_s").isNotNull())
    )


def bunching_pairs(
    dep: DataFrame,
    since,
    until,
    max_share: float | None = BUNCHING_SHARE,
    max_gap_s: int = MAX_PLANNED_GAP_S,
    look_back_s: int = LOOK_BACK_S,
    span_s: int = HOUR_SPAN_S,
    per: str = "hour",
) -> DataFrame:
    """Each departure in [since, until) with the departure just before it at the same stop.

    The input is cut to the window plus a look-back before any window runs;
    pass departures partitioned by operating_day and the cut prunes them.  A
    neighbour of the same vehicle or journey makes no pair, and the one before
    it is not tried.
    """
    share = BUNCHING_SHARE if max_share is None else max_share
    start, end = instant(since), instant(until)
    at = F.col("departed_at")
    d = on_days(dep.where((at >= start - seconds(look_back_s)) & (at < end)), "operating_day", start - seconds(look_back_s), end).select(
        *PLACE,
        "stop_name",
        "stop_lat",
        "stop_long",
        "vehicle_id",
        "journey_id",
        "departed_at",
        "scheduled_departure",
        "lateness_s",
    )
    paired = with_previous(
        d,
        PLACE,
        "departed_at",
        {
            "leader_vehicle_id": "vehicle_id",
            "leader_journey_id": "journey_id",
            "leader_departed_at": "departed_at",
            "leader_lateness_s": "lateness_s",
        },
        span_s,
        tie=["vehicle_id", "journey_id"],
    ).where(
        (F.col("leader_vehicle_id") != F.col("vehicle_id"))
        & (F.col("leader_journey_id") != F.col("journey_id"))
        & (F.col("departed_at") >= start)
    )
    # One row per place and hour: small parts to hash, so the pairs need no sort by place and hour.
    planned = planned_headway(d, max_gap_s, span_s, per).hint("shuffle_hash")
    matched = join_null_safe(
        paired.withColumn("planned_hour", F.date_trunc(per, "scheduled_departure")), planned, [*PLACE, "planned_hour"]
    )
    headway = whole_seconds(F.col("leader_departed_at"), F.col("departed_at")).cast("int")
    plan = F.col("planned_headway_s")
    return matched.select(
        *PLACE,
        "stop_name",
        "stop_lat",
        "stop_long",
        "leader_vehicle_id",
        F.col("vehicle_id").alias("follower_vehicle_id"),
        "leader_departed_at",
        F.col("departed_at").alias("follower_departed_at"),
        headway.alias("headway_s"),
        F.nullif(plan, F.lit(0)).alias("scheduled_headway_s"),
        "leader_lateness_s",
        F.col("lateness_s").alias("follower_lateness_s"),
        F.coalesce((plan > 0) & (headway < F.lit(share) * plan), F.lit(False)).alias("bunching"),
    )


NOW_COLUMNS = [
    "route",
    "direction",
    "stop_name",
    "leader_vehicle_id",
    "follower_vehicle_id",
    "headway_s",
    "scheduled_headway_s",
    "leader_lateness_s",
    "follower_lateness_s",
    "follower_departed_at",
    "age_s",
]


def bunching_now(
    dep: DataFrame,
    live: DataFrame,
    as_of,
    route: str | None = None,
    within_s: int = 300,
    **pair_options,
) -> DataFrame:
    """Bunched pairs of the last minutes, each at its latest stop; always at least one row.

    ``live`` is the one-row result of ``feed_live``: without pairs, its flag
    tells "no Bunching" from "unknown".
    """
    now = instant(as_of)
    is_live = live.select("feed_live").scalar()
    pairs = bunching_pairs(dep, now - seconds(within_s), now, **pair_options).where("bunching")
    wanted = (route or "").strip()
    if wanted:
        pairs = pairs.where(F.col("route") == wanted)
    pair_key = ["route", "direction", "leader_vehicle_id", "follower_vehicle_id"]
    detail = ["stop_name", "headway_s", "scheduled_headway_s", "leader_lateness_s", "follower_lateness_s"]
    latest = (
        pairs.groupBy(*pair_key)
        .agg(F.max(F.struct("follower_departed_at", "stop_id", *detail)).alias("at"))
        .select(*pair_key, "at.follower_departed_at", *[f"at.{c}" for c in detail])
        .withColumn("age_s", whole_seconds(F.col("follower_departed_at"), now))
        .select(*NOW_COLUMNS)
    )
    types = dict(latest.dtypes)
    none = live.where(latest.agg(F.count(F.lit(1))).scalar() == 0).select(
        *[F.lit(None).cast(types[c]).alias(c) for c in NOW_COLUMNS]
    )
    return latest.unionByName(none).select(is_live.alias("feed_live"), *NOW_COLUMNS).orderBy("headway_s")


def bunching_by_route(pairs: DataFrame) -> DataFrame:
    """Judged and bunched departures per route and direction, and the pairs behind them.

    One pass counts rows by headway, which leaves few, and by pair, which is
    shuffled by pair; a route and direction then adds up counts only.
    """
    line, pair = ["route", "direction"], ["leader_vehicle_id", "follower_vehicle_id"]
    judged = pairs.where(
        F.col("scheduled_headway_s").isNotNull() & F.col("route").isNotNull() & F.col("direction").isNotNull()
    )
    b = F.col("bunching")
    rows = judged.select(*line, "bunching", *[F.when(b, F.col(c)).alias(c) for c in ("headway_s", *pair)])
    counts = (
        rows.groupingSets([[*line, "bunching", "headway_s"], [*line, "bunching", *pair]], *line, "bunching", "headway_s", *pair)
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("headway_s").alias("is_pair"))
        .groupBy(*line, "bunching", "headway_s", "is_pair")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different"))
    )
    row, pair_row = F.col("is_pair") == 0, F.col("is_pair") == 1
    bunched = F.sum(F.when(row & b, F.col("n")).otherwise(0))
    return (
        counts.groupBy(*line)
        .agg(
            F.sum(F.when(row, F.col("n"))).alias("departures"),
            bunched.alias("bunched_departures"),
            (bunched / F.sum(F.when(row, F.col("n")))).alias("share"),
            F.sum(F.when(pair_row & b, F.col("different")).otherwise(0)).alias("tram_pairs"),
            F.percentile(F.when(row & b, F.col("headway_s")), 0.5, F.col("n")).cast("int").alias("median_headway_s"),
        )
        .orderBy(F.desc("bunched_departures"), *route_order(F.col("route")), "direction")
    )


def bunching_totals(by_route: DataFrame) -> DataFrame:
    """Sums over the per-route table."""
    return by_route.agg(
        F.sum("departures").alias("departures"),
        F.sum("bunched_departures").alias("bunched_departures"),
        (F.sum("bunched_departures") / F.sum("departures")).alias("share"),
        F.sum("tram_pairs").alias("tram_pairs"),
    )


def bunching_by_stop(pairs: DataFrame) -> DataFrame:
    """Stops with Bunching: how often and on which routes; stops with an unknown field are left out."""
    place = ["stop_id", "stop_name", "stop_lat", "stop_long"]
    rows = pairs.where("bunching").dropna(subset=place)
    return (
        rows.groupBy(*place)
        .agg(F.count(F.lit(1)).alias("bunching"), natural_route_list(F.collect_set("route")).alias("routes"))
        .withColumnsRenamed({"stop_lat": "lat", "stop_long": "long"})
        .orderBy(F.desc("bunching"), "stop_id")
    )


def pair_lines(pairs: DataFrame, fleet: DataFrame) -> DataFrame:
    """From leader to follower at their current positions; both must be on the map."""
    at = fleet.select("vehicle_id", "lat", "long")
    lead = at.withColumnsRenamed({"vehicle_id": "leader_vehicle_id", "lat": "from_lat", "long": "from_long"})
    follow = at.withColumnsRenamed({"vehicle_id": "follower_vehicle_id", "lat": "to_lat", "long": "to_long"})
    return (
        pairs.select("route", "leader_vehicle_id", "follower_vehicle_id", "headway_s")
        .join(lead, "leader_vehicle_id")
        .join(follow, "follower_vehicle_id")
        .select(
            "route",
            "leader_vehicle_id",
            "follower_vehicle_id",
            "headway_s",
            "from_long",
            "from_lat",
            "to_long",
            "to_lat",
        )
    )
