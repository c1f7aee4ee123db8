"""Per-user lists of watched routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import instant
from ..functions.status import squash


def reconcile_watchlist(saved: DataFrame, requested: DataFrame, as_of, users: DataFrame | None = None) -> DataFrame:
    """New watchlists: the requested set replaces a user's saved set.

    ``saved(user_id, route, added_at)``, ``requested(user_id, route)``.  Kept
    routes keep their added_at, new ones get ``as_of``.  Users who sent no
    request keep their list; ``users(user_id)`` names those who did (needed for
    a request that empties a list), default: users with a requested row.
    """
    asked = requested.select("user_id", squash(F.col("route")).alias("route")).where(F.col("route").isNotNull())
    asked = asked.distinct()
    changing = (requested if users is None else users).select("user_id").distinct()
    key = ["user_id", "route"]
    untouched = saved.join(changing, "user_id", "left_anti")
    kept = saved.join(asked, key, "left_semi").join(changing, "user_id", "left_semi")
    added = asked.join(saved, key, "left_anti").withColumn("added_at", instant(as_of))
    columns = ["user_id", "route", "added_at"]
    return untouched.select(columns).unionByName(kept.select(columns)).unionByName(added.select(columns))
