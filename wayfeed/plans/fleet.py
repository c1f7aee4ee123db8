"""Current state, live fleet, watchlists and reference loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import instant
from ..operators import fleet as f
from ..operators import reference as ref
from ..operators.watchlist import reconcile_watchlist
from ..sources.paths import shared_dir
from ..sources.tables import load_reference, read_reference_csv, read_version, retained
from .registry import query
from .views import (
    SQL_CURRENT,
    SQL_NOW,
    SQL_POSITIONS,
    SQL_REFERENCE,
    last_instant,
    load,
    positions,
    routes_of_regions,
    sql_diff_s,
    sql_local,
    stops_of_nations,
    text,
)

HALF_DAY = 43_200
_COLUMNS = "vehicle_id, mode, route, direction, journey_id, lat, long, heading, speed_ms, lateness_s, last_seen_at"


def current(spark, sf_dir):
    return f.latest_by_key(positions(spark, sf_dir), ["vehicle_id"], "last_seen_at")


@query("vehicle_current", f"WITH {SQL_CURRENT} SELECT {_COLUMNS} FROM vehicle_current")
def vehicle_current(spark, sf_dir):
    return current(spark, sf_dir)


@query(
    "vehicle_current_shipments",
    """SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC) = 1""",
)
def vehicle_current_shipments(spark, sf_dir):
    columns = ["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    return f.latest_by_key(load(spark, sf_dir, "lineitem").select(*columns), ["l_suppkey"], "l_shipdate")


_CUT = "TIMESTAMP '2024-01-30 12:00:00'"


@query(
    "snapshot_diff",
    f"""WITH {SQL_POSITIONS},
b AS (
  SELECT {_COLUMNS} FROM positions WHERE last_seen_at < {_CUT} AND vehicle_id <> '40/7'
  QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY last_seen_at DESC) = 1
),
a AS (
  SELECT {_COLUMNS} FROM positions WHERE vehicle_id <> '40/8'
  QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY last_seen_at DESC) = 1
)
SELECT a.*, 'insert' AS _change_type FROM a WHERE vehicle_id NOT IN (SELECT vehicle_id FROM b)
UNION ALL SELECT b.*, 'delete' FROM b WHERE vehicle_id NOT IN (SELECT vehicle_id FROM a)
UNION ALL SELECT b.*, 'update_preimage' FROM b JOIN a USING (vehicle_id) WHERE b.last_seen_at <> a.last_seen_at
UNION ALL SELECT a.*, 'update_postimage' FROM b JOIN a USING (vehicle_id) WHERE b.last_seen_at <> a.last_seen_at""",
)
def snapshot_diff(spark, sf_dir):
    """From the state at noon of the last day to the final one; one vehicle comes, one goes."""
    p = positions(spark, sf_dir)
    seen, vehicle = F.col("last_seen_at"), F.col("vehicle_id")
    before = f.latest_by_key(p.where((seen < instant("2024-01-30 12:00:00")) & (vehicle != "40/7")), ["vehicle_id"], "last_seen_at")
    after = f.latest_by_key(p.where(vehicle != "40/8"), ["vehicle_id"], "last_seen_at")
    return f.snapshot_diff(before, after, ["vehicle_id"])


@query(
    "cdc_inserts",
    """SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view')""",
)
def cdc_inserts(spark, sf_dir):
    """Events as a change history in which clicks and views are the inserts."""
    kind = F.when(F.col("event_type").isin("click", "view"), "insert").otherwise("update_postimage")
    history = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", kind.alias("_change_type"))
    return f.cdc_inserts(history)


@query(
    "vehicle_freshness",
    f"""WITH {SQL_CURRENT}, aged AS (
  SELECT vehicle_id, last_seen_at, {sql_diff_s('last_seen_at', SQL_NOW)} AS age_s FROM vehicle_current)
SELECT *, CASE WHEN age_s <= 30 THEN 'fresh' WHEN age_s <= 300 THEN 'fading' ELSE 'hidden' END AS freshness FROM aged""",
)
def vehicle_freshness(spark, sf_dir):
    rows = current(spark, sf_dir).select("vehicle_id", "last_seen_at")
    return f.vehicle_freshness(rows, last_instant(spark, sf_dir))


_LIVE = f"""{SQL_CURRENT},
aged AS (
  SELECT {_COLUMNS}, (epoch_us({SQL_NOW}) - epoch_us(last_seen_at)) / 1000000 AS age_s FROM vehicle_current
  WHERE last_seen_at > {SQL_NOW} - INTERVAL {HALF_DAY} SECOND
),
live AS (
  SELECT *, CASE WHEN lateness_s IS NULL THEN 'unknown' WHEN lateness_s < -60 THEN 'early' WHEN lateness_s <= 180 THEN 'on_time'
            WHEN lateness_s <= 600 THEN 'late' ELSE 'very_late' END AS band,
         CASE WHEN age_s <= 30 THEN 'fresh' WHEN age_s <= 300 THEN 'fading' ELSE 'hidden' END AS freshness
  FROM aged
)"""


def live(spark, sf_dir, **options):
    return f.live_fleet(current(spark, sf_dir), last_instant(spark, sf_dir), hidden_s=HALF_DAY, **options)


@query("live_fleet", f"WITH {_LIVE} SELECT * FROM live")
def live_fleet(spark, sf_dir):
    return live(spark, sf_dir)


@query(
    "live_fleet_filtered",
    f"""WITH {_LIVE}, {SQL_REFERENCE}
SELECT * FROM live WHERE mode = 'tram' AND route IN ('4', '10', '1') AND route IN (SELECT route FROM routes WHERE mode = 'tram')""",
)
def live_fleet_filtered(spark, sf_dir):
    mine = routes_of_regions(spark, sf_dir).where(F.col("mode") == "tram")
    return live(spark, sf_dir, modes=["tram"], routes=" 4, 10 ,, 1", watched=mine)


@query(
    "fleet_kpis",
    f"""WITH {_LIVE}
SELECT count(*) AS vehicles, count(*) FILTER (WHERE age_s <= 30) AS fresh, min(age_s) AS newest_age_s FROM live""",
)
def fleet_kpis(spark, sf_dir):
    return f.fleet_kpis(live(spark, sf_dir))


@query(
    "route_lateness",
    f"""WITH {SQL_CURRENT}, aged AS (
  SELECT vehicle_id, mode, route, direction, journey_id, lateness_s, last_seen_at,
         {sql_diff_s('last_seen_at', SQL_NOW)} AS age_s FROM vehicle_current WHERE route = '4')
SELECT *, CASE WHEN age_s <= 30 THEN 'fresh' WHEN age_s <= 300 THEN 'fading' ELSE 'hidden' END AS freshness FROM aged""",
)
def route_lateness(spark, sf_dir):
    return f.route_lateness(current(spark, sf_dir), " 4 ", last_instant(spark, sf_dir))


@query(
    "route_status_now",
    f"""WITH {SQL_CURRENT}
SELECT route, direction, vehicle_id, lateness_s,
       CASE WHEN lateness_s IS NULL THEN 'lateness not published' WHEN lateness_s < -60 THEN 'early'
            WHEN lateness_s <= 180 THEN 'on-time' WHEN lateness_s <= 600 THEN 'late' ELSE 'very late' END AS status,
       {sql_local('last_seen_at')} AS last_seen_local, {sql_diff_s('last_seen_at', SQL_NOW)} AS seconds_since_last_seen
FROM vehicle_current WHERE mode = 'tram' AND last_seen_at > {SQL_NOW} - INTERVAL {HALF_DAY} SECOND""",
)
def route_status_now(spark, sf_dir):
    return f.route_status_now(current(spark, sf_dir), last_instant(spark, sf_dir), within_s=HALF_DAY)


_WATCHED = "SELECT DISTINCT CAST(user_id % 20 AS VARCHAR) AS user_id, route FROM transit UNION ALL SELECT 'x', 'none'"


@query(
    "watch_summary",
    f"""WITH {_LIVE}, watched AS ({_WATCHED}),
m AS (SELECT route, count(*) AS vehicles, max(lateness_s) AS worst_lateness_s FROM live GROUP BY 1),
r AS (SELECT route, count(*) AS reports FROM transit GROUP BY 1)
SELECT w.user_id, w.route, coalesce(vehicles, 0) AS vehicles, worst_lateness_s, coalesce(reports, 0) AS reports
FROM watched w LEFT JOIN m ON w.route = m.route LEFT JOIN r ON w.route = r.route""",
)
def watch_summary(spark, sf_dir):
    p = positions(spark, sf_dir)
    user = F.regexp_replace("vehicle_id", "^40/", "").cast("bigint") % 20
    watched = p.select(text(user).alias("user_id"), "route").distinct()
    nothing = p.agg(F.count(F.lit(1))).select(F.lit("x").alias("user_id"), F.lit("none").alias("route"))
    return f.watch_summary(watched.unionAll(nothing), live(spark, sf_dir), p)


@query(
    "lookup_lists",
    f"""WITH {SQL_CURRENT}, {SQL_REFERENCE}
SELECT DISTINCT 'known_routes' AS list, route AS "value" FROM vehicle_current
UNION ALL SELECT DISTINCT 'tram_routes', route FROM routes WHERE mode = 'tram'
UNION ALL SELECT DISTINCT 'tram_stops', stop_name FROM stops WHERE main_vehicle_type = 0""",
)
def lookup_lists(spark, sf_dir):
    return f.lookup_lists(current(spark, sf_dir), routes_of_regions(spark, sf_dir), stops_of_nations(spark, sf_dir))


@query(
    "route_options",
    f"""WITH {SQL_CURRENT}, {SQL_REFERENCE}
SELECT route FROM vehicle_current UNION SELECT route FROM routes""",
)
def route_options(spark, sf_dir):
    return f.route_options(current(spark, sf_dir), routes_of_regions(spark, sf_dir))


_RECONCILE = """
saved AS (
  SELECT o_custkey AS user_id, o_orderpriority AS route, min(o_orderdate) AS added_at FROM orders
  WHERE o_orderstatus <> 'P' GROUP BY 1, 2
),
sent AS (
  SELECT o_custkey AS user_id, CASE WHEN o_orderstatus = 'O' THEN '  ' || o_orderpriority || ' ' ELSE ' ' END AS route
  FROM orders WHERE o_orderstatus <> 'F'
),
asked AS (SELECT DISTINCT user_id, trim(route) AS route FROM sent WHERE trim(route) <> '')"""


@query(
    "watchlist_reconcile",
    f"""WITH {_RECONCILE}
SELECT * FROM saved WHERE user_id NOT IN (SELECT user_id FROM sent)
UNION ALL SELECT s.* FROM saved s JOIN asked a ON s.user_id = a.user_id AND s.route = a.route
UNION ALL SELECT a.user_id, a.route, TIMESTAMP '2024-02-01' FROM asked a
  WHERE NOT EXISTS (SELECT 1 FROM saved s WHERE s.user_id = a.user_id AND s.route = a.route)""",
)
def watchlist_reconcile(spark, sf_dir):
    """Customers as users and order priorities as routes; blank requests empty a list."""
    o = load(spark, sf_dir, "orders")
    status, user = F.col("o_orderstatus"), F.col("o_custkey").alias("user_id")
    saved = (
        o.where(status != "P")
        .groupBy(user, F.col("o_orderpriority").alias("route"))
        .agg(F.min("o_orderdate").alias("added_at"))
    )
    padded = F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))
    requested = o.where(status != "F").select(user, F.when(status == "O", padded).otherwise(" ").alias("route"))
    return reconcile_watchlist(saved, requested, "2024-02-01 00:00:00")


# ---------------------------------------------------------------- reference files

_GTFS_TYPE = "CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '900' WHEN 2 THEN '1' ELSE '3' END"


def _route_file(spark, sf_dir):
    key = F.col("p_partkey")
    kinds = F.array(*[F.lit(x) for x in ("0", "900", "1", "3")])
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("R"), text(key)).alias("route_id"),
        F.concat(text(key % 50), F.when(key % 7 == 0, "T").otherwise("")).alias("route_short_name"),
        F.when(key % 5 == 0, " ").otherwise(F.concat(F.col("p_name"), F.lit("  "))).alias("route_long_name"),
        F.element_at(kinds, (key % 4 + 1).cast("int")).alias("route_type"),
    )


_ROUTE_SQL = f"""
SELECT 'R' || CAST(p_partkey AS VARCHAR) AS feed_route_id,
       CAST(p_partkey % 50 AS VARCHAR) || CASE WHEN p_partkey % 7 = 0 THEN 'T' ELSE '' END AS route,
       CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS route_name,
       CASE {_GTFS_TYPE} WHEN '1' THEN 'metro' ELSE 'tram' END AS mode, CAST({_GTFS_TYPE} AS INTEGER) AS gtfs_route_type
FROM part WHERE {_GTFS_TYPE} <> '3'"""


@query(
    "mode_map",
    f"""SELECT {_GTFS_TYPE} AS route_type, CASE {_GTFS_TYPE} WHEN '1' THEN 'metro' ELSE 'tram' END AS mode, count(*) AS n
FROM part WHERE {_GTFS_TYPE} <> '3' GROUP BY 1, 2""",
)
def mode_map(spark, sf_dir):
    mapped = ref.map_mode(_route_file(spark, sf_dir))
    return mapped.groupBy("route_type", "mode").agg(F.count(F.lit(1)).alias("n"))


def _loaded(spark, sf_dir):
    """Parts as routes and customers as stops, written as text files, loaded and versioned."""
    key = F.col("c_custkey")
    blank = F.when(key % 3 == 0, " ")
    stop_file = load(spark, sf_dir, "customer").select(
        text(key).alias("stop_id"),
        F.concat(F.lit("C"), text(key)).alias("stop_code"),
        F.concat(F.lit(" "), F.col("c_name")).alias("stop_name"),
        text(F.lit(60.0) + key / F.lit(10_000.0)).alias("stop_lat"),
        text(F.lit(24.0) + key / F.lit(10_000.0)).alias("stop_lon"),
        text(F.col("c_nationkey") % 4).alias("vehicle_type"),
        blank.otherwise("A").alias("zone_id"),
        F.lit(" ").alias("platform_code"),
        F.lit("").alias("parent_station"),
        F.when(key % 11 == 0, "1").when(key % 2 == 0, "0").otherwise(" ").alias("location_type"),
    )
    files, out = shared_dir(spark, "gtfs"), shared_dir(spark, "reference")
    for name, df in (("routes", _route_file(spark, sf_dir)), ("stops", stop_file)):
        keep = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        df.write.options(**keep).csv(f"{files}/{name}")
    load_reference(
        spark, f"{files}/routes", f"{files}/stops", out, "2024-02-01 00:00:00", version=1, min_routes=10, min_stops=100
    )
    return out


@query("reference_routes", f"SELECT *, TIMESTAMP '2024-02-01' AS loaded_at FROM ({_ROUTE_SQL})")
def reference_routes(spark, sf_dir):
    return read_version(spark, f"{_loaded(spark, sf_dir)}/routes")


@query(
    "reference_stops",
    """SELECT CAST(c_custkey AS VARCHAR) AS stop_id, 'C' || CAST(c_custkey AS VARCHAR) AS stop_code, c_name AS stop_name,
       CAST(60 AS DOUBLE) + c_custkey / CAST(10000 AS DOUBLE) AS lat, CAST(24 AS DOUBLE) + c_custkey / CAST(10000 AS DOUBLE) AS long,
       c_nationkey % 4 AS main_vehicle_type, CASE WHEN c_custkey % 3 <> 0 THEN 'A' END AS zone_id,
       CAST(NULL AS VARCHAR) AS platform_code, CAST(NULL AS VARCHAR) AS parent_station, TIMESTAMP '2024-02-01' AS loaded_at
FROM customer WHERE c_custkey % 11 <> 0""",
)
def reference_stops(spark, sf_dir):
    return read_version(spark, f"{_loaded(spark, sf_dir)}/stops")


@query(
    "reference_csv",
    """SELECT 'R' || CAST(p_partkey AS VARCHAR) AS route_id,
       CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS route_long_name FROM part""",
)
def reference_csv(spark, sf_dir):
    """A text file whose padded and blank fields come back trimmed or NULL."""
    path = shared_dir(spark, "csv")
    keep = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    _route_file(spark, sf_dir).select("route_id", "route_long_name").write.options(**keep).csv(path)
    return read_reference_csv(spark, path)


@query(
    "retention_cut",
    f"SELECT event_id, ts FROM events WHERE ts >= {SQL_NOW} - INTERVAL 5 DAY",
)
def retention_cut(spark, sf_dir):
    """What a table with five days of retention keeps."""
    return retained(load(spark, sf_dir, "events"), "ts", 5, last_instant(spark, sf_dir)).select("event_id", "ts")
