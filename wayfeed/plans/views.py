"""Canonical transit views over the given tables, in Spark and in SQL.

V1 reads ``events`` as departures, positions, heartbeats, feed messages and
rider reports; V2 reads ``lineitem`` joined with ``orders`` as departures, for
volume.  Every view keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import local_time, operating_day

# The tables' timestamps are UTC wall clock; reading them as instants keeps filters on them in the scan.
TABLES = {
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

ROUTE_OF = {"click": "4", "error": "10", "purchase": "4T", "signup": "1", "view": "M1"}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def text(c: Column) -> Column:
    return c.cast("string")


# ---------------------------------------------------------------- SQL helpers


def sql_local(ts: str) -> str:
    return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Helsinki')"


def sql_day(ts: str) -> str:
    return f"CAST({sql_local(ts)} - INTERVAL 270 MINUTE AS DATE)"


def sql_ok(col: str = "lateness_s", early: int = -60, late: int = 180) -> str:
    return f"coalesce({col} BETWEEN {early} AND {late}, false)"


def sql_route_number(col: str) -> str:
    return f"coalesce(TRY_CAST(nullif(regexp_replace({col}, '[^0-9]', '', 'g'), '') AS BIGINT), 1000000)"


def sql_sec(ts: str) -> str:
    return f"(epoch_us({ts}) // 1000000)"


def sql_diff_s(a: str, b: str) -> str:
    """Whole seconds from a to b, truncated toward zero."""
    return f"CAST(trunc((epoch_us({b}) - epoch_us({a})) / 1000000.0) AS BIGINT)"


# ---------------------------------------------------------------- V1: events


def transit(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """V1 base rows."""
    events = load(spark, sf_dir, "events") if events is None else events
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.create_map(*[F.lit(x) for kv in ROUTE_OF.items() for x in kv])
    user = F.col("user_id")
    e = events.select(
        "event_id",
        F.col("ts").alias("at"),
        "user_id",
        "value",
        k.alias("k"),
        F.try_element_at(names, F.col("event_type")).alias("route"),
        F.when(F.col("event_type") == "view", "metro").otherwise("tram").alias("mode"),
        text(user % 2 + 1).alias("direction"),
        F.concat(F.lit("40/"), text(user)).alias("vehicle_id"),
        "event_type",
    )
    late = F.when((F.col("mode") == "tram") & (user % 50 != 0), F.floor(F.col("value") * 10).cast("int") - 300)
    return (
        e.withColumns(
            {
                "stop_id": text(F.col("k") % 10 + 18),
                "lateness_s": late,
                "operating_day": operating_day(F.col("at")),
                "lat": F.lit(59.9) + (user % 80) / F.lit(100.0),
                "long": F.lit(24.2) + (F.col("k") % 140) / F.lit(100.0),
            }
        )
        .withColumn(
            "scheduled_departure",
            F.when(
                F.col("k") != 50,
                F.timestamp_micros(
                    F.unix_micros("at") - F.coalesce("lateness_s", F.lit(0)).cast("bigint") * 1_000_000
                ),
            ),
        )
        .withColumn("journey_id", F.concat_ws("|", "route", "direction", text(F.col("operating_day")), text(user)))
    )


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROUTE_OF.items())
SQL_TRANSIT = f"""
t0 AS (
  SELECT event_id, ts AS "at", user_id, value, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE event_type {_CASES} END AS route,
         CASE WHEN event_type = 'view' THEN 'metro' ELSE 'tram' END AS mode,
         CAST(user_id % 2 + 1 AS VARCHAR) AS direction, '40/' || CAST(user_id AS VARCHAR) AS vehicle_id,
         {sql_day('ts')} AS operating_day
  FROM events
),
t1 AS (
  SELECT *, CAST(k % 10 + 18 AS VARCHAR) AS stop_id,
         CASE WHEN mode = 'tram' AND user_id % 50 <> 0 THEN CAST(floor(value * 10) AS INTEGER) - 300 END AS lateness_s,
         CAST(59.9 AS DOUBLE) + (user_id % 80) / CAST(100 AS DOUBLE) AS lat,
         CAST(24.2 AS DOUBLE) + (k % 140) / CAST(100 AS DOUBLE) AS long
  FROM t0
),
transit AS (
  SELECT *, CASE WHEN k <> 50 THEN "at" - to_seconds(coalesce(lateness_s, 0)) END AS scheduled_departure,
         concat_ws('|', route, direction, CAST(operating_day AS VARCHAR), CAST(user_id AS VARCHAR)) AS journey_id
  FROM t1
)"""


def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 as departures; one stop has no name, one no coordinates."""
    t = transit(spark, sf_dir)
    stop = F.col("stop_id")
    return t.select(
        "operating_day",
        "route",
        F.concat(F.lit("Route "), F.col("route")).alias("route_name"),
        "direction",
        "journey_id",
        "vehicle_id",
        "stop_id",
        F.when(stop != "27", F.concat(F.lit("Stop "), stop)).alias("stop_name"),
        F.when(stop != "26", F.lit(60.0) + stop.cast("int") / F.lit(100.0)).alias("stop_lat"),
        F.when(stop != "26", F.lit(25.0) - stop.cast("int") / F.lit(100.0)).alias("stop_long"),
        F.col("at").alias("departed_at"),
        local_time(F.col("at")).alias("departed_at_local"),
        "scheduled_departure",
        "lateness_s",
        F.lit(None).cast("int").alias("timetable_lateness_s"),
    )


SQL_DEPARTURES_ONLY = f"""
departures AS (
  SELECT operating_day, route, 'Route ' || route AS route_name, direction, journey_id, vehicle_id, stop_id,
         CASE WHEN stop_id <> '27' THEN 'Stop ' || stop_id END AS stop_name,
         CASE WHEN stop_id <> '26' THEN CAST(60 AS DOUBLE) + CAST(stop_id AS INTEGER) / CAST(100 AS DOUBLE) END AS stop_lat,
         CASE WHEN stop_id <> '26' THEN CAST(25 AS DOUBLE) - CAST(stop_id AS INTEGER) / CAST(100 AS DOUBLE) END AS stop_long,
         "at" AS departed_at, {sql_local('"at"')} AS departed_at_local, scheduled_departure, lateness_s
  FROM transit
)"""
SQL_DEPARTURES = f"{SQL_TRANSIT}, {SQL_DEPARTURES_ONLY}"


def heartbeats(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """V1 as heartbeats: one session per event type, totals growing with the event number."""
    events = load(spark, sf_dir, "events") if events is None else events
    return events.select(
        F.col("event_type").alias("session_id"),
        F.col("ts").alias("heartbeat_at"),
        (F.col("event_id") + 1).alias("received_total"),
        F.floor(F.col("event_id") / 100).alias("dropped_total"),
    )


SQL_HEARTBEATS = """
heartbeats AS (
  SELECT event_type AS session_id, ts AS heartbeat_at, event_id + 1 AS received_total, event_id // 100 AS dropped_total
  FROM events
)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 as current-state rows, one per event."""
    return transit(spark, sf_dir).select(
        "vehicle_id",
        "mode",
        "route",
        "direction",
        "journey_id",
        "lat",
        "long",
        (F.col("k") * 3).alias("heading"),
        (F.col("value") / F.lit(10.0)).alias("speed_ms"),
        "lateness_s",
        F.col("at").alias("last_seen_at"),
    )


SQL_POSITIONS = f"""{SQL_TRANSIT},
positions AS (
  SELECT vehicle_id, mode, route, direction, journey_id, lat, long, k * 3 AS heading,
         value / CAST(10 AS DOUBLE) AS speed_ms, lateness_s, "at" AS last_seen_at
  FROM transit
)"""
SQL_CURRENT = f"""{SQL_POSITIONS},
vehicle_current AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY last_seen_at DESC) AS rn FROM positions
  ) WHERE rn = 1
)"""


def last_instant(spark: SparkSession, sf_dir: str) -> Column:
    """The newest instant of the events table, the ``as_of`` of the queries.

    Read once where the query is built: as a subquery it would be planned again, scan and all, in every bound made of it,
    and bounds that are literals prune partitions when planning.
    """
    micros = load(spark, sf_dir, "events").agg(F.max(F.unix_micros("ts"))).first()[0]
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


SQL_NOW = "(SELECT max(ts) FROM events)"


# ---------------------------------------------------------------- V1 as raw feed messages


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def feed_type(event_id: Column) -> Column:
    """Positions, arrivals, pre-departures and departures take turns."""
    return F.element_at(F.array(*[F.lit(t) for t in ("vp", "arr", "pde", "dep")]), (event_id % 4 + 1).cast("int"))


def _dealt_out(spark: SparkSession, sf_dir: str, in_order: bool) -> DataFrame:
    """The events in as many tasks as there are cores; ``in_order``: each task has the events of a part of the time."""
    events, n = load(spark, sf_dir, "events"), spark.sparkContext.defaultParallelism
    return events.repartitionByRange(n, "ts", "event_id") if in_order else events.repartition(n, "event_id")


def messages(spark: SparkSession, sf_dir: str, numbered: bool = False, in_order: bool = False) -> DataFrame:
    """V1 as raw rows: JSON payloads under a topic; positions arrive four times, some bodies are bad.

    ``numbered`` keeps the event's id and the number of the copy; ``in_order`` has the partitions in order of time.
    """
    # A recording is many files; the given table is one row group, so its rows are dealt out before they become text.
    events = _dealt_out(spark, sf_dir, in_order)
    t = transit(spark, sf_dir, events)
    kind = feed_type(F.col("event_id"))
    planned = F.col("scheduled_departure")
    body = F.struct(
        F.col("route").alias("desi"),
        F.col("direction").alias("dir"),
        F.lit(40).alias("oper"),
        F.when(F.col("user_id") % 97 != 0, F.col("user_id")).alias("veh"),
        F.when(F.col("k") != 99, _iso(F.col("at"))).otherwise("not a time").alias("tst"),
        (F.col("value") / F.lit(10.0)).alias("spd"),
        (F.col("k") * 3).alias("hdg"),
        "lat",
        "long",
        (-F.col("lateness_s")).alias("dl"),
        (F.col("k") % 2).alias("drst"),
        text(F.col("operating_day")).alias("oday"),
        F.date_format("at", "HH:mm").alias("start"),
        F.lit("GPS").alias("loc"),
        (F.col("k") % 10 + 18).alias("stop"),
        F.concat(F.lit("100"), F.col("route")).alias("route"),
        F.col("k").alias("occu"),
        _iso(planned - F.expr("INTERVAL 20 SECONDS")).alias("ttarr"),
        _iso(planned).alias("ttdep"),
    )
    topic = F.concat(
        F.lit("/hfp/v2/journey/ongoing/"), kind, F.lit("/"), F.col("mode"), F.lit("/0040/"), text(F.col("user_id"))
    )
    copies = F.sequence(F.lit(0), F.when(kind == "vp", 3).otherwise(0))
    return t.select(
        F.lit("event").alias("kind"),
        topic.alias("topic"),
        F.to_json(F.create_map(F.upper(kind), body)).alias("payload"),
        "at",
        F.col("event_type").alias("session_id"),
        "event_id",
        F.explode(copies).alias("copy"),
    ).select(
        "kind",
        "topic",
        "payload",
        F.timestamp_micros(F.unix_micros("at") + 500_000 + F.col("copy") * 1000).alias("received_at"),
        "session_id",
        *(["event_id", "copy"] if numbered else []),
    )


def heartbeat_rows(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """The heartbeats as raw rows; ``in_order`` deals them out as that of :func:`messages` does."""
    return heartbeats(spark, sf_dir, _dealt_out(spark, sf_dir, True) if in_order else None).select(
        F.lit("heartbeat").alias("kind"),
        F.lit(None).cast("string").alias("topic"),
        F.to_json(F.struct("received_total", "dropped_total")).alias("payload"),
        F.col("heartbeat_at").alias("received_at"),
        "session_id",
    )


# What parsing the messages must give, straight from the columns.
SQL_PARSED = f"""{SQL_TRANSIT},
typed AS (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'vp' WHEN 1 THEN 'arr' WHEN 2 THEN 'pde' ELSE 'dep' END AS event_type,
         mode, CASE WHEN k <> 99 THEN "at" END AS tst,
         CASE WHEN user_id % 97 <> 0 THEN vehicle_id END AS vehicle_id, route, direction, operating_day,
         strftime("at", '%H:%M') AS journey_start,
         concat_ws('|', route, direction, CAST(operating_day AS VARCHAR), strftime("at", '%H:%M')) AS journey_id,
         '100' || route AS feed_route_id, lat, long, value / CAST(10 AS DOUBLE) AS speed_ms, k * 3 AS heading,
         lateness_s, stop_id, scheduled_departure - INTERVAL 20 SECOND AS scheduled_arrival, scheduled_departure,
         'GPS' AS location_source, k % 2 AS door_status, k AS occupancy,
         "at" + INTERVAL 500 MILLISECOND AS first_received_at, event_type AS session_id
  FROM transit
),
parsed AS (
  SELECT *, CAST(floor((epoch_us(tst) - epoch_us(CASE WHEN event_type = 'arr' THEN scheduled_arrival
                 ELSE scheduled_departure END)) / 1000000.0 + 0.5) AS INTEGER) AS timetable_lateness_s,
         first_received_at AS received_at
  FROM typed
),
copies AS (
  SELECT p.* REPLACE (first_received_at + to_milliseconds(c.n) AS received_at)
  FROM parsed p JOIN (VALUES (0), (1), (2), (3)) c(n) ON c.n = 0 OR p.event_type = 'vp'
)"""
PARSED_COLUMNS = (
    "event_type, mode, tst, vehicle_id, route, direction, operating_day, journey_start, journey_id, feed_route_id, "
    "lat, long, speed_ms, heading, lateness_s, stop_id, scheduled_arrival, scheduled_departure, location_source, "
    "door_status, occupancy, received_at, session_id, timetable_lateness_s"
)


# ---------------------------------------------------------------- V2: shipments


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 as departures: lateness is the shipping delay beyond 60 days."""
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]
    line = load(spark, sf_dir, "lineitem").select(*columns)
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
    planned = F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")
    stop = F.col("l_partkey") % 200
    return joined.select(
        operating_day(F.col("l_shipdate")).alias("operating_day"),
        F.concat("l_returnflag", "l_linestatus").alias("route"),
        F.concat(F.lit("Route "), F.col("l_returnflag")).alias("route_name"),
        text(F.col("l_linenumber") % 2 + 1).alias("direction"),
        text(F.col("l_orderkey")).alias("journey_id"),
        text(F.col("l_suppkey")).alias("vehicle_id"),
        text(stop).alias("stop_id"),
        F.concat(F.lit("Stop "), text(stop)).alias("stop_name"),
        (F.lit(60.0) + stop / F.lit(1000.0)).alias("stop_lat"),
        (F.lit(25.0) - stop / F.lit(1000.0)).alias("stop_long"),
        F.col("l_shipdate").alias("departed_at"),
        local_time(F.col("l_shipdate")).alias("departed_at_local"),
        planned.alias("scheduled_departure"),
        (F.unix_seconds("l_shipdate") - F.unix_seconds(planned)).cast("int").alias("lateness_s"),
        F.lit(None).cast("int").alias("timetable_lateness_s"),
    )


SQL_SHIPMENTS = f"""
departures AS (
  SELECT {sql_day('l_shipdate')} AS operating_day, l_returnflag || l_linestatus AS route,
         'Route ' || l_returnflag AS route_name, CAST(l_linenumber % 2 + 1 AS VARCHAR) AS direction,
         CAST(l_orderkey AS VARCHAR) AS journey_id, CAST(l_suppkey AS VARCHAR) AS vehicle_id,
         CAST(l_partkey % 200 AS VARCHAR) AS stop_id, 'Stop ' || CAST(l_partkey % 200 AS VARCHAR) AS stop_name,
         CAST(60 AS DOUBLE) + (l_partkey % 200) / CAST(1000 AS DOUBLE) AS stop_lat,
         CAST(25 AS DOUBLE) - (l_partkey % 200) / CAST(1000 AS DOUBLE) AS stop_long,
         l_shipdate AS departed_at, {sql_local('l_shipdate')} AS departed_at_local,
         o_orderdate + INTERVAL 60 DAY AS scheduled_departure,
         CAST((epoch_us(l_shipdate) - epoch_us(o_orderdate + INTERVAL 60 DAY)) // 1000000 AS INTEGER) AS lateness_s
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


# ---------------------------------------------------------------- reference tables


def stops_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 stops, so some stop ids of V1 stay unmatched."""
    n = load(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    return n.select(
        text(key).alias("stop_id"),
        F.concat(F.lit("S"), text(key)).alias("stop_code"),
        F.col("n_name").alias("stop_name"),
        F.when(key != 24, F.lit(60.0) + key / F.lit(100.0)).alias("lat"),
        F.when(key != 24, F.lit(25.0) - key / F.lit(100.0)).alias("long"),
        (key % 4).alias("main_vehicle_type"),
    )


def routes_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes 4, 10, 4T by id, 1 only by name, M1 not at all."""
    names = F.array(*[F.lit(x) for x in ("4", "10", "4T", "1", "X9")])
    r = load(spark, sf_dir, "region")
    route = F.element_at(names, F.col("r_regionkey") + 1)
    return r.select(
        F.concat(F.lit("100"), route, F.when(F.col("r_regionkey") == 3, "B").otherwise("")).alias("feed_route_id"),
        route.alias("route"),
        F.col("r_name").alias("route_name"),
        F.when(F.col("r_regionkey") != 4, "tram").otherwise("metro").alias("mode"),
    )


SQL_REFERENCE = """
stops AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS stop_id, 'S' || CAST(n_nationkey AS VARCHAR) AS stop_code, n_name AS stop_name,
         CASE WHEN n_nationkey <> 24 THEN CAST(60 AS DOUBLE) + n_nationkey / CAST(100 AS DOUBLE) END AS lat,
         CASE WHEN n_nationkey <> 24 THEN CAST(25 AS DOUBLE) - n_nationkey / CAST(100 AS DOUBLE) END AS long,
         n_nationkey % 4 AS main_vehicle_type
  FROM nation
),
routes AS (
  SELECT '100' || route || CASE WHEN r_regionkey = 3 THEN 'B' ELSE '' END AS feed_route_id, route,
         r_name AS route_name, CASE WHEN r_regionkey <> 4 THEN 'tram' ELSE 'metro' END AS mode
  FROM (SELECT *, CASE r_regionkey WHEN 0 THEN '4' WHEN 1 THEN '10' WHEN 2 THEN '4T' WHEN 3 THEN '1' ELSE 'X9' END AS route
        FROM region)
)"""
