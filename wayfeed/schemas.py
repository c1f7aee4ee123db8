"""Declared schemas and fixed values of the vehicle feed."""

from pyspark.sql import types as T

# --- Fixed values: they define the feed format and the published rules. ---
EVENT_TYPES = ["vp", "arr", "pde", "dep"]
MODES = ["tram", "metro"]
STOP_EVENT_TYPES = ["arr", "pde", "dep"]
TOPIC_PREFIX = "/hfp/v2/journey/ongoing"
DEFAULT_TOPICS = [f"{TOPIC_PREFIX}/{event}/{mode}/#" for event in EVENT_TYPES for mode in MODES]
HEARTBEAT_EVERY_S = 10
MAX_HEARTBEAT_SPACING_S = 30
DEDUP_WATERMARK = "2 minutes"
DEDUP_KEYS = ["vehicle_id", "event_type", "tst"]
RETENTION_DAYS = {
    "bronze_events": 5,
    "silver_position_events": 30,
    "silver_stop_events": 30,
    "silver_heartbeats": 30,
    "gold_departures": 30,
}
ROUTE_TYPE_TO_MODE = {"0": "tram", "900": "tram", "1": "metro"}
MIN_ROUTES = 10
MIN_STOPS = 1000
REPORT_CATEGORIES = ["late", "early", "crowded", "skipped_stop", "breakdown", "other"]
NOTE_MAX = 280

# Drop rules and the warn rule of the typed events.
ROW_REQUIRED = {
    "tst_present": "tst IS NOT NULL",
    "vehicle_id_present": "vehicle_id IS NOT NULL",
}
INSIDE_REGION = {
    "inside_helsinki_region": "lat BETWEEN 59.9 AND 60.6 AND long BETWEEN 24.2 AND 25.6",
}
LATENESS_PLAUSIBLE = {"lateness_plausible": "lateness_s IS NULL OR abs(lateness_s) <= 3600"}
# --- End of fixed values. ---

# One recorded line of the feed.
RECORDED = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
    ]
)

# One row of the raw (bronze) table.
ENVELOPE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("session_id", T.StringType()),
    ]
)

# The payload is a one-key map, event name -> body.
PAYLOAD_BODY = T.StructType(
    [
        T.StructField("desi", T.StringType()),
        T.StructField("dir", T.StringType()),
        T.StructField("oper", T.IntegerType()),
        T.StructField("veh", T.IntegerType()),
        T.StructField("tst", T.StringType()),
        T.StructField("spd", T.DoubleType()),
        T.StructField("hdg", T.IntegerType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("long", T.DoubleType()),
        T.StructField("dl", T.IntegerType()),
        T.StructField("drst", T.IntegerType()),
        T.StructField("oday", T.StringType()),
        T.StructField("start", T.StringType()),
        T.StructField("loc", T.StringType()),
        T.StructField("stop", T.StringType()),
        T.StructField("route", T.StringType()),
        T.StructField("occu", T.IntegerType()),
        T.StructField("ttarr", T.StringType()),
        T.StructField("ttdep", T.StringType()),
    ]
)
PAYLOAD = T.MapType(T.StringType(), PAYLOAD_BODY)

HEARTBEAT_BODY = T.StructType(
    [
        T.StructField("received_total", T.LongType()),
        T.StructField("dropped_total", T.LongType()),
    ]
)

# Columns of a Position Event are those of a Stop Event minus these.
STOP_ONLY_COLUMNS = ["stop_id", "scheduled_arrival", "scheduled_departure", "timetable_lateness_s"]

# Columns kept in the current-state table, next to its key and sequence.
CURRENT_COLUMNS = [
    "vehicle_id",
    "mode",
    "route",
    "direction",
    "journey_id",
    "lat",
    "long",
    "heading",
    "speed_ms",
    "lateness_s",
    "last_seen_at",
]
