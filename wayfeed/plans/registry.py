"""Register a Spark query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import use_utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def shown(df: DataFrame) -> DataFrame:
    """Instants as zone-less UTC timestamps, the way the given tables store them."""
    instants = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in instants}) if instants else df


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shown(build(use_utc(spark), sf_dir))

        QUERIES[key] = call
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register
