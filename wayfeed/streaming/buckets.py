"""The newest row per key in hash buckets: a batch rewrites the buckets it touches and tells what changed."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.fleet import latest_by_key, snapshot_diff
from ..sources.paths import children, delete, read_text, write_text

# A table is a folder with data/__version=<batch>/__bucket=<b>, changes/__version=<batch>, and manifest/<batch>.json: for each bucket the
# batch that wrote it last.  A batch counts once its manifest is written, which is the last thing it does.


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, dict] | None:
    names = [n for n in children(spark, f"{path}/manifest") if n.endswith(".json") and n[:-5].isdigit()]
    ready = [int(n[:-5]) for n in names if before is None or int(n[:-5]) < before]
    if not ready:
        return None
    return ready[-1], json.loads(read_text(spark, f"{path}/manifest/{ready[-1]:012d}.json"))


def _read(spark: SparkSession, path: str, held: dict[str, int], schema: T.StructType) -> DataFrame:
    """Rows of the given buckets; reading needs no list of files beyond them."""
    folders = [f"{path}/data/__version={v}/__bucket={b}" for b, v in held.items()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_buckets(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table after the newest whole batch (older than ``before``); None when there is none."""
    found = _manifest(spark, path, before)
    return found and _read(spark, path, found[1]["buckets"], T.StructType.fromJson(found[1]["schema"]))


def read_changes(spark: SparkSession, path: str) -> DataFrame | None:
    """Change rows of all whole batches, with the batch as ``version``: insert, update_preimage and update_postimage."""
    found = _manifest(spark, path)
    if found is None:
        return None
    return spark.read.parquet(f"{path}/changes").where(F.col("__version") <= found[0]).withColumnRenamed("__version", "version")


def merge_buckets(path: str, keys: list[str], seq: str, buckets: int = 64, keep: int = 3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that keeps the newest row per key, rewriting only the buckets of the batch's keys.

    The batch is reduced to one row per key, joined with the old rows of its buckets alone, and written as new files of
    those; other buckets stay where they are.  The same step writes the change feed of the batch.  A batch that is
    repeated starts from the state before it, so it gives the same files again.  ``buckets`` is fixed by the first batch.
    Files that none of the newest ``keep`` states refers to are removed; changes stay.
    """
    path = path.rstrip("/")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = _manifest(spark, path, before=batch_id)
        held = found[1]["buckets"] if found else {}
        count = found[1]["count"] if found else buckets
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in batch.schema.fields])
        bucket = F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")
        fresh = f"{path}/fresh/{batch_id}"
        latest_by_key(batch, keys, seq).write.mode("overwrite").parquet(fresh)
        new = spark.read.schema(schema).parquet(fresh)
        touched = sorted(r[0] for r in new.select(bucket).distinct().collect())
        old = _read(spark, path, {b: v for b, v in held.items() if int(b) in touched}, schema)
        merged = latest_by_key(old.unionByName(new), keys, seq)
        merged.withColumn("__bucket", bucket).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/data/__version={batch_id}")
        after = held | {str(b): batch_id for b in touched}
        current = _read(spark, path, {str(b): batch_id for b in touched}, schema)
        snapshot_diff(old, current, keys).write.mode("overwrite").parquet(f"{path}/changes/__version={batch_id}")
        state = {"count": count, "buckets": after, "schema": schema.jsonValue()}
        write_text(spark, f"{path}/manifest/{batch_id:012d}.json", json.dumps(state))
        delete(spark, fresh)
        _tidy(spark, path, keep)

    return step


def _tidy(spark: SparkSession, path: str, keep: int) -> None:
    names = [n for n in children(spark, f"{path}/manifest") if n.endswith(".json")]
    live, held = names[-keep:], set()
    for name in live:
        held |= {(f"__version={v}", f"__bucket={b}") for b, v in json.loads(read_text(spark, f"{path}/manifest/{name}"))["buckets"].items()}
    newest = int(live[-1][:-5])
    for version in children(spark, f"{path}/data"):
        if not version.startswith("__version=") or int(version.split("=")[1]) > newest:
            continue
        parts = [b for b in children(spark, f"{path}/data/{version}") if b.startswith("__bucket=")]
        dead = [b for b in parts if (version, b) not in held]
        if len(dead) == len(parts):
            delete(spark, f"{path}/data/{version}")
        else:
            for b in dead:
                delete(spark, f"{path}/data/{version}/{b}")
    for name in names[:-keep]:
        delete(spark, f"{path}/manifest/{name}")
