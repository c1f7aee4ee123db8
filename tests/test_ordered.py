"""The span-cut operators must equal plain windows, whatever the span and the skew."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfeed.operators import ordered as o


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else rng.choice([None, "a", "b", "c", "d"])
        second = rng.choice([rng.randrange(0, 200), rng.randrange(0, 90_000), 50_000])
        rows.append((i, key, second, rng.choice([None, rng.randrange(100)])))
    return spark.createDataFrame(rows, "id int, key string, s int, v int").withColumn("at", F.timestamp_seconds("s")).cache()


SPANS = [30, 3600, 10_000_000]


def collect(df):
    return sorted(tuple(r) for r in df.select("id", "x").collect())


@pytest.mark.parametrize("span", SPANS)
def test_previous_and_next(data, span):
    w = Window.partitionBy("key").orderBy("at", "id")
    plain = collect(data.withColumn("x", F.lag("id").over(w)))
    assert collect(o.with_previous(data, ["key"], "at", {"x": F.col("id")}, span, ["id"])) == plain
    plain = collect(data.withColumn("x", F.lead("id").over(w)))
    assert collect(o.with_next(data, ["key"], "at", {"x": F.col("id")}, span, ["id"])) == plain


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("forward", [False, True])
def test_neighbour_instant(data, span, forward):
    w = Window.partitionBy("key").orderBy("at", "id")
    plain = collect(data.withColumn("x", (F.lead if forward else F.lag)("at").over(w)))
    assert collect(o.with_neighbour_instant(data, ["key"], "at", "x", span, forward, ["id"])) == plain


@pytest.mark.parametrize("span", SPANS)
def test_last_known(data, span):
    w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = collect(data.withColumn("x", F.last("v", ignorenulls=True).over(w)))
    assert collect(o.with_last_known(data, ["key"], "at", F.col("v"), "x", span, ["id"])) == plain


@pytest.mark.parametrize("span", SPANS)
def test_running_sum(data, span):
    w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = collect(data.withColumn("x", F.coalesce(F.sum("v").over(w), F.lit(0))))
    assert collect(o.with_running_sum(data, ["key"], "at", {"x": "v"}, span, ["id"])) == plain


@pytest.mark.parametrize("span", SPANS)
def test_values_by_name_equal_expressions(data, span):
    w = Window.partitionBy("key").orderBy("at", "id")
    plain = collect(data.withColumn("x", F.lag("v").over(w)))
    assert collect(o.with_previous(data, ["key"], "at", {"x": "v"}, span, ["id"])) == plain
    both = o.with_previous(data, ["key"], "at", {"y": F.col("v") + 0, "x": "v"}, span, ["id"])
    assert both.columns == [*data.columns, "y", "x"] and both.where(~F.col("x").eqNullSafe(F.col("y"))).count() == 0


def test_rows_travel_without_copies_of_their_columns(data):
    df = o.with_previous(data, ["key"], "at", {"x": "v", "y": "id"}, 3600, ["id"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "__values" not in plan and "__of_" not in plan


@pytest.mark.parametrize("within, span", [(1, 30), (45, 30), (45, 3600), (7200, 3600)])
def test_previous_instant_within(data, within, span):
    """Fractions of a second count: 45.9 s before is within 45 whole seconds."""
    some = data.withColumn("at", F.timestamp_micros(F.col("s").cast("long") * 1_000_000 + F.col("id") % 7 * 150_000)).select("key", "at").distinct()
    gap = F.timestamp_diff("SECOND", "x", "at")
    plain = some.withColumn("x", F.lag("at").over(Window.partitionBy("key").orderBy("at")))
    found = o.with_previous_instant_within(some, ["key"], "at", "x", within, span)
    want, got = (sorted(map(str, df.select("key", "at", F.when(gap <= within, F.col("x"))).collect())) for df in (plain, found))
    assert got == want


def test_previous_instant_within_reads_once(spark, tmp_path):
    spark.sql("SELECT 'a' AS key, timestamp'2026-10-03 10:00:00' AS at").write.parquet(str(tmp_path / "t"))
    df = o.with_previous_instant_within(spark.read.parquet(str(tmp_path / "t")), ["key"], "at", "x", 60, 3600)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_a_hot_key_is_spread_over_many_groups(data):
    """No window partition of the plan is the bare key."""
    df = o.with_previous(data, ["key"], "at", {"x": F.col("id")}, 3600, ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "__span" in plan
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_join_null_safe(spark):
    left = spark.createDataFrame([("a", None, 1), (None, None, 2), ("b", "x", 3)], "k string, l string, n int")
    right = spark.createDataFrame([("a", None, 10), (None, None, 20)], "k string, l string, m int")
    found = {r["n"]: r["m"] for r in o.join_null_safe(left, right, ["k", "l"]).collect()}
    assert found == {1: 10, 2: 20, 3: None}
