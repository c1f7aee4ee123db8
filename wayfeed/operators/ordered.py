"""Ordered operators whose groups never grow without bound.

A plain ``lag(..) OVER (PARTITION BY stop ORDER BY ts)`` sorts all rows of a
stop in one task, so one busy stop (or session, or vehicle) stalls the job.
Here a group is cut into time spans and the window runs per (keys, span).  What
has to cross a span border is found first, by an aggregate with one row per
(keys, span) that is combined on the map side, and is sent into the span that
needs it as one extra row, which the window sees first and which is dropped
afterwards.  The rows themselves are shuffled and sorted once and joined with
nothing.  The result equals the plain window.

``order`` must be a timestamp column without NULLs; ``tie`` columns break its
ties, so the result does not depend on how rows are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN, VALUES, IS_ROW = "__span", "__values", "__is_row"


def span_of(ts: Column, span_s: int) -> Column:
    """Number of the time span an instant falls into."""
    return F.floor(F.unix_seconds(ts) / F.lit(span_s))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def _cut(df: DataFrame, order: str, span_s: int) -> DataFrame:
    return df.withColumns({SPAN: span_of(F.col(order), span_s), IS_ROW: F.lit(True)})


def _with_extra(cut: DataFrame, extra: DataFrame) -> DataFrame:
    """Rows plus the extra rows of their spans."""
    marked = extra.where(F.col(SPAN).isNotNull()).withColumn(IS_ROW, F.lit(False))
    return cut.unionByName(marked, allowMissingColumns=True)


def _neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Column | str],
    span_s: int,
    tie: Sequence[str],
    forward: bool,
    instant_only: bool = False,
) -> DataFrame:
    keys = list(keys)
    # A column given by name is read where it is; only expressions become columns of their own.
    source = {name: v if isinstance(v, str) else f"__of_{name}" for name, v in values.items()}
    made = {source[name]: v for name, v in values.items() if not isinstance(v, str)}
    cut = _cut(df, order, span_s).withColumns(made) if made else _cut(df, order, span_s)

    # The outermost row of each span, handed to the nearest span that has rows.
    spans = Window.partitionBy(*keys).orderBy(SPAN)
    target = (F.lag if forward else F.lead)(SPAN).over(spans).alias(SPAN)
    if instant_only:
        # A plain max or min of a timestamp: a hash aggregate without any sort.
        edges = cut.groupBy(*keys, SPAN).agg((F.min if forward else F.max)(order).alias(order))
        extra = edges.select(*keys, target, order)
    else:
        carried = [c for c in dict.fromkeys([order, *tie, *source.values()]) if c not in keys]
        outer = (F.min_by if forward else F.max_by)(F.struct(*carried), F.struct(order, *tie))
        extra = cut.groupBy(*keys, SPAN).agg(outer.alias("__edge")).select(*keys, target, "__edge.*")

    step = F.lead if forward else F.lag
    in_span = Window.partitionBy(*keys, SPAN).orderBy(order, *tie)
    found = [step(c).over(in_span).alias(f"__found_{name}") for name, c in source.items()]
    seen = _with_extra(cut, extra).select("*", *found).where(IS_ROW)
    return seen.select(*df.columns, *[F.col(f"__found_{name}").alias(name) for name in values])


def with_previous(df, keys, order, values, span_s, tie=()) -> DataFrame:
    """Add ``values`` (columns by name, or expressions) taken from the row just before, per ``keys`` in time order."""
    return _neighbour(df, keys, order, values, span_s, tie, forward=False)


def with_next(df, keys, order, values, span_s, tie=()) -> DataFrame:
    """Add ``values`` (columns by name, or expressions) taken from the row just after, per ``keys`` in time order."""
    return _neighbour(df, keys, order, values, span_s, tie, forward=True)


def with_neighbour_instant(df, keys, order, name, span_s, forward=False, tie=()) -> DataFrame:
    """Add the instant of the row just before (or after) as ``name``, per ``keys``."""
    return _neighbour(df, keys, order, {name: order}, span_s, tie, forward, instant_only=True)


def with_previous_instant_within(df, keys, order, name, within_s, span_s) -> DataFrame:
    """Add the instant of the row just before as ``name``, per ``keys``; NULL may stand for one more than ``within_s`` before.

    One pass over the input: a row less than ``within_s`` (and the second that
    whole seconds leave out) before a border is also seen by the next span.
    """
    span_s = max(span_s, within_s + 1)
    last = F.col(order) + F.make_dt_interval(secs=F.lit(within_s + 1))
    own, until = span_of(F.col(order), span_s), span_of(last, span_s)
    seen_by = df.select("*", F.explode(F.sequence(own, until)).alias(SPAN)).withColumn(IS_ROW, F.col(SPAN) == own)
    in_span = Window.partitionBy(*keys, SPAN).orderBy(order)
    found = seen_by.withColumn("__found", F.lag(order).over(in_span)).where(IS_ROW)
    return found.select(*df.columns, F.col("__found").alias(name))


def _before_span(span_s: int) -> Column:
    """An instant just before the first one of a span."""
    return F.timestamp_micros(F.col(SPAN) * F.lit(span_s * 1_000_000) - 1)


def with_last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    span_s: int,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add the latest non-NULL ``value`` at or before each row (an as-of lookup).

    Make ``value`` a struct to carry several columns that belong together.
    """
    keys = list(keys)
    cut = _cut(df, order, span_s).withColumn(VALUES, value)
    # Spans without a value keep their row (with NULL): they still need one carried in.
    known_at = F.when(F.col(VALUES).isNotNull(), F.struct(order, *tie))
    edges = cut.groupBy(*keys, SPAN).agg(F.max_by(VALUES, known_at).alias("__edge"))
    earlier = Window.partitionBy(*keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    extra = edges.select(
        *keys, SPAN, _before_span(span_s).alias(order), F.last("__edge", ignorenulls=True).over(earlier).alias(VALUES)
    ).where(F.col(VALUES).isNotNull())
    so_far = Window.partitionBy(*keys, SPAN).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    seen = _with_extra(cut, extra).withColumn("__found", F.last(VALUES, ignorenulls=True).over(so_far)).where(IS_ROW)
    return seen.select(*df.columns, F.col("__found").alias(name))


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, str],
    span_s: int,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add running totals (``{new column: summed column}``) per ``keys`` in time order."""
    keys = list(keys)
    cut = _cut(df, order, span_s)
    edges = cut.groupBy(*keys, SPAN).agg(*[F.sum(old).alias(old) for old in sums.values()])
    earlier = Window.partitionBy(*keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    extra = edges.select(
        *keys,
        SPAN,
        _before_span(span_s).alias(order),
        *[F.sum(old).over(earlier).alias(old) for old in sums.values()],
    )
    so_far = Window.partitionBy(*keys, SPAN).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    totals = {new: F.coalesce(F.sum(old).over(so_far), F.lit(0)) for new, old in sums.items()}
    return _with_extra(cut, extra).withColumns(totals).where(IS_ROW).select(*df.columns, *sums)
