"""Dedup that shows what it drops: every event is kept, a copy, or late."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import DEDUP_KEYS, DEDUP_WATERMARK

KEPT, COPY, LATE = "kept", "copy", "late"


def _with_ticks(marked: DataFrame, lot: str, buckets: int) -> DataFrame:
    """Rows plus, for each lot of a task, a row without key in every bucket that carries the lot's newest event time."""

    def step(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            yield batch
            if not batch.num_rows:
                continue
            newest = pa.table({"lot": batch[lot], "us": batch["_us"]}).filter(pc.is_valid(batch["_us"])).group_by("lot").aggregate([("us", "max")])
            ticks = [(n, us, b) for n, us in zip(newest["lot"].to_pylist(), newest["us_max"].to_pylist()) for b in range(buckets)]
            # The other columns repeat the first row, so that none becomes nullable; a tick's end here.
            columns = dict(zip(batch.schema.names, batch.take(pa.array([0] * len(ticks), pa.int64())).columns))
            for c, values in {lot: [t[0] for t in ticks], "_us": [t[1] for t in ticks], "_bucket": [t[2] for t in ticks], "_key": [None] * len(ticks)}.items():
                columns[c] = pa.array(values, batch.schema.field(c).type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in batch.schema.names], schema=batch.schema)

    return marked.mapInArrow(step, marked.schema)


def tag_copies_and_late(events: DataFrame, delay: str = DEDUP_WATERMARK, buckets: int = 64, lot: str | None = None) -> DataFrame:
    """All rows of ``events`` with ``outcome``: ``kept``, ``copy`` or ``late``; the three add up to the input.

    As a stream, the watermark is the newest event time of the batches before, less ``delay``.  A row at or behind it, to
    the millisecond, is ``late``: its key's state may be gone, so whether it is a copy cannot be known.  Of the other
    rows of a key the first one (by batch, then time received) is ``kept``.  A row without a key cannot have copies
    and is ``kept``.  A batch table has no late rows.

    State is the set of keys seen whose time the watermark has not passed, held in ``buckets`` by a hash of the key: a
    busy vehicle spreads over all of them, one call handles all rows of a bucket, and a bucket forgets old keys each time it
    is called.  Give it as many buckets as keep a few thousand keys in each; the number never changes the result.  The
    built-in dedup drops late rows without a trace before any state is asked; this operator judges them itself.

    ``lot`` names a column that numbers the batches a micro-batch of a stream was put together from (the source option
    ``lotsPerBatch``).  Each lot then counts as a batch of its own, against the newest event time of all lots before it,
    so the result is that of one micro-batch a lot.
    """
    keyed = F.lit(True)
    for c in DEDUP_KEYS:
        keyed = keyed & F.col(c).isNotNull()
    columns = events.columns
    if not events.isStreaming:
        order = ["received_at", *sorted(c for c in columns if c not in DEDUP_KEYS and c != "received_at")]
        first = F.row_number().over(Window.partitionBy(*DEDUP_KEYS).orderBy(*order)) == 1
        tagged = events.where(keyed).withColumn("outcome", F.when(first, KEPT).otherwise(COPY))
        return tagged.unionByName(events.where(~keyed).withColumn("outcome", F.lit(KEPT)))
    moment = F.unix_micros("tst")
    key = F.when(keyed, F.concat_ws("\u0000", *[c for c in DEDUP_KEYS if c != "tst"], moment))
    spread = F.pmod(F.xxhash64(F.coalesce(key, F.col("received_at").cast("string"))), F.lit(buckets))
    # Rows without a key take part in buckets of their own, so that the source is read once.
    bucket = F.when(keyed, spread).otherwise(-1 - spread)
    helpers = {"_key": key, "_us": moment, "_in": F.unix_micros("received_at"), "_bucket": bucket}
    schema = ", ".join(f"`{c}` {t}" for c, t in events.dtypes) + ", outcome string"
    if lot is not None:
        delay_ms = events.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {delay})").first()[0]
        step = _step_by_lots(columns, lot, delay_ms)
        ticked = _with_ticks(events.withColumns(helpers), lot, buckets)
        return ticked.groupBy("_bucket").applyInPandasWithState(
            step, schema, "newest bigint, keys array<string>, times array<bigint>", "append", GroupStateTimeout.NoTimeout
        )
    marked = events.withWatermark("tst", delay).withColumns(helpers)

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if group[0] < 0:
            for rows in parts:
                yield rows.assign(outcome=KEPT)[[*columns, "outcome"]]
            return
        mark_ms = state.getCurrentWatermarkMs()
        seen = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(parts), ignore_index=True).sort_values("_in", kind="stable")
        late = rows["_us"] // 1000 <= mark_ms if mark_ms > 0 else pd.Series(False, rows.index)
        again = rows["_key"].isin(seen) | rows["_key"].where(~late).duplicated()
        rows["outcome"] = KEPT
        rows.loc[again, "outcome"] = COPY
        rows.loc[late, "outcome"] = LATE
        seen.update(rows.loc[~late, ["_key", "_us"]].itertuples(index=False, name=None))
        live = {k: us for k, us in seen.items() if us // 1000 > mark_ms}
        state.update((list(live), list(live.values())))
        yield rows[[*columns, "outcome"]]

    return marked.groupBy("_bucket").applyInPandasWithState(step, schema, "keys array<string>, times array<bigint>", "append", GroupStateTimeout.NoTimeout)


def _step_by_lots(columns: list[str], lot: str, delay_ms: int):
    """The state step of a bucket when a micro-batch holds many lots; rows of keyed buckets without a key are ticks."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if group[0] < 0:
            for rows in parts:
                yield rows.assign(outcome=KEPT)[[*columns, "outcome"]]
            return
        newest, keys, times = state.get if state.exists else (None, [], [])
        seen = dict(zip(keys, times))
        rows = pd.concat(list(parts), ignore_index=True)
        tick = rows["_key"].isna()
        newest_of = (rows.loc[tick].groupby(lot)["_us"].max() // 1000).sort_index()
        rows = rows.loc[~tick].sort_values([lot, "_in"], kind="stable", ignore_index=True)
        # What has been seen before the first lot, the second, and so on; the last one stands for the next micro-batch.
        before = np.maximum.accumulate(np.array([delay_ms if newest is None else newest, *newest_of], dtype="int64"))
        mark = before[np.searchsorted(newest_of.index, rows[lot])] - delay_ms
        late = (rows["_us"] // 1000 <= mark) & (mark > 0)
        again = rows["_key"].isin(seen) | rows["_key"].where(~late).duplicated()
        rows["outcome"] = KEPT
        rows.loc[again, "outcome"] = COPY
        rows.loc[late, "outcome"] = LATE
        fresh = ~late & ~again & (rows["_us"] // 1000 > before[-1] - delay_ms)
        live = {k: us for k, us in seen.items() if us // 1000 > before[-1] - delay_ms}
        live.update(rows.loc[fresh, ["_key", "_us"]].itertuples(index=False, name=None))
        state.update((int(before[-1]), list(live), [int(us) for us in live.values()]))
        yield rows[[*columns, "outcome"]]

    return step


def outcome_counts(tagged: DataFrame) -> DataFrame:
    """Rows of each event type and outcome."""
    return tagged.groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("n"))
