"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_shuffle, stored

CAPACITIES = (512, 1024, 2048, 4096)


def words_and_end(text: Column) -> Column:
    """Number of white-space separated words and one end mark."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long") + 1


def price(capacity: int) -> float:
    """Cost of training on one sequence: linear work and attention, which grows with the square."""
    return capacity + capacity * capacity / 16_384


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost=price) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item (given longest first), and the capacity of each bin.

    An item goes to the open bin that it leaves least room in.  If none has room, the bin size opens whose price for each
    token it may hold is least, counting the item and those still to come that fit beside it.  In the end every bin gets
    the smallest capacity that holds its contents.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    total_upto = [0] * (top + 1)
    for n in lengths:
        total_upto[n] += n
    for n in range(1, top + 1):
        total_upto[n] += total_upto[n - 1]
    remaining = sum(lengths)
    by_room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r is set if some bin has room r
    opened: list[int] = []
    used: list[int] = []
    bins, offsets = [], []
    for n in lengths:
        remaining -= n
        fitting = open_rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            best = None
            for c in capacities:
                if c >= n:
                    beside = min(c - n, total_upto[c - n] if c - n < n else remaining, remaining)
                    rate = cost(c) / (n + beside)
                    if best is None or rate < best[0]:
                        best = (rate, c)
            k, room = len(opened), best[1]
            opened.append(room)
            used.append(0)
        bins.append(k)
        offsets.append(used[k])
        used[k] += n
        room -= n
        by_room.setdefault(room, []).append(k)
        open_rooms |= 1 << room
    return bins, offsets, [next(c for c in capacities if c >= u) for u in used]


def best_fit(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, per_group: int = 20_000, cost=price) -> DataFrame:
    """doc_id, piece, piece_start, n_tokens, bin_id, bin_offset, bin_tokens, bin_capacity: one row for each piece of a document.

    ``length`` (default: words and an end mark) counts a row's tokens.  A row longer than the largest capacity is cut
    into pieces of that size and a rest; nothing is dropped.  Pieces are dealt by a hash of id, length and a number among
    rows alike into groups of about ``per_group`` pieces, and each group is packed by one task, so no task or shuffle
    partition grows with the input, also where many rows have one id or none or few rows are huge.  An empty
    or NULL text is one token; repeated rows are packed each; an empty table gives an empty result.
    """
    top = max(capacities)
    n = length if length is not None else words_and_end(F.col("text"))
    sized = docs.select("doc_id", F.greatest(n.cast("long"), F.lit(1)).alias("total"))
    # Rows of one id and length are alike here: they are counted and numbered, a block of numbers at a time, so that the
    # rows of one id (or none) spread over tasks and groups.
    alike = stored(sized.groupBy("doc_id", "total").agg(F.count("*").alias("rows")), "packing")
    n_pieces = alike.agg(F.sum(F.col("rows") * F.expr(f"(total - 1) div {top} + 1"))).first()[0] or 0
    groups = max(1, math.ceil(n_pieces / per_group))
    alike = alike.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(rows - 1) div 1000"))))
    alike = alike.repartition(n_shuffle(docs.sparkSession), "doc_id", "total", "block")
    sized = alike.withColumn("copy", F.explode(F.sequence(F.col("block") * 1000, F.least(F.col("rows"), F.col("block") * 1000 + 1000) - 1)))
    pieces = sized.select(
        "doc_id", "total", "copy", F.explode(F.sequence(F.lit(0), ((F.col("total") - 1) / top).cast("int"))).alias("piece")
    ).select("doc_id", "total", "copy", "piece", (F.col("piece").cast("long") * top).alias("piece_start"), F.least(F.lit(top).cast("long"), F.col("total") - F.col("piece").cast("long") * top).alias("n_tokens"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets, sizes = pack(rows["n_tokens"].tolist(), capacities, cost)
        rows["bin_id"] = rows["pack"] * (1 << 32) + pd.Series(bins, dtype="int64")
        rows["bin_offset"] = pd.Series(offsets, dtype="int64")
        rows["bin_tokens"] = rows.groupby("bin_id")["n_tokens"].transform("sum")
        rows["bin_capacity"] = pd.Series([sizes[k] for k in bins], dtype="int64")
        return rows.drop(columns="pack")

    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64("doc_id", "piece", "total", "copy"), F.lit(groups))).drop("total", "copy")
    schema = f"doc_id {kind}, piece int, piece_start long, n_tokens long, bin_id long, bin_offset long, bin_tokens long, bin_capacity long"
    return dealt.groupBy("pack").applyInPandas(run, schema)
