"""Helpers the text operators share: shared-folder tables, Arrow text batches, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paths import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: lineage ends there and survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string")) % modulus


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of about ``max_bytes`` of text: the rows, their bytes in one array, and the n + 1 offsets.

    A longer text is a range of its own, so memory is bounded by ``max_bytes`` or one text.  NULL counts as empty.
    """
    texts = batch.column(column).fill_null(b"" if pa.types.is_binary(batch.column(column).type) else "")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def map_text(df: DataFrame, step, schema: str, column: str = "text", max_bytes: int = 2_000_000, setup=None) -> DataFrame:
    """``step(rows, bytes, offsets[, setup()])`` gives a RecordBatch (or None) for each slice of texts."""

    def run(batches):
        extra = (setup(),) if setup else ()
        for batch in batches:
            for rows, data, offsets in text_slices(batch, column, max_bytes):
                out = step(rows, data, offsets, *extra)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at document borders."""
    before = np.empty(len(mask), bool)
    before[:1] = False
    before[1:] = mask[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(mask))]
    before[cut] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(len(mask), bool)
    after[-1:] = False
    after[:-1] = mask[1:]
    after[cut - 1] = False
    return starts, np.flatnonzero(mask & ~after) + 1


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base must be odd."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            filled = 1
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * np.uint64(pow(b, filled, 1 << 64))
                filled *= 2
            pair.append(out)
        held = _powers[base] = (pair[0], pair[1])
    return held[0][:n], held[1][:n]


def prefix_hash(data: np.ndarray, base: int) -> np.ndarray:
    """Sums of (byte + 1) * base**i over prefixes, modulo 2**64; see ``span_hash``."""
    up, _ = powers(base, max(1, len(data)))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of the data behind ``prefix``; equal spans have equal hashes wherever they stand."""
    _, down = powers(base, len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes, for links inside one task."""
    root = np.arange(n)
    if not len(left):
        return root
    while True:
        a, b = root[left], root[right]
        differ = a != b
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def components(edges: DataFrame, purpose: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b longs), for every node of an edge.

    Alternates two steps: every neighbour larger than u is linked to the smallest of u and its neighbours, then every
    neighbour up to u.  Both are a minimum by key, combined before the shuffle, and a join by that key, whose hot keys
    adaptive execution splits.  Ends when the links are stars.  Each round is written to the shared folder.
    """
    links = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), purpose)

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = pairs.join(low, "u")
        if larger:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            own = low.filter("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))
            out = joined.filter("v <= u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(own)
        return out.filter("a <> b").distinct()

    for _ in range(rounds):
        both = links.selectExpr("a as u", "b as v").union(links.selectExpr("b as u", "a as v"))
        wide = star(both, True)
        small = star(wide.selectExpr("a as u", "b as v"), False)
        grown = stored(small, purpose)
        state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state(grown) == state(links):
            break
        links = grown
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.selectExpr("a as node", "b as component").union(links.selectExpr("b as node", "b as component").distinct())
