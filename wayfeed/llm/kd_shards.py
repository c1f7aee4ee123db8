"""K-d tree sharding: leaves of near-equal bytes from weighted medians along the widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import n_shuffle, stored

BINS = 1024
DIMENSIONS = {"n_bytes": F.octet_length, "n_chars": F.char_length, "checksum": F.crc32}


@dataclass
class Node:
    """A cell of ``shards`` leaves from ``first`` on; ``cut`` = (dimension, key, tie) sends rows up to it to the left."""

    first: int
    shards: int
    cut: tuple | None = None
    children: list = field(default_factory=list)


def order_key(dimension: str) -> Column:
    """A dimension below 2**31 and then the checksum of the text, so that equal texts stand together."""
    return F.shiftleft(F.least(F.col(dimension), F.lit((1 << 31) - 1)), 32) + F.col("checksum")


def leaf(node: Node) -> Column:
    """First shard of the cell that a row falls in."""
    if node.cut is None:
        return F.lit(node.first)
    dimension, key, tie = node.cut
    own = order_key(dimension)
    goes_left = (own < key) if tie is None else (own < key) | ((own == key) & (F.col("tie") <= tie))
    return F.when(goes_left, leaf(node.children[0])).otherwise(leaf(node.children[1]))


def settings(spark: SparkSession, columns: str, values: list[tuple]) -> DataFrame:
    """An inline table of one row of longs for each open cell; there are fewer cells than shards."""
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(f'{v}L' for v in row) + ')' for row in values)} AS t({columns})"))


def medians(rows: DataFrame, targets: dict[int, float], tolerance: float) -> dict[int, tuple]:
    """For each cell of rows (cell, key, size) where the running weight comes nearest to the target, by zooming histograms.

    Gives (smallest key, largest key, weight, weight still missing before it) of the last bin; its weight is above
    ``tolerance`` only where one single key outweighs it.  Each round is one aggregate of at most ``BINS`` rows a cell.
    """
    spark = rows.sparkSession
    spans = rows.groupBy("cell").agg(F.min("key").alias("a"), F.max("key").alias("b")).collect()
    active = {r["cell"]: (r["a"], r["b"], targets[r["cell"]]) for r in spans}
    found: dict[int, tuple] = {}
    while active:
        zoom = settings(spark, "cell, low, high, width", [(k, a, b, (b - a) // BINS + 1) for k, (a, b, _) in active.items()])
        bins = (
            rows.join(zoom, "cell")
            .filter("key between low and high")
            .groupBy("cell", F.expr("(key - low) div width").alias("bin"))
            .agg(F.sum("size").alias("size"), F.min("key").alias("a"), F.max("key").alias("b"))
            .collect()
        )
        by_cell: dict[int, list] = {}
        for r in sorted(bins, key=lambda r: (r["cell"], r["bin"])):
            by_cell.setdefault(r["cell"], []).append(r)
        following = {}
        for k, own in by_cell.items():
            missing = active[k][2]
            for at, r in enumerate(own):
                if missing < r["size"] or at == len(own) - 1:
                    break
                missing -= r["size"]
            if r["a"] == r["b"] or r["size"] <= tolerance:
                found[k] = (r["a"], r["b"], r["size"], missing)
            else:
                following[k] = (r["a"], r["b"], missing)
        active = following
    return found


def kd_tree(rows: DataFrame, shards: int, dimensions: tuple[str, ...], exact: float = 0.001, whole: float = 0.01) -> Node:
    """The tree over slim rows (size, tie, dimensions), grown level by level; only histograms reach the driver.

    ``exact``: weight, as a share of one shard, below which a cut counts as met; ``whole``: group of equal texts up to
    which it stays on one side.
    """
    spans = rows.agg(F.sum("size").alias("size"), *[F.min(d).alias(f"{d}_a") for d in dimensions], *[F.max(d).alias(f"{d}_b") for d in dimensions]).first()
    root = Node(0, shards)
    if spans["size"] is None:
        return root
    share = spans["size"] / shards
    scale = {d: max(1, spans[f"{d}_b"] - spans[f"{d}_a"]) for d in dimensions}
    level = [root] if shards > 1 else []
    while level:
        placed = rows.withColumn("cell", leaf(root))
        open_cells = [n.first for n in level]
        stats = {
            r["cell"]: r
            for r in placed.filter(F.col("cell").isin(open_cells)).groupBy("cell")
            .agg(F.sum("size").alias("size"), *[(F.max(d) - F.min(d)).alias(d) for d in dimensions]).collect()
        }
        widest = {k: max(dimensions, key=lambda d: (r[d] / scale[d], -dimensions.index(d))) for k, r in stats.items()}
        nodes = {n.first: n for n in level if n.first in stats}
        targets = {k: stats[k]["size"] * (n.shards // 2) / n.shards for k, n in nodes.items()}
        chosen = settings(rows.sparkSession, "cell, along", [(k, dimensions.index(widest[k])) for k in nodes])
        key = F.lit(None).cast("long")
        for number, d in enumerate(dimensions):
            key = F.when(F.col("along") == number, order_key(d)).otherwise(key)
        keyed = placed.join(chosen, "cell").select("cell", "size", "tie", key.alias("key"))
        cuts = medians(keyed, targets, share * exact)
        heavy = {k: c for k, c in cuts.items() if c[0] == c[1] and c[2] > share * whole}
        ties = {}
        if heavy:
            one = settings(rows.sparkSession, "cell, only", [(k, c[0]) for k, c in heavy.items()])
            same = keyed.join(one, "cell").filter("key = only").select("cell", "size", F.col("tie").alias("key"))
            ties = medians(same, {k: c[3] for k, c in heavy.items()}, share * exact)
        following = []
        for k, n in nodes.items():
            a, b, size, missing = cuts[k]
            if k in ties:
                tie_a, tie_b, size, missing = ties[k]
                n.cut = (widest[k], a, tie_b if missing * 2 >= size else tie_a - 1)
            else:
                n.cut = (widest[k], b + 1 if missing * 2 >= size else a, None)
            left = n.shards // 2
            n.children = [Node(n.first, left), Node(n.first + left, n.shards - left)]
            following += [c for c in n.children if c.shards > 1]
        level = following
    return root


def numbered(rows: DataFrame, group: str, slot: str, per_chunk: int = 50_000, order: str = "doc_id") -> DataFrame:
    """Gapless numbers from 0 within each ``group``: rows are numbered in chunks by a hash of ``tie``, after the counts before."""
    n = rows.count()
    chunks = max(1, n // per_chunk // 4)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("tie"), F.lit(chunks)))
    counts = dealt.groupBy(group, "chunk").agg(F.count("*").alias("n"))
    before = counts.alias("x").withColumn(
        "before", F.coalesce(F.sum("n").over(W.Window.partitionBy(group).orderBy("chunk").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    )
    own = F.row_number().over(W.Window.partitionBy(group, "chunk").orderBy(order, "checksum", "tie")) - 1
    return dealt.withColumn("own", own).join(before.select(group, "chunk", "before"), [group, "chunk"]).withColumn(slot, F.col("before") + F.col("own"))


def with_ties(slim: DataFrame, per_block: int = 1000) -> DataFrame:
    """Adds ``tie``, a hash of the row and of its number among rows alike, so that any group of rows can be cut.

    Rows alike are counted and numbered again, a block of numbers at a time, so no group meets in one task.
    """
    columns = slim.columns
    alike = slim.groupBy(*columns).agg(F.count("*").alias("rows"))
    alike = alike.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {per_block}"))))
    alike = alike.repartition(n_shuffle(slim.sparkSession), "doc_id", "checksum", "block")
    first = F.col("block") * per_block
    copies = alike.withColumn("copy", F.explode(F.sequence(first, F.least(F.col("rows"), first + per_block) - 1)))
    return copies.select(*columns, F.shiftright(F.xxhash64("doc_id", "checksum", "size", "copy", F.lit(5)), 2).alias("tie"))


def kd_shards(docs: DataFrame, shards: int = 40, overhead: int = 16, dimensions: dict | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; law ``bytes``.

    Size is the UTF-8 bytes of the text (NULL: none) plus ``overhead``.  Cells split at the weighted median along the
    dimension that is widest against its span in the whole table, until each holds the bytes of one shard.  All default
    dimensions depend on the text alone, so equal texts share a shard unless a cut falls into a group of over a
    hundredth of a shard, which is split by a hash of the id and a number among rows alike.  So rows with NULL ids and
    repeated rows are placed like any other, and may be split; an empty table gives an empty result.
    """
    taken = {name: make for name, make in (dimensions or DIMENSIONS).items()} | {"checksum": F.crc32}
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        *[make(text).cast("long").alias(name) for name, make in taken.items()],
    )
    rows = stored(with_ties(slim), "kd-rows")
    root = kd_tree(rows, shards, tuple(taken))
    placed = rows.withColumn("shard", leaf(root).cast("int"))
    return numbered(placed, "shard", "slot").select(
        "doc_id",
        "size",
        F.col("checksum").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
