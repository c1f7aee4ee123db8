"""Exact ranked lexical search: documents against all items of a set, by dense blocked matrix products."""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_text, stored

#: Bytes of a term stay, A to Z in lower case; all others become a space.
FOLD = np.full(256, 0x20, np.uint8)
for low, high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    FOLD[low:high] = np.arange(low, high)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
#: No term of a document adds more than this to a score for each unit of weight.
TOP_IMPACT = 1_000_000
EXACT = 1 << 53
SALTS = 16


def term_bytes(text: str) -> list[bytes]:
    return FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes().split()


class Block(NamedTuple):
    """Weights of some items over their own terms: entries sorted by column, each with its item and weight."""

    first: int  # number of the first item
    items: int
    terms: np.ndarray  # number in the vocabulary of each column, ascending
    column: np.ndarray
    item: np.ndarray
    weight: np.ndarray


def blocks_of(term_sets: list[np.ndarray], weight: np.ndarray, first: int, per_block: int) -> list[Block]:
    out = []
    for low in range(0, len(term_sets), per_block):
        part = term_sets[low : low + per_block]
        entries = np.concatenate(part)
        item = np.repeat(np.arange(len(part)), [len(t) for t in part])
        worth = weight[entries] > 0
        terms, column = np.unique(entries[worth], return_inverse=True)
        order = np.argsort(column, kind="stable")
        out.append(Block(first + low, len(part), terms, column[order], item[worth][order], weight[entries][worth][order].astype(np.float64)))
    return out


def tile_width(largest_weight: float, most: int) -> int:
    """Columns whose products can be summed in float64 in any order without rounding: all sums stay below 2^53."""
    return max(1, min(most, (EXACT - 1) // max(1, int(largest_weight) * TOP_IMPACT)))


def products(block: Block, document: np.ndarray, term: np.ndarray, impact: np.ndarray, documents: int, most: int) -> np.ndarray:
    """Scores (documents x items) as int64: tiles of the terms that both sides have, multiplied densely, summed as integers."""
    scores = np.zeros((documents, block.items), np.int64)
    if not len(block.terms) or not len(term):
        return scores
    column = np.minimum(np.searchsorted(block.terms, term), len(block.terms) - 1)
    known = block.terms[column] == term
    document, column, impact = document[known], column[known], impact[known]
    used, compact = np.unique(column, return_inverse=True)
    width = tile_width(block.weight.max(), most)
    for low in range(0, len(used), width):
        tile = used[low : low + width]
        mine = (compact >= low) & (compact < low + len(tile))
        impacts = np.zeros((documents, len(tile)))
        impacts[document[mine], compact[mine] - low] = impact[mine]
        place = np.minimum(np.searchsorted(tile, block.column), len(tile) - 1)
        theirs = tile[place] == block.column
        weights = np.zeros((len(tile), block.items))
        weights[place[theirs], block.item[theirs]] = block.weight[theirs]
        scores += (impacts @ weights).astype(np.int64)
    return scores


class Top:
    """The k best documents of each item of a block so far; equal scores by ascending id, rows without an id last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.floor = k, np.ones(items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        floor = self.floor
        if len(scores) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        row, item = np.nonzero(scores >= floor)  # with all ties of the k-th
        if not len(row):
            return
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[row, item[len(self.item) :]]])
        doc, none = np.concatenate([self.doc, doc[row]]), np.concatenate([self.none, none[row]])
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        start = np.searchsorted(item, np.arange(len(self.floor) + 1))
        best = order[np.arange(len(item)) - start[item] < self.k]
        full = np.flatnonzero(np.diff(start) >= self.k)
        self.floor[full] = np.maximum(1, score[order[start[full] + self.k - 1]])
        self.item, self.score, self.doc, self.none = item[np.arange(len(item)) - start[item] < self.k], score[best], doc[best], none[best]


def length_norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """100 - 50 + (50 n N) div L of each document; in whole numbers of any size."""
    return np.array([50 + 50 * int(x) * documents // terms for x in n], np.int64)


def term_impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * norm)


def matches(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, counts: number of all terms of each document that has any, and those of the vocabulary in it."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def step(rows, data, offsets):
        number = held.value
        raw, keep, n, size, terms, counts = FOLD[data].tobytes(), [], [], [0], [], []
        for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
            words = raw[a:b].split()
            if not words:
                continue
            tf = Counter(words)
            both = tf.keys() & number.keys()
            keep.append(i)
            n.append(len(words))
            terms.extend(map(number.__getitem__, both))
            counts.extend(map(tf.__getitem__, both))
            size.append(len(terms))
        at = pa.array(size, pa.int32())
        columns = [rows.column("doc_id").take(pa.array(keep, pa.int32())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_text(source, step, "doc_id long, n long, terms array<int>, counts array<long>")


def tops(found: DataFrame, blocks: list[Block], k: int, documents: int, terms: int, tile_docs: int, tile_terms: int) -> DataFrame:
    """item, doc_id, score: the k best documents of each item among those of each task."""
    held = found.sparkSession.sparkContext.broadcast(blocks)

    def run(batches):
        blocks = held.value
        best = [Top(b.items, k) for b in blocks]
        for batch in batches:
            for low in range(0, batch.num_rows, tile_docs):
                part = batch.slice(low, tile_docs)
                ids, lists, counts = part.column("doc_id"), part.column("terms"), part.column("counts")
                size = np.diff(np.asarray(lists.offsets))
                document = np.repeat(np.arange(part.num_rows), size)
                norm = length_norm(part.column("n").to_numpy(), documents, terms)
                impact = term_impacts(counts.flatten().to_numpy(), norm[document]).astype(np.float64)
                none, doc = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                term = lists.flatten().to_numpy()
                for block, top in zip(blocks, best):
                    top.add(products(block, document, term, impact, part.num_rows, tile_terms), doc, none)
        for block, top in zip(blocks, best):
            columns = [pa.array(block.first + top.item), pa.array(top.doc, mask=top.none), pa.array(top.score)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return found.mapInArrow(run, "item long, doc_id long, score long")


def first_k(ranked: DataFrame, k: int) -> DataFrame:
    """item, rank, doc_id, score.  A first cut by item and salt bounds what one task gets for an item in the second."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    cut = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, group_bytes: int = 16_000_000, pass_items: int = 16_384, per_block: int = 256, tile_docs: int = 1024, tile_terms: int = 4096
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each row of ``items``.

    Terms are runs of digits, ASCII letters (in lower case) and characters beyond ASCII, in whole texts.  All statistics
    cover all documents.  The score of a document sums w * ((10^9 tf) div (1000 tf + 20 m)) over an item's distinct terms.

    One pass over the texts keeps, for each document, the terms that some item has, and stores them in the shared folder.
    Then tiles of ``tile_docs`` documents are multiplied with blocks of ``per_block`` items, in float64 over the terms
    that both have, at most ``tile_terms`` and so many that no sum reaches 2^53; tiles are added as integers, so scores are exact.
    Each tile keeps every document that ties with its k-th best; each task hands over k rows an item.

    Item texts are worked on once each however often they repeat, in groups of ``group_bytes`` at most (or one text),
    of which the driver holds one at a time and broadcasts its vocabulary and weights; each group is one pass over the
    documents and each ``pass_items`` of it one over the stored terms.  Groups do not change scores.  Items without terms and
    documents without any shared term give no row.  A NULL text has no terms; a row without doc_id ranks after
    others of its score; repeated rows are documents of their own; other columns are ignored; ids of items may have any
    type, repeat or be NULL (one result for each row); empty tables give an empty result.
    """
    spark = docs.sparkSession
    texts = items.select("text").filter("text is not null").distinct()
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = 1 if total <= group_bytes else math.ceil(2 * total / group_bytes)
    results, numbered, first = [], [], 0
    for group in range(groups):
        part = sorted(r.text for r in texts.filter(F.pmod(F.xxhash64("text"), F.lit(groups)) == group).toLocalIterator())
        vocabulary: dict[bytes, int] = {}
        term_sets = []
        for text in part:
            term_sets.append(np.unique(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in term_bytes(text)], np.int32)))
        if not vocabulary:
            continue
        found = stored(matches(docs, vocabulary), "ranked-search")
        documents, terms = found.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(vocabulary), np.int64)
        held = found.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        df[held["term"].to_numpy()] = held["count"].to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        for low in range(0, len(part), pass_items):
            blocks = blocks_of(term_sets[low : low + pass_items], weight, first + low, per_block)
            results.append(first_k(tops(found, blocks, k, documents, terms or 1, tile_docs, tile_terms), k))
        numbered.append(spark.createDataFrame([(first + i, text) for i, text in enumerate(part)], "item long, text string"))
        first += len(part)
    kind = items.schema["item_id"].dataType.simpleString()
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    union = lambda frames: frames[0] if len(frames) == 1 else union(frames[: len(frames) // 2]).unionByName(union(frames[len(frames) // 2 :]))
    named = items.select("item_id", "text").join(union(numbered), "text").select("item_id", "item")
    return union(results).join(named, "item").select("item_id", "rank", "doc_id", "score")
