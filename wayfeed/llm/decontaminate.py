"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_text, prefix_hash, runs, span_hash, stored

BASE = 0xC2B2AE3D27D4EB4F
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (letters, digits and all beyond ASCII; A-Z lower-cased), and where each text's words start (n + 1)."""
    starts, ends = runs(IS_WORD[data], offsets)
    h = span_hash(prefix_hash(LOWER[data], BASE), BASE, starts, ends)
    return h, np.searchsorted(starts, offsets)


@dataclass
class Part:
    """A stretch of a test item of at most half a passage: its words, and how many belong to the question."""

    item: int
    words: np.ndarray
    question: int


@dataclass
class Limits:
    """Passages of ``passage`` words every half passage; ``ratio``: least share of a part's own BM25 score; ``gram``-word
    shingles, of which the share ``overlap`` of a part and ``each`` of its question and of its answer must be in the passage."""

    passage: int = 128
    ratio: float = 0.5
    gram: int = 5
    overlap: float = 0.8
    each: float = 0.5
    k1: float = 1.2
    b: float = 0.75
    block: int = 64


def parts_of(item: int, text: str, limits: Limits) -> list[Part]:
    """The question ends with the first ?, or, without one, two thirds into the words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    w, _ = words(raw, np.array([0, len(raw)]))
    mark = text.find("?")
    if mark >= 0:
        head = np.frombuffer(text[: mark + 1].encode(), np.uint8)
        question = len(words(head, np.array([0, len(head)]))[0])
    else:
        question = (2 * len(w) + 2) // 3
    half = limits.passage // 2
    # The last part of a long item reaches back over the one before, so that no part is a few words only.
    starts = [*range(0, len(w) - half, half), max(0, len(w) - half)] if len(w) else []
    return [Part(item, w[k : k + half], min(max(0, question - k), half)) for k in starts]


@dataclass
class Statistics:
    """Parts of the whole benchmark, their mean length in words, and in how many parts each word of an index stands."""

    parts: int
    mean: float
    df: dict[int, int]


def part_words(items: DataFrame, limits: Limits) -> DataFrame:
    """A row (NULL, length) for each part of the items, and a row (word, NULL) for each distinct word of a part."""

    def step(rows, data, offsets):
        word, length = [], []
        for item, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            for p in parts_of(item, text, limits):
                own = np.unique(p.words).view(np.int64).tolist()
                word += [None, *own]
                length += [len(p.words), *[None] * len(own)]
        return pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(length, pa.int64())], ["word", "length"])

    return map_text(items, step, "word long, length long", max_bytes=500_000)


class Index:
    """Postings (part, impact) by word, in blocks with their largest impact; impacts are shares of the part's own score.

    ``statistics``: those of the whole benchmark, of which ``parts`` may be a block.
    """

    def __init__(self, parts: list[Part], limits: Limits, statistics: Statistics):
        self.parts, self.limits = parts, limits
        n, mean, df = statistics.parts, statistics.mean, statistics.df
        self.postings: dict[int, list[tuple[int, float]]] = {}
        essential, self.spare = [], np.zeros(len(parts))
        for k, p in enumerate(parts):
            terms, tf = np.unique(p.words, return_counts=True)
            own = {}
            for t, f in zip(terms.tolist(), tf.tolist()):
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                own[t] = idf * f * (limits.k1 + 1) / (f + limits.k1 * (1 - limits.b + limits.b * len(p.words) / mean))
            total = sum(own.values())
            for t, s in own.items():
                self.postings.setdefault(t, []).append((k, s / total))
            # A part's most telling words whose absence rules it out: the others alone stay below the ratio.
            left = 1.0
            for s, t in sorted(((s / total, t) for t, s in own.items()), reverse=True):
                if left < limits.ratio * 0.6:
                    break
                essential.append((t, k, s))
                left -= s
            self.spare[k] = left
        self.blocks = {
            t: [(own[i : i + limits.block], own[min(i + limits.block, len(own)) - 1][0], max(s for _, s in own[i : i + limits.block])) for i in range(0, len(own), limits.block)]
            for t, own in self.postings.items()
        }
        self.most = {t: max(b[2] for b in blocks) for t, blocks in self.blocks.items()}
        essential.sort()
        self.e_term = np.array([e[0] for e in essential], np.uint64)
        self.e_part = np.array([e[1] for e in essential], np.int64)
        self.e_share = np.array([e[2] for e in essential])
        self.terms = np.unique(self.e_term)
        self.e_first = np.searchsorted(self.e_term, self.terms)
        self.e_count = np.searchsorted(self.e_term, self.terms, side="right") - self.e_first
        self.shingles = [self.grams(p.words) for p in parts]

    def grams(self, w: np.ndarray) -> np.ndarray:
        n = min(self.limits.gram, len(w))
        h = np.zeros(max(0, len(w) - n + 1), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + w[k : len(h) + k]
        return h

    def search(self, passage: set[int]) -> list[tuple[int, float]]:
        """All parts whose score reaches the ratio, by block-max WAND over the passage's words."""
        least = self.limits.ratio - 1e-9
        cursors = [[0, 0, t] for t in passage if t in self.blocks]  # block, place in it, term

        def at(c):
            return self.blocks[c[2]][c[0]][0][c[1]][0]

        def seek(c, part):
            """Move a cursor to the first posting at or beyond ``part``, skipping whole blocks; False at the end."""
            blocks = self.blocks[c[2]]
            while c[0] < len(blocks) and blocks[c[0]][1] < part:
                c[0], c[1] = c[0] + 1, 0
            if c[0] == len(blocks):
                return False
            own = blocks[c[0]][0]
            while own[c[1]][0] < part:
                c[1] += 1
            return True

        found = []
        while cursors:
            cursors.sort(key=at)
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                return found
            part = at(cursors[pivot])
            while pivot + 1 < len(cursors) and at(cursors[pivot + 1]) == part:
                pivot += 1
            upper, beyond = 0.0, None
            for c in cursors[: pivot + 1]:
                blocks, k = self.blocks[c[2]], c[0]
                while k < len(blocks) and blocks[k][1] < part:
                    k += 1
                if k < len(blocks):
                    upper += blocks[k][2]
                    beyond = blocks[k][1] if beyond is None else min(beyond, blocks[k][1])
            if upper >= least:
                live = [c for c in cursors[: pivot + 1] if seek(c, part)]
                here = [c for c in live if at(c) == part]
                score = sum(self.blocks[c[2]][c[0]][0][c[1]][1] for c in here)
                if score >= least:
                    found.append((part, score))
                target = part + 1
            else:
                target = max(part + 1, (beyond if beyond is not None else part) + 1)
                if pivot + 1 < len(cursors):
                    target = max(part + 1, min(target, at(cursors[pivot + 1])))
                live = cursors[: pivot + 1]
            cursors = [c for c in live if seek(c, target)] + cursors[pivot + 1 :]
        return found

    def verified(self, part: int, passage: np.ndarray) -> float:
        """Share of the part's shingles in the passage, or 0 if its question or its answer is not there."""
        own, p = self.shingles[part], self.parts[part]
        held = np.isin(own, self.grams(passage) if len(p.words) >= self.limits.gram else self.windows(passage, len(p.words)))
        share = held.mean()
        middle = np.arange(len(own)) + min(self.limits.gram, len(p.words)) // 2
        for side in (held[middle < p.question], held[middle >= p.question]):
            if len(side) and side.mean() < self.limits.each:
                return 0.0
        return float(share) if share >= self.limits.overlap else 0.0

    def windows(self, w: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(max(0, len(w) - n + 1), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + w[k : len(h) + k]
        return h

    def candidates(self, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Passages (places in ``passages``) that can reach the ratio for some part, by its essential words and the rest in full."""
        passages = self.passages(first)
        if not len(self.terms) or not len(w):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, w), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == w)
        at = at[hit]
        n = self.e_count[at]
        place = np.repeat(self.e_first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        part, share, where = self.e_part[place], self.e_share[place], np.repeat(hit, n)
        # A word stands in the last passage that starts at or before it, and in the one before if that reaches it.
        last = np.searchsorted(passages[0], where, side="right") - 1
        twice = (last > 0) & (passages[1][np.maximum(last - 1, 0)] > where)
        key = np.concatenate([last, last[twice] - 1]) * len(self.parts) + np.concatenate([part, part[twice]])
        keys, which = np.unique(key, return_inverse=True)
        total = np.bincount(which, np.concatenate([share, share[twice]]), len(keys))
        keep = total + self.spare[keys % len(self.parts)] >= self.limits.ratio - 1e-9
        return np.unique(keys[keep] // len(self.parts))

    def passages(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, in words, of the passages of all texts; the last of a text may be short."""
        half = self.limits.passage // 2
        n = np.diff(first)
        many = np.maximum(1, (n + half - 1) // half - 1) * (n > 0)
        text = np.repeat(np.arange(len(n)), many)
        starts = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * half
        return starts, np.minimum(starts + self.limits.passage, first[text + 1])


def matches(docs: DataFrame, items: DataFrame, limits: Limits | None = None, block_items: int = 20_000) -> DataFrame:
    """doc_id, row (a number for each row of docs), item_id, score, overlap of each test item found in a text.

    Each passage is a query: its words bound the score of every part from above, and passages that can reach the ratio
    search the index; what is found must share the shingles of question and answer.  The items are indexed and
    broadcast in blocks of about ``block_items``, each passing over all texts, so a large benchmark needs more passes,
    not more memory.  BM25 statistics are counted over all items first, so blocks change neither scores nor finds.
    """
    limits = limits or Limits()
    spark = docs.sparkSession
    fine = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    blocks = max(1, math.ceil(fine.count() / block_items))
    listed = stored(part_words(fine, limits), "benchmark-words")
    count, total = listed.filter("word is null").agg(F.count("*"), F.sum("length")).first()
    frequency = listed.filter("word is not null").groupBy("word").agg(F.count("*").alias("df"))
    if blocks > 1:
        frequency = stored(frequency, "benchmark-df")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for block in range(blocks):
        own = fine.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = own.orderBy("item_id", "text").collect()
        if blocks > 1:
            known = frequency.join(part_words(own, limits).select("word").distinct(), "word").select("word", "df").toArrow()
        else:
            known = frequency.select("word", "df").toArrow()
        df = dict(zip(known["word"].to_numpy().view(np.uint64).tolist(), known["df"].to_pylist()))
        parts = [p for r in rows for p in parts_of(r["item_id"], r["text"], limits)]
        index = Index(parts, limits, Statistics(count, (total or 0) / max(1, count), df))
        shared = spark.sparkContext.broadcast(index)

        def step(batch, data, offsets, shared=shared):
            index = shared.value
            w, first = words(data, offsets)
            starts, ends = index.passages(first)
            best: dict[tuple[int, int], tuple[float, float]] = {}
            for k in index.candidates(w, first).tolist():
                passage = w[starts[k] : ends[k]]
                for part, score in index.search(set(passage.tolist())):
                    share = index.verified(part, passage)
                    if share:
                        key = int(np.searchsorted(first, starts[k], side="right") - 1), index.parts[part].item
                        best[key] = max(best.get(key, (0.0, 0.0)), (score, share))
            if not best:
                return None
            place = pa.array([k[0] for k in best])
            columns = [batch.column(0).take(place), batch.column(2).take(place), [k[1] for k in best], [v[0] for v in best.values()], [v[1] for v in best.values()]]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "row", "item_id", "score", "overlap"])

        source = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
        found = map_text(source, step, f"doc_id {kind}, row long, item_id long, score double, overlap double", max_bytes=500_000)
        out = found if out is None else out.union(found)
    return out


def contaminated(docs: DataFrame, items: DataFrame, limits: Limits | None = None, block_items: int = 20_000) -> DataFrame:
    """doc_id, n_items, item_ids (sorted), best_score, best_overlap, contaminated for every document id, NULL among them.

    Rows with the same id are one document.  NULL and empty texts are clean; an empty benchmark finds nothing.
    """
    found = matches(docs, items, limits, block_items).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("score").alias("best_score"), F.max("overlap").alias("best_overlap")
    )
    own = docs.select(F.col("doc_id").alias("own")).distinct()
    joined = own.join(found, F.col("own").eqNullSafe(F.col("doc_id")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return joined.select(
        F.col("own").alias("doc_id"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"),
        F.coalesce("best_overlap", F.lit(0.0)).alias("best_overlap"), (F.size(ids) > 0).alias("contaminated"),
    )
