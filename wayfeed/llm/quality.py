"""Quality classifier: hashed word n-grams, logistic regression trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, id_remainder, map_text, mixed, prefix_hash, runs, span_hash, text_or_empty

BASE = 0x9E3779B97F4A7C15
BITS = 18
SCALE = 20.0
IS_MARK = np.zeros(256, bool)
IS_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
IS_UPPER = np.zeros(256, bool)
IS_UPPER[65:91] = True


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature of every n-gram in the texts, and where each text's features start (n + 1).

    Tokens are runs of letters and digits, lower-cased, and runs of marks.  N-grams: one and two words; one to three
    shapes, a shape being the marks themselves or how a word is written (and whether it repeats the last word).
    """
    space = IS_SPACE[data]
    mark = IS_MARK[data] & ~space
    ws, we = runs(~space & ~mark, offsets)
    ms, me = runs(mark, offsets)
    starts, ends = np.concatenate([ws, ms]), np.concatenate([we, me])
    is_word = np.arange(len(starts)) < len(ws)
    order = np.argsort(starts, kind="stable")
    starts, ends, is_word = starts[order], ends[order], is_word[order]
    prefix = prefix_hash(LOWER[data], BASE)
    token = span_hash(prefix, BASE, starts, ends)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    caps = np.concatenate([[0], np.cumsum(IS_UPPER[data])])
    n_caps, length = caps[ends] - caps[starts], ends - starts
    shape = np.where(n_caps == 0, 1, np.where(n_caps == length, np.where(length > 1, 3, 2), np.where(n_caps == 1, 2, 4))).astype(np.uint64)
    repeats = np.zeros(len(token), bool)
    repeats[1:] = is_word[1:] & (token[1:] == token[:-1]) & (doc[1:] == doc[:-1])
    shape[repeats] += np.uint64(8)
    shape = np.where(is_word, shape, token)

    def grams(kind: int, values: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(values) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.full(len(values) - n + 1, kind, np.uint64)
        for k in range(n):
            h = mixed(h ^ values[k : len(values) - n + 1 + k])
        same = docs[: len(h)] == docs[n - 1 :]
        return h[same], docs[: len(h)][same]

    word, word_doc = token[is_word], doc[is_word]
    found = [grams(1, word, word_doc, 1), grams(2, word, word_doc, 2)] + [grams(10 + n, shape, doc, n) for n in (1, 2, 3)]
    h = (np.concatenate([f[0] for f in found]) >> np.uint64(64 - bits)).astype(np.int32)
    of = np.concatenate([f[1] for f in found])
    by = np.argsort(of, kind="stable")
    return h[by], np.searchsorted(of[by], np.arange(len(offsets)))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights of FTRL-proximal over (features, values, label), in the given order; the last weight is the bias."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, x, y in examples:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange((1 << bits) + 1))


def train(
    labelled: DataFrame, sample: int = 12_000, shards: int = 4, bits: int = BITS, epochs: int = 3,
    alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02,
) -> np.ndarray:
    """Weights from rows (doc_id, text, label 0 or 1), of which the bounded ``sample`` with the smallest id hashes counts.

    Each of ``shards`` tasks trains on its part, and the weights are averaged on the driver (``shards`` vectors of fixed
    size).  Without any label all weights are 0.
    """

    def fit(rows):
        table = rows.select(["doc_id", "text", "label"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        examples = []
        for text, label in zip(table.column("text").to_pylist(), table.column("label").to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            f, _ = features(data, np.array([0, len(data)]), bits)
            i, c = np.unique(f, return_counts=True)
            x = c * (SCALE / max(1, len(f)))
            examples.append((np.append(i, 1 << bits), np.append(x, 1.0), label))
        order = np.random.default_rng(7).permutation(len(examples))
        w = ftrl([examples[k] for k in order], bits, epochs, alpha, beta, l1, l2)
        return pa.table({"n": pa.array([len(examples)], pa.int64()), "w": pa.array([w.astype(np.float64).tobytes()], pa.binary())})

    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) if sample else labelled
    dealt = chosen.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)))
    found = dealt.groupBy("shard").applyInArrow(fit, "n long, w binary").collect()
    if not found:
        return np.zeros((1 << bits) + 1)
    return np.average([np.frombuffer(r["w"]) for r in found], axis=0, weights=[r["n"] for r in found])


def training_rows(docs: DataFrame, labels: DataFrame, column: str = "quality", fold: int = 5, held_out: int = 0, sample: int = 12_000) -> DataFrame:
    """(doc_id, text, label) for at most ``sample`` labelled ids outside the held-out fold.

    The ids come from ``labels`` alone, so only the few chosen ones meet the texts.  An id with several labels has their
    smallest; labels other than 0 and 1, and NULL ids, do not count.
    """
    known = (
        labels.filter(F.col(column).isin(0, 1) & (id_remainder(F.col("doc_id"), fold) != held_out))
        .groupBy("doc_id")
        .agg(F.min(column).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, bits: int = BITS) -> DataFrame:
    """``docs`` as it is, with score (0 to 1) and predicted (1 if score >= threshold, else 0) of every whole text.

    Each score is one sparse dot product, of that text alone: repeated texts have equal scores wherever they lie.  A NULL
    text counts as empty and gets the score of the bias; columns named ``score`` and ``predicted`` are replaced, all others kept;
    an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    taken = docs.drop("score", "predicted")

    def step(rows, data, offsets):
        w = shared.value
        f, first = features(data, offsets, bits)
        size = np.diff(first)
        filled, sums = np.flatnonzero(size), np.zeros(len(size))
        if len(filled):
            sums[filled] = np.add.reduceat(w[f].astype(np.float64), first[filled])
        z = w[1 << bits] + sums * SCALE / np.maximum(1, size)
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*rows.schema.names, "score", "predicted"]
        )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields)
    return map_text(taken, step, f"{schema}, score double, predicted int", max_bytes=500_000)
