"""Language identification by interpolated Kneser-Ney character models held in sorted arrays."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, text_or_empty

ORDER = 4
CODES = 1 << 16


@functools.cache
def letters() -> np.ndarray:
    """Lower-case code of each letter of the basic plane, 0x20 for anything else; rarer planes are one letter, 0xFFFF."""
    out = np.full(CODES + 1, 0x20, np.uint64)
    for c in range(CODES):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    out[CODES] = 0xFFFF
    return out


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, and which text each belongs to: letters, runs of all else as one space, ORDER - 1 spaces first."""
    lead = " " * (ORDER - 1)
    joined = "".join(lead + t for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = code >= CODES
    s = letters()[np.minimum(code, CODES)]
    if high.any():
        rare = {c: chr(c).isalpha() for c in np.unique(code[high]).tolist()}
        s[high] = [0xFFFF if rare[c] else 0x20 for c in code[high].tolist()]
    sizes = np.fromiter((len(t) + len(lead) for t in texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts)), sizes)
    begins = np.cumsum(sizes) - sizes
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0x20) | (s[:-1] != 0x20)
    for k in range(len(lead)):
        keep[begins + k] = True
    # The space that follows the lead is one more of its run.
    after = begins + len(lead)
    after = after[sizes > len(lead)]
    keep[after] = s[after] != 0x20
    return s[keep], of[keep]


def grams(s: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol after the lead of its text as a 64-bit code of itself and the ORDER - 1 before it, and its text."""
    if len(s) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(len(s) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        g = (g << np.uint64(16)) | s[k : len(s) - ORDER + 1 + k]
    same = of[: len(g)] == of[ORDER - 1 :]
    return g[same], of[ORDER - 1 :][same]


def tail(g: np.ndarray, n: int) -> np.ndarray:
    return g & np.uint64((1 << (16 * n)) - 1)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class KneserNey:
    """One model: probability of a symbol after up to ORDER - 1 others, lower orders by how many contexts precede them."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.keys, self.left, self.contexts, self.weight, self.norm = {}, {}, {}, {}, {}
        c = counts.astype(np.float64)
        for n in range(ORDER, 0, -1):
            self.keys[n] = codes
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            contexts, which = np.unique(codes >> np.uint64(16), return_inverse=True)
            self.contexts[n] = contexts
            self.norm[n] = np.bincount(which, c, len(contexts))
            self.weight[n] = discount * np.bincount(which, minlength=len(contexts)) / self.norm[n]
            self.left[n] = np.maximum(c - discount, 0)
            # The next lower order counts the distinct symbols before each shorter n-gram.
            codes, c = np.unique(tail(codes, n - 1), return_counts=True)
            c = c.astype(np.float64)
        self.uniform = 1 / (len(self.keys[1]) + 1)

    def probability(self, g: np.ndarray) -> np.ndarray:
        p = np.full(len(g), self.uniform)
        for n in range(1, ORDER + 1):
            own = tail(g, n)
            at, there = find(self.contexts[n], own >> np.uint64(16))
            k, seen = find(self.keys[n], own)
            direct = np.where(seen, self.left[n][k], 0) / self.norm[n][at]
            p = np.where(there, direct + self.weight[n][at] * p, p)
        return p

    def back_off(self, context: np.ndarray, n: int) -> np.ndarray:
        """What is left for lower orders after a context of n - 1 symbols; all if it was never seen."""
        at, there = find(self.contexts[n], context)
        return np.where(there, self.weight[n][at], 1.0)


class Models:
    """Sorted arrays over the n-grams of all languages with the log probability in each."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        own = [KneserNey(*counts[x]) for x in self.languages]
        self.keys, self.logp, self.contexts, self.logw = {}, {}, {}, {}
        for n in range(ORDER, 0, -1):
            union = functools.reduce(np.union1d, [m.keys[n] for m in own])
            self.keys[n] = union
            # Lower-order codes have zeros in front; the model of order n alone is asked by a context it never saw.
            self.logp[n] = np.stack([np.log(self.of_order(m, union, n)) for m in own], axis=1).astype(np.float32)
            contexts = functools.reduce(np.union1d, [m.contexts[n] for m in own])
            self.contexts[n] = contexts
            self.logw[n] = np.stack([np.log(m.back_off(contexts, n)) for m in own], axis=1).astype(np.float32)
        self.uniform = np.log([m.uniform for m in own]).astype(np.float32)

    @staticmethod
    def of_order(model: KneserNey, g: np.ndarray, order: int) -> np.ndarray:
        p = np.full(len(g), model.uniform)
        for n in range(1, order + 1):
            own = tail(g, n)
            at, there = find(model.contexts[n], own >> np.uint64(16))
            k, seen = find(model.keys[n], own)
            p = np.where(there, np.where(seen, model.left[n][k], 0) / model.norm[n][at] + model.weight[n][at] * p, p)
        return p

    def log_probability(self, g: np.ndarray) -> np.ndarray:
        """Rows of log probabilities, one column a language; n-grams that no language has seen take the next lower order."""
        out = np.zeros((len(g), len(self.languages)), np.float32)
        todo = np.arange(len(g))
        for n in range(ORDER, 0, -1):
            own = tail(g[todo], n)
            at, seen = find(self.keys[n], own)
            out[todo[seen]] += self.logp[n][at[seen]]
            todo, own = todo[~seen], own[~seen]
            if not len(todo):
                return out
            at, there = find(self.contexts[n], own >> np.uint64(16))
            out[todo[there]] += self.logw[n][at[there]]
        out[todo] += self.uniform
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability of each text in each language, and whether it has a letter."""
        s, of = symbols(texts)
        g, of = grams(s, of)
        size = np.bincount(of, minlength=len(texts))
        lp = self.log_probability(g)
        sums = np.stack([np.bincount(of, lp[:, k], len(texts)) for k in range(len(self.languages))], axis=1)
        has_letter = np.bincount(of, tail(g, 1) != 0x20, len(texts)) > 0
        return -sums / np.maximum(1, size)[:, None], has_letter


def confidence(entropy: np.ndarray, sharpness: float) -> tuple[np.ndarray, np.ndarray]:
    best = entropy.argmin(axis=1)
    odds = np.exp(-(entropy - entropy.min(axis=1, keepdims=True)) * sharpness)
    return best, 1 / odds.sum(axis=1)


class Detector:
    """Models with the calibration of confidence and rejection."""

    def __init__(self, models: Models, sharpness: float, limits: np.ndarray):
        self.models, self.sharpness, self.limits = models, sharpness, limits


def train(labelled: DataFrame, per_language: int = 2000, accept: float = 0.995) -> Detector | None:
    """A detector from rows (doc_id, text, lang); None without any.

    About ``per_language`` rows of each language are used, picked by a hash of the id.  A fifth of them is kept out of
    the models: on it ``sharpness`` is fitted (least log loss of the right language) and each language's rejection limit
    set so that the share ``accept`` of its texts stays below it.
    """
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000.0
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    spare = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(5)) == 0
    sample = known.filter(part < share).select("text", "lang", F.coalesce(spare, F.lit(False)).alias("spare"))

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            texts = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                g, _ = grams(*symbols([texts[i] for i in np.flatnonzero(langs == lang)]))
                code, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

    rows = sample.filter("not spare").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counted = rows.toArrow()
    langs = np.array(counted.column("lang").to_pylist(), object)
    codes, n = counted.column("code").to_numpy().view(np.uint64), counted.column("n").to_numpy()
    tables = {}
    for lang in sorted(set(langs)):
        own = langs == lang
        order = np.argsort(codes[own])
        tables[lang] = codes[own][order], n[own][order]
    if not tables:
        return None
    models = Models(tables)
    shared = labelled.sparkSession.sparkContext.broadcast(models)

    def measure(batches):
        for batch in batches:
            ce, fine = shared.value.cross_entropies(batch.column(0).to_pylist())
            keep = np.flatnonzero(fine)
            if len(keep):
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(keep)), pa.array(list(ce[keep]), pa.list_(pa.float64()))], ["lang", "ce"])

    held = [(r["lang"], r["ce"]) for r in sample.filter("spare").select("text", "lang").mapInArrow(measure, "lang string, ce array<double>").collect()]
    held = [(models.languages.index(lang), ce) for lang, ce in held if lang in tables]
    if not held:
        return Detector(models, 20.0, np.full(len(models.languages), np.inf))
    right, ce = np.array([x for x, _ in held]), np.array([x for _, x in held])

    def loss(k):
        z = -(ce - ce.min(axis=1, keepdims=True)) * k
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), right]))

    sharpness = min((2.0**k for k in np.arange(0, 8.1, 0.25)), key=loss)
    limits = np.array([np.quantile(ce[right == k, k], accept) if (right == k).any() else np.inf for k in range(len(models.languages))])
    return Detector(models, sharpness, limits)


def detect(docs: DataFrame, detector: Detector | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected for every whole text.

    The language with the lowest cross-entropy a symbol wins; the smaller name wins a tie.  ``score`` is the calibrated
    share of the winner.  ``rejected``: the entropy is above the winner's limit.  A text that is NULL or has no letter
    (or any text, without a detector) is ``und`` with score 0, no entropy, and is rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def step(rows, data, offsets):
        d = shared.value
        texts = rows.column(1).to_pylist()
        if d is None:
            k = len(texts)
            found = [["und"] * k, np.zeros(k), pa.nulls(k, pa.float64()), np.ones(k, bool)]
        else:
            ce, fine = d.models.cross_entropies(texts)
            best, share = confidence(ce, d.sharpness)
            names = [d.models.languages[b] if f else "und" for b, f in zip(best, fine)]
            low = ce.min(axis=1)
            found = [names, np.where(fine, share, 0.0), pa.array(low, mask=~fine), ~fine | (low > d.limits[best])]
        return pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, found)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", text_or_empty().alias("text"))
    return map_text(source, step, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean", max_bytes=500_000)
