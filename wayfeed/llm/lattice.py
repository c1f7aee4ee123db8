"""Language-model scores from a subword lattice: all segmentations of a text into pieces of a given vocabulary count."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, mixed, prefix_hash, span_hash, stored, text_or_empty, text_slices

BASE = 0x9E3779B97F4A7C15
START = 0x20  # stands before each word; words hold no white space
LONG = 96  # longer words are taken one by one
SLOTS = 20
MARK = "▁"


class Pieces:
    """The vocabulary as byte strings (a leading word mark is one START), one byte each included, and prior weights.

    The model file's scores are ranks of merges, so the prior of a piece falls with its rank; a byte that no piece spells
    has the prior of the last rank.  ``end`` is one piece more.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores: dict[bytes, float] = {}
        for i in range(model.vocab_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            piece = model.id_to_piece(i)
            body = piece[1:] if piece.startswith(MARK) else piece
            if MARK in body or any(c.isspace() and ord(c) < 128 for c in body):
                continue
            raw = (b" " if piece.startswith(MARK) else b"") + body.encode()
            if raw:
                scores[raw] = max(scores.get(raw, -np.inf), model.get_score(i))
        last = 1.0 + max((-s for s in scores.values() if -s < 1e8), default=1.0)
        for b in range(256):
            scores.setdefault(bytes([b]), -last)
        self.texts = sorted(scores)
        prior = np.array([1 / (2 + min(-scores[p], last)) for p in self.texts] + [1 / last])
        self.prior = prior / prior.sum()
        self.end = len(self.texts)
        self.ids = {p: k for k, p in enumerate(self.texts)}
        self.longest = max(map(len, self.texts))
        self.lengths = sorted({len(p) for p in self.texts})
        weights = [pow(BASE, k, 1 << 64) for k in range(self.longest)]
        self.keys = np.array([sum((b + 1) * w for b, w in zip(p, weights)) % (1 << 64) for p in self.texts], np.uint64)
        # Each piece's slot by the upper bits of its mixed key; the few that share a slot are searched.
        self.slot = np.full(1 << SLOTS, -1, np.int32)
        slots = (mixed(self.keys) >> np.uint64(64 - SLOTS)).astype(np.int64)
        self.slot[slots] = np.arange(len(slots))
        self.crowded = np.zeros(1 << SLOTS, bool)
        values, n = np.unique(slots, return_counts=True)
        self.crowded[values[n > 1]] = True
        self.order = np.argsort(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece number of each hash, or -1."""
        at = (mixed(keys) >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = self.slot[at].astype(np.int64)
        out[(out >= 0) & (self.keys[np.maximum(out, 0)] != keys)] = -1
        crowd = np.flatnonzero(self.crowded[at])
        if len(crowd):
            place = np.minimum(np.searchsorted(self.keys[self.order], keys[crowd]), len(self.order) - 1)
            k = self.order[place]
            out[crowd] = np.where(self.keys[k] == keys[crowd], k, -1)
        return out


def edges(x: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Lattice edges (from, to, rows, pieces) in order of their ends; words are columns of bytes, padded below ``sizes``."""
    n = len(x)
    up = np.array([pow(BASE, k, 1 << 64) for k in range(n)], np.uint64)
    down = np.array([pow(pow(BASE, k, 1 << 64), -1, 1 << 64) for k in range(n)], np.uint64)
    prefix = np.zeros((n + 1, x.shape[1]), np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:, None], axis=0, out=prefix[1:])
    found = []
    for size in pieces.lengths:
        if size > n:
            break
        k = pieces.find(((prefix[size:] - prefix[:-size]) * down[: n - size + 1, None]).ravel())
        own = np.flatnonzero(k >= 0)
        at, row = np.divmod(own, x.shape[1])
        inside = at + size <= sizes[row]
        found.append((at[inside], np.full(inside.sum(), size), row[inside], k[own[inside]]))
    at, size, row, k = (np.concatenate(c) for c in zip(*found))
    key = (at + size) * (n + 1) + size
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    return [(int(at[g[0]]), int(at[g[0]] + size[g[0]]), row[g], k[g]) for g in np.split(order, cuts)]


def forward(n: int, count: int, found: list, logw: np.ndarray) -> np.ndarray:
    """Log of the summed weights of all ways to reach each place (n + 1, count)."""
    alpha = np.full((n + 1, count), -np.inf)
    alpha[0] = 0.0
    for at, to, rows, k in found:
        alpha[to, rows] = np.logaddexp(alpha[to, rows], alpha[at, rows] + logw[k])
    return alpha


def long_word(word: bytes, pieces: Pieces, logw: np.ndarray, counts: np.ndarray | None = None, weight: float = 0.0) -> float:
    """The same recursion for one word of any length; adds ``weight`` times the expected pieces to ``counts``."""
    n = len(word)
    alpha, own = [0.0] + [-math.inf] * n, []
    for to in range(1, n + 1):
        terms = []
        for size in pieces.lengths:
            if size > to:
                break
            k = pieces.ids.get(word[to - size : to])
            if k is not None:
                terms.append(alpha[to - size] + logw[k])
                own.append((to - size, to, k))
        top = max(terms)
        alpha[to] = top + math.log(sum(math.exp(t - top) for t in terms))
    if counts is not None:
        beta = [-math.inf] * n + [0.0]
        for at, to, k in reversed(own):
            here = beta[to] + logw[k]
            counts[k] += weight * math.exp(min(0.0, alpha[at] + here - alpha[n]))
            a, b = max(beta[at], here), min(beta[at], here)
            beta[at] = a + math.log1p(math.exp(b - a)) if b > -math.inf else a
    return alpha[n]


def word_scores(words: list[bytes], pieces: Pieces, logw: np.ndarray, counts: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
    """Natural log of the marginal weight of each word over all segmentations; sums expected pieces into ``counts``."""
    out = np.zeros(len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    by_length = np.argsort(lengths, kind="stable")
    short = by_length[lengths[by_length] <= LONG]
    for i in by_length[len(short) :].tolist():
        out[i] = long_word(b" " + words[i], pieces, logw, counts, float(weights[i]) if weights is not None else 0.0)
    for first in range(0, len(short), 8192):
        part = short[first : first + 8192]
        size = lengths[part] + 1
        n = int(size.max())
        x = np.frombuffer(b"".join([(b" " + words[i]).ljust(n, b"\0") for i in part.tolist()]), np.uint8).reshape(len(part), n).T
        found = edges(x, size, pieces)
        alpha = forward(n, len(part), found, logw)
        column = np.arange(len(part))
        whole = alpha[size, column]
        out[part] = whole
        if counts is not None:
            beta = np.full(alpha.shape, -np.inf)
            beta[size, column] = 0.0
            w = weights[part]
            for at, to, rows, piece in reversed(found):
                here = beta[to, rows] + logw[piece]
                share = w[rows] * np.exp(np.minimum(0.0, alpha[at, rows] + here - whole[rows]))
                np.add.at(counts, piece, share)
                beta[at, rows] = np.logaddexp(beta[at, rows], here)
    return out


def lattice_scores(docs: DataFrame, model_path: str, fold: int = 10, held_out: int = 0, rounds: int = 3, prior_weight: float = 1000.0, discount: float | None = 0.75, bucket_bytes: int = 12_000_000, flush_bytes: int = 8_000_000, smoothing: float = 0.1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Tokens are the words (A-Z lower-cased) and one end.  ``score`` is the log10 probability of the text in a model over
    the pieces of ``model_path``: the product over words of the sum over all segmentations, times the end.  Piece weights
    start from the vocabulary's own scores and are fitted to the training texts (crc32 of the id as text mod ``fold`` is
    not ``held_out``) by ``rounds`` of expectation and maximisation over distinct words, smoothed by the start weights with
    ``prior_weight`` pseudo-counts.  With ``discount``, a word of the training texts is one edge more of its lattice, with
    its count less the discount; what the discounts leave is the weight of all other ways, whose pieces are fitted to each
    distinct word once.  Without it (None), pieces are all there is, and words count as often as they occur.
    ``base_score`` is the smoothed word unigram of the training texts.

    Words travel packed: each task sends its distinct words once, dealt by a hash, with their training counts; a bucket
    adds up the counts, scores each distinct word once and sends figures back to the task's texts.  Memory is bounded by
    ``flush_bytes`` of text and by a bucket of about ``bucket_bytes`` of text.  A NULL text is empty (one token), a NULL id
    is training; rows with the same id are scored each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    out_of_training = F.coalesce(id_remainder(F.col("doc_id"), fold) == held_out, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", text_or_empty().alias("text"), out_of_training.alias("held_out"))
    size = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(24, math.ceil(size / bucket_bytes))
    store = spark.sparkContext.broadcast(Pieces(model_path))

    def words_of(batches):
        """Per task and flush: its texts as (row, word numbers), and its distinct words by bucket with training counts."""
        from pyspark import TaskContext

        part, flush = TaskContext.get().partitionId(), 0
        numbers: dict[bytes, int] = {}
        texts: list[tuple] = []
        done = 0

        def out():
            words = list(numbers)
            counts = np.zeros(len(words), np.int64)
            for _, held, at, n in texts:
                if not held:
                    counts[at] += n
            bucket = np.zeros(len(words), np.int64)
            for k in range(0, len(words), 20_000):
                own = words[k : k + 20_000]
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                ends = np.cumsum(sizes + 1) - 1
                prefix = prefix_hash(np.frombuffer(b" ".join(own), np.uint8), BASE)
                bucket[k : k + 20_000] = span_hash(prefix, BASE, ends - sizes, ends) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            batch = part * (1 << 20) + flush
            rows = [
                (batch, b, b" ".join([words[i] for i in order[cuts[b] : cuts[b + 1]].tolist()]), counts[order[cuts[b] : cuts[b + 1]]].tobytes())
                for b in range(buckets) if cuts[b] < cuts[b + 1]
            ]
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            own = [(place[at], n) for _, _, at, n in texts]
            n_words = np.array([len(a) for a, _ in own], np.int64)
            body = {
                "batch": [batch] * (len(rows) + 1),
                "bucket": [r[1] for r in rows] + [-1],
                "words": [r[2] for r in rows] + [n_words.tobytes()],
                "counts": [r[3] for r in rows] + [b"".join(a.tobytes() for a, _ in own)],
                "times": [b""] * len(rows) + [b"".join(n.astype(np.uint32).tobytes() for _, n in own)],
                "ids": [None] * len(rows) + [[t[0] for t in texts]],
                "held": [None] * len(rows) + [[t[1] for t in texts]],
            }
            return pa.RecordBatch.from_pydict(body, schema)

        schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("times", pa.binary()), ("ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_()))])
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", 1_000_000):
                raw = data.tobytes()
                ids, held = rows.column(0).to_pylist(), rows.column(2).to_pylist()
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    tokens = raw[a:b].lower().split()
                    at = np.array([numbers.setdefault(t, len(numbers)) for t in tokens], np.int64)
                    at, n = np.unique(at, return_counts=True)
                    texts.append((ids[k], held[k], at.astype(np.uint32), n.astype(np.uint32)))
                done += len(raw)
                if done >= flush_bytes:
                    yield out()
                    numbers, texts, done, flush = {}, [], 0, flush + 1
        if texts:
            yield out()

    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = f"batch long, bucket long, words binary, counts binary, times binary, ids array<{kind}>, held array<boolean>"
    sent = stored(source.mapInArrow(words_of, schema), "lattice-words")
    vocabulary = sent.filter("bucket >= 0").select("batch", "bucket", "words", "counts")

    def add_up(table):
        words, counts = gathered(table)
        own = {w: n for w, n in zip(words, counts.tolist()) if n}  # words of held-out texts alone go
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "words": pa.array([b" ".join(own)], pa.binary()), "counts": pa.array([np.array(list(own.values()), np.int64).tobytes()], pa.binary())})

    known = stored(vocabulary.groupBy("bucket").applyInArrow(add_up, "bucket long, words binary, counts binary"), "lattice-counts")

    def totals(batches):
        for batch in batches:
            n = [np.frombuffer(c, np.int64) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in n], pa.int64()), pa.array([len(x) for x in n], pa.int64())], ["n", "v"])

    sums = known.select("counts").mapInArrow(totals, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    ends = source.filter("not held_out").count()
    total, distinct = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)

    pieces = store.value
    weights = pieces.prior
    for _ in range(rounds):
        logw = spark.sparkContext.broadcast(np.log(np.maximum(weights, 1e-300)))

        def expect(batches, logw=logw):
            counts = np.zeros(len(logw.value))
            for batch in batches:
                for words, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    n = np.frombuffer(n, np.int64).astype(np.float64)
                    word_scores(words.split(b" ") if words else [], store.value, logw.value, counts, n if discount is None else np.ones(len(n)))
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["piece", "n"])

        # One row a piece reaches the driver, whatever the size of the corpus.
        expected = known.select("words", "counts").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        found = pieces.prior * prior_weight
        for r in expected:
            found[r["piece"]] += r["n"]
        found[pieces.end] = found[pieces.end] + ends if discount is None else 0.0
        weights = found / found.sum()
    with np.errstate(divide="ignore"):
        logw = spark.sparkContext.broadcast(np.log(weights))
    edges_of_words = discount is not None and total > 0
    left_over = (discount or 0.0) * (distinct - (ends > 0)) / max(1, total)

    def figures(table):
        """For each task's words of this bucket: training count and log10 probability, in the order they were sent."""
        batches, lists = table.column("batch").to_pylist(), [w.split(b" ") for w in table.column("words").to_pylist()]
        counts: dict[bytes, int] = {}
        for words, n in zip(lists, table.column("counts").to_pylist()):
            for w, c in zip(words, np.frombuffer(n, np.int64).tolist()):
                counts[w] = counts.get(w, 0) + c
        names = list(counts)
        own = word_scores(names, store.value, logw.value)
        if edges_of_words:
            n = np.array([counts[w] for w in names], np.float64)
            with np.errstate(divide="ignore"):
                own = np.logaddexp(np.log(np.maximum(n - discount, 0) / total), own + np.log(max(left_over, 1e-300)))
        score = dict(zip(names, (own / math.log(10)).tolist()))
        c = [np.array([counts[w] for w in words], np.int64).tobytes() for words in lists]
        s = [np.array([score[w] for w in words], np.float64).tobytes() for words in lists]
        bucket = table.column("bucket")
        return pa.table({"batch": pa.array(batches, pa.int64()), "bucket": bucket, "c": pa.array(c, pa.binary()), "s": pa.array(s, pa.binary())})

    back = vocabulary.groupBy("bucket").applyInArrow(figures, "batch long, bucket long, c binary, s binary")
    texts = sent.filter("bucket = -1").select("batch", "words", "counts", "times", "ids", "held")
    floor, scale = smoothing, total + smoothing * (distinct + 1)
    end_score = math.log10(ends / total) if edges_of_words else float(np.log10(max(weights[pieces.end], 1e-300)))

    def finish(texts, figures):
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        t = texts.to_pylist()
        f = sorted(zip(figures.column("bucket").to_pylist(), figures.column("c").to_pylist(), figures.column("s").to_pylist()))
        c = np.frombuffer(b"".join(x[1] for x in f), np.int64)
        s = np.frombuffer(b"".join(x[2] for x in f), np.float64)
        base = np.log10((c + floor) / scale)
        columns = [[] for _ in names]
        for r in t:
            n_words = np.frombuffer(r["words"], np.int64)
            at, n = np.frombuffer(r["counts"], np.uint32), np.frombuffer(r["times"], np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(len(n_words)), n_words)
            add = lambda v: np.bincount(owner, v, len(n_words))
            columns[0] += r["ids"]
            columns[1] += r["held"]
            columns[2] += (add(n).astype(np.int64) + 1).tolist()
            columns[3] += (add(n * (c[at] > 0)).astype(np.int64) + (ends > 0)).tolist()
            columns[4] += (add(n * base[at]) + np.log10((ends + floor) / scale)).tolist()
            columns[5] += (add(n * s[at]) + end_score).tolist()
        kinds = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(v, k) for v, k in zip(columns, kinds)], names)

    done = texts.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def gathered(table) -> tuple[list[bytes], np.ndarray]:
    """Distinct words of a bucket and their summed training counts."""
    counts: dict[bytes, int] = {}
    for words, n in zip(table.column("words").to_pylist(), table.column("counts").to_pylist()):
        for w, c in zip(words.split(b" "), np.frombuffer(n, np.int64).tolist()):
            counts[w] = counts.get(w, 0) + c
    return list(counts), np.array(list(counts.values()), np.int64)
