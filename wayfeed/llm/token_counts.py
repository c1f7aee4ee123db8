"""Token counts by a given SentencePiece model, with overlap resynchronisation for huge documents."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SPACE = "▁"
_models: dict[str, tuple] = {}


def load(path: str) -> tuple:
    """The library's processor and the pairs of neighbouring characters that stand inside some piece; once a worker."""
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pairs = set()
        for i in range(model.vocab_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
                pairs.update(map("".join, itertools.pairwise(model.id_to_piece(i))))
        _models[path] = model, frozenset(pairs)
    return _models[path]


def stable(raw: bytes, at: int, pairs: frozenset) -> bool:
    """No piece holds both characters beside ``at``: no merge ever crosses it, both sides are encoded independently."""
    before, after = raw[max(0, at - 4) : at].decode(errors="ignore"), raw[at : at + 4].decode(errors="ignore")
    return (before[-1] + after[0]).replace(" ", SPACE) not in pairs


def char_start(raw: bytes, at: int) -> int:
    """The character border at or before byte ``at``."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def count_long(model, pairs: frozenset, text: str, chunk: int, overlap: int) -> int:
    """Tokens of one text, from overlapping chunks of about ``chunk`` bytes.

    Each chunk is encoded with offsets from before its border to beyond the next one.  Two neighbours are spliced at
    the first stable boundary of their overlap at which both have a token start; a chunk counts the tokens between its
    two splices, so what the library puts before a chunk's first character never counts.  An overlap without such a
    boundary is widened twofold, in the end to the whole text.
    """
    raw = text.encode()
    n = len(raw)

    def starts(low: int, high: int) -> np.ndarray:
        return low + np.fromiter((p.begin for p in model.encode(raw[low:high].decode(), out_type="proto").pieces), np.int64)

    total, spliced, low, end = 0, 0, 0, char_start(raw, min(n, chunk))
    mine = starts(0, char_start(raw, min(n, end + overlap)))
    while end < n:
        width, following = overlap, char_start(raw, min(n, end + chunk))
        while True:
            left, right = char_start(raw, max(spliced, end - width)), char_start(raw, min(n, end + width))
            if width > overlap:
                mine = starts(low, right)
            theirs = starts(left, char_start(raw, min(n, max(following, right) + overlap)))
            shared = np.intersect1d(mine, theirs)
            shared = shared[(shared > left) & (shared < right)]
            cut = next((at for at in shared.tolist() if stable(raw, at, pairs)), None)
            if cut is not None:
                break
            if left == spliced and right == n:
                return total + int((starts(low, n) >= spliced).sum())
            width *= 2
        total += int(((mine >= spliced) & (mine < cut)).sum())
        spliced, low, mine, end = cut, left, theirs, max(following, right)
    return total + int((mine >= spliced).sum())


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = 16_384, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, as the library counts them with ``model_path``.

    Texts up to ``chunk`` characters are encoded at once, longer ones by overlapping chunks.  A NULL text is empty and
    has 0 tokens; ids may be NULL or repeated (one row for each row); other columns are ignored; an empty table gives an
    empty one.  The executors must be able to read the model file.
    """

    def run(batches):
        model, pairs = load(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = np.zeros(len(texts), np.int64)
            short = [i for i, text in enumerate(texts) if len(text) <= chunk]
            for k in range(0, len(short), 500):
                part = short[k : k + 500]
                counts[part] = [len(ids) for ids in model.encode([texts[i] for i in part], num_threads=1)]
            for i, text in enumerate(texts):
                if len(text) > chunk:
                    counts[i] = count_long(model, pairs, text, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    source = docs.select("doc_id", text_or_empty().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = source.schema["doc_id"].dataType.simpleString()
    counted = source.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
