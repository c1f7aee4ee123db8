"""Packing of token ids into training sequences of near equal cost."""

from __future__ import annotations

import base64
import math
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, text_or_empty

_coders: dict[tuple[str, str], Coder] = {}
#: A place where every pre-token rule of byte-level BPE begins anew: one space between a visible character and a letter.
BREAK = re.compile(r"(?<=\S) (?=[A-Za-z])")


class Coder:
    """Ids of a byte-level BPE vocabulary as the ``tokenizers`` file gives them.

    ``ranks_path`` holds the same vocabulary for ``tiktoken``, which gives the same ids some seven times faster; the strings of
    the file's added tokens become their ids, as by the library's default.  Texts above ``most`` characters are encoded in
    parts cut where the vocabulary's pre-tokens must end, so that no list grows with a text.
    """

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import json

        import public_tokenizers
        import tiktoken

        with open(json_path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.special = {a["content"]: a["id"] for a in added}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    @staticmethod
    def of(json_path: str, ranks_path: str) -> Coder:
        """The coder of these files, loaded once a worker."""
        if (json_path, ranks_path) not in _coders:
            _coders[json_path, ranks_path] = Coder(json_path, ranks_path)
        return _coders[json_path, ranks_path]

    def part(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.encoding.encode(text, allowed_special="all"), np.uint32)
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    def encode(self, text: str, most: int = 1_000_000) -> np.ndarray:
        parts, start = [], 0
        while len(text) - start > most and (cut := BREAK.search(text, start + most)):
            parts.append(self.part(text[start : cut.start()]))
            start = cut.start()
        parts.append(self.part(text[start:] if start else text))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]


def cost(n, linear: float = 1.0, quadratic: float = 1 / 16_384):
    """Estimated work on a piece of ``n`` tokens: linear layers, and attention within the piece."""
    return linear * n + quadratic * n * n


def deal(lengths: list[int], capacity: int, least: int, work=cost) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, np.ndarray]:
    """(piece, begin, length, sequence, offset) for pieces given longest first; tokens and cost of each sequence.

    As many sequences as the tokens fill are open from the start, so that the first pieces spread evenly.  A piece goes to
    the sequence of least cost among those with room for it.  If none has room, its head goes where most room is left, if that is
    ``least`` tokens or more, else a sequence is opened; the rest of it is placed in the same way.
    """
    n_open = math.ceil(sum(lengths) / capacity)
    size = n_open + 64
    room, spent = np.zeros(size, np.int64), np.zeros(size)
    room[:n_open] = capacity
    placed = []
    for i, total in enumerate(lengths):
        done = 0
        while done < total:
            n = total - done
            fits = np.flatnonzero(room >= n)
            if len(fits):
                k = int(fits[spent[fits].argmin()])
            else:
                k = int(room.argmax())
                if room[k] < least:
                    if n_open == size:
                        size *= 2
                        room, spent = np.resize(room, size), np.resize(spent, size)
                        room[n_open:], spent[n_open:] = 0, 0
                    k, n_open = n_open, n_open + 1
                    room[k] = capacity
                n = min(n, int(room[k]))
            placed.append((i, done, n, k, capacity - int(room[k])))
            room[k] -= n
            spent[k] += work(n)
            done += n
    return placed, capacity - room[:n_open], spent[:n_open]


def balanced_sequences(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = 2048, end_id: int = 1, least: int = 32, group_bytes: int = 16_000_000, work=cost) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset, sequence_tokens, sequence_cost: one row for each piece.

    A document is the ids of its whole text and ``end_id``.  ``ids`` are a piece's ids as little-endian unsigned 32-bit
    numbers; ``start`` counts the document's ids before it; ``doc_tokens`` counts all.  A document longer than ``capacity``
    is cut into pieces of that size, each a sequence of its own, and a rest.  Rests and short documents are assigned by
    descending length to the sequence of least estimated cost (linear and quadratic) with room; see ``deal``.

    Pieces are dealt by a hash into groups of about ``group_bytes`` of text, each packed by one task: a group
    leaves less than one sequence of padding and what ``least`` costs.  A group is sized by all bytes of the table, so
    huge documents spread over groups, and repeated rows are told apart by task and number, so they spread too.  Without
    repeated rows the result does not depend on how the table is split.  A NULL or empty text is one id; ids may be NULL or repeated; other columns are ignored; an empty table gives an empty result.
    """
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)).first()[0] or 0
    groups = max(1, math.ceil(size / group_bytes))
    source = docs.select("doc_id", text_or_empty().alias("text"))
    source = source.withColumn("h", F.xxhash64("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def setup():
        return Coder.of(json_path, ranks_path), {}, TaskContext.get().partitionId()

    def step(rows, data, offsets, extra):
        coder, seen, task = extra
        raw, hashes = data.tobytes(), rows.column("h").to_pylist()
        row, copies, starts, lengths, totals, pieces = [], [], [], [], [], []
        for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
            ids = np.append(coder.encode(raw[a:b].decode()), np.uint32(end_id)).astype("<u4")
            copy = seen.get(hashes[i], 0)
            seen[hashes[i]] = copy + 1
            for start in range(0, len(ids), capacity):
                row.append(i)
                copies.append((task << 32) + copy if copy else 0)
                starts.append(start)
                lengths.append(min(capacity, len(ids) - start))
                totals.append(len(ids))
                pieces.append(ids[start : start + capacity].tobytes())
        at = pa.array(row, pa.int32())
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id").take(at), rows.column("h").take(at), pa.array(copies, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(pieces, pa.binary())],
            ["doc_id", "h", "copy", "start", "length", "doc_tokens", "ids"],
        )

    cut = map_text(source, step, f"doc_id {kind}, h long, copy long, start long, length long, doc_tokens long, ids binary", setup=setup)
    dealt = cut.withColumn("pack", F.pmod(F.xxhash64("h", "copy", "start"), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("h", "ascending"), ("copy", "ascending"), ("start", "ascending")])
        placed, tokens, spent = deal(rows["length"].to_pylist(), capacity, least, work)
        at, begin, n, k, offset = (np.array(x, np.int64) for x in zip(*placed))
        ids = rows["ids"].to_pylist()
        parts = [ids[i] if b == 0 and 4 * m == len(ids[i]) else ids[i][4 * b : 4 * (b + m)] for i, b, m, *_ in placed]
        pack = rows["pack"][0].as_py()
        found = rows.select(["doc_id", "start", "doc_tokens"]).take(pa.array(at))
        columns = [found["doc_id"], pa.array(found["start"].to_numpy() + begin), pa.array(n), pa.array(parts, pa.binary()), found["doc_tokens"], pa.array((pack << 32) + k), pa.array(offset), pa.array(tokens[k]), pa.array(spent[k])]
        return pa.table(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "sequence_cost"])

    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"
    return dealt.groupBy("pack").applyInArrow(run, schema)
