"""Removal of repeated byte strings by suffix arrays, sorted in two stages."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, mixed, prefix_hash, span_hash, stored, text_slices

BASE, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
GRAM = 32  # bytes of an anchor
PACK = 7  # symbols of 9 bits in one sort key


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` (symbols 0 to 256, the last one 0) in order of their first ``depth`` symbols at least.

    Two stages.  Only suffixes smaller than their successor are sorted directly, by keys of ``PACK`` symbols, ties by the
    next ones.  The others are induced: a scan of the buckets by first symbol, upwards, puts the predecessor of each
    suffix that it meets, if larger, next in the bucket of its own first symbol.
    """
    n = len(t)
    wide = t.astype(np.int64)
    change = np.sign(np.diff(wide, append=-1))
    place = np.where(change != 0, np.arange(n), n)
    ahead = np.minimum.accumulate(place[::-1])[::-1]
    small = np.flatnonzero(change[np.minimum(ahead, n - 1)] > 0)
    key = np.zeros(n + depth + 2 * PACK, np.uint64)
    padded = np.zeros(len(key) + PACK, np.uint64)
    padded[:n] = t
    for k in range(PACK):
        key = (key << np.uint64(9)) | padded[k : k + len(key)]
    order = np.argsort(key[small], kind="stable")
    direct = small[order]
    value = key[direct]
    for done in range(PACK, depth + 1, PACK):
        equal = value[1:] == value[:-1] if done == PACK else same_group & (value[1:] == value[:-1])
        same_group = equal
        tied = np.zeros(len(direct), bool)
        tied[1:] |= equal
        tied[:-1] |= equal
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(np.concatenate([[True], ~equal]))[at]
        deeper = key[direct[at] + done]
        by = np.lexsort((deeper, group))
        direct[at] = direct[at][by]
        value = np.arange(len(direct), dtype=np.uint64)  # settled rows stay apart
        value[at] = deeper[by] + np.uint64(len(direct))
    # Induce: each bucket holds its larger suffixes first, then its directly sorted ones.
    first = t[direct]
    bounds = np.searchsorted(first, np.arange(258))
    is_small = np.zeros(n, bool)
    is_small[small] = True
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    waiting[0].append(np.array([n - 1]))
    out = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Deal the larger predecessors of ``found`` to their buckets; those of bucket ``c`` itself are returned."""
        before = found[found > 0] - 1
        before = before[~is_small[before]]
        symbol = t[before]
        own = before[symbol == c]
        before, symbol = before[symbol != c], symbol[symbol != c]
        by = np.argsort(symbol, kind="stable")
        before, symbol = before[by], symbol[by]
        cuts = np.flatnonzero(np.diff(symbol)) + 1
        for part in np.split(before, cuts) if len(before) else ():
            waiting[int(t[part[0]])].append(part)
        return own

    for c in range(257):
        found = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(found):
            out.append(found)
            found = induce(found, c)
        found = direct[bounds[c] : bounds[c + 1]]
        if len(found):
            out.append(found)
            induce(found, c)
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the common prefix of each suffix in ``order`` with the one before it (0 for the first)."""
    padded = np.concatenate([t, np.zeros(most + 1, t.dtype)])
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    for k in range(most):
        at = at[padded[order[at] + k] == padded[order[at - 1] + k]]
        if not len(at):
            break
        out[at] = k + 1
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """For each window of ``width`` bytes its anchor: the ``GRAM``-byte string in it with the smallest hash, leftmost first.

    Gives one row for each run of windows with the same anchor: hash of the anchor, its place, first and last + 1 window
    start, and text.  Equal windows have equal anchors at equal places in them, wherever they stand.
    """
    n, span = len(data), width - GRAM + 1
    sizes = np.diff(offsets)
    count = np.maximum(0, sizes - width + 1)
    if not count.sum():
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    at = np.arange(n - GRAM + 1)
    h = span_hash(prefix_hash(data, BASE), BASE, at, at + GRAM)
    low_bits = np.uint64((1 << max(24, n.bit_length())) - 1)
    least, size = (h & ~low_bits) | at.astype(np.uint64), 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    text = np.repeat(np.arange(len(sizes)), count)
    window = offsets[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    place = (least[window] & low_bits).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([cut[1:], [len(window)]]) - 1
    return h[place[cut]], place[cut], window[cut], window[last] + 1, text[cut]


def first_of(keys: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each row, whether no row of its key stands before it by (doc, pos)."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.lexsort((pos, doc, keys))
    k, d, p = keys[order], doc[order], pos[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), np.arange(len(k)), 0))
    out = np.zeros(len(keys), bool)
    out[order] = (d == d[head]) & (p == p[head])
    return out


def shared_spans(t: np.ndarray, start: np.ndarray, anchor: np.ndarray, end: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Which contexts may share a window with another of their group: they agree in a span that some window must hold.

    A window with ``o`` bytes before its anchor holds the bytes around the anchor that all windows with o in a quarter
    of the range have in common.
    """
    slack = width - GRAM
    step = slack // 4 + 1
    prefix = prefix_hash(t.astype(np.uint8), BASE2)
    may = np.zeros(len(start), bool)
    for low in range(0, slack + 1, step):
        high = min(low + step - 1, slack)
        a, b = anchor - low, anchor + width - high
        k = np.flatnonzero((a >= start) & (b <= end))
        key = mixed(span_hash(prefix, BASE2, a[k], b[k]) ^ group[k])
        _, which, n = np.unique(key, return_inverse=True, return_counts=True)
        may[k[n[which] > 1]] = True
    return may


def repeated_windows(contexts: list[bytes], doc: np.ndarray, pos: np.ndarray, before: np.ndarray, group: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(doc, first, last + 1 window start) of windows that also start earlier, among the windows of the contexts.

    Contexts of one group hold an anchor ``before`` bytes after their start, and every window in them holds it.  The
    contexts are joined with separators, their suffixes sorted, and windows whose suffixes have ``width`` symbols in
    common stand together; all but the first by (doc, place) are repeats.
    """
    def joined(which):
        raw = b"\0".join(contexts[i] for i in which) + b"\0"
        sizes = np.fromiter((len(contexts[i]) for i in which), np.int64, len(which))
        starts = np.cumsum(sizes + 1) - sizes - 1
        t = np.frombuffer(raw, np.uint8).astype(np.uint16) + np.uint16(1)
        t[starts + sizes] = 0
        return t, starts, sizes

    which = np.arange(len(contexts))
    t, starts, sizes = joined(which)
    which = np.flatnonzero(shared_spans(t - 1, starts, starts + before, starts + sizes, group, width))
    if not len(which):
        return []
    t, starts, sizes = joined(which)
    order = suffix_array(t, width)
    owner = np.repeat(np.arange(len(which)), sizes + 1)
    inside = np.arange(len(t)) - starts[owner]
    is_window = inside <= sizes[owner] - width
    lcp = common_prefixes(t, order, width)
    cls = np.cumsum(lcp < width)
    keep = is_window[order]
    at, cls = order[keep], cls[keep]
    d, p = doc[which][owner[at]], pos[which][owner[at]] + inside[at]
    later = np.flatnonzero(~first_of(cls.astype(np.uint64), d, p))
    at = np.sort(at[later])
    if not len(at):
        return []
    cut = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
    last = at[np.concatenate([cut[1:], [len(at)]]) - 1]
    o = owner[at[cut]]
    begin = pos[which][o] + inside[at[cut]]
    return list(zip(doc[which][o].tolist(), begin.tolist(), (begin + last - at[cut] + 1).tolist()))


FIELDS = (("h", np.uint64), ("ctx", np.uint64), ("doc", np.int64), ("start", np.int32), ("before", np.int32), ("length", np.int32))


def packed(columns: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(columns[name], kind).tobytes() for name, kind in FIELDS)


def unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(kind).itemsize for _, kind in FIELDS)
    parts: dict[str, list] = {name: [] for name, _ in FIELDS}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for name, kind in FIELDS:
            parts[name].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(v) if v else np.zeros(0, dict(FIELDS)[name]) for name, v in parts.items()}


def anchor_rows(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, width: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Anchors of the texts with the hash of all bytes their windows cover; and the place of each in ``data``."""
    h, place, start, end, text = anchors(data, offsets, width)
    ctx = span_hash(prefix_hash(data, BASE2), BASE2, start, end - 1 + width) if len(h) else h
    ctx = mixed(ctx ^ (place - start).astype(np.uint64))
    rows = {"h": h, "ctx": ctx, "doc": docs[text], "start": start - offsets[text], "before": place - start, "length": end - start}
    return rows, start


def take(rows: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {name: v[which] for name, v in rows.items()}


def class_key(rows: dict[str, np.ndarray]) -> np.ndarray:
    return mixed(rows["h"] * np.uint64(3) + rows["ctx"])


def window_runs(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Windows that repeat as runs of window starts, one row for each run of a document."""
    if not len(rows["doc"]):
        return rows
    docs, owner = np.unique(rows["doc"], return_inverse=True)
    begin = owner * (1 << 40) + rows["start"].astype(np.int64)
    order = np.argsort(begin, kind="stable")
    begin = begin[order]
    reach = np.maximum.accumulate(begin + rows["length"][order])
    cut = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    last = np.concatenate([cut[1:], [len(begin)]]) - 1
    none = np.zeros(len(cut), np.uint64)
    return {"h": none, "ctx": none, "doc": docs[owner[order[cut]]], "start": begin[cut] % (1 << 40), "before": none, "length": reach[last] - begin[cut]}


def frequent_anchors(docs: DataFrame, width: int, many: int, share: int = 8, most: int = 65_536) -> np.ndarray:
    """Anchors seen with at least ``many`` different surroundings, judged on every ``share``-th document; sorted.

    The list, of ``most`` anchors at most, only decides on which way an anchor's windows are compared, never the result.
    """

    def step(rows, data, offsets):
        found, _ = anchor_rows(data, offsets, np.asarray(rows.column(0)), width)
        h = found["h"][first_of(class_key(found), found["doc"] * 0, found["start"] * 0)]
        values, n = np.unique(h, return_counts=True)
        keep = n > 1
        return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(n[keep])], ["h", "n"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(share)) == 0).select("doc_id", "text")
    counts = map_text(sample, step, "h long, n long", max_bytes=500_000).groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") * share >= many).orderBy(F.desc("n"), "h").limit(most).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def compared(docs: DataFrame, width: int, frequent: np.ndarray, buckets: int, flush_bytes: int) -> DataFrame:
    """Rows (kind, doc, h, start, before, length): kind 0, window starts that are repeats; kind 1, contexts to be sorted.

    Each task takes anchors in order of their documents, settles what repeats inside the task, and deals the rest by
    anchor.  Where an anchor's surroundings are all equal, all but the first are repeats; else the first of each
    different surroundings goes on to the suffix sort.  The windows of frequent anchors are dealt one by one by their own
    hashes, so that no group grows with how common an anchor is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def result(rows: dict[str, np.ndarray], kind: int) -> list[pa.Array]:
        n = len(rows["h"])
        return [pa.array(np.full(n, kind, np.int32)), pa.array(rows["doc"]), pa.array(rows["h"].view(np.int64)), *[pa.array(rows[c].astype(np.int32)) for c in ("start", "before", "length")]]

    names = ["kind", "doc", "h", "start", "before", "length"]

    def deal(batches):
        hot, held, size = shared.value, [], 0

        def blobs():
            joined = {name: np.concatenate([rows[name] for rows in held]) for name, _ in FIELDS}
            first = first_of(class_key(joined), joined["doc"], joined["start"])
            own, repeats = take(joined, first), window_runs(take(joined, ~first))
            bucket = (mixed(own["h"]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [(b, packed(take(own, order[cuts[b] : cuts[b + 1]])), b"") for b in range(buckets) if cuts[b] < cuts[b + 1]]
            if len(repeats["h"]):
                out.append((int(mixed(np.array([repeats["doc"][0]], np.uint64))[0] % np.uint64(buckets)), b"", packed(repeats)))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["bucket", "anchors", "repeats"])

        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", 500_000):
                docs_ = np.asarray(rows.column(0))
                found, place = anchor_rows(data, offsets, docs_, width)
                if len(hot) and len(found["h"]):
                    at = np.minimum(np.searchsorted(hot, found["h"]), len(hot) - 1)
                    is_hot = hot[at] == found["h"]
                    own, where = take(found, is_hot), place[is_hot]
                    if len(where):
                        n = own["length"].astype(np.int64)
                        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        start = np.repeat(where, n) + step
                        h = span_hash(prefix_hash(data, BASE2), BASE2, start, start + width)
                        one = np.ones(len(h), np.int32)
                        windows = {"h": h, "ctx": h, "doc": np.repeat(own["doc"], n), "start": np.repeat(own["start"], n) + step, "before": one * 0, "length": one}
                        held.append(windows)
                        found = take(found, ~is_hot)
                held.append(found)
                size += len(data)
                if size >= flush_bytes:
                    yield blobs()
                    held, size = [], 0
        if held:
            yield blobs()

    def settle(table):
        rows = unpacked([b for b in table.column("anchors").to_pylist() if b])
        first = first_of(class_key(rows), rows["doc"], rows["start"])
        repeats, own = take(rows, ~first), take(rows, first)
        # Anchors left with one kind of surroundings, or single windows, are done.
        one = np.zeros(0, bool)
        if len(own["h"]):
            key = class_key(own)
            h, which = np.unique(own["h"], return_inverse=True)
            low, high = np.full(len(h), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(h), np.uint64)
            np.minimum.at(low, which, key)
            np.maximum.at(high, which, key)
            one = (low == high)[which]
        local = unpacked([b for b in table.column("repeats").to_pylist() if b])
        parts = [result(window_runs(repeats), 0), result(local, 0), result(take(own, ~one), 1)]
        return pa.table([pa.concat_arrays([p[i] for p in parts]) for i in range(len(names))], names)

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "bucket long, anchors binary, repeats binary")
    return dealt.groupBy("bucket").applyInArrow(settle, "kind int, doc long, h long, start int, before int, length int")


def sorted_repeats(docs: DataFrame, contexts: DataFrame, width: int, task_bytes: int = 800_000) -> DataFrame:
    """(doc, start, length) of the repeated windows in ``contexts`` (kind 1 of ``compared``), found by suffix sorting.

    The bytes of the contexts are cut from their documents and dealt by anchor; a task sorts the suffixes of about
    ``task_bytes``.
    """
    total = contexts.agg(F.sum(F.col("length") + F.lit(width))).first()[0] or 0
    wanted = contexts.groupBy("doc").agg(F.collect_list(F.struct("h", "start", "before", "length")).alias("spans"))
    joined = docs.select(F.col("doc_id").alias("doc"), F.col("text").cast("binary").alias("raw")).join(wanted, "doc")
    spans = joined.select("doc", "raw", F.explode("spans").alias("x"))
    cut = spans.select("doc", "x.*", F.expr(f"substring(raw, x.start + 1, x.length + {width - 1})").alias("context"))

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        col = lambda name: t.column(name).to_numpy()
        found = repeated_windows(t.column("context").to_pylist(), col("doc"), col("start").astype(np.int64), col("before").astype(np.int64), col("h").view(np.uint64), width)
        if found:
            d, a, b = (np.array(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a.astype(np.int32)), pa.array((b - a).astype(np.int32))], ["doc", "start", "length"])

    parts = max(1, math.ceil(total / task_bytes))
    return cut.repartition(parts, "h").mapInArrow(run, "doc long, start int, length int")


def repeated_spans(docs: DataFrame, width: int = 100, many: int = 2000, bucket_bytes: int = 8_000_000, flush_bytes: int = 12_000_000) -> DataFrame:
    """doc_id, spans (start and end of byte ranges, merged, in order) for each document with bytes to remove.

    A byte is removed if a string of ``width`` bytes that covers it also starts earlier: in a document with a smaller
    id, or before in the same one.  Strings never cross documents.  Rows that share an id count as one document; rows
    with a NULL id or text take no part.
    """
    fine = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = fine.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    frequent = frequent_anchors(fine, width, many)
    buckets = max(16, math.ceil(size / bucket_bytes))
    rows = stored(compared(fine, width, frequent, buckets, flush_bytes), "suffix-anchors")
    found = stored(sorted_repeats(fine, rows.filter("kind = 1"), width), "suffix-repeats")
    windows = rows.filter("kind = 0").select("doc", "start", "length").union(found)
    lists = windows.groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("windows"))

    def merge(batches):
        for batch in batches:
            docs_, spans = batch.column(0), batch.column(1)
            owner = np.repeat(np.arange(len(docs_)), np.diff(np.asarray(spans.offsets)))
            values = spans.flatten()
            start, length = (np.asarray(values.field(i)).astype(np.int64) for i in range(2))
            order = np.lexsort((start, owner))
            owner, start, end = owner[order], start[order], (start + length)[order] - 1 + width
            # Ends never fall below an earlier one of the same document, once those are carried on.
            wide = owner * (1 << 40)
            reach = np.maximum.accumulate(wide + end)
            new = np.concatenate([[True], wide[1:] + start[1:] > reach[:-1]])
            cut = np.flatnonzero(new)
            last = np.concatenate([cut[1:], [len(owner)]]) - 1
            begins, ends, own = start[cut], reach[last] - wide[last], owner[cut]
            offsets = np.searchsorted(own, np.arange(len(docs_) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(begins), pa.array(ends)], ["start", "end"])
            yield pa.RecordBatch.from_arrays([docs_, pa.ListArray.from_arrays(pa.array(offsets), pairs)], ["doc_id", "spans"])

    return lists.mapInArrow(merge, "doc_id long, spans array<struct<start:long,end:long>>")


def without_repeats(docs: DataFrame, width: int = 100, **how) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: the remaining bytes) added.

    Columns of ``docs`` with these names give way.  A NULL text is empty; a row with a NULL id stays whole; an empty table
    gives an empty result.
    """
    spans = repeated_spans(docs, width, **how).select(F.col("doc_id").alias("spans_of"), "spans")
    taken = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "spans", "spans_of")
    joined = taken.join(spans, taken["doc_id"] == spans["spans_of"], "left").drop("spans_of")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    cut = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    full = joined.withColumn("n_bytes", F.octet_length(raw).cast("long")).withColumn("spans", cut)
    # What stands between the removed spans, in order.
    borders = F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end")), F.concat(F.col("spans.start"), F.array("n_bytes")),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    piece = lambda x: F.substring(raw, (x["a"] + 1).cast("int"), (F.greatest(x["b"], x["a"]) - x["a"]).cast("int"))
    hexed = F.array_join(F.transform(borders, lambda x: F.hex(piece(x))), "")
    kept = F.when(F.size("spans") == 0, raw).otherwise(F.unhex(hexed))
    done = full.withColumn("kept", kept).withColumn("n_removed", F.col("n_bytes") - F.octet_length("kept")).withColumn("n_spans", F.size("spans").cast("long"))
    return done.select(*taken.columns, "n_bytes", "n_removed", "n_spans", "kept")
