"""Decontamination, byte repeats and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from wayfeed.llm import decontaminate, packing, suffixes

from .conftest import words

ITEM = "item_id long, text string"


def test_decontamination(spark, make_docs, odd_texts, clashing):
    rng = random.Random(14)
    items = [" ".join(words(rng, n)) for n in (8, 14, 40, 63, 64, 65, 90, 200)] + ["Which one is it? " + " ".join(words(rng, 12)), "", None, "one"]
    texts, want = list(odd_texts), {}
    for k, item in enumerate(items[:9]):
        for shape in (lambda t: t, str.upper, lambda t: t.replace(" ", "\n"), lambda t: t.replace(" ", ", ")):
            filler = words(rng, rng.randint(0, 400))
            at = rng.randint(0, len(filler))
            want[len(texts)] = k
            texts.append(" ".join([*filler[:at], shape(item), *filler[at:]]))
    for k, item in enumerate(items[2:8], 2):  # half an item, or its words in another order, is no leak
        own = item.split()
        if len(own) // 2 >= decontaminate.Limits().passage // 2:  # but a whole part of a long item is one
            want[len(texts)] = k
        texts += [" ".join(words(rng, 50) + own[: len(own) // 2]), " ".join(rng.sample(own, len(own)))]
    table = spark.createDataFrame([*enumerate(items), (2, items[2]), (None, "x y z")], ITEM)
    scores = []
    for block_items in (20_000, 4):
        got = {r.doc_id: r for r in decontaminate.contaminated(clashing(make_docs(texts)), table, block_items=block_items).collect()}
        assert len(got) == len(texts)
        for i in range(len(texts)):
            found = [k for k in got[i].item_ids if k != 11]  # the one-word item is wherever its word is
            assert found == ([want[i]] if i in want else []), (i, found)
            assert got[i].contaminated == (got[i].n_items > 0)
        scores.append({i: (r.best_score, r.best_overlap) for i, r in got.items()})
    assert scores[0] == scores[1]  # statistics are those of all items, whatever the blocks
    none = decontaminate.contaminated(make_docs(texts[:3]), table.limit(0)).collect()
    assert len(none) == 3 and not any(r.contaminated for r in none)
    assert decontaminate.contaminated(make_docs([]), table).count() == 0


def test_search_finds_all_above_the_ratio():
    rng = random.Random(15)
    limits = decontaminate.Limits(ratio=0.3, block=3)
    vocabulary = words(rng, 60)
    parts = [p for k in range(80) for p in decontaminate.parts_of(k, " ".join(rng.choices(vocabulary, k=rng.randint(3, 20))), limits)]
    df = {}
    for p in parts:
        for t in set(p.words.tolist()):
            df[t] = df.get(t, 0) + 1
    index = decontaminate.Index(parts, limits, decontaminate.Statistics(len(parts), sum(len(p.words) for p in parts) / len(parts), df))
    for _ in range(60):
        raw = np.frombuffer(" ".join(rng.choices(vocabulary, k=25)).encode(), np.uint8)
        w, first = decontaminate.words(raw, np.array([0, len(raw)]))
        scores = {}
        for t in set(w.tolist()):
            for k, s in index.postings.get(t, []):
                scores[k] = scores.get(k, 0.0) + s
        want = {k for k, s in scores.items() if s >= 0.3 - 1e-9}
        assert {k for k, _ in index.search(set(w.tolist()))} == want
        assert not want or index.candidates(w, first).tolist() == [0]


def brute_repeats(rows, width=100):
    """Removed mask of each row; rows are (id, bytes) with distinct ids."""
    seen, out = {}, {}
    for i, raw in sorted(rows):
        mask = np.zeros(len(raw), bool)
        for k in range(len(raw) - width + 1):
            w = raw[k : k + width]
            if w in seen:
                mask[k : k + width] = True
            seen.setdefault(w, True)
        out[i] = mask
    return out


def repeat_texts(rng):
    shared = [" ".join(words(rng, 40)) for _ in range(4)]
    line = "a line of less than one hundred bytes that very many documents hold at their end"
    texts = ["", "short", "ab" * 300, "x" * 99, "y" * 100, "y" * 101, "é" * 120, shared[0], shared[0][:150], shared[0]]
    for k in range(60):
        own = words(rng, rng.randint(5, 60))
        at = rng.randint(0, len(own))
        texts.append(" ".join([*own[:at], rng.choice(shared), *own[at:]]) + ("\n" + line if k % 2 else ""))
    texts += [texts[20], texts[25][7:], texts[30][:-9] + "?"]
    return texts


@pytest.mark.parametrize("many", [2000, 3])
def test_repeats(spark, make_docs, clashing, many):
    rng = random.Random(16)
    texts = repeat_texts(rng)
    ids = rng.sample(range(-500, 500), len(texts))
    docs = clashing(make_docs([*texts, None, texts[7]], [*ids, 777, None])).drop("kept", "spans")
    got = {r.doc_id: r for r in suffixes.without_repeats(docs, many=many, flush_bytes=3000).collect()}
    want = brute_repeats([(i, t.encode()) for i, t in zip(ids, texts)])
    for i, t in zip(ids, texts):
        raw, mask = t.encode(), want[i]
        edges = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(raw), int(mask.sum()), edges), t[:60]
        assert bytes(got[i].kept) == np.frombuffer(raw, np.uint8)[~mask].tobytes()
    assert (got[777].n_bytes, bytes(got[777].kept)) == (0, b"") and got[None].n_removed == 0
    assert "size" in got[777].asDict()
    assert suffixes.without_repeats(make_docs([])).count() == 0


def test_window_runs_cover_the_same_windows():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 400):
        rows = {"doc": rng.integers(-3, 4, n), "start": rng.integers(0, 300, n).astype(np.int32), "length": rng.integers(1, 9, n).astype(np.int32)}
        rows |= {"h": np.zeros(n, np.uint64), "ctx": np.zeros(n, np.uint64), "before": np.zeros(n, np.int32)}
        got = suffixes.window_runs(rows)
        cover = lambda r: [(d, x) for d, a, m in zip(r["doc"].tolist(), r["start"].tolist(), r["length"].tolist()) for x in range(a, a + m)]
        assert sorted(cover(got)) == sorted(set(cover(rows)))


def test_suffix_array_orders_all_suffixes():
    rng = np.random.default_rng(1)
    for trial in range(120):
        n = int(rng.integers(1, 150))
        t = rng.integers(1, rng.integers(2, 6), n)
        t = np.append(np.resize(t[:5], n) if trial % 3 == 0 else t, 0).astype(np.uint16)
        depth = int(rng.integers(8, 120))
        order = suffixes.suffix_array(t, depth)
        assert sorted(order.tolist()) == list(range(len(t)))
        keys = [tuple(t[i : i + depth].tolist()) for i in order]
        assert keys == sorted(keys)
        lcp = suffixes.common_prefixes(t, order, depth)
        for a, b, n_common in zip(order, order[1:], lcp[1:].tolist()):
            x, y = t[a:].tolist(), t[b:].tolist()
            k = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert n_common == min(k, depth)


def test_pipeline(spark, make_docs, tmp_path):
    rng = random.Random(17)
    item = " ".join(words(rng, 30))
    clean = [" ".join(words(rng, rng.randint(60, 200))) + "." for _ in range(300)]
    junk = [" ".join(w.upper() + "!!" for w in words(rng, 60)) for _ in range(60)]
    passage = " ".join(words(rng, 60))
    texts = clean + junk + [clean[0], clean[0]] + [" ".join(words(rng, 50)) + " " + item + " " + " ".join(words(rng, 50))] + [" ".join(words(rng, 40)) + " " + passage + " " + " ".join(words(rng, 40)) for _ in range(5)]
    make_docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 300, 2)] + [(300 + k, 0, 0) for k in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], ITEM).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = corpus_pipeline.stored(docs, "test")
        kept.append({r.doc_id: r.text for r in docs.collect()})
    n = len(clean) + len(junk)
    assert set(kept[0]) == set(range(300)) | set(range(n, len(texts)))
    assert set(kept[1]) == set(kept[0]) - {n, n + 1}
    whole = brute_repeats([(i, texts[i].encode()) for i in kept[1]])
    assert all(t.encode() == np.frombuffer(texts[i].encode(), np.uint8)[~whole[i]].tobytes() for i, t in kept[2].items())
    assert sum(passage in t for t in kept[2].values()) == 1 and set(kept[2]) == set(kept[1])
    assert set(kept[3]) == set(kept[2]) - {n + 2}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept[3]) and max(r.bin_tokens for r in packed) <= max(packing.CAPACITIES)


def test_stages_on_empty_and_odd_rows(spark, make_docs, odd_texts, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], ITEM).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = make_docs([*odd_texts, "no id at all", "twice", "twice"], [*range(len(odd_texts)), None, 99, 99])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    got = {r.doc_id for r in docs.collect()}
    assert None in got and 99 in got and 8 not in got


def test_different_texts_of_one_id_are_judged_each(spark, make_docs):
    rng = random.Random(41)
    one, two, three = (" ".join(words(rng, 60)) for _ in range(3))
    docs = make_docs([one, one, two, three, three, three], [3, 5, 5, 7, 7, None])
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == sorted([("3", one), ("5", two), ("7", three), ("None", three)])
