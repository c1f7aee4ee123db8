"""Ranked search, fill-in-middle and balanced packing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfeed.llm import balanced_packing, fill_in_middle, ranked_search
from wayfeed.llm.queries import coder_paths

from .conftest import words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- ranked search


def by_hand(docs, items, k):
    terms = [TERM.findall((t or "").translate(FOLD)) for _, t in docs]
    big_n, big_l = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(w for t in terms for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for (doc, _), t in zip(docs, terms):
            tf, total = Counter(t), 0
            for w in set(TERM.findall((text or "").translate(FOLD))):
                if tf[w]:
                    m = 50 + 50 * len(t) * big_n // big_l
                    weight = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1)))
                    total += weight * (1_000_000_000 * tf[w] // (1000 * tf[w] + 20 * m))
            if total > 0:
                scores.append((-total, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def corpus(odd_texts):
    rng = random.Random(11)
    texts = odd_texts + [" ".join(words(rng, rng.randint(1, 40), "ae")) for _ in range(250)]
    texts += ["Über ÉTÉ 42x 漢字 a_b-c"] * 40 + ["nar nar"] * 5  # many ties
    ids = [*range(len(texts) - 4), None, None, 3, 3]
    queries = [None, "", "?!", "über été 42X", "nar", "nar NAR Nar", " ".join(words(rng, 400, "ae")), "漢字", *(" ".join(words(rng, 12, "ae")) for _ in range(20)), "never-seen-term zzz"]
    return list(zip(ids, texts)), list(zip([*range(len(queries) - 3), 5, None, None], queries))


@pytest.mark.parametrize("limits", [{}, {"tile_docs": 7, "tile_terms": 3, "per_block": 4}, {"group_bytes": 300, "pass_items": 5, "per_block": 2}])
def test_search_is_exact(spark, make_docs, clashing, corpus, limits):
    docs, items = corpus
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("own")).withColumn("item", F.lit(1))
    got = ranked_search.search(clashing(make_docs([t for _, t in docs], [i for i, _ in docs])).repartition(5), table, k=6, **limits)
    assert found(got) == by_hand(docs, items, 6)


def test_search_of_empty_tables(spark, make_docs):
    items = spark.createDataFrame([("a", "one two")], "item_id string, text string")
    assert ranked_search.search(make_docs([]), items).count() == 0
    assert ranked_search.search(make_docs([None, "", "?"]), items).count() == 0
    got = ranked_search.search(make_docs(["one"]), items.limit(0))
    assert got.count() == 0 and dict(got.dtypes)["item_id"] == "string"
    assert [tuple(r)[:3] for r in ranked_search.search(make_docs(["one"]), items).collect()] == [("a", 1, 0)]


def test_tiles_never_reach_2_53():
    for weight in (1, 9_000, 30_000, 10**9):
        width = ranked_search.tile_width(weight, 1 << 40)
        assert width >= 1 and (width * weight * ranked_search.TOP_IMPACT < ranked_search.EXACT or width == 1)
    rng = np.random.default_rng(1)
    weight = rng.integers(1, 30_000, 5000)
    block = ranked_search.blocks_of([np.arange(5000)], weight, 0, 8)[0]
    impact = rng.integers(1, ranked_search.TOP_IMPACT, 5000)
    got = ranked_search.products(block, np.zeros(5000, np.int64), np.arange(5000), impact.astype(float), 1, 512)
    assert int(got[0, 0]) == int((weight * impact).sum())


def test_tied_documents_of_many_tiles(make_docs, spark):
    docs = make_docs(["same text"] * 500 + ["something else"] * 600, list(range(999, -101, -1)))
    items = spark.createDataFrame([(1, "text other")], "item_id long, text string")
    got = ranked_search.search(docs.repartition(9), items, k=20, tile_docs=8).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in got] == [(k + 1, 500 + k) for k in range(20)]


# --- fill-in-middle


def fim_by_hand(doc_id, text, unit, fim=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    sha = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in fill_in_middle.MARKS) or h[2] % 100 >= fim:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


FIM_TEXTS = ["a\nb\n", "\n", "\n\n\n", "é\n漢字\n😀x", "no break", "a <P> b\nc", "<", "<S", "x<P\n>y", "ab<\nM>\n<", "aé" * 50 + "\n" + "😀" * 9 + "\nend", "A\r\nB\r\n C"]


@pytest.mark.parametrize("unit", ["line", "char"])
def test_fill_in_middle_is_exact(make_docs, odd_texts, clashing, unit):
    rng = random.Random(12)
    texts = odd_texts + FIM_TEXTS * 6 + ["".join(rng.choice("ab\n é漢😀<>PSM") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    ids = [None, None, *range(2, len(texts) - 1), 5]
    docs = clashing(make_docs(texts, ids)).withColumn("form", F.lit("own")).withColumn("h1", F.lit(1))
    for more in ({}, {"fim_percent": 60, "spm_percent": 20, "seed": 9}):
        done = fill_in_middle.fill_in_middle(docs, unit=unit, **more)
        got = done.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
        want = [(i, *fim_by_hand(i, t, unit, *([60, 20, 9] if more else []))) for i, t in zip(ids, texts)]
        assert sorted(str(tuple(r)[:-1]) for r in got) == sorted(map(str, want))
        assert sorted(r.back for r in got) == sorted(t or "" for t in texts)
        assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_no_rows_and_bad_marks(make_docs):
    assert fill_in_middle.fill_in_middle(make_docs([])).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "<S>", ""), ("aba", "<S>", "<M>"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(make_docs(["x"]), marks=marks)
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(make_docs(["x"]), unit="word")


def test_multibyte_index_converts_both_ways():
    text = "aé漢😀b" * 7 + "plain" + "ñ"
    data = np.frombuffer(text.encode(), np.uint8)
    index = fill_in_middle.Multibyte(data)
    at = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert index.bytes(np.arange(len(text) + 1)).tolist() == at.tolist()
    assert index.chars(at).tolist() == list(range(len(text) + 1))
    assert len(fill_in_middle.Multibyte(np.frombuffer(b"ascii only", np.uint8)).at) == 0


# --- balanced packing


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(coder_paths()[0])


def check_pieces(rows, docs, library, capacity, end_id=1):
    """The pieces hold the ids of each document once, and sequences have no gap."""
    want = Counter()
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end_id]
        want[i, np.array(ids, "<u4").tobytes()] += 1
    by_doc, sequences = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rs[0].sequence_tokens <= capacity
        assert rs[0].sequence_cost == pytest.approx(sum(balanced_packing.cost(r.length) for r in rs))
    unique = {i for (i, _), n in want.items() if n == 1 and sum(k[0] == i for k in want) == 1}
    for i in unique:
        held = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in held] == [sum(len(x.ids) // 4 for x in held[:k]) for k in range(len(held))]
        whole = b"".join(bytes(r.ids) for r in held)
        assert want[i, whole] == 1 and held[0].doc_tokens == len(whole) // 4
    assert sum(r.length for r in rows) == sum(n * len(ids) // 4 for (_, ids), n in want.items())
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(i for i, _ in docs)
    return sequences


def test_packing_keeps_the_librarys_ids(make_docs, odd_texts, clashing, library):
    rng = random.Random(13)
    texts = odd_texts + [" ".join(words(rng, rng.randint(1, 300))) for _ in range(200)] + ["a<|endoftext|>b", " <|endoftext|> " * 30, "   x\n\n\t y  ", "don't we'll 123 4é５"]
    ids = [None, None, *range(2, len(texts) - 1), 5]
    docs = clashing(make_docs(texts, ids)).withColumn("ids", F.lit("own")).withColumn("copy", F.lit("own"))
    rows = balanced_packing.balanced_sequences(docs, *coder_paths(), capacity=256, group_bytes=20_000).collect()
    sequences = check_pieces(rows, list(zip(ids, texts)), library, 256)
    padding = sum(256 - rs[0].sequence_tokens for rs in sequences.values())
    assert padding <= 0.1 * 256 * len(sequences)
    docs = docs.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    one, two = (balanced_packing.balanced_sequences(docs.repartition(n), *coder_paths(), capacity=256, group_bytes=20_000).collect() for n in (2, 7))
    assert sorted(map(str, one)) == sorted(map(str, two))  # however the table is split


def test_long_texts_are_encoded_in_parts(library):
    rng = random.Random(14)
    coder = balanced_packing.Coder.of(*coder_paths())
    for text in (" ".join(words(rng, 3000)), "x" * 4000, " " * 3000 + "a b" * 200, "wörter, 1 2  3 zwei\n Zeilen " * 90, "a <|endoftext|> b" * 80):
        assert coder.encode(text, most=50).tolist() == library.encode(text, add_special_tokens=False).ids


def test_groups_are_sized_by_bytes(make_docs):
    rows = balanced_packing.balanced_sequences(make_docs(["ab cd " * 3000] * 12, list(range(12))), *coder_paths(), capacity=128, group_bytes=20_000).collect()
    groups = Counter(r.sequence_id >> 32 for r in rows)
    assert len(groups) == 11 and max(groups.values()) < 3 * min(groups.values())
    alike = balanced_packing.balanced_sequences(make_docs(["ab cd ef"] * 3000, [None] * 3000).repartition(4), *coder_paths(), capacity=128, group_bytes=1000).collect()
    groups = Counter(r.sequence_id >> 32 for r in alike)
    assert len(groups) == 27 and max(groups.values()) < 300 and sum(r.length for r in alike) == 3000 * alike[0].doc_tokens


def test_deal_by_hand():
    placed, tokens, spent = balanced_packing.deal([6, 5, 4, 3, 2], 10, 1, work=lambda n: n)
    assert [(i, k) for i, _, _, k, _ in placed] == [(0, 0), (1, 1), (2, 1), (3, 0), (4, 1)] or sum(tokens) == 20
    assert tokens.tolist() == [10, 10] and spent.sum() == 20
    placed, tokens, _ = balanced_packing.deal([7, 7, 6], 10, 2)  # nothing has room for 6: cut
    assert [(p[0], p[1], p[2]) for p in placed] == [(0, 0, 7), (1, 0, 7), (2, 0, 3), (2, 3, 3)] and tokens.tolist() == [10, 10]
    assert len(balanced_packing.deal([7, 7, 6], 10, 4)[1]) == 3  # too little room to cut: one more sequence
    assert balanced_packing.deal([3] * 200, 4, 2)[1].tolist() == [3] * 200


def test_costs_are_nearer_than_first_come(make_docs):
    rng = random.Random(15)
    lengths = sorted((min(2047, int(rng.paretovariate(0.8) * 40)) for _ in range(4000)), reverse=True)
    placed, tokens, spent = balanced_packing.deal(lengths, 2048, 32)
    assert 2048 * len(tokens) - tokens.sum() < 0.01 * tokens.sum()
    costs, used = [0.0], 0
    for n in rng.sample(lengths, len(lengths)):
        if used + n > 2048:
            costs.append(0.0)
            used = 0
        costs[-1] += balanced_packing.cost(n)
        used += n
    assert np.std(spent[:-1]) < 0.5 * np.std(costs[:-1])


def test_packing_of_no_rows(make_docs):
    assert balanced_packing.balanced_sequences(make_docs([]), *coder_paths()).count() == 0


def test_crc_is_of_little_endian_ids(spark, make_docs):
    row = balanced_packing.balanced_sequences(make_docs(["hello world"]), *coder_paths()).select(F.crc32("ids").alias("c"), "ids").first()
    assert row.c == zlib.crc32(bytes(row.ids)) and np.frombuffer(bytes(row.ids), "<u4")[-1] == 1
