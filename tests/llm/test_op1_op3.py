"""Token counts and packing."""

import random

import pytest

from wayfeed.llm import packing, token_counts
from wayfeed.llm.queries import model_path

from .conftest import words

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def test_counts_are_the_librarys(spark, make_docs, odd_texts, clashing, model):
    texts = odd_texts + ["a" * 300 + " " + "b  c\n" * 400, "é😀" * 900, "<s> </s> <unk> ▁▁ x" * 60]
    for chunk, overlap in ((16_384, 256), (200, 4), (64, 1)):
        got = {r.doc_id: r for r in token_counts.token_counts(clashing(make_docs(texts)), model_path(), limit=40, chunk=chunk, overlap=overlap).collect()}
        for i, t in enumerate(texts):
            n = len(model.encode(t or ""))
            assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 40)


def test_empty_table_and_repeated_ids(spark, make_docs):
    assert token_counts.token_counts(make_docs([]), model_path()).count() == 0
    rows = token_counts.token_counts(make_docs(["a b", "a b", "c"], [None, 1, 1]), model_path()).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]


def test_no_stable_boundary_takes_the_whole_text(model):
    _, pairs = token_counts.load(model_path())
    text = "aaaaaaaaan" * 500
    assert token_counts.count_long(model, pairs, text, 50, 2) == len(model.encode(text))


def test_packing_is_a_partition(spark, make_docs, odd_texts, clashing):
    rng = random.Random(1)
    texts = odd_texts + [" ".join(words(rng, rng.randint(1, 900))) for _ in range(300)]
    got = packing.best_fit(clashing(make_docs(texts)), per_group=100).collect()
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.piece_start, r.n_tokens))
        bins.setdefault(r.bin_id, []).append(r)
    split = lambda t: len((t or "").encode().split()) + 1
    for i, t in enumerate(texts):
        at = 0
        for start, n in sorted(by_doc[i]):
            assert start == at
            at += n
        assert at == split(t)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at == rows[0].bin_tokens
        assert rows[0].bin_capacity == min(c for c in packing.CAPACITIES if c >= at)


def test_best_fit_by_hand():
    bins, offsets, sizes = packing.pack([7, 6, 4, 3, 2], (10, 16), cost=lambda c: c)
    assert sizes[bins[0]] == 16 or sizes[bins[0]] == 10
    held = {}
    for b, n in zip(bins, [7, 6, 4, 3, 2]):
        held[b] = held.get(b, 0) + n
    assert all(held[b] <= sizes[b] for b in held) and sum(held.values()) == 22
    assert packing.pack([10, 9, 1], (10,), cost=lambda c: c)[0] == [0, 1, 1]
    assert packing.pack([3], (4, 8), cost=lambda c: 1)[2] == [4]  # downsized to its contents
    assert packing.pack([], (4,)) == ([], [], [])


def test_packing_of_no_rows(make_docs):
    assert packing.best_fit(make_docs([])).count() == 0


def test_rows_of_one_id_spread_over_groups(make_docs):
    texts = ["a few words"] * 3000 + ["some more words here"] * 2000
    got = packing.best_fit(make_docs(texts, [None] * 3000 + [7] * 2000), per_group=100).collect()
    sizes = {}
    for r in got:
        sizes[r.bin_id >> 32] = sizes.get(r.bin_id >> 32, 0) + 1
    assert len(got) == 5000 and sum(r.doc_id is None and r.n_tokens == 4 for r in got) == 3000
    assert len(sizes) == 50 and max(sizes.values()) <= 200


def test_groups_are_sized_by_pieces(spark, make_docs):
    docs = make_docs(["x"] * 20).selectExpr("doc_id", "text", "cast(819200 as bigint) as total")
    got = packing.best_fit(docs, length=docs["total"], per_group=200).groupBy((packing.F.col("bin_id") / (1 << 32)).cast("int").alias("g")).count().collect()
    assert sum(r["count"] for r in got) == 4000 and len(got) == 20 and max(r["count"] for r in got) < 300


def test_best_fit_against_plain_code():
    """Each choice is checked by looking at every open bin and every item still to come."""
    rng = random.Random(11)
    for trial in range(40):
        capacities = sorted(rng.sample([3, 8, 16, 20, 33, 64], rng.randint(1, 4)))
        lengths = sorted((min(capacities[-1], int(rng.expovariate(0.1)) + 1) for _ in range(rng.randint(0, 80))), reverse=True)
        cost = rng.choice([packing.price, lambda c: c + c * c / 10, lambda c: 1.0])
        bins, offsets, sizes = packing.pack(lengths, tuple(capacities), cost)
        opened, used = [], []
        for k, (n, chosen, at) in enumerate(zip(lengths, bins, offsets)):
            rooms = [c - u for c, u in zip(opened, used) if c - u >= n]
            if rooms:
                assert opened[chosen] - used[chosen] == min(rooms)
            else:
                rates = [(cost(c) / (n + min(c - n, sum(m for m in lengths[k + 1 :] if m <= c - n))), c) for c in capacities if c >= n]
                assert chosen == len(opened)
                opened.append(min(rates)[1])
                used.append(0)
            assert at == used[chosen]
            used[chosen] += n
        assert sizes == [min(c for c in capacities if c >= u) for u in used]
