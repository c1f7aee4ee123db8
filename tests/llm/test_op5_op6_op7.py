"""Embeddings, k-d shards and SimHash groups."""

import math
import random
import zlib

import numpy as np
import pytest

from wayfeed.llm import common, embeddings, kd_shards, simhash

from .conftest import words


def reachable(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2001 + k) for k in range(60)]
    want = reachable({x for p in links for x in p}, links)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in set(want) - set(got))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    v = [(centres[rng.integers(12)] + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.2])).astype(np.float32).tolist() for _ in range(220)]
    v += [v[0]] * 40 + [[2 * x for x in v[1]]]
    rows = [(i, x, int(rng.integers(3))) for i, x in enumerate(v)]
    odd = [None, [], [0.0] * 24, [math.nan] + v[0][1:], [math.inf] + v[0][1:], [None] + v[0][1:], v[0][:5]]
    rows += [(1000 + k, x, 1) for k, x in enumerate(odd)] + [(2000, v[0], None), (None, v[0], 1), (0, v[0], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embeddings.embedding_groups(df.selectExpr("*", "1 as n", "2 as dim", "3 as rid", "4 as fine"), rows_per_tile=16, sample=100).collect()
    fine = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links, n = [], {}
    for a, (i, x, la) in enumerate(fine):
        for j, y, lb in fine[a + 1 :]:
            if la == lb and len(x) == len(y):
                p, q = np.array(x, np.float64), np.array(y, np.float64)
                if p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= 0.98:
                    links.append((i, j))
                    n[i], n[j] = n.get(i, 0) + 1, n.get(j, 0) + 1
    low = reachable({r[0] for r in rows if r[0] is not None}, links)
    assert len(got) == len(rows) and len(links) > 500
    for r in got:
        assert r.vec_id is None or (r.component_id, r.kept) == (low[r.vec_id], low[r.vec_id] == r.vec_id)
        if r.vec_id not in (0, None):
            assert r.n_links == n.get(r.vec_id, 0)
    assert embeddings.embedding_groups(df.limit(0)).count() == 0


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 40))
    x[150:] = x[:150] + rng.normal(size=(150, 40)) * 0.1
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    i, j = embeddings.close_pairs(x, x, 0.98)
    assert {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.98))} <= set(zip(i.tolist(), j.tolist()))


def test_double_components_are_not_rounded(spark):
    rows = [(1, [1e39, 0.0], 1), (2, [1e39, 0.0], 1), (3, [1.0, 1e-12], 1), (4, [0.0, 1e-60], 1), (5, [0.0, 2e-60], 1)]
    got = embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}


def test_shards(spark, make_docs, odd_texts, clashing):
    rng = random.Random(9)
    texts = odd_texts + [" ".join(words(rng, rng.randint(1, 60))) for _ in range(900)] + ["the same text again and again"] * 500
    ids = [None if k == 3 else k for k in range(len(texts))]
    docs = clashing(make_docs(texts, ids)).union(clashing(make_docs(texts[:5], range(5))))
    got = kd_shards.kd_shards(docs, shards=7).collect()
    assert len(got) == len(texts) + 5
    sizes, slots, shards_of = {}, {}, {}
    for r in got:
        t = (texts[r.doc_id] if r.doc_id is not None else texts[3]) or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "bytes", None)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        shards_of.setdefault(t, set()).add(r.shard)
    assert set(sizes) == set(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(sizes.values()) / 7, max(r.size for r in got)
    assert all(abs(s - mean) <= largest * 0.6 for s in sizes.values())
    # Only cuts inside a group of copies part it.
    assert sum(len(s) > 1 for s in shards_of.values()) <= 6 and len(shards_of["the same text again and again"]) >= 1
    assert kd_shards.kd_shards(make_docs([])).count() == 0
    assert [r.shard for r in kd_shards.kd_shards(make_docs(["a"]), shards=1).collect()] == [0]


def test_shards_near_equal(spark, make_docs):
    rng = random.Random(10)
    texts = [" ".join(words(rng, rng.randint(1, 30))) for _ in range(4000)] + ["copy " * 9] * 1500
    got = kd_shards.kd_shards(make_docs(texts), shards=10).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 10


def test_shards_are_near_equal_where_half_the_rows_are_alike(spark, make_docs):
    rng = random.Random(16)
    texts = [" ".join(words(rng, rng.randint(20, 60))) for _ in range(1500)]
    docs = make_docs(texts + ["one text of many rows without an id, " * 9] * 1500, [*range(1500), *[None] * 1500])
    got = kd_shards.kd_shards(docs.repartition(5), shards=40).collect()
    sizes, slots = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(sizes.values()) / 40
    assert len(got) == 3000 and set(sizes) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(abs(s - mean) for s in sizes.values()) <= 0.05 * mean


def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    n = max(1, len(w) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def test_simhash_groups(spark, make_docs, odd_texts, clashing):
    rng = random.Random(11)
    texts = list(odd_texts)
    for _ in range(25):
        base = words(rng, rng.randint(30, 400))
        texts += [" ".join(base)] + [" ".join([w if rng.random() > 0.004 else "other" for w in base]) for _ in range(4)]
    ids = [1000 - k for k in range(len(texts))]
    got = {r.doc_id: r for r in simhash.simhash_groups(clashing(make_docs(texts, ids)).drop("bits")).collect()}
    prints = {i: brute_fingerprint(t) for i, t in zip(ids, texts)}
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    low = reachable(ids, links)
    assert len({(a, b) for a, b in links if prints[a] != prints[b]}) > 20
    for i in ids:
        assert (got[i].fingerprint, got[i].component_id) == (f"{prints[i]:016x}", low[i])
    assert simhash.simhash_groups(make_docs([])).count() == 0
    rows = simhash.simhash_groups(make_docs(["a b c", "a b c", "a b c"], [None, 5, 5])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == [("5", 5), ("5", 5), ("None", 5)]


@pytest.mark.parametrize("most", [4096, 3])
def test_near_links_on_dense_groups(spark, most):
    rng = random.Random(12)
    values = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(60):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = reachable(signed, [(signed[i], signed[j]) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3])
    links = [(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(s,) for s in signed], "bits long"), most=most).collect()]
    assert reachable(signed, links) == want


def test_tree_finds_all_within_radius():
    rng = random.Random(13)
    tree, values = simhash.Tree(), [rng.getrandbits(12) for _ in range(300)]
    for v in values:
        tree.add(v, 2)
    for q in values[:40]:
        assert sorted(tree.within(q, 2)) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 2]


def jaccard(a, b, n=5):
    x, y = ({tuple(t.lower().split()[k : k + n]) for k in range(max(1, len(t.split()) - n + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("most", [4096, 40])
def test_near_copies_by_five_words(spark, make_docs, clashing, most, monkeypatch):
    """Copies with a few words edited are one group, texts that share a third of their words are not."""
    monkeypatch.setattr(simhash.wide_links, "__defaults__", (most, 3))
    rng = random.Random(8)
    bases = [words(rng, rng.randint(120, 400)) for _ in range(60)]
    edited = []
    for k, base in enumerate(bases):
        copy = list(base)
        for at in rng.sample(range(len(copy)), max(1, len(copy) // 100)):
            copy[at] = "edited"
        edited.append(copy)
    other = [b[: len(b) // 3] + words(rng, 2 * len(b) // 3) for b in bases]
    family = [[w if rng.random() > 0.01 else "new" for w in bases[0]] for _ in range(150)]
    texts = [" ".join(t) for t in [*bases, *edited, *other, *family]]
    assert min(jaccard(texts[k], texts[60 + k]) for k in range(60)) >= 0.85
    got = {r.doc_id: r.component_id for r in simhash.near_copies(clashing(make_docs(texts))).collect()}
    assert len(got) == len(texts)
    assert sum(got[60 + k] == k for k in range(60)) >= 57
    assert [got[120 + k] for k in range(60)] == list(range(120, 180)) and [got[k] for k in range(60)] == list(range(60))
    assert sum(got[180 + k] == 0 for k in range(150)) >= 145


def test_near_copies_of_odd_rows(spark, make_docs, odd_texts):
    texts = [*odd_texts, "no id", "twice", "other"]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(make_docs(texts, [*range(len(odd_texts)), None, 99, 99])).collect()}
    assert got == {k: k for k in got} | {1: 0, 2: 0, 8: 7, 9: 7}
    assert simhash.near_copies(make_docs([])).count() == 0


def test_wide_links_join_what_brute_force_joins(spark):
    """Components of links are those of all pairs that are near and agree in a key."""
    rng = random.Random(21)
    base = words(rng, 300)
    texts = [" ".join(w if rng.random() > 0.025 else f"w{rng.randint(0, 99)}" for w in base) for _ in range(120)]
    made = [simhash.wide_print(t.encode()) for t in texts]
    radius = simhash.wide_radius(0.8)
    values = spark.createDataFrame([(k, bytearray(p), keys.tolist()) for k, (p, keys) in enumerate(made)], "id long, print binary, keys array<int>")
    root = list(range(120))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(120):
        for j in range(i):
            near = (int.from_bytes(made[i][0], "big") ^ int.from_bytes(made[j][0], "big")).bit_count() <= radius
            if near and (made[i][1] == made[j][1]).any():
                root[max(up(i), up(j))] = min(up(i), up(j))
    got = {r.node: r.component for r in common.components(simhash.wide_links(values, radius), "test").collect()}
    assert {k: got.get(k, k) for k in range(120)} == {k: up(k) for k in range(120)}


def test_wide_links_lose_no_pair_of_a_large_group(spark):
    """One key shared by all, the others by none: every near pair is found however small the parts."""
    rng = random.Random(31)
    prints = []
    for _ in range(100):
        x = rng.getrandbits(512)
        prints += [x, x ^ sum(1 << b for b in rng.sample(range(512), 60))]
    rows = [(k, bytearray(p.to_bytes(64, "big")), [7] + [1000 * k + j for j in range(31)]) for k, p in enumerate(prints)]
    values = spark.createDataFrame(rows, "id long, print binary, keys array<int>")
    got = {(r.node, r.component) for r in common.components(simhash.wide_links(values, 85, 20), "test").collect()}
    assert got == {(k, k - k % 2) for k in range(200)}


def test_near_copies_are_those_of_exact_similarity(spark, make_docs):
    """Pairs below 0.8 stay, also short ones; pairs at 0.8 or more link."""
    rng = random.Random(32)
    texts, want = [], {}
    for k in range(150):
        base = words(rng, (8, 9, 15, 40, 240)[k % 5])
        copy = list(base)
        for at in rng.sample(range(len(base)), max(1, len(base) * (k % 3 + 1) // 90)):
            copy[at] = "edited"
        texts += [" ".join(base), " ".join(copy if k % 5 > 1 else base + words(rng, 1))]
        want[2 * k + 1] = 2 * k if jaccard(*texts[-2:]) >= 0.8 else 2 * k + 1
    got = {r.doc_id: r.component_id for r in simhash.near_copies(make_docs(texts)).collect()}
    assert 30 < sum(k % 2 and v == k for k, v in want.items()) < 120
    wrong = [k for k in want if got[k] < want[k]]
    missed = [k for k in want if got[k] > want[k]]
    assert not wrong and len(missed) <= 3 and all(len(texts[k].split()) > 80 for k in missed)


@pytest.mark.parametrize("budget", [10**6, 60])
def test_open_links_connect_what_brute_force_connects(spark, budget):
    rng = random.Random(33)
    sets = [sorted(rng.sample(range(24), rng.randint(17, 22))) for _ in range(60)]
    rows = [(k, k % 2, len(x), bytearray(np.array(x, np.uint64).tobytes())) for k, x in enumerate(sets)]
    near = lambda x, y: len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))
    links = [(i, j) for i in range(60) for j in range(i % 2, i, 2) if near(sets[i], sets[j])]
    frame = spark.createDataFrame(rows, "node long, component long, size long, members binary")
    known = links[: len(links) // 8]
    parts = common.components(spark.createDataFrame(known, "a long, b long"), "test")
    got = [(r.a, r.b) for r in simhash.open_links(frame, parts, 0.8, budget).collect()]
    assert {(max(x), min(x)) for x in got} <= set(links)
    assert reachable(range(60), got + known) == reachable(range(60), links)


def test_wide_links_bound_the_work_of_a_family(spark, monkeypatch):
    """Thousands of nearly equal values link to centres; hardly any is left to be dealt in tiles."""
    rng, dealt = random.Random(34), []
    base = rng.getrandbits(512)
    prints = [base ^ sum(1 << b for b in rng.sample(range(512), 18)) for _ in range(3000)]
    outer = [p ^ sum(1 << b for b in rng.sample(range(512), 75)) for p in prints[:20]]
    rows = [(k, bytearray(p.to_bytes(64, "big")), [5] * 3) for k, p in enumerate(prints + outer)]
    whole = simhash.tiles
    monkeypatch.setattr(simhash, "tiles", lambda rows, *more: dealt.append(rows.count()) or whole(rows, *more))
    values = spark.createDataFrame(rows, "id long, print binary, keys array<int>")
    got = {r.node: r.component for r in common.components(simhash.wide_links(values, 101, 100), "test").collect()}
    assert got == {k: 0 for k in range(3020)} and dealt[0] <= 3 * 20


def linked_by_brute_force(rows, threshold=0.98):
    """Links and component of each id; rows are (id, vector, label)."""
    n, links = {i: 0 for i, _, _ in rows}, []
    for label in {la for _, _, la in rows}:
        some = [(i, np.array(x, np.float64)) for i, x, la in rows if la == label]
        u = np.array([x / np.sqrt(x @ x) for _, x in some])
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1))):
            links.append((some[a][0], some[b][0]))
            n[some[a][0]] += 1
            n[some[b][0]] += 1
    low = reachable(list(n), links)
    return {i: (n[i], low[i], low[i] == i) for i in n}


@pytest.mark.parametrize("dim", [40, 6])
def test_embeddings_of_large_labels_go_to_cells(spark, dim):
    """A label of many cells and blocks: pairs across cuts, a dense group, and copies spread over all batches."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(900, dim))
    x[300:600] = x[:300] + rng.normal(size=(300, dim)) * rng.choice([0.05, 0.15, 0.2], size=(300, 1))
    x[600:760] = x[5] + rng.normal(size=(160, dim)) * 0.07
    x[760:820] = x[7]
    x[820:830] = np.where(np.abs(x[8]) < 0.5, 0.0, x[8])
    x[820:825] = np.where(x[820:825] == 0, -0.0, x[820:825])
    rows = [(int(i), [float(v) for v in row.astype(np.float32)], int(k % 10 == 9)) for k, (i, row) in enumerate(zip(rng.permutation(900), x))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    want = linked_by_brute_force(rows)
    assert sum(n for n, _, _ in want.values()) > 5_000
    for cell_bytes in (900 * dim, 96 << 20):
        got = embeddings.embedding_groups(df, rows_per_tile=16, sample=400, cell_bytes=cell_bytes).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want


def test_embeddings_store_no_pairs_of_tiles(spark, tmp_path, monkeypatch):
    """What is stored follows the links; sending a vector to each tile of its label grows with the label's size."""
    rng = np.random.default_rng(18)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(rng.normal(size=(1500, 64)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(common, "shared_dir", lambda session, purpose: str(tmp_path / f"{purpose}-{len(list(tmp_path.iterdir()))}"))
    assert embeddings.embedding_groups(df, rows_per_tile=64).filter("n_links = 0 and kept").count() == 1500
    assert 0 < sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 1500 * 64 * 4 / 4


def test_cells_meet_every_close_pair_once():
    rng = np.random.default_rng(19)
    x = rng.normal(size=(700, 12)).astype(np.float32)
    x[350:] = x[:350] + rng.normal(size=(350, 12)).astype(np.float32) * 0.2
    columns = embeddings.along(x, {}, 5)
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    nodes = embeddings.grow(columns, 40)[1]
    rows, cells, guest = embeddings.deal(nodes, columns, 0.04 + embeddings.SLACK)
    assert sorted(rows[~guest].tolist()) == list(range(700)) and len(set(cells.tolist())) > 8
    home = dict(zip(rows[~guest].tolist(), cells[~guest].tolist()))
    visited = {}
    for r, c in zip(rows[guest].tolist(), cells[guest].tolist()):
        visited.setdefault(r, set()).add(c)
    for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.98, 1))):
        meets = (home[a] == home[b]) + (home[b] in visited.get(a, ())) + (home[a] in visited.get(b, ()))
        assert meets == 1


def test_a_cell_without_members_links_nothing():
    cell = embeddings.Cell({}, 0.98, 4, 8, 100)
    h, n, x = np.arange(50), np.ones(50, np.int64), np.ones((50, 8), np.float32)
    assert not [*cell.feed(True, h, h, h, n, x), *cell.finish()]


def test_copies_of_a_guest_count_once_wherever_batches_end():
    """Equal guests that come in several batches are one, linked with all members close to them."""
    cell = embeddings.Cell({}, 0.98, 4, 8, 64)
    one, none = np.ones((1, 8), np.float32), np.zeros(1, np.int64)
    x = np.concatenate([one, one * 2, -one, np.eye(8, dtype=np.float32)])
    h = np.arange(len(x))
    out = [*cell.feed(False, h, h, h + 10, np.ones(len(x), np.int64), x)]
    for k in (7, 5, 6):
        out += cell.feed(True, none, none, none + k, none + 2, one)
    out += [*cell.feed(True, none + 1, none, none + 4, none + 1, -one), *cell.finish()]
    got = sorted((r["rid"], r["links"]) for b in out for r in b.to_pylist())
    assert got == [(4, 1), (5, 2), (10, 7), (11, 7), (12, 1)]


def test_a_cut_cell_is_freed_at_once():
    """Nothing waits for the collector of cycles, which may not run while a task goes through large cells."""
    import gc
    import weakref

    columns = np.random.default_rng(20).normal(size=(4, 500)).astype(np.float32)
    held = weakref.ref(columns)
    gc.disable()
    try:
        assert len(embeddings.grow(columns, 20)[1]) > 15
        del columns
        assert held() is None
    finally:
        gc.enable()
