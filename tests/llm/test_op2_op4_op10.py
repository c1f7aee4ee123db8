"""Lattice scores, language identification and the quality classifier."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest

from wayfeed.llm import language, lattice, quality
from wayfeed.llm.queries import model_path

from .conftest import crc, words


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces(model_path())


def test_marginal_is_the_sum_over_all_segmentations(pieces):
    logw = np.log(pieces.prior)
    for word in (b"a", b"the", b"token", "ciónes".encode(), "▁é".encode(), b"\xff\xfe"):
        w, total = b" " + word, 0.0
        for cuts in itertools.product((0, 1), repeat=len(w) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(w)]
            ids = [pieces.ids.get(w[a:b]) for a, b in itertools.pairwise(at)]
            if None not in ids:
                total += math.exp(sum(logw[k] for k in ids))
        assert lattice.word_scores([word], pieces, logw)[0] == pytest.approx(math.log(total), abs=1e-9)
        assert lattice.long_word(w, pieces, logw) == pytest.approx(math.log(total), abs=1e-9)


def test_expected_pieces_spell_the_words(pieces):
    logw, sizes = np.log(pieces.prior), np.array([len(p) for p in pieces.texts] + [0])
    own, weights = [b"theatre", b"x" * 120, "ñandú".encode()], np.array([2.0, 1.0, 3.0])
    counts = np.zeros(len(logw))
    lattice.word_scores(own, pieces, logw, counts, weights)
    assert counts @ sizes == pytest.approx(sum(w * (len(o) + 1) for o, w in zip(own, weights)))


def test_scores_against_brute_force(spark, make_docs, odd_texts, clashing, pieces):
    rng = random.Random(2)
    texts = odd_texts + [" ".join(words(rng, rng.randint(1, 80))) for _ in range(60)]
    docs = clashing(make_docs(texts))
    got = {r.doc_id: r for r in lattice.lattice_scores(docs.drop("n_tokens"), model_path(), rounds=2, flush_bytes=20_000).collect()}
    split = lambda t: [*(t or "").encode().lower().split(), None]
    c = collections.Counter(w for i, t in enumerate(texts) if crc(i) % 10 for w in split(t))
    n, v = sum(c.values()), len(c)
    weights = pieces.prior
    for _ in range(2):
        counts = np.zeros(len(weights))
        own = [w for w in c if w is not None]
        lattice.word_scores(own, pieces, np.log(np.maximum(weights, 1e-300)), counts, np.ones(len(own)))
        weights = pieces.prior * 1000.0 + counts
        weights[pieces.end] = 0
        weights = weights / weights.sum()
    logw = np.log(np.maximum(weights, 1e-300))
    left = 0.75 * (v - 1) / n
    for i, t in enumerate(texts):
        tokens = split(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        score = math.log10(c[None] / n)
        for w in tokens[:-1]:
            score += math.log10(max(0.0, c[w] - 0.75) / n + left * math.exp(lattice.word_scores([w], pieces, logw)[0]))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 10 == 0, len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if "x" * 5000 != t:
            assert r.score == pytest.approx(score, rel=1e-6)
        assert r.score <= 0


def test_scores_of_odd_tables(make_docs):
    assert lattice.lattice_scores(make_docs([]), model_path(), rounds=1).count() == 0
    held = next(i for i in range(99) if crc(i) % 10 == 0)
    row = lattice.lattice_scores(make_docs(["a b"], [held]), model_path(), rounds=1).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score < 0
    rows = lattice.lattice_scores(make_docs(["a b", "a b", None], [None, 7, 7]), model_path(), rounds=1, discount=None).collect()
    assert len(rows) == 3 and not any(r.held_out for r in rows if r.doc_id is None)


class SlowKneserNey:
    """Interpolated Kneser-Ney over dictionaries of tuples, straight from its definition."""

    def __init__(self, texts, order=4):
        self.order, self.counts = order, {order: collections.Counter()}
        for t in texts:
            plain = [" "] * (order - 1)
            for ch in t:
                low = ch.lower() if len(ch.lower()) == 1 else ch
                if ch.isalpha() or len(plain) < order or plain[-1] != " ":
                    plain.append(low if ch.isalpha() else " ")
            self.counts[order].update(tuple(plain[k : k + order]) for k in range(len(plain) - order + 1))
        for n in range(order - 1, 0, -1):
            self.counts[n] = collections.Counter(g[1:] for g in self.counts[n + 1])
        self.alphabet = sorted({g[0] for g in self.counts[1]})

    def probability(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(self.alphabet) + 1)
        c = self.counts[n]
        once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        follow = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        lower = self.probability(gram[1:])
        if not follow:
            return lower
        total = sum(follow.values())
        return max(c[gram] - discount, 0) / total + discount * len(follow) / total * lower if gram in c else discount * len(follow) / total * lower


def code(gram):
    out = 0
    for ch in gram:
        out = (out << 16) | ord(ch)
    return out


def test_kneser_ney_against_its_definition():
    rng = random.Random(3)
    texts = {"xx": [" ".join(words(rng, 12)) for _ in range(4)] + ["Ab--ab 7 é", ""], "yy": [" ".join(words(rng, 9, "ou")) for _ in range(3)]}
    slow = {k: SlowKneserNey(t) for k, t in texts.items()}
    counts = {k: np.unique(language.grams(*language.symbols(t))[0], return_counts=True) for k, t in texts.items()}
    models, fast = language.Models(counts), {k: language.KneserNey(*c) for k, c in counts.items()}
    seen = sorted(slow["xx"].counts[4]) + sorted(slow["yy"].counts[4])
    contexts = [g[:-1] for g in rng.sample(seen, 25)] + [("q", "q", "q"), (" ", "q", "z"), ("z", "z", "a")]
    for k, model in slow.items():
        grams = [(*c, a) for c in contexts for a in [*model.alphabet, "\u4e00"]]  # the last one is in no text
        want = np.array([model.probability(g) for g in grams])
        asked = np.array([code(g) for g in grams], np.uint64)
        assert fast[k].probability(asked) == pytest.approx(want, rel=1e-9)
        together = models.log_probability(asked)[:, models.languages.index(k)]
        assert together == pytest.approx(np.log(want), rel=1e-4, abs=1e-4)
        # The alphabet and one symbol for all others share a probability of one after every context.
        assert want.reshape(len(contexts), -1).sum(axis=1) == pytest.approx(np.ones(len(contexts)), abs=1e-9)
    text = "Ab ou--é"
    entropy, _ = models.cross_entropies([text])
    for k, model in slow.items():
        plain = "   ab ou é"
        want = -sum(math.log(model.probability(tuple(plain[i : i + 4]))) for i in range(len(plain) - 3)) / (len(plain) - 3)
        assert entropy[0, models.languages.index(k)] == pytest.approx(want, rel=1e-4)


def test_languages(spark, make_docs, odd_texts, clashing):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    kinds = {"aa": "ae", "bb": "ou", "cc": "i"}
    rows = [(lang, " ".join(words(rng, rng.randint(5, 60), v))) for lang, v in kinds.items() for _ in range(60)]
    docs = make_docs([t for _, t in rows])
    lang = F.element_at(F.array(*[F.lit(x) for x, _ in rows]), (F.col("doc_id") + 1).cast("int"))
    detector = language.train(docs.withColumn("lang", lang))
    got = {r.doc_id: r for r in language.detect(docs, detector).collect()}
    assert sum(got[i].lang_pred == rows[i][0] for i in range(len(rows))) >= 0.97 * len(rows)
    odd = {r.doc_id: r for r in language.detect(clashing(make_docs(odd_texts)), detector).collect()}
    for i, t in enumerate(odd_texts):
        no_letter = not any(c.isalpha() for c in t or "")
        assert (odd[i].lang_pred == "und") == no_letter and 0 <= odd[i].score <= 1
        assert not no_letter or odd[i].rejected
    assert odd[6].rejected  # other scripts
    assert language.detect(make_docs([]), detector).count() == 0
    assert language.train(make_docs([])) is None
    assert [r.lang_pred for r in language.detect(make_docs(["abc"]), None).collect()] == ["und"]


def test_quality(spark, make_docs, odd_texts, clashing):
    rng = random.Random(6)
    texts, marks = [], []
    for _ in range(240):
        good = rng.random() < 0.7
        own = words(rng, rng.randint(20, 80))
        texts.append(" ".join(own) + "." if good else rng.choice([" ".join(w.upper() + "!!" for w in own), " ".join(w for w in own[:9] for _ in range(9)), " ".join(w + rng.choice(["###", "%%%"]) for w in own)]))
        marks.append(int(good))
    docs = make_docs(texts)
    labels = spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)] + [(3, None, 0), (None, 1, 0), (5, 7, 1), (8, marks[8], 0)], "doc_id long, quality int, toxic int")
    weights = quality.train(quality.training_rows(clashing(docs), labels))
    got = {r.doc_id: r for r in quality.score(docs, weights).collect()}
    held = [i for i in range(len(texts)) if crc(i) % 5 == 0]
    assert sum(got[i].predicted == marks[i] for i in held) >= 0.95 * len(held)
    odd = quality.score(clashing(make_docs(odd_texts)), weights)
    assert odd.columns.count("score") == 1 and odd.schema["score"].dataType.simpleString() == "double"
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd.collect()) and odd.count() == len(odd_texts)
    none = quality.train(quality.training_rows(make_docs([]), labels))
    assert [r.score for r in quality.score(make_docs(["a"]), none).collect()] == [0.5]
    assert quality.score(make_docs([]), weights).count() == 0


def test_updates_follow_the_rule():
    x = (np.array([0, 4]), np.array([1.0, 1.0]), 1)
    w = quality.ftrl([x], 2, 1, 0.5, 1.0, 0.0, 0.0)
    # One step from 0: z = g = -0.5, n = 0.25, w = 0.5 / ((1 + 0.5) / 0.5)
    assert w[0] == pytest.approx(1 / 6) and w[4] == pytest.approx(1 / 6) and not w[1:4].any()


def slow_features(text):
    """N-grams of words and shapes as tuples, in the order of ``quality.features``."""
    tokens = []
    for m in re.finditer(rb"[!-/:-@\[-`{-~]+|[^\x09-\x0d !-/:-@\[-`{-~]+", text.encode()):
        raw = m.group()
        tokens.append((not re.match(rb"[!-/:-@\[-`{-~]", raw), raw, raw.lower()))
    shapes = []
    for k, (is_word, raw, low) in enumerate(tokens):
        caps = sum(65 <= b < 91 for b in raw)
        kind = "lower" if not caps else ("title" if caps == 1 else "upper" if caps == len(raw) else "mixed")
        shapes.append((kind, k > 0 and tokens[k - 1][2] == low) if is_word else low)
    plain = [low for is_word, _, low in tokens if is_word]
    grams = lambda name, x, n: [(name, *x[k : k + n]) for k in range(len(x) - n + 1)]
    return [g for n in (1, 2) for g in grams(f"w{n}", plain, n)] + [g for n in (1, 2, 3) for g in grams(f"s{n}", shapes, n)]


QUALITY_TEXTS = ["Same end", "end of Same SAME same", "", "a-b--C d!! !! d", "  \t", "É é iPhone X xx", "Same end", "end end END. end"]


def test_quality_features_and_scores_against_plain_code(spark, make_docs):
    joined = "".join(QUALITY_TEXTS).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in QUALITY_TEXTS])
    h, first = quality.features(np.frombuffer(joined, np.uint8), offsets, 31)
    named = {}
    for k, t in enumerate(QUALITY_TEXTS):
        want, found = slow_features(t), h[first[k] : first[k + 1]].tolist()
        assert len(want) == len(found)
        for gram, number in zip(want, found):
            assert named.setdefault(gram, number) == number
    assert len(set(named.values())) == len(named)

    weights = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1)
    got = quality.score(make_docs(QUALITY_TEXTS).coalesce(1), weights).collect()
    w = weights.astype(np.float32).astype(np.float64)
    alone = [quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in QUALITY_TEXTS]
    for r in got:
        f = alone[r.doc_id]
        z = w[-1] + quality.SCALE * sum(w[k] for k in f.tolist()) / max(1, len(f))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)
    # Equal texts have equal scores to the last digit, wherever they lie among others.
    by = {r.doc_id: r.score for r in got}
    assert by[0] == by[6] and by[2] == by[4]
