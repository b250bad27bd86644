import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hornspark.llm import lm_scoring as lm

from . import brute

PIECES = (b"a", b"b", b" ", b"ab", b" a", b"bab", b"aba")
SCORES = np.log(np.array([0.2, 0.1, 0.1, 0.2, 0.1, 0.1, 0.1]))
WORDS = [b" abab", b"a", b" baba", b" ab" * 3, b" " + b"ab" * 60]


def forward(word, scores):
    p = dict(zip(PIECES, np.exp(scores)))
    a = [1.0]
    for j in range(1, len(word) + 1):
        a.append(sum(a[i] * p.get(word[i:j], 0) for i in range(j)))
    return math.log(a[-1])


def test_marginals():
    two = np.stack([SCORES, SCORES[::-1]], 1)
    got, _ = lm.Lattice(PIECES, two).marginals(WORDS)
    assert np.allclose(got, [[forward(w, SCORES), forward(w, SCORES[::-1])] for w in WORDS])


def test_expected_counts_are_the_gradient():
    counts = np.array([1.0, 2, 1, 3, 1])
    _, expected = lm.Lattice(PIECES, SCORES[:, None]).marginals(WORDS, counts)
    for i in range(len(PIECES)):
        up, down = SCORES.copy(), SCORES.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = sum(c * (forward(w, up) - forward(w, down)) for c, w in zip(counts, WORDS)) / 2e-5
        assert expected[i] == pytest.approx(slope, abs=1e-3)


def test_vocabulary_is_found_whole():
    pieces = lm.vocabulary(lm.vocabulary_path())
    lattice = lm.Lattice(pieces, np.zeros((len(pieces), 1)))
    keys = np.array([lattice._key(p) for p in pieces], np.uint64)
    assert (lattice.find(keys) == np.arange(len(pieces))).all() and (lattice.find(keys + np.uint64(1)) < 0).all()
    assert {bytes([b]) for b in range(256)} <= set(pieces)


def scored(df):
    return {r.doc_id: r for r in lm.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()}


@pytest.mark.parametrize("frequent", [10**6, 20])
def test_base(texts, table, monkeypatch, frequent):
    """Base scores, with all words frequent and with most of them joined."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    got, expected = scored(table(texts)), brute.base_scores(texts, brute.held_out)
    for d, (held, tokens, known, n, base) in expected.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_scores_do_not_depend_on_the_way(texts, table, monkeypatch):
    whole = scored(table(texts))
    monkeypatch.setattr(lm, "FREQUENT", 20)
    monkeypatch.setattr(lm, "BATCH_BYTES", 1000)
    joined = scored(table(texts, 5))
    assert all(joined[d].score == pytest.approx(r.score, rel=1e-6) for d, r in whole.items())


def test_a_model_of_one_class_is_the_sum_of_its_parts(spark, table):
    """Score of a text = end + sum of its words, each from its arc and its lattice."""
    docs = [(i, "aa bb aa") for i in range(30)]
    got = scored(table(docs))
    train = [d for d, _ in docs if not brute.held_out(d)]
    n, ends = 4 * len(train), len(train)
    word = {"aa": (2 * ends - lm.DISCOUNT) / n, "bb": (ends - lm.DISCOUNT) / n}
    floor = math.log10((ends - lm.DISCOUNT) / n) + 2 * math.log10(word["aa"]) + math.log10(word["bb"])
    assert floor < got[0].score < floor + 0.5


def test_nothing_to_learn_from(spark, table):
    held = next(d for d in range(100) if brute.held_out(d))
    got = scored(table([(held, "a b")]))
    assert got[held].train_tokens == 0 and got[held].n_known == 0 and got[held].base_score == 0.0 and got[held].score < 0
    assert lm.score(table([]), F.lit(False)).count() == 0


def test_nulls_and_repeats(table):
    docs = [(1, None), (1, None), (None, "x y"), (3, "x y"), (3, "x y")]
    got = lm.score(table(docs), F.lit(False)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.train_tokens) for r in got) == [(0, 3, 11), (1, 1, 11), (1, 1, 11), (3, 3, 11), (3, 3, 11)]
    assert lm.score(table(docs), F.lit(None).cast("boolean")).filter("held_out").count() == 0


def test_rare_words_outweigh_the_frequent_ones(spark, monkeypatch):
    """Frequent words of one class and rare words of another: no class is left out before both are counted."""
    rare = [f"wort{i}" for i in range(200)]
    docs = [(i, "the " * 50, "en") for i in range(40)] + [(100 + i, " ".join(rare[i % 4 * 50 : i % 4 * 50 + 50]), "de") for i in range(40)]
    docs.append((-1, "the " * 40 + " ".join(rare[:60]), "en"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = []
    for frequent in (20, 1_000_000):  # the rare words are joined, or all words are frequent
        monkeypatch.setattr(lm, "FREQUENT", frequent)
        got.append({r.doc_id: r.score for r in lm.score(df, F.col("doc_id") < 0).collect()})
    assert got[0] == pytest.approx(got[1])


def plain_model(docs, held):
    """The model of (id, text, class) rows in plain Python: EM over all segmentations, word arcs, mixture."""
    pieces = lm.vocabulary(lm.vocabulary_path())
    ids = {p: i for i, p in enumerate(pieces)}
    longest = max(map(len, pieces))
    given = lm.given_weights(len(pieces))

    def arcs(word):
        return [[(i, ids[word[i:j]]) for i in range(max(0, j - longest), j) if word[i:j] in ids] for j in range(1, len(word) + 1)]

    def forward(word, p):
        a = [1.0]
        for found in arcs(word):
            a.append(math.fsum(a[i] * p[k] for i, k in found))
        return a

    def probabilities(weights):
        first = math.fsum(w for w, x in zip(weights, pieces) if x.startswith(b" "))
        rest = math.fsum(weights) - first
        return [w / (first if x.startswith(b" ") else rest) for w, x in zip(weights, pieces)] + [weights[-1] / rest]

    tokens = {d: [b" " + w.encode() for w in brute.ws_words(brute.folded(t))] for d, t, _ in docs}
    models = {}
    for cls in {c for d, _, c in docs if not held(d)}:
        own = [d for d, _, c in docs if c == cls and not held(d)]
        counts = {}
        for d in own:
            for w in tokens[d]:
                counts[w] = counts.get(w, 0) + 1
        p = probabilities(given.tolist())
        for _ in range(lm.ROUNDS if counts else 0):
            weights = [lm.PRIOR * g for g in given]
            for w in counts:
                a, found = forward(w, p), arcs(w)
                b = [0.0] * len(w) + [1.0]
                for j in range(len(w), 0, -1):
                    for i, k in found[j - 1]:
                        b[i] += p[k] * b[j]
                for j in range(1, len(w) + 1):
                    for i, k in found[j - 1]:
                        weights[k] += a[i] * p[k] * b[j] / a[-1]
            weights[-1] += len(counts)
            p = probabilities(weights)
        n = sum(counts.values()) + len(own)
        models[cls] = (len(own), n, counts, p)
    docs_seen = sum(m[0] for m in models.values())
    out = {}
    for d, own in tokens.items():
        logs = []
        for n_docs, n, counts, p in models.values():
            share = lm.DISCOUNT * (len(counts) + 1) / n
            log = math.log(n_docs / docs_seen) + math.log((n_docs - lm.DISCOUNT) / n)
            for w in own:
                log += math.log(max(counts.get(w, 0) - lm.DISCOUNT, 0) / n + share * forward(w, p)[-1] * p[-1])
            logs.append(log)
        best = max(logs)
        out[d] = (best + math.log(sum(math.exp(x - best) for x in logs))) / math.log(10)
    return out


@pytest.mark.parametrize("frequent", [1, 20, 10**6])
def test_score_is_the_plain_mixture(spark, monkeypatch, frequent):
    """Three languages, words that several share and words that none has, against plain Python."""
    import random

    rng = random.Random(11)
    heads = {"en": ["the", "ring", "thing", "straße"], "de": ["der", "ring", "straße", "unding"], "fr": ["le", "chose", "ring", "é"]}
    docs = []
    for d in range(60):
        cls = rng.choice(sorted(heads))
        other = rng.choice(sorted(heads)) if rng.random() < 0.3 else cls
        docs.append((d, " ".join(rng.choice(heads[rng.choice([cls, other])]) + rng.choice(["", "", "s", "en", "ing", str(rng.randrange(9))]) for _ in range(rng.randrange(12))), cls))
    docs += [(60, None, "en"), (61, "The RING  theses", "de"), (62, "unheard-of wörter", "fr")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    held = lambda d: d % 5 == 2
    got = {r.doc_id: r.score for r in lm.score(df, F.col("doc_id") % 5 == 2).collect()}
    expected = plain_model(docs, held)
    assert len({c for d, _, c in docs if not held(d)}) == 3
    for d, score in expected.items():
        assert got[d] == pytest.approx(score, rel=1e-9), d
