import pytest
from pyspark.sql import functions as F

from hornspark.llm import exact_dedup, near_dedup, substring_dedup
from hornspark.llm.components import connected_components

from . import brute
from .conftest import rows


def test_exact(spark, texts, table):
    assert rows(exact_dedup.duplicate_groups(table(texts))) == sorted(brute.exact_groups(texts), key=str)


def test_exact_with_ties_nulls_and_repeats(table):
    docs = [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "z"), (3, None), (4, "")]
    assert rows(exact_dedup.duplicate_groups(table(docs))) == sorted(brute.exact_groups(docs), key=str)
    kept = exact_dedup.drop_duplicates(table(docs))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a"), (None, "z"), (3, None)], key=str)
    assert kept.columns == table(docs).columns


def test_a_small_filter_loses_nothing(texts, table):
    got = exact_dedup.duplicate_groups(table(texts), bits_per_row=1, max_filter_bytes=1)
    assert rows(got) == sorted(brute.exact_groups(texts), key=str)


def test_several_filters_lose_nothing_and_let_few_through(spark, table):
    docs = [(i, f"text {i - i % 3 if i < 60 else i}") for i in range(4000)]
    got = exact_dedup.duplicate_groups(table(docs), max_filter_bytes=6000)  # three filters
    assert rows(got) == sorted(brute.exact_groups(docs), key=str)
    hashed = spark.createDataFrame([(i, str(i)) for i in range(20000)], "id long, sha string")
    maybe, alone = exact_dedup.told_apart(hashed, 20000, 32, 1 << 20)
    assert maybe.count() < 200 and maybe.count() + alone.count() == 20000


def test_exact_runs_no_python(spark, texts, table):
    plan = exact_dedup.duplicate_groups(table(texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_near(texts, table):
    assert rows(near_dedup.near_duplicates(table(texts), shingle=3, percent=85)) == sorted(brute.near_groups(texts), key=str)
    assert rows(near_dedup.near_duplicates(table(texts))) == sorted(brute.near_groups(texts, 5, 80), key=str)


def test_near_in_a_large_family(spark, table, monkeypatch):
    """Copies of a text with edits around the threshold, in buckets and families beyond the small sizes."""
    import random

    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for d in range(90):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        docs.append((d, " ".join(w)))
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(near_dedup, "TILE", 16)
    expected = sorted(brute.near_groups(docs), key=str)
    assert len({c for _, _, c, _ in expected}) > 5
    for large in (16, 64 * 16):
        monkeypatch.setattr(near_dedup, "LARGE", large)
        assert rows(near_dedup.near_duplicates(table(docs), shingle=3, percent=85)) == expected


def test_near_with_a_common_passage(table, monkeypatch):
    """Two thirds of each text are the same, so buckets and families are large and links are few."""
    import random

    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for d in range(120):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.randint(10, 30))]
        if d % 4 == 3:
            own = docs[d - 2][1].split()[40:]
            own[0] = "changed"
        docs.append((d, " ".join(passage + own)))
    docs += [(200 + d, f"{t} more") for d, t in docs[::5]]
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(near_dedup, "TILE", 16)
    for shingle, percent, large in ((3, 85, 16), (5, 80, 16), (3, 85, 64 * 16)):
        monkeypatch.setattr(near_dedup, "LARGE", large)  # with the second banding, and without
        expected = sorted(brute.near_groups(docs, shingle, percent), key=str)
        assert 30 < len({c for _, _, c, _ in expected}) < 120
        assert rows(near_dedup.near_duplicates(table(docs), shingle=shingle, percent=percent)) == expected


def test_near_exact_threshold(table):
    # sets of 17 and 20 shingles that share 17: 85 of 100
    a = " ".join(f"w{i}" for i in range(19))
    b = " ".join(f"w{i}" for i in range(22))
    c = " ".join(f"w{i}" for i in range(23))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table([(1, a), (2, b), (3, "z " + c)]), shingle=3, percent=85).collect()}
    assert got == {r[0]: r[2] for r in brute.near_groups([(1, a), (2, b), (3, "z " + c)])}
    assert got[2] == 1


def test_near_nulls_and_repeats(table):
    docs = [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (7, "A b c d"), (8, None), (9, "")]
    got = rows(near_dedup.near_duplicates(table(docs), shingle=3, percent=85))
    assert got == sorted([(4, 2, 4, True), (4, 2, 4, True), (None, 2, None, True), (7, 2, 4, False), (8, 0, 8, True), (9, 0, 9, True)], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(tuple(r) for r in connected_components(df).collect())
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98, 200: 200, 201: 200}
    assert connected_components(df.limit(0)).count() == 0


def test_substrings(texts, table):
    got = rows(substring_dedup.repeated_spans(table(texts)).drop("spans"))
    assert got == sorted(brute.removed_words(texts), key=str)


@pytest.mark.parametrize("window", [1, 3, 20])
def test_substring_windows(texts, table, window):
    docs = [x for x in texts if x[0] not in (60, 61, 62)]
    got = rows(substring_dedup.repeated_spans(table(docs), window=window).drop("spans"))
    assert got == sorted(brute.removed_words(docs, window), key=str)


def test_substrings_of_shared_borders(table):
    """The same passage between different words, at starts and ends, and repeated in one text."""
    p = [f"p{i}" for i in range(55)]
    docs = [(5, " ".join(["a", *p])), (3, " ".join([*p, "b"])), (9, " ".join([*p[:50], "c", *p[5:], *p])), (1, " ".join(p[2:52])), (12, " ".join([*p, *p])), (13, " ".join(p[:49]))]
    assert rows(substring_dedup.repeated_spans(table(docs)).drop("spans")) == sorted(brute.removed_words(docs), key=str)


def test_kept_text(spark, texts, table):
    df = table(texts)
    spans = substring_dedup.repeated_spans(df).select(F.col("doc_id").alias("d"), "spans", "kept_sha256")
    joined = df.join(spans, F.col("doc_id") == F.col("d"))
    bad = joined.filter(F.sha2(substring_dedup.without_spans(F.col("text"), F.col("spans")), 256) != F.col("kept_sha256"))
    assert bad.count() == 0


def test_substring_repeats_and_nulls(table):
    t = " ".join(f"w{i}" for i in range(60))
    got = rows(substring_dedup.repeated_spans(table([(1, t), (1, t), (2, t), (None, t)])).select("doc_id", "n_removed"))
    assert got == sorted([(1, 0), (1, 0), (2, 60), (None, 0)], key=str)


def test_automaton_matches_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(60):
        refs = [(rng.randrange(9), [rng.randrange(3) for _ in range(rng.randrange(14))]) for _ in range(rng.randint(1, 4))]
        text, window, below = [rng.randrange(3) for _ in range(20)], rng.randint(1, 5), rng.randrange(10)
        expected = {i + window for i in range(len(text) - window + 1) if any(o < below and text[i : i + window] == r[k : k + window] for o, r in refs for k in range(len(r) - window + 1))}
        for most in (window, 7, 100):
            got = set()
            for automaton in substring_dedup.shards(refs, window, most):
                got |= set(automaton.matched_ends(text, window, below))
            assert got == expected


def test_empty_tables(table):
    empty = table([])
    assert exact_dedup.duplicate_groups(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.drop_near_duplicates(empty).count() == 0
    assert substring_dedup.repeated_spans(empty).count() == 0
