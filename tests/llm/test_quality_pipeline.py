import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hornspark.llm import quality, queries
from hornspark.llm.near_dedup import near_duplicates

from . import brute
from .conftest import rows

GOOD = [f"word{i}" for i in range(200)]


def made(n, seed=1):
    """Documents with labels: junk is shouted, toxic texts hold an insult."""
    rng = random.Random(seed)
    docs, labels = [], []
    for d in range(n):
        w = [rng.choice(GOOD) for _ in range(rng.randint(20, 80))]
        bad, toxic = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["insult", "slur"])
        text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)
        docs.append((d, text))
        if d % 2:
            labels.append((d, int(not bad), int(toxic)))
    return docs, labels, {d: ("!!" in t, "insult" in t.lower() or "slur" in t.lower()) for d, t in docs}


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_finds_what_was_labelled(spark, table):
    docs, labels, truth = made(600)
    docs += [(1000, None), (1001, ""), (None, "word1 word2"), (1002, "word3 " * 30000)]
    df = table(docs)
    model = quality.train(df, label_table(spark, [*labels, (labels[0][0], 0, 0), (None, 0, 1), (10**9, 1, 1)]))
    scored = quality.classify(df, model)
    assert scored.columns[: len(df.columns)] == df.columns and scored.columns[-1] == "_rejected"
    got = {r.doc_id: r["_rejected"] for r in scored.collect()}
    wrong = [d for d, t in truth.items() if got[d] != any(t)]
    assert len(wrong) <= 0.02 * len(docs) and set(got) == {d for d, _ in docs}
    kept = quality.keep_good(df, label_table(spark, labels))
    assert kept.columns == df.columns and 0 < kept.count() < len(docs)


def test_without_labels_nothing_is_rejected(spark, table):
    docs = [(1, "a"), (2, "b")]
    empty = label_table(spark, [(1, 1, 0)]).limit(0)
    for labels in (empty, label_table(spark, [(1, 1, 0), (2, 1, 0)])):
        assert quality.keep_good(table(docs), labels).count() == 2
    assert quality.keep_good(table([]), label_table(spark, [(1, 1, 0)])).count() == 0
    assert quality.keep_good(table([]), empty).count() == 0


def test_co_training_uses_the_pool():
    """Few labels and a pool: pseudo-labels of one view teach the other."""
    rng = np.random.default_rng(0)
    n, labelled = 6000, 1000
    y = rng.integers(0, 2, n)
    strong = [[int(v)] for v in y]  # the first view tells all
    weak = [[int(v) * 40 + int(rng.integers(0, 40))] for v in y]  # the second has forty features for each class
    xs = [quality.Rows(np.array([c for r in view for c in r]), np.arange(n + 1), width) for view, width in ((strong, 2), (weak, 80))]
    alone = quality.co_train([xs[1].take(np.arange(labelled)), xs[1].take(np.arange(labelled))], y[:labelled].astype(float))
    model = quality.co_train(xs, y[:labelled].astype(float))
    right = lambda odds: ((odds > 0) == (y > 0)).mean()
    assert right(model.views[1].log_odds(xs[1])) > 0.95 > right(alone.views[0].log_odds(xs[1]))
    assert right(model.log_odds(xs, n)) > 0.99


def test_platt():
    z = np.array([-3.0, -2, -1, 1, 2, 3] * 20)
    a, b = quality.fit_platt(z, (z > 0).astype(float))
    assert a > 1 and abs(b) < 0.1
    assert quality.fit_platt(z, (z < 0).astype(float))[0] == 0.0


def test_features():
    ids, bounds = quality.text_features(pa.array(["a a b", "", "A!! a", "b", "prefixes prefix"]))
    assert np.diff(bounds).tolist() == [2 + 4, 4, 2 + 4, 1 + 4, 2 + 1 + 1 + 4]  # "prefix" is no longer than 6
    assert set(ids[bounds[3] : bounds[4]]) & set(ids[bounds[0] : bounds[1]])


def test_training_over_tables_is_co_training(spark, table):
    """The distributed rounds against the same rounds in memory, over all rows as the pool."""
    docs, labels, _ = made(900, seed=3)
    docs += [(docs[5][0], docs[5][1]), (None, "word1 insult"), (5000, None), (5001, "")]
    model, compact = quality.train_on(table(docs, 5), label_table(spark, labels), "doc_id", "text", ["lang", "source", "n_chars"], ["quality", "toxic"], 10**6)
    rows_ = compact.filter("_id IS NOT NULL").orderBy(F.desc("_in"), "tie", "row").collect()
    assert len(rows_) == len(docs) - 1 and sum(r._in for r in rows_) >= len(labels)
    xs = []
    for name, known in zip(("text", "meta"), model.tables, strict=True):
        own = [list(r[name]) for r in rows_]
        xs.append(quality.Rows(np.array([x for o in own for x in o], np.int64), np.append(0, np.cumsum([len(o) for o in own])), len(known)))
    handed = 0
    for k, t in enumerate(("quality", "toxic")):
        y = np.array([float(r[f"_{t}"] > 0) for r in rows_ if r._in])
        plain = quality.co_train(xs, y)
        assert plain.prior == pytest.approx(model.targets[t].prior)
        for a, b in zip(plain.views, model.targets[t].views, strict=True):
            assert np.allclose(a.weights, b.weights, atol=1e-6) and (a.weights != 0).any()
            assert (a.intercept, a.slope, a.shift) == pytest.approx((b.intercept, b.slope, b.shift), abs=1e-6)
        alone = quality.fit_view(xs[0].take(np.arange(len(y))), y, len(y))
        handed += not np.allclose(alone.weights, plain.views[0].weights) or not np.allclose(quality.fit_view(xs[1].take(np.arange(len(y))), y, len(y)).weights, plain.views[1].weights)
    assert handed  # pseudo-labels did change a view


def test_fit_is_the_optimum():
    """The gradient of the penalised loss, in plain Python, is zero at the fit, and Platt's is too."""
    rng = random.Random(2)
    own = [sorted(rng.sample(range(12), 3)) for _ in range(200)]
    y = np.array([float((0 in o) != (rng.random() < 0.1)) for o in own])
    w, b = quality.fit_logistic(quality.Rows(np.array([c for o in own for c in o]), np.arange(201) * 3, 12), y)
    p = [1 / (1 + np.exp(-(b + sum(w[c] for c in o)))) for o in own]
    assert sum(q - v for q, v in zip(p, y)) == pytest.approx(0, abs=1e-3)
    for c in range(12):
        assert sum(q - v for q, v, o in zip(p, y, own) if c in o) + quality.RIDGE * w[c] == pytest.approx(0, abs=1e-3)
    z = np.array([b + sum(w[c] for c in o) for o in own])
    slope, shift = quality.fit_platt(z, y)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    r = 1 / (1 + np.exp(-(slope * z + shift))) - t
    assert r.sum() == pytest.approx(0, abs=1e-2) and (r * z).sum() == pytest.approx(0, abs=1e-2)


def test_every_view_has_features(spark):
    """Also where nothing tells at one in a million, and on the smallest tables."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert all((v.weights != 0).any() for c in model.targets.values() for v in c.views) and all(len(c.views) == 2 for c in model.targets.values())
    bad = {r.doc_id for r in labels.filter("quality = 0 OR toxic = 1").collect()}
    rejected = {r.doc_id for r in quality.classify(docs, model).filter("rejected").join(labels, "doc_id").collect()}
    assert len(rejected & bad) >= len(bad) // 2 and len(rejected - bad) <= 3


SF = "/root/testdata/sf0.001"


def test_registered_queries_use_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_decontamination", "op5_near_dedup", "op6_lm_scoring", "op7_exact_dedup", "op8_sharding", "op9_quality", "op10_substring_dedup"):
        assert queries.QUERIES[name](spark, SF).count() == docs, name


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert sorted(expected.columns) == order
    assert rows(got.select(*order)) == sorted((tuple(r) for r in expected.select(*order).fetchall()), key=str)


def test_pipeline(spark, tmp_path):
    """Each stage against its plain version, on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{len(steps)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(steps)}")
        pairs = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        kept = {r[0] for r in docs.select("doc_id").collect()}
        if "packing" not in name:
            assert docs.columns == before.columns
        if name == "quality classifier":
            assert 0.5 * before.count() < len(kept) < before.count()
        if name == "exact dedup":
            assert kept == {r[0] for r in brute.exact_groups(pairs(before)) if r[3]}
        if name == "MinHash near-dedup":
            assert kept == {r[0] for r in brute.near_groups(pairs(before), 5, 80) if r[3]}  # the stage takes five words and 0.8
        if name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert kept == {r[0] for r in brute.contamination(pairs(before), items) if not r[5]}
            last = kept
        steps[name] = kept
    assert steps["best-fit packing"] == last
    assert sorted(map(str, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(str, docs.select("doc_id", "piece", "ids_crc32").collect()))


def test_pipeline_on_awkward_tables(spark, texts, table, tmp_path):
    df = table([*texts, (3, "one"), (None, "lost"), (None, None)])
    sf = str(tmp_path / "sf")
    df.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, None), (1, "one two three")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    label_table(spark, [(8, 1, 0), (9, 0, 0), (None, 1, 1)]).write.parquet(f"{sf}/labels.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 10 and out.filter(F.col("doc_id") == 7).count() == 0
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{sf}0/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{sf}0").count() == 0


def test_default_near_dedup_takes_five_words(table):
    docs = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d x f")]
    assert {r.doc_id: r.n_shingles for r in near_duplicates(table(docs)).collect()} == {1: 2, 2: 2, 3: 2}


def test_near_dedup_stage_takes_five_words_and_four_fifths(spark, texts, table):
    w = [f"w{i}" for i in range(120)]
    docs = [*texts, (100, " ".join(w[:100])), (101, " ".join(w))]  # 96 of 116 shingles of five words, 98 of 118 of three
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(docs), SF).collect()}
    assert 100 in kept and 101 not in kept
    assert kept == {r[0] for r in brute.near_groups(docs, 5, 80) if r[3]}
    own = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in own.select("doc_id", "text").collect()]
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, own, SF).collect()} == {r[0] for r in brute.near_groups(pairs, 5, 80) if r[3]}
