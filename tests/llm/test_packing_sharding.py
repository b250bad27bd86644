import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hornspark.llm import packing, sharding

from . import brute
from .conftest import rows

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= items[i]}:
            j = bins.index(room)
            bins[j] -= items[i]
            place(i + 1, bins)
            bins[j] += items[i]
        bins.append(capacity - items[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.choice([10, 15, 20])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        h = packing.Histogram(collections.Counter(items), capacity)
        fixed = packing.reduce_instance(h)
        rest = [x for x in range(capacity + 1) for _ in range(h.n[x])]
        assert sum(b.count for b in fixed) + optimum(rest, capacity) == optimum(items, capacity)


def test_plans_are_whole():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.choice([10, 30, 64])
        counts = collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 60)))
        got = collections.Counter()
        for b in packing.plan(counts, capacity):
            assert sum(x * k for x, k in b.content) + b.free == capacity and b.free >= 0 and b.count > 0
            for x, k in b.content:
                got[x] += k * b.count
        assert got == counts


def test_cut_points():
    assert packing.cut_points(10, 10) == [0] and packing.cut_points(20, 10) == [0, 10] and packing.cut_points(23, 10) == [0, 3, 13]


def check(df, docs, capacity=2048, special_as_text=False):
    """Against the tokenizer as it comes from its file, or told to take special tokens' strings as text."""
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    if special_as_text:
        t.encode_special_tokens = True
    got = df.collect()
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for _, x in docs]
    expected = collections.Counter()
    for (d, _), own in zip(docs, ids):
        starts = packing.cut_points(len(own), capacity)
        for k, (a, e) in enumerate(zip(starts, [*starts[1:], len(own)])):
            expected[(d, k, a, e - a, zlib.crc32(own[a:e].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-sum(map(len, ids)) // capacity)


def test_packing(texts, table):
    bins, least = check(packing.pack_documents(table(texts)), texts)
    assert bins <= least + 1


def test_packing_ids_and_other_vocabulary(texts, table):
    docs = [*texts[:20], (3, "one"), (3, "one"), (None, "<|endoftext|> x")]
    check(packing.pack_documents(table(docs), vocabulary=P.path("byte_bpe_50k.json"), capacity=16), docs, 16)
    df = packing.pack_documents(table(docs), capacity=16, with_ids=True)
    check(df, docs, 16)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in df.collect())


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_packing_special_tokens(table, vocabulary):
    docs = [(1, "<|endoftext|> x"), (2, "a <|endoftext|>"), (3, "x  <|endoftext|><|endoftext|>\n\ny <|endoftext|"), (4, "a" + " " * 120_000 + "<|endoftext|>  b")]
    got = packing.pack_documents(table(docs), vocabulary=P.path(vocabulary), with_ids=True)
    check(got, docs)
    assert got.filter("doc_id = 1").first().ids == [50256, 2124, 0]
    check(packing.pack_documents(table(docs), vocabulary=P.path(vocabulary), special_as_text=True), docs, special_as_text=True)


def test_packing_long_white_space(table):
    """Runs that tiktoken fails on, and others that it takes."""
    docs = [(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000), (3, "x" * 300_000), (4, "a" + "\u3000" * 99_999 + "b"), (5, "a " * 200_000)]
    check(packing.pack_documents(table(docs)), docs)


def test_packing_nothing(table):
    assert packing.pack_documents(table([])).count() == 0


def test_jump_hash():
    rng = random.Random(1)
    keys = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [brute.jump(int(k), n) for k in keys]
    few, more = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert set(more[few != more]) == {16}


def test_sharding(texts, table):
    docs = [*texts, (3, "one"), (3, "one"), (None, "x"), (None, None)]
    got = sharding.shard_documents(table(docs)).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs), key=str)
    slots = collections.defaultdict(list)
    shard = {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert shard.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(table([])).count() == 0


def test_a_shard_depends_on_nothing_but_the_key(texts, table):
    a = sharding.shard_documents(table(texts, 1)).select("doc_id", "shard")
    b = sharding.shard_documents(table([(d, f"{t} more") for d, t in texts[::-1]], 5)).select("doc_id", "shard")
    assert rows(a) == rows(b)


def test_sharding_sizes_are_even(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = [r["count"] for r in sharding.shard_documents(df).groupBy("shard").count().collect()]
    assert len(counts) == 16 and max(counts) < 1.4 * 250
