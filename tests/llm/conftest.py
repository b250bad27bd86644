import random

import pytest
from pyspark.sql import functions as F

WORDS = ["the", "of", "and", "Thing", "ring", "éa", "straße", "x1", "hello,", "(see)", "über", "a"]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", str(rng.randrange(50))]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empty texts, repeats, near copies, shared passages, a long text."""
    rng = random.Random(5)
    shared = [passage(rng, 60) for _ in range(3)]
    docs = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one two"), (5, "ONE\ttwo"), (6, "one  two"), (7, "one two three")]
    for i in range(8, 60):
        kind = i % 6
        body = passage(rng, rng.randint(3, 120))
        if kind == 1 and i > 20:
            body = docs[rng.randrange(8, i)][1]
        elif kind == 2 and i > 20:
            w = (docs[rng.randrange(8, i)][1] or "a").split(" ")
            w[rng.randrange(len(w))] = "changed"
            body = " ".join(w)
        elif kind == 3:
            body = f"{passage(rng, 7)} {rng.choice(shared)}\n{passage(rng, 9)}"
        docs.append((i, body))
    docs.append((60, passage(rng, 20000)))
    docs.append((61, "w" * 30000))
    docs.append((62, docs[60][1].replace(" ", "  ")))
    return docs


@pytest.fixture
def table(spark):
    """A documents table of (id, text) pairs with further columns, some with awkward names."""

    def make(pairs, partitions=3):
        df = spark.createDataFrame([(d, t, "en", f"src{(d or 0) % 3}", len(t or "")) for d, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")
        clash = ["id", "row", "slot", "label", "sha", "n", "_pid", "_may", "_slot", "_gone", "words", "keys", "shard", "length", "rejected", "_id", "wid", "bitmap"]
        return df.withColumns({c: F.lit("extra") for c in clash}).repartition(partitions) if pairs else df.withColumns({c: F.lit("extra") for c in clash})

    return make


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
