"""Language-model scoring by subword lattice likelihood.

A word's probability is the sum over all ways to cut it into pieces of an existing
vocabulary, found by the forward recursion in log space.  Pieces do not cross white
space, so the lattice of a text is a chain of its words' lattices, and each distinct
word's marginal is computed once for the whole corpus.

* The vocabulary and its scores are given: a piece's rank is its score, taken as a Zipf
  law.  EM fits the scores to the training texts: the expected counts of the pieces over
  all segmentations of all distinct training words, on top of ``PRIOR`` draws from the
  given scores.  The piece that starts a word and the pieces that go on, or stop, are
  two distributions.
* A word of the training texts also has an arc of its own over its whole lattice: its
  count less ``DISCOUNT``; what the discounts save is the lattice's share.  The end of a
  text is a token of its own.
* The model is a mixture over the values of a column (the language): a text's
  probability is the marginal over the classes too, so no text is told its class.

Words that make up a millionth of the corpus or more (so at most a million) are broadcast
with their scores; the others meet theirs in a join, for all classes.  What comes back to
the driver has a row for each piece and class.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import arrow_batches, cut, table
from ._words import WORD_BASE, byte_powers, mix, words_of

#: A word is frequent with one in so many tokens.
FREQUENT = 1_000_000
#: Draws from the given scores that a fit starts from, in pieces.
PRIOR = 1000.0
#: Rounds of EM.
ROUNDS = 4
#: Taken off every count for what was not seen.
DISCOUNT = 0.7
#: Values of the class column with a model of their own at most; all others share one.
CLASSES = 8
#: Offset of the Zipf law of the ranks.
ZIPF_OFFSET = 10
#: Share of ends among tokens where there is no training text.
BLIND_END = 0.01
#: Longest word, in bytes, that is handled side by side with others.
SIDE_BY_SIDE = 64
#: Bytes of text, and words, handled at once.
BATCH_BYTES, BATCH_WORDS = 8 << 20, 50_000
LOG10 = math.log(10)


# --------------------------------------------------------------------------- the lattice


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[bytes, ...]:
    """Pieces in the order of their ranks.  All single bytes are among them, so every text
    has a segmentation."""
    with open(path, "rb") as f:
        return tuple(base64.b64decode(line.split()[0]) for line in f if line.strip())


def normalised(weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log probabilities of the pieces and, last, of the stop: those that start a word sum to
    one, and all others with the stop do."""
    first = np.append(starts, False)
    out = np.empty(len(weights))
    for part in (first, ~first):
        out[part] = np.log(weights[part] / weights[part].sum())
    return out


def given_weights(n: int) -> np.ndarray:
    """The ranks' Zipf law and, last, the stop's weight, which is the mean."""
    weight = 1.0 / (np.arange(n) + ZIPF_OFFSET)
    return np.append(weight, weight.mean()) / (weight.sum() + weight.mean())


def piece_hash(sums_to: np.ndarray, sums_from: np.ndarray, down: np.uint64, length: int) -> np.ndarray:
    return mix((sums_to - sums_from) * down + np.uint64(length * WORD_BASE & 0xFFFFFFFFFFFFFFFF))


class Lattice:
    """Marginal probabilities of words over the segmentations into scored pieces."""

    BITS = 19

    def __init__(self, pieces: tuple[bytes, ...], scores: np.ndarray):
        """``scores``: log probabilities, pieces x classes."""
        self.pieces, self.scores = pieces, scores
        self.lengths = sorted({len(p) for p in pieces})
        self.ids = {p: i for i, p in enumerate(pieces)}
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.key, self.value = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
        self.probes = 1
        for i, slot in enumerate((keys >> np.uint64(64 - self.BITS)).tolist()):
            n = 1
            while self.value[slot] >= 0:
                slot, n = (slot + 1) & ((1 << self.BITS) - 1), n + 1
            self.key[slot], self.value[slot], self.probes = keys[i], i, max(self.probes, n)

    @staticmethod
    def _key(piece: bytes) -> int:
        up, _ = byte_powers(len(piece) + 1)
        total = np.sum((np.frombuffer(piece, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(piece)], dtype=np.uint64)
        return int(piece_hash(np.array([total]), np.array([0], np.uint64), np.uint64(1), len(piece))[0])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or -1."""
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.where(self.key[slot] == keys, self.value[slot], -1)
        for _ in range(1, self.probes):
            miss = np.flatnonzero(out < 0)
            miss = miss[self.value[slot[miss]] >= 0]
            if not len(miss):
                break
            slot[miss] = (slot[miss] + 1) & ((1 << self.BITS) - 1)
            out[miss] = np.where(self.key[slot[miss]] == keys[miss], self.value[slot[miss]], -1)
        return out

    def marginals(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability (words x classes) of the pieces of each word; with ``counts``, for a
        single class, also the pieces' expected counts."""
        classes = self.scores.shape[1]
        out = np.empty((len(words), classes))
        expected = np.zeros(len(self.pieces)) if counts is not None else None
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        long = int((sizes > SIDE_BY_SIDE).sum())
        for i in order[:long]:
            out[i] = self._one(words[i], None if counts is None else counts[i], expected)
        rest = order[long:]
        for k in range(0, len(rest), BATCH_WORDS):
            part = rest[k : k + BATCH_WORDS]
            out[part] = self._many([words[i] for i in part], sizes[part], None if counts is None else counts[part], expected)
        return out, expected

    def _many(self, words: list[bytes], sizes: np.ndarray, counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        """Words in order of decreasing size, all of them a position at a time."""
        top, n, classes = int(sizes[0]), len(words), self.scores.shape[1]
        up, down = byte_powers(top + 1)
        text = np.frombuffer(b"".join(w.ljust(top, b"\0") for w in words), np.uint8).reshape(n, top)
        sums = np.zeros((top + 1, n), np.uint64)
        np.cumsum(((text.astype(np.uint64) + np.uint64(1)) * up[:top]).T, axis=0, out=sums[1:])
        alpha = [np.zeros((n, classes))]
        arcs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for j in range(1, top + 1):
            m = int(np.searchsorted(-sizes, -j, "right"))
            here = np.full((m, classes), -np.inf)
            for length in self.lengths:
                if length > j:
                    break
                i = j - length
                piece = self.find(piece_hash(sums[j, :m], sums[i, :m], down[i], length))
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    ids = piece[hit]
                    here[hit] = np.logaddexp(here[hit], alpha[i][hit] + self.scores[ids])
                    if counts is not None:
                        arcs.append((i, j, hit, ids))
            alpha.append(here)
        total = np.empty((n, classes))
        for j, a in enumerate(alpha):
            own = np.flatnonzero(sizes[: len(a)] == j)
            total[own] = a[own]
        if counts is not None:
            beta = [np.where(sizes[: len(a)] == j, 0.0, -np.inf) for j, a in enumerate(alpha)]
            for i, j, hit, ids in reversed(arcs):
                after = beta[j][hit] + self.scores[ids, 0]
                beta[i][hit] = np.logaddexp(beta[i][hit], after)
                share = np.exp(alpha[i][hit, 0] + after - total[hit, 0]) * counts[hit]
                expected += np.bincount(ids, share, len(expected))
        return total

    def _one(self, word: bytes, count: float | None, expected: np.ndarray | None) -> np.ndarray:
        """A long word, a position at a time."""
        n, longest = len(word), self.lengths[-1]
        alpha, arcs = [np.zeros(self.scores.shape[1])], []
        for j in range(1, n + 1):
            found = [(i, self.ids[word[i:j]]) for i in range(max(0, j - longest), j) if word[i:j] in self.ids]
            alpha.append(np.logaddexp.reduce([alpha[i] + self.scores[p] for i, p in found]))
            if count is not None:
                arcs.append(found)
        if count is not None:
            beta = [-math.inf] * n + [0.0]
            for j in range(n, 0, -1):
                for i, piece in arcs[j - 1]:
                    after = beta[j] + self.scores[piece, 0]
                    beta[i] = float(np.logaddexp(beta[i], after))
                    expected[piece] += math.exp(alpha[i][0] + after - alpha[n][0]) * count
        return alpha[n]


# --------------------------------------------------------------------------- the corpus


def gathered(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold about ``most`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    whole = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
    yield from (b for b in whole if b.num_rows)


def list_column(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def count_words(docs: DataFrame, classes: int) -> DataFrame:
    """(wid, word, c0, c1, ...): all words, by their 64-bit hash and with the leading space that
    marks a word's start, and their counts in the training texts of each class (``cls``;
    -1 is held out)."""
    names = [f"c{k}" for k in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            w = words_of(b.column("text"), fold=True)
            cls = np.repeat(b.column("cls").to_numpy(), np.diff(w.first))
            ids, first, place = np.unique(w.ids, return_index=True, return_inverse=True)
            trained = cls >= 0
            counts = np.bincount((place * classes + cls)[trained], minlength=len(ids) * classes).reshape(-1, classes)
            raw = w.data.tobytes()
            words = [b" " + raw[s:e] for s, e in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(words, pa.binary()), *[pa.array(counts[:, k], pa.int64()) for k in range(classes)]], ["wid", "word", *names])

    counted = docs.select("text", "cls").mapInArrow(run, "wid long, word binary, " + ", ".join(f"{n} long" for n in names))
    return table(counted.groupBy("wid", "word").agg(*[F.sum(n).alias(n) for n in names]))


def fit(counts: DataFrame, types: list[int], path: str, rounds: int) -> np.ndarray:
    """Scores (pieces and, last, the stop, x classes) after ``rounds`` of EM over the distinct
    words of each class."""
    pieces, classes = vocabulary(path), len(types)
    starts = np.array([p.startswith(b" ") for p in pieces])
    given = given_weights(len(pieces))
    scores = np.repeat(normalised(given, starts)[:, None], classes, 1)
    sc = counts.sparkSession.sparkContext
    for _ in range(rounds if any(types) else 0):
        told = sc.broadcast(scores)

        def expect(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            total = np.zeros((len(told.value) - 1, classes))
            lattice = Lattice(vocabulary(path), told.value[:-1])
            for b in batches:
                words = b.column("word").to_pylist()
                for k in range(classes):
                    own = np.flatnonzero(b.column(f"c{k}").to_numpy() > 0)
                    if len(own):
                        lattice.scores = told.value[:-1, k : k + 1]
                        total[:, k] += lattice.marginals([words[i] for i in own], np.ones(len(own)))[1]
            piece, cls = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(cls, pa.int32()), pa.array(total[piece, cls])], ["piece", "cls", "expected"])

        arrow_batches(counts.sparkSession, BATCH_WORDS)
        found = counts.drop("wid").mapInArrow(expect, "piece int, cls int, expected double")
        found = found.groupBy("piece", "cls").agg(F.sum("expected").alias("expected")).toArrow()  # pieces x classes at most
        weights = np.repeat(PRIOR * given[:, None], classes, 1)
        np.add.at(weights, (found.column("piece").to_numpy(), found.column("cls").to_numpy()), found.column("expected").to_numpy())
        weights[-1] += types
        scores = np.stack([normalised(weights[:, k], starts) for k in range(classes)], 1)
    return scores


def token_scores(counts: DataFrame, scores: np.ndarray, sizes: np.ndarray, types: np.ndarray, path: str) -> DataFrame:
    """(wid, c, lp): each word's count and its log probability in each class."""
    classes = len(sizes)
    told = counts.sparkSession.sparkContext.broadcast(scores)
    with np.errstate(divide="ignore"):
        share = np.where(sizes > 0, DISCOUNT * types / np.maximum(sizes, 1), 1 - BLIND_END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path), told.value[:-1])
        for b in batches:
            c = np.stack([b.column(f"c{k}").to_numpy() for k in range(classes)], 1)
            cuts, _ = lattice.marginals(b.column("word").to_pylist())
            own = np.maximum(c - DISCOUNT, 0) / np.maximum(sizes, 1)
            with np.errstate(divide="ignore"):
                lp = np.logaddexp(np.log(own), np.log(share) + cuts + told.value[-1])
            yield pa.RecordBatch.from_arrays([b.column("wid"), pa.array(c.sum(1)), list_column(lp)], ["wid", "c", "lp"])

    arrow_batches(counts.sparkSession, BATCH_WORDS)
    return counts.mapInArrow(run, "wid long, c long, lp array<double>")


def score(docs: DataFrame, held_out: Column, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", rounds: int = ROUNDS) -> DataFrame:
    """A row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where ``held_out`` is false (or null).  Null and empty
    texts are one token, the end.  Repeated rows count and are scored each by itself.  A null
    class is a class.  Without training rows nothing is known and the given scores stay.
    Other columns are not looked at."""
    path = path or vocabulary_path()
    value = F.coalesce(F.col(class_col).cast("string"), F.lit("")) if class_col else F.lit("")
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), value.alias("value"))
    trained = slim.filter(~F.col("held_out")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    top = [r["value"] for r in trained.orderBy(F.desc("n"), "value").limit(CLASSES + 1).collect()]
    classes = max(1, len(top))  # with more values than CLASSES the last class is theirs together
    cls = F.lit(classes - 1)
    for k, v in enumerate(top[:CLASSES]):
        cls = F.when(F.col("value") == v, k).otherwise(cls)
    slim = slim.withColumn("cls", F.when(F.col("held_out"), -1).otherwise(cls).cast("int")).drop("value")
    arrow_batches(docs.sparkSession)
    counts = count_words(slim, classes)
    ends = np.zeros(classes)
    for r in slim.filter("cls >= 0").groupBy("cls").count().collect():
        ends[r["cls"]] = r["count"]
    c = [F.col(f"c{k}") for k in range(classes)]
    seen = sum(c[1:], c[0]) > 0
    facts = counts.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in c], *[F.count(F.when(x > 0, 1)) for x in c], F.count(F.when(seen, 1))).first()
    sizes, types = np.array(facts[:classes]) + ends, np.array(facts[classes : 2 * classes]) + (ends > 0)
    n, v = int(sizes.sum()), facts[-1] + int(ends.sum() > 0)
    scores = fit(counts, [int(t) for t in facts[classes : 2 * classes]], path, rounds)
    log_class = np.log(ends + 1e-300) - np.log(max(1.0, ends.sum())) if ends.sum() else np.zeros(classes)
    log_end = np.where(sizes > 0, np.log(np.maximum(ends - DISCOUNT, 1e-9) / np.maximum(sizes, 1)), math.log(BLIND_END))
    start = log_class + log_end

    total = sum(c[1:], c[0])
    scored_words = lambda which: token_scores(counts.filter(which), scores, sizes, types, path)
    often = scored_words(total * FREQUENT >= max(n, 1)).toArrow().sort_by("wid")  # FREQUENT rows at most
    lps = np.array(often.column("lp").combine_chunks().flatten()).reshape(-1, classes)
    known = docs.sparkSession.sparkContext.broadcast((often.column("wid").to_numpy(), often.column("c").to_numpy(), lps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wids, cs, lp = known.value
        for b in gathered(batches):
            w = words_of(b.column("text"), fold=True)
            rows, size = b.num_rows, np.diff(w.first)
            doc = np.repeat(np.arange(rows), size)
            ids, place = np.unique(w.ids, return_inverse=True)
            signed = ids.view(np.int64)
            at = np.searchsorted(wids, signed)
            frequent = at < len(wids)
            frequent[frequent] = wids[at[frequent]] == signed[frequent]
            hit = frequent[place]
            where, mine = at[place[hit]], doc[hit]
            summed = lambda x: np.bincount(mine, x, rows).astype(float)  # noqa: B023, E731  (of nothing: whole numbers)
            base = summed(np.log10(cs[where] + 1.0))
            sums = np.stack([summed(lp[where, k]) for k in range(classes)], 1) + start
            pair, tf = np.unique((doc * max(1, len(ids)) + place)[~hit], return_counts=True)
            bounds = pa.array(np.searchsorted(pair, np.arange(rows + 1) * max(1, len(ids))), pa.int32())
            rare = pa.ListArray.from_arrays(bounds, pa.array(signed[pair % max(1, len(ids))]))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("held_out"), pa.array(size, pa.int64()), pa.array(np.bincount(mine, minlength=rows), pa.int64()), pa.array(base), rare, pa.ListArray.from_arrays(bounds, pa.array(tf, pa.int32())), list_column(sums)],
                ["id", "held_out", "n_words", "known", "base", "wid", "tf", "s"],
            )

    schema = T.StructType([slim.schema["id"], *T._parse_datatype_string("held_out boolean, n_words long, known long, base double, wid array<long>, tf array<int>, s array<double>")])
    arrow_batches(docs.sparkSession)
    scanned = table(slim.drop("cls").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    rare = scanned.select("row", F.explode(F.arrays_zip("wid", "tf")).alias("r")).select("row", "r.wid", "r.tf")
    met = rare.join(scored_words(total * FREQUENT < max(n, 1)), "wid")
    sums = F.array(*[F.sum(F.col("tf") * F.get("lp", F.lit(k))) for k in range(classes)])
    parts = met.groupBy("row").agg(sums.alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf"))).alias("known_more"), F.sum(F.col("tf") * F.log10(F.col("c") + F.lit(1.0))).alias("base_more"))
    zero = F.lit(0.0)
    joined = scanned.drop("wid", "tf").join(parts, "row", "left").withColumn("v", F.transform("s", lambda s, k: s + F.coalesce(F.get("more", k), zero)))
    best = F.array_max("v")
    marginal = best + F.log(F.aggregate("v", zero, lambda a, x: a + F.exp(x - best)))
    tokens = F.col("n_words") + 1
    trained_ends = int(ends.sum())
    end_base, per_token = math.log10(trained_ends + 1), math.log10(n + 1 * (v + 1))
    return joined.select(
        F.col("id").alias(id_col),
        "held_out",
        tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("known_more", F.lit(0).cast("long")) + F.lit(int(trained_ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", zero) + F.lit(end_base) - tokens * F.lit(per_token)).alias("base_score"),
        (marginal / F.lit(LOG10)).alias("score"),
    )


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
