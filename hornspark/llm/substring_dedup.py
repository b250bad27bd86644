"""Substring dedup by suffix automata of reference shards.

A word goes if it lies in a window of 50 words that also starts in a document with a
smaller id.  Suffix automata over reference text decide this: documents are streamed
through them for matching statistics, and where the longest match reaches 50 words and
occurs in a smaller document, the window goes.  As automata of a whole corpus fit nowhere,
reference text is first narrowed down, exactly, to what can match:

1. Every window has an anchor, the smallest hash of its 16-word sequences.  Consecutive
   windows with one anchor are a run; equal windows have equal anchors.
2. Runs that are equal as a whole name the smallest document that holds them.
3. For anchors that still have different runs, the windows of one copy of each are
   compared by hash.
   So every repeated window names a smaller document, its reference, and a place there.
4. The named places are the reference text.  Documents with repeats are dealt into blocks of
   about ``BLOCK_WORDS``; the places that a block's documents name go to it as its reference
   shards, once each, an automaton is built of each shard, and the block's documents are
   streamed.  A block has at most as many places as its documents have windows.

Of steps 2 and 3 only what a filter of anchors, or windows, that occur twice lets through is
shuffled.

Hashes only choose the reference text; words go by the automaton's verdict.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import arrow_batches, cut, join_groups, may_repeat, semi_filter
from ._words import Words, mix, ngrams, sub_batches, word_powers, words_of

WINDOW = 50
#: Words of an anchor.
ANCHOR = 16
#: Words of the documents of a block, about.
BLOCK_WORDS = 150_000
#: Reference words of a shard at most, which bounds an automaton's memory.
SHARD_WORDS = 200_000
NOBODY = float("inf")


# --------------------------------------------------------------------------- the automaton


class SuffixAutomaton:
    """All substrings of word sequences, each state with the smallest owner of its substrings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [NOBODY]

    def _clone(self, q: int, length: int) -> int:
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(length)
        self.owner.append(NOBODY)
        return len(self.next) - 1

    def _redirect(self, p: int, c: int, q: int) -> int:
        """The state of exactly the longest substring of p, followed by c."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._clone(q, self.length[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, owner: float, words: Iterable[int]) -> None:
        nxt, link, length, own = self.next, self.link, self.length, self.owner
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                last = self._redirect(last, c, q)
                if owner < own[last]:
                    own[last] = owner
                continue
            state = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            own.append(owner)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = state
                p = link[p]
            if p != -1:
                link[state] = self._redirect(p, c, nxt[p][c])
            last = state

    def settle(self) -> None:
        """Give every state the smallest owner of the longer substrings that end in its own."""
        own, link = self.owner, self.link
        for s in np.argsort(-np.array(self.length), kind="stable")[:-1].tolist():
            if own[s] < own[link[s]]:
                own[link[s]] = own[s]

    def matched_ends(self, words: list[int], window: int, below: float) -> list[int]:
        """Ends (exclusive) of the windows that a smaller owner holds too."""
        nxt, link, length, own = self.next, self.link, self.length, self.owner
        state, match, out = 0, 0, []
        for i, c in enumerate(words, 1):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                match = length[state]
                to = nxt[state].get(c)
            if to is None:
                continue
            state, match = to, match + 1
            if match >= window:
                while length[link[state]] >= window:
                    state = link[state]
                match = min(match, length[state])
                if own[state] < below:
                    out.append(i)
        return out


def shards(segments: list[tuple[float, list[int]]], window: int, most: int = SHARD_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata of at most ``most`` words each; a longer segment is cut so that every window
    is whole in some shard."""
    automaton, size = SuffixAutomaton(), 0
    for owner, words in segments:
        for at in range(0, max(1, len(words) - window + 1), most - window + 1):
            part = words[at : at + most]
            if size and size + len(part) > most:
                automaton.settle()
                yield automaton
                automaton, size = SuffixAutomaton(), 0
            automaton.add(owner, part)
            size += len(part)
    if size:
        automaton.settle()
        yield automaton


# --------------------------------------------------------------------------- candidates


def full_sha(words: Words, i: int) -> str:
    raw = words.raw(int(words.first[i]), int(words.first[i + 1]))
    return hashlib.sha256(b" ".join(raw.split())).hexdigest()


def runs_of(words: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, hash, first window, windows) of every run of a batch of texts."""
    count = np.maximum(np.diff(words.first) - window + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    if not len(row):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + words.first[row]
    least, span, want = mix(ngrams(words.ids, anchor) ^ np.uint64(anchor)), 1, window - anchor + 1
    while 2 * span <= want:  # sliding minimum of spans doubled up to the wanted one
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    key = least[at]
    begin = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])))
    n = np.diff(np.append(begin, len(row)))
    up, down = word_powers(len(words.ids) + 1)
    sums = np.zeros(len(words.ids) + 1, np.uint64)
    np.cumsum(words.ids * up[: len(words.ids)], out=sums[1:])
    s = at[begin]
    whole = mix((sums[s + n + window - 1] - sums[s]) * down[s] + n.astype(np.uint64))
    return row[begin], key[begin].view(np.int64), whole.view(np.int64), s - words.first[row[begin]], n


RUNS = "anchor array<long>, run array<long>, start array<int>, n array<int>"


def scan(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(id, n_words, sha, runs) of (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in sub_batches(big, 512):
                w = words_of(b.column("text"), fold=False)
                row, *cols = runs_of(w, window, anchor)
                bounds = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(c, k)) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
                sha = [full_sha(w, i) for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(w.first), pa.int64()), pa.array(sha), *lists], ["id", "n_words", "sha", "anchor", "run", "start", "n"])

    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string(f"n_words long, sha string, {RUNS}")])
    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def window_hashes(texts: DataFrame, window: int) -> DataFrame:
    """(id, at, w): the windows of the ``runs`` (start, n) of each (id, text, runs) row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in sub_batches(big, 512):
                words = words_of(b.column("text"), fold=False)
                grams = ngrams(words.ids, window)
                rows, ats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, runs in enumerate(b.column("runs").to_pylist()):
                    most = max(0, int(words.first[i + 1] - words.first[i]) - window + 1)
                    at = np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in runs]))
                    at = at[at < most]
                    rows.append(np.full(len(at), i))
                    ats.append(at)
                row, at = np.concatenate(rows), np.concatenate(ats)
                found = grams[words.first[row] + at] if len(row) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(at, pa.int32()), pa.array(found.view(np.int64))], ["id", "at", "w"])

    schema = T.StructType([texts.schema["id"], T.StructField("at", T.IntegerType()), T.StructField("w", T.LongType())])
    return texts.select("id", "text", "runs").mapInArrow(run, schema)


def references(docs: DataFrame, scanned: DataFrame, window: int) -> DataFrame:
    """(id, ref, start, n): the windows from ``start`` on of the smaller document ``ref``, n of
    them, stand in document ``id`` too.  Names a reference for every repeated window."""
    item = F.explode(F.arrays_zip("anchor", "run", "start", "n")).alias("r")
    runs = scanned.filter(F.col("id").isNotNull()).select("id", item).select("id", "r.*")
    runs = may_repeat(runs, F.col("anchor"), scanned.agg(F.sum(F.size("anchor"))).first()[0] or 0)
    groups = runs.groupBy("run", "anchor").agg(F.min(F.struct("id", "start", "n")).alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("k"))
    groups = cut(groups)
    total = scanned.count()
    equal = groups.filter(F.col("last") > F.col("first.id")).select("run", "first", "k")
    again = join_groups(semi_filter(runs.select("id", "run"), F.col("run"), equal, F.col("run"), equal.count()), equal, "run", "k", total)
    hits = again.filter(F.col("id") > F.col("first.id")).select("id", F.col("first.id").alias("ref"), F.col("first.start").alias("start"), F.col("first.n").alias("n"))

    differ = cut(groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("g")).filter("g > 1"))
    open_runs = join_groups(semi_filter(groups.select("anchor", "first"), F.col("anchor"), differ, F.col("anchor"), differ.count()), differ, "anchor", "g", total)
    per_doc = cut(open_runs.groupBy(F.col("first.id").alias("id")).agg(F.collect_list(F.struct(F.col("first.start").alias("start"), F.col("first.n").alias("n"))).alias("runs")))
    texts = semi_filter(docs, F.col("id"), per_doc, F.col("id"), per_doc.count()).join(per_doc, "id")
    arrow_batches(docs.sparkSession)
    windows = cut(window_hashes(texts, window))
    windows = cut(may_repeat(windows, F.col("w"), windows.count()))
    first = windows.groupBy("w").agg(F.min(F.struct("id", "at")).alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("k"))
    first = cut(first.filter(F.col("last") > F.col("first.id")).drop("last"))
    single = join_groups(windows.select("id", "w"), first, "w", "k", total).filter(F.col("id") > F.col("first.id"))
    return cut(hits.unionByName(single.select("id", F.col("first.id").alias("ref"), F.col("first.at").alias("start"), F.lit(1).alias("n"))).distinct())


def reference_texts(docs: DataFrame, hits: DataFrame, block: Column, window: int) -> DataFrame:
    """(block, kind, id, texts): for each block of documents, the stretches of each reference that
    its documents' hits name, merged.  ``block`` is that of the hits' ``id``."""
    wanted = cut(hits.groupBy("ref", block.alias("block")).agg(F.collect_set(F.struct("start", "n")).alias("places")))
    refs = cut(wanted.select("ref").distinct())
    rows = semi_filter(docs, F.col("id"), refs, F.col("ref"), refs.count()).join(wanted, F.col("id") == F.col("ref"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in sub_batches(big, 512):
                words = words_of(b.column("text"), fold=False)
                texts = []
                for i, places in enumerate(b.column("places").to_pylist()):
                    merged: list[list[int]] = []
                    n = int(words.first[i + 1] - words.first[i])
                    for start, end in sorted((p["start"], p["start"] + p["n"] + window - 1) for p in places):
                        end = min(end, n)
                        if merged and start <= merged[-1][1] - window + 1:
                            merged[-1][1] = max(merged[-1][1], end)
                        elif end - start >= window:
                            merged.append([start, end])
                    base = int(words.first[i])
                    texts.append([words.raw(base + s, base + e).decode("utf-8", "surrogateescape") for s, e in merged])
                yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(np.zeros(b.num_rows, np.int32)), b.column("id"), pa.array(texts, pa.list_(pa.string()))], ["block", "kind", "id", "texts"])

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), docs.schema["id"], T.StructField("texts", T.ArrayType(T.StringType()))])
    arrow_batches(docs.sparkSession)
    return rows.select("block", "id", "text", "places").mapInArrow(run, schema)


# --------------------------------------------------------------------------- the verdict


def spans_from(ends: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal stretches covered by the windows that end at ``ends``."""
    out: list[list[int]] = []
    for e in sorted(ends):
        if out and e - window <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([e - window, e])
    return [(a, b) for a, b in out]


def stream_blocks(rows: DataFrame, window: int) -> DataFrame:
    """(id, sha, spans, kept_sha) of the documents (kind 1) of each block, streamed through the
    automata of the block's references (kind 0)."""

    def words_in(texts: list[str]) -> list[list[int]]:
        w = words_of(pa.array(texts, pa.large_string()), fold=False)
        return [w.ids[w.first[i] : w.first[i + 1]].tolist() for i in range(len(texts))]

    def verdicts(refs: list[tuple], docs: list[tuple]) -> Iterator[tuple]:
        segments = [(ref, ids) for ref, texts in refs for ids in words_in(texts)]
        ends: list[set[int]] = [set() for _ in docs]
        ids = words_in([text for _, text in docs])
        for automaton in shards(segments, window):
            for k, (doc, _) in enumerate(docs):
                ends[k].update(automaton.matched_ends(ids[k], window, doc))
        for (doc, text), found in zip(docs, ends, strict=True):
            spans = spans_from(list(found), window)
            all_words = text.encode("utf-8", "surrogateescape").split()
            kept, at = [], 0
            for a, b in spans:
                kept += all_words[at:a]
                at = b
            kept += all_words[at:]
            yield doc, hashlib.sha256(b" ".join(all_words)).hexdigest(), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(b" ".join(kept)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, block, refs, docs = pa.int64(), None, [], []

        def out() -> pa.RecordBatch:
            cols = list(zip(*verdicts(refs, docs), strict=True)) or [()] * 4
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (kind, pa.string(), span, pa.string()), strict=True)], ["id", "sha", "spans", "kept_sha"])

        for b in batches:
            kind = b.schema.field("id").type
            for row in b.to_pylist():
                if row["block"] != block:
                    if docs:
                        yield out()
                    block, refs, docs = row["block"], [], []
                if row["kind"]:
                    docs.append((row["id"], row["texts"][0]))
                else:
                    refs.append((row["id"], row["texts"]))
        if docs:
            yield out()

    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("sha string, spans array<struct<start: int, end: int>>, kept_sha string")])
    arrow_batches(rows.sparkSession, 64)
    return rows.repartition("block").sortWithinPartitions("block", "kind").select("block", "kind", "id", "texts").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per row of ``docs``: id, n_words, n_removed, kept_sha256, spans (start, end).

    ``spans`` are the maximal stretches of words that lie in repeated windows; words are
    split at ASCII white space and unchanged.  Null and empty texts have no words; texts
    shorter than a window keep all.  A document with the same id is not a smaller one, so
    repeated rows keep their text; null ids neither lose words nor make others lose them.
    Other columns are not looked at."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scanned = cut(scan(slim, window, min(ANCHOR, window)))
    hits = references(slim, scanned, window)
    flagged = cut(hits.select("id").distinct())
    words = scanned.join(flagged, "id", "left_semi").agg(F.sum("n_words").alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(words / BLOCK_WORDS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    # documents that the filter lets through by chance are streamed too; the automata give them what is theirs
    own = semi_filter(slim.filter("id IS NOT NULL"), F.col("id"), flagged, F.col("id"), flagged.count())
    own = own.select(block.alias("block"), F.lit(1).alias("kind"), "id", F.array("text").alias("texts"))
    refs = reference_texts(slim, hits, block, window)
    verdict = cut(stream_blocks(refs.unionByName(own), window)).dropDuplicates(["id", "sha"])
    v = verdict.select(F.col("id").alias("vid"), F.col("sha").alias("vsha"), "spans", "kept_sha")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    joined = scanned.select("id", "n_words", "sha").join(v, (F.col("id") == F.col("vid")) & (F.col("sha") == F.col("vsha")), "left")
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The words of ``text`` outside ``spans``, joined by one space."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = F.filter(words, lambda _, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])))
    return F.array_join(kept, " ")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("spans")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(words[i:i + 49], ' ')) < doc_id AS again
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)
), places AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), covered AS (
  SELECT doc_id, i, word, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING), FALSE) AS gone
  FROM places LEFT JOIN starts USING (doc_id, i)
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM covered GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
