"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

1. Signatures.  A first permutation mixes a shingle's hash to a place on the ring of 2**32;
   a second permutation, circularly shifted by k, gives coordinate k: two permutations
   for all coordinates (C-MinHash).  Equal shingle sets are one node from here on.
2. Banding.  Documents with an equal band share a bucket.  Pairs of small buckets are
   candidates if their sketches (32 coordinates, 8 bits each) are not far apart, and a bucket
   gives a spanning forest of them; in larger buckets each document is only joined with the
   smallest.  So the rows stay in proportion to the documents.
3. Families: the connected components of the candidates.  Any two documents that shared a
   bucket and may be similar are in one family.  A common passage can chain unrelated
   documents to a large family; families beyond ``LARGE`` documents are banded once more with
   longer bands, which only documents that are alike in most coordinates share.
4. Verification.  Within a family pairs are compared exactly, on full shingle sets, in tiles
   of ``TILE`` by ``TILE`` documents in the order of their sizes, dealt to different tasks; a tile
   reports a spanning forest of its links, never the pairs, and tiles whose documents differ
   too much in size are left out.  In families that are still beyond ``LARGE``, first every
   document is compared with its neighbours in the order of the document that its buckets
   joined it to, and with that document: one tile a ``TILE`` documents.  Only where that leaves
   a family in several components are its other tiles compared, but those that hold one.
5. The components of these links are the result.

A pair at exactly the threshold shares no band with probability (1 - s**rows)**bands, under
1e-6 at 0.8 and above, and 1e-6 more in large families; a pair that shares one is always
compared in full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import arrow_batches, cut, grouped_rank, join_groups, semi_filter, without
from ._words import mix, ngrams, sub_batches, words_of
from .components import connected_components

#: Bands and coordinates of a band: of all documents, and of those in large families.
BANDS, ROWS = 36, 5
LONG_BANDS, LONG_ROWS = 75, 8
SKETCH = 32
#: Equal sketch coordinates of a candidate pair at least: a pair at 0.8 has fewer with a probability under 1e-6.
SKETCH_EQUAL = 13
#: Pairs are listed in buckets of up to so many documents.
SMALL_BUCKET = 16
#: Documents of a family that one task compares with each other.
TILE = 128
#: Documents of a family from which on tiles of all its blocks would ship each text too often.
LARGE = 64 * TILE
#: Rows of a batch; the shingle keys hold the row in their upper 8 bits.
BATCH = 256

#: Odd multipliers of the second permutation.
MIX_A, MIX_B = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)


def shingle_keys(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of up to 256 texts, sorted, text by text, and the texts' bounds.

    A shingle is 56 bits of hash.  A text of fewer than ``k`` words, but not none, has one."""
    words = words_of(batch.column("text"), fold=True)
    count = np.diff(words.first)
    n = len(count)
    grams = ngrams(words.ids, k)
    row = np.repeat(np.arange(n), np.maximum(count - k + 1, 0))
    at = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(count - k + 1, 0)) - np.maximum(count - k + 1, 0), np.maximum(count - k + 1, 0)) + words.first[row]
    keys = (row.astype(np.uint64) << np.uint64(56)) | (grams[at] >> np.uint64(8))
    short = np.flatnonzero((count > 0) & (count < k))
    extra = []
    for i in short:
        whole = ngrams(words.ids[words.first[i] : words.first[i + 1]], int(count[i]))
        extra.append((np.uint64(i) << np.uint64(56)) | (whole[0] >> np.uint64(8)))
    keys = np.unique(np.concatenate([keys, np.array(extra, np.uint64)]))
    bounds = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(56)) if n < 256 else np.append(np.searchsorted(keys, np.arange(n, dtype=np.uint64) << np.uint64(56)), len(keys))
    return keys & np.uint64((1 << 56) - 1), bounds


def circulant_signature(shingles: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """Signatures (texts x coordinates) of texts that all have a shingle."""
    place = (mix(shingles.copy()) >> np.uint64(32)).astype(np.uint32) * MIX_A  # sigma, and the start of pi
    out = np.empty((len(bounds) - 1, coordinates), np.uint32)
    h, t = np.empty_like(place), np.empty_like(place)
    for k in range(coordinates):
        np.add(place, np.uint32(k * int(MIX_A) & 0xFFFFFFFF), out=h)  # = (sigma + k) * MIX_A: pi, shifted by k
        np.right_shift(h, np.uint32(15), out=t)
        np.bitwise_xor(h, t, out=h)
        np.multiply(h, MIX_B, out=h)
        out[:, k] = np.minimum.reduceat(h, bounds[:-1])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def signatures(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n, digest, keys, sketch) of (id, text) rows; without shingles all but id and n null."""
    picks = np.linspace(0, bands * rows - 1, SKETCH).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in sub_batches(big, BATCH):
                shingles, bounds = shingle_keys(b, shingle)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                digest, keys, sketch = [None] * len(n), [None] * len(n), [None] * len(n)
                if len(some):
                    inner = np.append(bounds[:-1][some], len(shingles))
                    sig = circulant_signature(shingles, inner, bands * rows)
                    sums = [np.add.reduceat(mix(shingles ^ np.uint64(s)), inner[:-1]) for s in (1, 2)]
                    for j, (i, key) in enumerate(zip(some, band_keys(sig, bands, rows).view(np.int64), strict=True)):
                        digest[i] = sums[0][j].tobytes() + sums[1][j].tobytes()
                        keys[i] = key
                        sketch[i] = (sig[j, picks] & np.uint32(255)).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["id", "n", "digest", "keys", "sketch"],
                )

    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string("n long, digest binary, keys array<long>, sketch binary")])
    arrow_batches(docs.sparkSession)
    return docs.select("id", "text").mapInArrow(run, schema)


# --------------------------------------------------------------------------- candidates


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges to the first row of its component from every other row of a symmetric matrix of links."""
    m = len(linked)
    np.fill_diagonal(linked, True)
    label = np.arange(m)
    while True:
        least = np.where(linked, label[None, :], m).min(1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    return [(int(label[i]), i) for i in range(m) if label[i] != i]


def small_bucket_pairs(buckets: DataFrame, id_type: T.DataType) -> DataFrame:
    """A spanning forest (a, b) of the members (id, sketch) of each row whose sketches are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column("members").to_pylist():
                members.sort(key=lambda m: m["id"])
                s = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(len(members), SKETCH)
                for i, j in forest((s[:, None, :] == s[None, :, :]).sum(2) >= SKETCH_EQUAL):
                    a.append(members[i]["id"])
                    b.append(members[j]["id"])
            kind = batch.schema.field("members").type.value_type.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])
    return buckets.select("members").mapInArrow(run, schema)


def candidates(nodes: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) of nodes (id, keys, sketch): see step 2 above."""
    rows = nodes.select("id", "sketch", F.explode("keys").alias("key"))
    buckets = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1"))
    shared = semi_filter(rows, F.col("key"), buckets, F.col("key"), buckets.count())
    large = join_groups(shared.select("id", "key"), buckets.filter(F.col("n") > SMALL_BUCKET), "key", "n", total)
    stars = large.select(F.col("first").alias("a"), F.col("id").alias("b"))
    small = shared.join(buckets.filter(F.col("n") <= SMALL_BUCKET).select("key"), "key")
    listed = small.groupBy("key").agg(F.collect_list(F.struct("id", "sketch")).alias("members"))
    pairs = small_bucket_pairs(listed, nodes.schema["id"].dataType)
    either = stars.unionByName(pairs).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # a document's smaller neighbours, one a band at most, hang on the smallest of them: nearly one edge a document
    near = either.groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("others"))
    among = near.select("a", F.explode("others").alias("b")).filter("a <> b").distinct()
    return cut(near.select("a", "b").unionByName(among).distinct())


# --------------------------------------------------------------------------- verification


def links(sets: list[np.ndarray], split: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with 100 * intersection >= percent * union.

    With ``split`` only pairs across it (before, from there on) are compared."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh_value = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(fresh_value) - 1
    common = np.bincount(column)[column] > 1  # a shingle of one document alone is in no intersection
    owner, column = owner[common], np.cumsum(fresh_value & common)[common] - 1
    shared = np.zeros((m, m), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    width = max(1, min(columns, max(256, (32 << 20) // (4 * m))))
    for lo in range(0, columns, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        x = np.zeros((m, width), np.float32)
        x[owner[i:j], column[i:j] - lo] = 1
        shared += x @ x.T  # sums under 2**24 are exact
    both = shared.astype(np.int64)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    if split:
        linked[:split, :split] = False
        linked[split:, split:] = False
    return forest(linked)


def family_links(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges (a, b) of the links within the groups (family, ti, tj) of (id, block, text)."""
    id_type = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sides, sets = None, [], [], []

        def found() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: sides[i])
            split = sum(s == sides[order[0]] for s in sides) if group[1] != group[2] else 0
            edges = links([sets[i] for i in order], split, percent) if len(order) > 1 and (not split or split < len(order)) else []
            a, b = ([ids[order[e[k]]] for e in edges] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

        for big in batches:
            kind = big.schema.field("id").type
            for batch in sub_batches(big, BATCH):
                shingles, bounds = shingle_keys(batch, shingle)
                keys = list(zip(*(batch.column(c).to_pylist() for c in ("family", "ti", "tj")), strict=True))
                for i, (key, own, side) in enumerate(zip(keys, batch.column("id").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                    if key != group:
                        if group is not None:
                            yield found()
                        group, ids, sides, sets = key, [], [], []
                    ids.append(own)
                    sides.append(side)
                    sets.append(shingles[bounds[i] : bounds[i + 1]].copy())
        if group is not None:
            yield found()

    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])
    dealt = rows.repartition("family", "ti", "tj").sortWithinPartitions("family", "ti", "tj")
    return dealt.select("family", "ti", "tj", "id", "block", "text").mapInArrow(run, schema)


def sized(families: DataFrame) -> DataFrame:
    """(id, label, size): the members of families with their family's size."""
    sizes = cut(families.groupBy("label").agg(F.count(F.lit(1)).alias("size")))
    return cut(join_groups(families.select("id", "label"), sizes, "label", "size", max(1, families.count())))


def texts_of(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """``placed`` (id, ...) with the texts; only rows of ``docs`` that are placed are shuffled."""
    ids = cut(placed.select("id").distinct())
    return semi_filter(docs, F.col("id"), ids, F.col("id"), ids.count()).join(placed, "id")


def blocked(members: DataFrame, order: list[str]) -> DataFrame:
    """Add ``block``: the members of each family in ``order``, ``TILE`` to a block."""
    ranked, _ = grouped_rank(members.repartitionByRange("label", *order), ["label"], order, "rank")
    return cut(ranked.withColumn("block", F.floor(F.col("rank") / TILE).cast("int")).drop("rank"))


def near_hubs(large: DataFrame, edges: DataFrame) -> DataFrame:
    """Tiles (family, ti, tj, id, block) of the members of large families that follow each other in
    the order of their hub, the smallest document that a bucket joined them to; with each hub as a guest."""
    hubs = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("hub"))
    members = blocked(large.select("id", "label").join(hubs, "id", "left").withColumn("hub", F.coalesce("hub", "id")), ["hub", "id"])
    home = members.select("label", F.col("id").alias("hub"), F.col("block").alias("home"))
    guests = members.select("label", "block", "hub").distinct().join(home, ["label", "hub"]).filter(F.col("home") != F.col("block"))
    rows = members.select("label", "block", "id").unionByName(guests.select("label", "block", F.col("hub").alias("id")))
    return rows.select("id", F.col("label").alias("family"), F.col("block").alias("ti"), F.col("block").alias("tj"), "block")


def tiles_of(blocks: DataFrame, percent: int) -> DataFrame:
    """Tiles (id, family, ti, tj, block) of ``blocks`` (label, block, id, comp, n), without those
    that hold one component or whose documents differ too much in size."""
    facts = cut(blocks.groupBy("label", "block").agg(*[f(c).alias(f"{k}_{c}") for c in ("comp", "n") for k, f in (("lo", F.min), ("hi", F.max))]))
    other = facts.toDF("label", *[f"o_{c}" for c in facts.columns[1:]])
    one = (F.col("lo_comp") == F.col("hi_comp")) & (F.col("o_lo_comp") == F.col("o_hi_comp")) & (F.col("lo_comp") == F.col("o_lo_comp"))
    alike = (100 * F.col("hi_n") >= percent * F.col("o_lo_n")) & (100 * F.col("o_hi_n") >= percent * F.col("lo_n"))
    tiles = facts.join(other, "label").filter((F.col("block") <= F.col("o_block")) & ~one & alike).select("label", F.col("block").alias("ti"), F.col("o_block").alias("tj"))
    sides = tiles.select("label", "ti", "tj", F.explode(F.array_distinct(F.array("ti", "tj"))).alias("block"))
    return sides.join(blocks.select("label", "block", "id"), ["label", "block"]).select("id", F.col("label").alias("family"), "ti", "tj", "block")


def across(large: DataFrame, found: DataFrame, sizes: DataFrame, percent: int) -> DataFrame | None:
    """The tiles of the families that ``found`` (a, b) leaves in several components; None if there are none."""
    comps = connected_components(found).select("id", F.col("label").alias("comp"))
    members = cut(large.select("id", "label").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    torn = cut(members.groupBy("label").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi"))
    if not torn.limit(1).count():
        return None
    still = join_groups(members, torn.select("label", "size"), "label", "size", max(1, members.count())).drop("size")
    return tiles_of(blocked(still.join(sizes, "id"), ["comp", "n", "id"]), percent)


def verified_links(docs: DataFrame, edges: DataFrame, sizes: DataFrame, total: int, shingle: int, percent: int) -> DataFrame:
    """Links of the documents (id, text) within the families that the candidates ``edges`` make.
    ``sizes``: (id, n) of the documents."""
    arrow_batches(docs.sparkSession)
    families = sized(connected_components(edges))
    plain, large = families.filter(F.col("size") <= LARGE), families.filter(F.col("size") > LARGE)
    if large.limit(1).count():  # the second banding
        ids = cut(large.select("id"))
        long = semi_filter(docs, F.col("id"), ids, F.col("id"), ids.count()).join(ids, "id", "left_semi")
        edges = candidates(cut(signatures(long, shingle, LONG_BANDS, LONG_ROWS)), total)
        families = sized(connected_components(edges))
        plain = plain.unionByName(families.filter(F.col("size") <= LARGE))
        large = cut(families.filter(F.col("size") > LARGE))
    zero = F.lit(0)
    tiles = plain.filter(F.col("size") <= TILE).select("id", F.col("label").alias("family"), zero.alias("ti"), zero.alias("tj"), zero.alias("block"))
    several = plain.filter(F.col("size") > TILE).select("id", "label")
    if several.limit(1).count():
        blocks = blocked(several.join(sizes, "id").withColumn("comp", F.col("id")), ["n", "id"])
        tiles = tiles.unionByName(tiles_of(blocks, percent))
    found = cut(family_links(texts_of(docs, cut(tiles)), shingle, percent))
    if not large.limit(1).count():
        return found
    near = cut(family_links(texts_of(docs, cut(near_hubs(large, edges))), shingle, percent))
    far = across(large, near, sizes, percent)
    out = found.unionByName(near)
    return out if far is None else out.unionByName(cut(family_links(texts_of(docs, cut(far)), shingle, percent)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """A row per row of ``docs``: id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct
    shingles of ``shingle`` words (A-Z in lower case; a shorter text is one shingle).
    ``component_id`` is the smallest id that links lead to.  Null and empty texts have no
    shingles and no links.  Rows that share an id are one document: what links one of them
    links all.  Null ids are linked with nothing.  Other columns are not looked at."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sig = cut(signatures(slim, shingle))
    usable = sig.filter((F.col("n") > 0) & F.col("id").isNotNull())
    sets = cut(usable.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")))
    total = sig.count()
    heads = sets.select(F.col("digest").alias("d"), "first")
    nodes = cut(usable.join(heads, (F.col("id") == F.col("first")) & (F.col("digest") == F.col("d"))).select("id", "n", "keys", "sketch"))
    edges = candidates(nodes, total)
    found = connected_components(verified_links(slim, edges, nodes.select("id", "n"), total, shingle, percent))
    rep = found.select(F.col("id").alias("first"), "label")
    groups = cut(sets.join(rep, "first", "left").select("digest", "copies", F.coalesce("label", "first").alias("component")))
    linked = join_groups(usable.select("id", "n", "digest"), groups, "digest", "copies", total).select("id", "n", "component")
    alone = sig.filter((F.col("n") == 0) | F.col("id").isNull()).select("id", "n", F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; all columns stay.

    Null and empty texts and null ids stay; rows that share an id stay or go together.  Very
    long texts are compared whole, and an empty table stays empty."""
    return without(docs, id_col, near_duplicates(docs, id_col, text_col, shingle, percent).filter("not kept").select(id_col))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, least(len(words), 1) + 1))) AS i FROM w)
), n AS (
  SELECT w.doc_id, count(s.shingle) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)
), both_ways AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b
)
SELECT n.doc_id, n_shingles, least(n.doc_id, min(r.b)) AS component_id, n.doc_id = least(n.doc_id, min(r.b)) AS kept
FROM n LEFT JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n_shingles
"""
