"""Benchmark decontamination with a distributed positional inverted index, in DataFrame
functions only.

1. The index.  One pass over the corpus stores the postings (term, document row, position)
   of the terms that are asked for, without a shuffle: each task writes the index of its own
   documents, sorted by term, so that a term's list is one stretch of each part.
2. The terms' counts, from the lists alone, give each window's rarest terms; a window with a
   term that the corpus lacks cannot occur.
3. The list of a window's rarest term, less the term's offset in the window, proposes starts.
   They are intersected with the second rarest term's list, offset-adjusted, and what is left
   with all the others'.  Only lists' entries of documents that still have a start are
   shuffled, by document and position, so that no document's are in one task.
4. Proximity: the same lists; a stretch is held by the last place of each term before its end.

Terms and windows are broadcast up to ``BLOCK_WORDS`` words of benchmark; a larger benchmark
takes the same joins by shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, semi_filter, table, without

#: Everything that separates words: all of ASCII but digits and small letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
#: Words of the windows up to which terms and windows are broadcast: tens of MB.
BLOCK_WORDS = 2_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z only; lower() does the same, and faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: words, and the items they stand in."""
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    return (
        items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
        .filter(n > 0)
        .select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, F.lit(window)))).alias("words"))
        .distinct()
    )


# --------------------------------------------------------------------------- the index


@dataclass
class Index:
    """docs (row, id, n_words), postings (row, pos, tid) and terms (term, tid, n), stored in the
    shared folder; ``few``: the terms may be broadcast."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    few: bool

    def hint(self, small: DataFrame) -> DataFrame:
        return F.broadcast(small) if self.few else small


def build_index(docs: DataFrame, terms: DataFrame, few: bool, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index the occurrences of ``terms`` (term, distinct) in ``docs``.

    Every row of ``docs`` is a document.  The first word of each is stored too, and carries the
    id and the number of words, so that one table, written in one pass, has it all."""
    numbered = cut(terms.withColumn("tid", F.monotonically_increasing_id()))
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    each = words.select("row", "id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "term"))
    marked = each.join(F.broadcast(numbered) if few else numbered, "term", "left")
    first = F.coalesce("pos", F.lit(0)) == 0
    kept = marked.filter(F.col("tid").isNotNull() | first)
    stored = table(kept.select("row", "pos", "tid", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("n_words")).alias("n_words")).sortWithinPartitions("tid"))
    postings = stored.filter("tid IS NOT NULL").select("row", "pos", "tid")
    counts = postings.groupBy("tid").agg(F.count(F.lit(1)).alias("n"))
    return Index(stored.filter("n_words IS NOT NULL").select("row", "id", "n_words"), postings, cut(numbered.join(counts, "tid", "left").select("term", "tid", F.coalesce("n", F.lit(0)).alias("n"))), few)


def by_rarity(index: Index, windows: DataFrame) -> DataFrame:
    """(win, terms): the terms (n, off, tid) of each window (win, words), the rarest first; without the
    windows that hold a term which the corpus lacks."""
    each = windows.select("win", F.posexplode("words").alias("off", "term")).join(index.hint(index.terms), "term")
    ranked = each.groupBy("win").agg(F.array_sort(F.collect_list(F.struct("n", "off", "tid"))).alias("terms"))
    return ranked.filter(F.col("terms")[0]["n"] > 0)


def starts_at(index: Index, needs: DataFrame) -> DataFrame:
    """(row, start, win): where the lists of ``needs`` (win, off, tid), one a window, put its start."""
    start = (F.col("pos") - F.col("off")).alias("start")
    return index.postings.join(index.hint(needs), "tid").select("row", start, "win").filter("start >= 0")


def intersect(index: Index, found: DataFrame, needs: DataFrame) -> DataFrame:
    """Those of ``found`` (row, start, win) at which every one of the window's ``needs`` (win, off, tid)
    has a posting at its offset; windows without needs stay."""
    found, needs = cut(found), cut(needs)
    wanted = index.hint(needs.groupBy("win").agg(F.count(F.lit(1)).alias("k")))
    rows = cut(found.select("row").distinct())
    asked = found.join(index.hint(needs), "win").select("row", "start", "win", (F.col("start") + F.col("off")).alias("pos"), "tid")
    lists = index.postings.join(index.hint(needs.select("tid").distinct()), "tid", "left_semi")
    lists = semi_filter(lists, F.col("row"), rows, F.col("row"), rows.count()).select("row", "pos", "tid")
    met = asked.join(lists, ["row", "pos", "tid"], "left_semi").groupBy("row", "start", "win").agg(F.count(F.lit(1)).alias("met"))
    whole = met.join(wanted, "win").filter(F.col("met") == F.col("k")).select("row", "start", "win")
    return whole.unionByName(found.join(wanted, "win", "left_anti"))


def phrase_matches(index: Index, windows: DataFrame) -> DataFrame:
    """(row, start, win) of every occurrence of every window (win, words)."""
    ranked = cut(by_rarity(index, windows))
    kth = lambda k: ranked.filter(F.size("terms") > k).select("win", F.col("terms")[k]["off"].alias("off"), F.col("terms")[k]["tid"].alias("tid"))
    rest = ranked.select("win", F.explode(F.slice("terms", F.lit(3), F.greatest(F.size("terms") - 2, F.lit(0)))).alias("t")).select("win", "t.off", "t.tid")
    return intersect(index, intersect(index, starts_at(index, kth(0)), kth(1)), rest)


def proximity_matches(docs: DataFrame, terms: list[str], slop: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end): the shortest stretches of at most ``slop`` words that hold all of ``terms``
    (no shorter one within them), by word positions, the end exclusive.

    Terms are lower-cased (A-Z) and split as texts are, so each is a word.  Null and empty
    texts, and an empty list of terms, match nothing.  Repeated rows match each by itself;
    other columns are not looked at."""
    spark = docs.sparkSession
    wanted = sorted({w for t in terms for w in re.split(SEPARATORS, t.translate(str.maketrans(UPPER, LOWER))) if w})
    index = build_index(docs, spark.createDataFrame([(w,) for w in wanted], "term string"), True, id_col, text_col)
    tids = [r["tid"] for r in index.terms.orderBy("n", "term").collect()]  # as many as terms; the rarest first
    lists = index.postings.select("row", "pos", "tid")
    for tid in tids if len(tids) > 1 else []:
        rows = cut(lists.filter(F.col("tid") == tid).select("row").distinct())
        lists = semi_filter(lists, F.col("row"), rows, F.col("row"), rows.count()).select("row", "pos", "tid")
    so_far = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = [F.last(F.when(F.col("tid") == tid, F.col("pos")), ignorenulls=True).over(so_far) for tid in tids]
    start = F.when(F.lit(bool(tids)), F.array_min(F.array(*latest)) if tids else F.lit(None).cast("int"))
    missing = F.exists(F.array(*latest), lambda x: x.isNull()) if tids else F.lit(True)
    spans = lists.select("row", "pos", start.alias("start"), missing.alias("missing")).filter(~F.col("missing") & (F.col("pos") - F.col("start") < slop))
    least = spans.groupBy("row", "start").agg((F.min("pos") + 1).alias("end"))
    return least.join(index.docs, "row").select(F.col("id").alias(id_col), "start", "end")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean; an item without words has no window;
    an item shorter than a window is one window.  Items with the same id are one item;
    repeated documents are judged each by itself.  Without items all is clean.  Other
    columns are not looked at, and null ids stay null."""
    named = cut(benchmark_windows(items, item_col, item_text_col, window))
    windows = cut(named.select("words").distinct().withColumn("win", F.monotonically_increasing_id()))
    few = (windows.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0) <= block_words
    index = build_index(docs, windows.select(F.explode("words").alias("term")).distinct(), few, id_col, text_col)
    lengths = windows.select("win", F.size("words").alias("n"))
    spans = phrase_matches(index, windows).join(index.hint(lengths), "win").select("row", "start", (F.col("start") + F.col("n")).alias("end"), "win")
    by_row = cut(spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.collect_set("win").alias("wins")))
    names = named.join(index.hint(windows), "words").select("win", "item")
    found = by_row.select("row", F.explode("wins").alias("win")).join(index.hint(names), "win").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"),
            F.greatest(a["reach"], s["end"]).alias("reach"),
        ),
        lambda a: a["n"].cast("long"),
    )
    per_row = by_row.select("row", covered.alias("n_hit")).join(found, "row")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    none = F.array().cast("array<string>")
    return (
        index.docs.join(per_row, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            n_hit.alias("n_hit"),
            F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones; all columns stay.

    A contaminated id goes with all its rows; rows with a null id stay.  Null and empty texts
    are clean, very long ones are read whole, and an empty table stays empty."""
    return without(docs, id_col, contamination(docs, items, id_col, text_col).filter("contaminated").select(id_col))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), s AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM s
), lens AS (SELECT DISTINCT n FROM win), pos AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n
), grams AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM pos
), hit AS (
  SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.k = win.k
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
