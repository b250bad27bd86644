"""Best-fit packing of tokenized documents into fixed-length sequences.

The instance is a histogram: how many pieces have each length, at most ``capacity``
numbers however many documents there are.  On it the driver

1. applies Martello and Toth's dominance reduction: a set of pieces that provably
   dominates every other sequence holding its largest piece is fixed, and the instance
   shrinks, until no rule applies;
2. packs the remainder best-fit in order of decreasing length.

Either step handles all pieces of a length, and all sequences filled alike, at once.  The
outcome is a table of ranges: "pieces a to b of length l go, k to a sequence, to the
sequences from s on, at offset o".  Pieces get their rank among those of their length
by a distributed numbering and look their range up; no piece goes through the driver.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from bisect import insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import arrow_batches, grouped_rank

CAPACITY = 2048
#: The id that ends each document.
END_ID = 0
#: tiktoken fails on white space runs of about a million characters; texts with runs from here on go to tokenizers.
LONG_RUN = 100_000


# --------------------------------------------------------------------------- the plan


@dataclass
class Bins:
    """``count`` sequences filled alike: (length, pieces of it) in order of placement."""

    count: int
    free: int
    content: list[tuple[int, int]] = field(default_factory=list)


class Histogram:
    """Pieces left, by length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.n = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.n[length] = count

    def smallest(self, k: int, without: int) -> list[int]:
        """Lengths of the k smallest pieces, one piece of length ``without`` set aside."""
        out: list[int] = []
        for length in np.flatnonzero(self.n):
            have = int(self.n[length]) - (length == without)
            out += [int(length)] * min(have, k - len(out))
            if len(out) == k:
                break
        return out

    def largest_within(self, limit: int, without: tuple[int, ...]) -> int:
        """Largest length of at most ``limit`` of a piece left beside those set aside, or 0."""
        for length in np.flatnonzero(self.n[: limit + 1])[::-1]:
            if self.n[length] > without.count(int(length)):
                return int(length)
        return 0


def dominating(h: Histogram, length: int) -> tuple[int, ...] | None:
    """A set holding a piece of ``length`` that dominates all feasible ones, else None.

    A set dominates another if the other's pieces can be grouped so that each group fits in
    a piece of the set's of its own; then some optimal packing uses the set."""
    room = h.capacity - length
    small = h.smallest(4, length)
    fit = [sum(small[: k + 1]) <= room for k in range(len(small))]
    if not any(fit):
        return (length,)
    best = h.largest_within(room, (length,))
    if best == room or sum(fit) == 1:
        return (length, best)  # whatever else joins this piece fits in the place of `best`
    if sum(fit) == 2:
        second = h.largest_within(room - best, (length, best))
        lesser = 0  # the largest smaller one of two that both join this piece
        for y in np.flatnonzero(h.n[: room // 2 + 1])[::-1]:
            y = int(y)
            have = int(h.n[y]) - (y == length)
            above = np.flatnonzero(h.n[y + 1 : room - y + 1])
            if have >= 2 or (have and any(h.n[y + 1 + a] > (y + 1 + a == length) for a in above[:2])):
                lesser = y
                break
        if second >= lesser > 0:
            return (length, best, second)
    return None


def reduce_instance(h: Histogram) -> list[Bins]:
    """Fix dominating sets until no rule applies; the histogram keeps the remainder."""
    fixed: list[Bins] = []
    changed = True
    while changed:
        changed = False
        for length in np.flatnonzero(h.n)[::-1]:
            length = int(length)
            while h.n[length] and (found := dominating(h, length)):
                kinds = {x: found.count(x) for x in found}
                # what is left only loses small pieces, so the set dominates as often as it is there
                times = min(int(h.n[x]) // k for x, k in kinds.items())
                for x, k in kinds.items():
                    h.n[x] -= times * k
                fixed.append(Bins(times, h.capacity - sum(found), list(kinds.items())))
                changed = True
    return fixed


def best_fit(h: Histogram) -> list[Bins]:
    """Best fit in order of decreasing length: a piece goes where the least room is left."""
    by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []  # sorted keys of by_room
    out: list[Bins] = []

    def keep(b: Bins) -> None:
        if b.free == 0:
            out.append(b)
            return
        if b.free not in by_room:
            by_room[b.free] = []
            insort(rooms, b.free)
        by_room[b.free].append(b)

    for length in np.flatnonzero(h.n)[::-1]:
        length, left = int(length), int(h.n[length])
        placed: list[Bins] = []
        for room in [r for r in rooms if r >= length]:
            each, group = room // length, by_room.pop(room)
            rooms.remove(room)
            while group and left:
                b = group.pop()
                full, rest = min(b.count, left // each), 0
                if full < b.count:
                    rest = left - full * each
                for count, k in ((full, each), (1, rest)):
                    if count and k:
                        placed.append(Bins(count, b.free - k * length, [*b.content, (length, k)]))
                left -= full * each + rest
                if same := b.count - full - bool(rest):
                    placed.append(Bins(same, b.free, b.content))
            placed += group
            if not left:
                break
        for b in placed:
            keep(b)
        each = h.capacity // length
        for count, k in ((left // each, each), (1, left % each)):
            if count and k:
                keep(Bins(count, h.capacity - k * length, [(length, k)]))
        h.n[length] = 0
    for group in by_room.values():
        out += group
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    h = Histogram(counts, capacity)
    return reduce_instance(h) + best_fit(h)


def ranges(bins: list[Bins]) -> dict[str, np.ndarray]:
    """The plan as ranges of ranks, sorted by (length, first rank).  Their number depends on
    the capacity, not on the number of pieces."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for b in bins:
        offset = 0
        for length, k in b.content:
            first = taken.get(length, 0)
            taken[length] = first + b.count * k
            rows.append((length, first, sequence, k, offset))
            offset += length * k
        sequence += b.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "each", "offset"), table.T, strict=True))


# --------------------------------------------------------------------------- tokens


def long_run(text: str) -> bool:
    """Whether a run of white space is ``LONG_RUN`` or longer."""
    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in re.finditer(r"\s+", text))


@lru_cache(maxsize=4)
def encoder(path: str, special_as_text: bool = False) -> Callable[[str], list[int]]:
    """Ids of a text by the vocabulary at ``path``: a ``.json`` of the tokenizers library, as
    ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them, or the
    same vocabulary's ``.tiktoken`` ranks, which give the same ids several times faster; the
    few texts that tiktoken cannot take go to the ``.json`` beside it.  The strings of special
    tokens in a text are these tokens, or with ``special_as_text`` ordinary text."""
    import public_tokenizers

    if path.endswith(".tiktoken"):
        import tiktoken

        beside = f"{path.removesuffix('.tiktoken')}.json"
        special = {} if special_as_text else special_tokens(beside)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        plain = (lambda text: fast.encode(text, allowed_special="all")) if special else fast.encode_ordinary
        return lambda text: encoder(beside, special_as_text)(text) if long_run(text) else plain(text)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if special_as_text:
        t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def special_tokens(path: str) -> dict[str, int]:
    """The special tokens that a ``.json`` vocabulary names; none where there is no such file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


def cut_points(length: int, capacity: int) -> list[int]:
    """Starts of a document's pieces: all but the first are full."""
    if length <= capacity:
        return [0]
    first = length % capacity
    return ([0] if first else []) + list(range(first, length, capacity))


def tokenize(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids) of every piece.  Null text is empty, so
    its only token is the end."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [slim.schema["id"], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))]
    schema = T.StructType([*fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, special_as_text)
        for b in batches:
            rows, out = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.array([*encode(text), END_ID], "<u4")
                starts = cut_points(len(ids), capacity)
                for piece, (a, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append(i)
                    out.append((piece, a, e - a, zlib.crc32(ids[a:e].tobytes()), *([ids[a:e].astype(np.int32)] if with_ids else [])))
            cols = list(zip(*out, strict=True)) or [()] * (len(schema) - 1)
            arrays = [b.column("id").take(pa.array(rows, pa.int64()))]
            for col, kind in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=False):
                arrays.append(pa.array(col, kind))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    arrow_batches(docs.sparkSession)
    return slim.mapInArrow(run, schema)


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``."""
    ranked, starts = grouped_rank(pieces, ["length"], order, "_rank")
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("_rows").alias("n")).collect()}  # <= capacity rows
    table = pieces.sparkSession.sparkContext.broadcast(ranges(plan(counts, capacity)))
    schema = T.StructType([*ranked.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = (t["length"] << 44) + t["first"]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            k = rank - t["first"][at]
            sequence, offset = t["sequence"][at] + k // t["each"][at], t["offset"][at] + k % t["each"][at] * length
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(place, schema).drop("_rank")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Every row of ``docs`` is a document of its own, repeated ones too; a null text is
    empty and takes one token; a text longer than a sequence is cut, first piece shorter.
    The strings of special tokens in a text are these tokens, unless ``special_as_text``.
    An empty table gives no rows; other columns are not looked at."""
    pieces = tokenize(docs, vocabulary or vocabulary_path(), capacity, id_col, text_col, with_ids, special_as_text)
    packed = pack(pieces, ["id", "piece", "start", "ids_crc32"], capacity)
    return packed.withColumnRenamed("id", id_col).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
