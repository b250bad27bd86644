"""Words and word n-grams of Arrow text columns as 64-bit hashes, without a Python loop over
words: bytes, words and n-grams are numpy arrays over a whole batch of texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: White space of the contracts: the space and the bytes 9 to 13.  Neither occurs inside a
#: UTF-8 sequence, so words can be found among bytes.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Odd multipliers of the polynomial hashes modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1B54A32D192ED03
#: Bytes hashed at a time.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, a bijection of the unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            steps = np.ones((2, n), np.uint64)
            steps[0, 1:], steps[1, 1:] = self.base, pow(self.base, -1, 1 << 64)
            self.up, self.down = np.multiply.accumulate(steps, axis=1)
        return self.up, self.down


byte_powers, word_powers = Powers(BYTE_BASE), Powers(WORD_BASE)


@dataclass
class Words:
    """The words of a batch of texts.  Text i has the words first[i] to first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    ids: np.ndarray

    def raw(self, i: int, j: int) -> bytes:
        """The bytes from word i to before word j, white space between them as it is."""
        return self.data[self.starts[i] : self.ends[j - 1]].tobytes() if j > i else b""

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the texts' n + 1 bounds in them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        base = int(starts[i])
        part = data[base : int(ends[j - 1])]
        up, down = byte_powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        a, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[a]) * down[a] + (e - a).astype(np.uint64) * np.uint64(WORD_BASE)
        i = j
    return mix(out)


def words_of(column: pa.Array, fold: bool) -> Words:
    """Split the texts at white space; ``fold`` lower-cases A-Z first."""
    data, offsets = text_bytes(column)
    if fold:
        data = FOLD[data]
    n = len(data)
    inside = ~IS_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] = inside[edge]
    stops[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hash_words(data, starts, ends))


def tokens_of(column: pa.Array, byte_class: np.ndarray) -> Words:
    """Runs of bytes of one class (class 0 separates), with A-Z in lower case."""
    data, offsets = text_bytes(column)
    kind, n = byte_class[data], len(data)
    edge = np.zeros(n + 1, bool)
    edge[[0, n]] = True
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    real = kind[begin] != 0
    data, starts, ends = FOLD[data], begin[real], end[real]
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hash_words(data, starts, ends))


def ngrams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k ids from each place on (over text borders too): len(ids) - k + 1."""
    if len(ids) < k:
        return np.zeros(0, np.uint64)
    up, down = word_powers(len(ids) + 1)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(ids * up[: len(ids)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(ids) - k + 1] + np.uint64(k))


def sub_batches(batch: pa.RecordBatch, rows: int, text: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, and of about ``most_bytes`` of text unless a single
    text is longer."""
    _, offsets = text_bytes(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1
        j = min(max(j, i + 1), i + rows, batch.num_rows)
        yield batch.slice(i, j - i)
        i = j
