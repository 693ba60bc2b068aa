"""Helpers shared by the operators: table reads, and words of many texts at once as numpy arrays.

Words are the runs between the six ASCII spaces (space, tab, line feed, vertical tab, form feed, return).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]

# The digest of a word is a polynomial in random 64-bit values of its bytes, modulo 2**64, then mixed.
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
# Arrow batches are cut to about this many bytes of text, so that temporary arrays stay small.
BATCH_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc32_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo the divisor. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers so that every bit of the result depends on every bit of the argument."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of the digest's base and of its inverse, extended when a longer batch arrives."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
            cls.up[0] = cls.down[0] = 1
            cls.up, cls.down = np.cumprod(cls.up, dtype=np.uint64), np.cumprod(cls.down, dtype=np.uint64)
        return cls.up, cls.down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the digest's base, and of its inverse: n at least."""
    return _Powers.reach(n)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _ASCII_LOWER[data]


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digest of each byte range; equal bytes give equal digests wherever they stand."""
    up, down = _Powers.reach(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the rows' bounds within these arrays (one more than rows)."""
    inside = ~_IS_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        begins[firsts] |= inside[firsts]
        lasts = offsets[1:][offsets[1:] > 0] - 1
        stops[lasts] |= inside[lasts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_digests(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words of a string column and the rows' bounds within them."""
    data, offsets = utf8(column)
    if lower:
        data = lower_ascii(data)
    starts, ends, bounds = word_spans(data, offsets)
    return span_digests(data, starts, ends), bounds


def word_digest(word: bytes) -> int:
    """Digest of one word, equal to what the array functions give."""
    data = np.frombuffer(word, np.uint8)
    return int(span_digests(data, np.zeros(1, np.int64), np.array([len(data)]))[0])


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches where their text exceeds a few megabytes; a longer text stands alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        if not len(column):
            continue
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        start = 0
        while start < len(column):
            stop = int(np.searchsorted(ends, ends[start] + BATCH_BYTES, side="right")) - 1
            stop = min(max(stop, start + 1), len(column))
            yield batch.slice(start, stop - start)
            start = stop


def byte_to_code_point(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position, one more entry than bytes."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
