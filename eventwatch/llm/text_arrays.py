"""Vectorised tokens and fingerprints over the byte buffers of Arrow text columns.

Everything here runs inside Spark tasks on one slice of rows at a time. Slices hold whole texts and
about `CHUNK_BYTES` bytes, so memory is bounded by that or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHUNK_BYTES = 2 << 20
#: Word breaks of every operator here: space, tab, line feed, vertical tab, form feed, return.
SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: Breaks for letters only: all ASCII but letters, digits and the apostrophe.
NOT_LETTERS = np.array([b < 128 and not (chr(b).isalnum() or b == 39) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
RADIX = np.uint64(0x9E3779B97F4A7C13)
RADIX_INVERSE = np.uint64(pow(int(RADIX), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalising mix (a bijection) of each element."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows, so that a worker holds few long texts at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every operator reads, nulls in the text as empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i is bytes[offsets[i]:offsets[i + 1]]; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of rows of about `limit` bytes."""
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


class Words:
    """Words of a slice: `start`, `end` (byte positions), `first` (word offsets per row), `hash`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, breaks: np.ndarray = _IS_SPACE):
        n = len(data)
        inside = ~breaks[data]
        fresh = np.empty(n, bool)
        if n:
            fresh[0] = inside[0]
            np.logical_and(inside[1:], ~inside[:-1], out=fresh[1:])
        heads = offsets[:-1][(offsets[:-1] < n) & (np.diff(offsets) > 0)]
        fresh[heads] = inside[heads]
        self.start = np.flatnonzero(fresh)
        stop = np.empty(n, bool)
        if n:
            stop[-1] = inside[-1]
            np.logical_and(inside[:-1], ~inside[1:] | fresh[1:], out=stop[:-1])
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = range_hashes(_LOWER[data] if lower else data, self.start, self.end)

    @property
    def row(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each pair, from one running sum."""
    n = len(data)
    powers = powers_of(RADIX, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers[:n], out=total[1:])
    inverse = powers_of(RADIX_INVERSE, n + 1)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


class Kept(dict):
    """Tables a process keeps for reuse; they are never sent to another one."""

    def __reduce__(self):
        return Kept, ()


_POWERS: dict[int, np.ndarray] = Kept()


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base² ... modulo 2⁶⁴, kept for reuse up to a few chunks' length."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        size = max(n, CHUNK_BYTES + 65536)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[int(base)] = known
    return known[:n]


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each `size`-word shingle; a row of fewer words gives its whole sequence as one."""
    h, first = words.hash, words.first
    n = len(h)
    counts = np.diff(first)
    whole = np.maximum(counts - size + 1, 0)
    out = mix(h + np.uint64(size))
    for k in range(1, size):
        if n > k:
            out[:-k] = mix(out[:-k] * np.uint64(3) + h[k:])
    starts = np.repeat(first[:-1], whole) + within(whole)
    rows = np.repeat(np.arange(len(counts)), whole)
    result = out[starts]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            few[has] = mix(few[has] * np.uint64(5) + h[first[short[has]] + k] + np.uint64(1))
        result, rows = np.concatenate([result, few]), np.concatenate([rows, short])
    return result, rows


def within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of `counts`, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the BIGINT with the same bits."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column: counts[i] values in row i."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder."""
    import uuid

    from eventwatch.session import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id as text: decides held-out rows."""
    return F.crc32(F.col(col).cast("string").cast("binary"))
