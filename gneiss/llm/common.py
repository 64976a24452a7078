"""What several corpus operators share: shared storage, row slices and vectorised word hashing."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gneiss.storage import durable, shared_dir

__all__ = ["durable", "shared_dir"]

U64 = np.uint64
WORD_GAP = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WORD_GAP)] = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of texts in an Arrow batch: Spark's own 10,000 make batches of many MB, held several times over on their way to Python.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch to BATCH_ROWS. The queries and the pipeline's stages call it, no operator does."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Gives memory that is free back to the system. A worker serves many tasks, and what one of them freed would stay with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        return


def tidy(f):
    """f, a generator over Arrow batches, that gives free memory back when it ends."""

    def over(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return over


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a list of keys up to which it is broadcast.
BROADCAST_ROWS = 200_000


def without(df: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """df without the rows whose values in the columns of keys, nulls included, are among its rows (left_semi: only those); a short
    list of keys is broadcast, and df isn't shuffled then."""
    keys = durable(keys)
    renamed = keys.toDF(*[f"{c} to find" for c in keys.columns])
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        renamed = renamed.hint("broadcast")
    same = None
    for c in keys.columns:
        one = df[f"`{c}`"].eqNullSafe(renamed[f"`{c} to find`"])
        same = one if same is None else same & one
    return df.join(renamed, same, how)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, U64), np.full(n - 1, base, U64)]).cumprod(dtype=U64)


_LOW, _HIGH = _powers(0x9E3779B97F4A7C15, 1 << 16), _powers(0xD6E8FEB86659FD93, 1 << 16)


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and the n + 1 offsets of its rows; null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], pa.string())
    a = a.cast(pa.large_binary())
    n = len(a)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + n + 1]
    if a.null_count:
        a = a.fill_null(b"")
        off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + n + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def bites(batches, rows: int = 512):
    """Arrow batches in slices of few rows, so that what a task makes of one stays small; no copies."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def row_slices(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of about `most` bytes each, a longer row alone, so that temporary arrays stay small."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words, and the n + 1 word indexes at which rows begin."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = is_word[data]
    before, after = np.zeros_like(w), np.zeros_like(w)
    before[1:], after[:-1] = w[:-1], w[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    value = _BYTE[data[place + np.repeat(starts, size)]]
    value *= _LOW[place & 0xFFFF]
    if size.max() > 0xFFFF:
        value *= _HIGH[(place >> 16) & 0xFFFF]
    return mix(np.add.reduceat(value, at) + size.astype(U64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, row ends ignored."""
    if len(h) < k:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - k + 1, U64)
    for j in range(k):
        out *= U64(0x9FB21C651E98DF25)
        out += h[j : len(h) - k + 1 + j]
    return mix(out)
