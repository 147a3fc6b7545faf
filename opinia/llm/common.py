"""Helpers shared by the operators: shared-folder lineage cuts, vectorised
tokenising and hashing of Arrow string batches.

Words are found on the UTF-8 bytes: a 256-entry table maps A-Z to a-z and
separators to 0, so one pass over a batch yields all words of all texts.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinia.session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 20  # texts are hashed in slices of about this size
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back:
    later jobs start from files that every executor sees."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def bucket(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (the folds of the contracts)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


# --- byte tables -------------------------------------------------------------------------------------------------


def alnum_table() -> np.ndarray:
    """0 for separators; a-z, 0-9 and bytes >= 0x80 stay, A-Z become a-z."""
    t = np.zeros(256, np.uint8)
    t[0x30:0x3A] = np.arange(0x30, 0x3A)
    t[0x61:0x7B] = np.arange(0x61, 0x7B)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


def space_table(lower: bool = False) -> np.ndarray:
    """0 for space and 0x09-0x0D, every other byte is part of a word (NUL is
    mapped to 0xFF, which UTF-8 never uses)."""
    t = np.arange(256, dtype=np.uint8)
    t[0] = 0xFF
    t[0x20] = 0
    t[0x09:0x0E] = 0
    if lower:
        t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


ALNUM = alnum_table()
SPACE = space_table()
SPACE_LOWER = space_table(lower=True)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads 64-bit keys."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (a longer text is alone)."""
    off = np.frombuffer(arr.buffers()[1], np.int32 if pa.types.is_string(arr.type) else np.int64)
    off = off[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    at = 0
    while at < len(arr):
        to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        to = max(to, at + 1)
        yield at, min(to, len(arr))
        at = min(to, len(arr))


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    wide = np.int32 if pa.types.is_string(arr.type) else np.int64
    off = np.frombuffer(arr.buffers()[1], wide)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def word_spans(mapped: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; no word crosses an offset in ``bounds``."""
    n = len(mapped)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = mapped != 0
    cut_at = np.zeros(n + 1, bool)
    cut_at[bounds[(bounds >= 0) & (bounds <= n)]] = True
    cut_at[0] = cut_at[n] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut_at[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut_at[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hash_spans(mapped: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a time.  Spans of at most eight
    bytes and equal length never collide."""
    if not len(s):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(mapped) + 8, np.uint8)
    padded[:len(mapped)] = mapped
    eight = np.ndarray((len(mapped) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    left = e - s
    h = mix64((eight[s] & _MASKS[np.minimum(left, 8)]) ^ (left.astype(np.uint64) * _MULT))
    rest, at = np.flatnonzero(left > 8), 8
    while len(rest):
        more = left[rest] - at
        x = eight[s[rest] + at] & _MASKS[np.minimum(more, 8)]
        h[rest] = mix64(h[rest] ^ (x * _MULT))
        rest, at = rest[more > 8], at + 8
    return h


def word_hashes(arr: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the texts' words) for one slice of texts."""
    buf, off = raw(arr)
    mapped = table[buf]
    s, e = word_spans(mapped, off)
    return hash_spans(mapped, s, e), np.searchsorted(s, off)


def strings(col: pa.Array) -> pa.Array:
    """Null texts become empty; chunks are joined."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col, "")


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, joined."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    starts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(starts, counts)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


SAMPLE_SPACE = 1 << 31


def sample_per_class(df: DataFrame, cls: str, ids: str, rows: int) -> DataFrame:
    """About ``rows`` rows of each class, all of them where a class has no more:
    rows whose hashed id falls below rows/count.  The choice depends on ids
    only.  Classes must be few (labels, languages): one count each is fetched."""
    chance = F.lit(-1.0)
    for r in df.groupBy(cls).count().collect():
        share = min(1.0, rows / r[1]) * SAMPLE_SPACE
        chance = F.when(F.col(cls).eqNullSafe(F.lit(r[0])), F.lit(share)).otherwise(chance)
    return df.where(F.pmod(F.xxhash64(ids), F.lit(SAMPLE_SPACE)) < chance)
