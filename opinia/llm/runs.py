"""Periodic runs of words in a text, by online dyadic square catching.

A square is a stretch repeated at once (``u u``); squares of the same period that touch
merge into a run.  On level k the text read so far is cut into completed blocks of 2^k
words, and each block is a catcher for the squares whose first half holds it: those of
a period q from 2^(k+1)-1 to 2^(k+2)-2.  A catcher compares its block with the suffix
of 2^k words that ends at each appended word; equality means that the words of the block
come back q words later.  Per appended word and level only the two catchers at a fitting
distance are asked, so a text of n words costs 2 n log n comparisons of hashes.  The
answers don't depend on each other, so all appended words of a batch of texts advance
together.  Equal answers of neighbouring blocks at one distance merge; what is long
enough is extended, word by word, to both ends.  Squares that lie in a run already found,
at a multiple of its period, are that run's own and go.

A run is a maximal stretch with smallest period q, of at least ``exponent`` * q and
``min_length`` words.  Words are told apart by 64-bit hashes, which hold whole words of up to
eight bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinia.llm import common as C

EXPONENT = 4  # a run has at least so many periods
MIN_LENGTH = 6  # and so many words
STEP = 1 << 18  # appended words that advance together
BATCH_ROWS = 2000


# --- catching -----------------------------------------------------------------------------------------------------


def _stack(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The texts' words one after the other, each text closed by a key of its own, so that
    no stretch that crosses two texts equals another one."""
    n = len(bounds) - 1
    out = np.empty(len(words) + n, np.uint64)
    text = np.repeat(np.arange(n), np.diff(bounds))
    out[np.arange(len(words)) + text] = words
    out[bounds[1:] + np.arange(n)] = C.mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def _squares(hashes: np.ndarray, level: int, cover: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block number, period) of the catchers that a suffix answers.  ``hashes`` has the
    hash of the 2^level words from each place on."""
    size, first = 1 << level, (2 << level) - 1
    blocks, periods = [], []
    for at in range(first, len(hashes), STEP):
        suffix = np.arange(at, min(at + STEP, len(hashes)))  # start of the suffix that an appended word completes
        near = (suffix - first) >> level
        for block in (near, near - 1):
            ok = block >= 0
            start = np.maximum(block, 0) << level
            ok &= hashes[start] == hashes[suffix]
            hit = np.flatnonzero(ok)
            if not len(hit):
                continue
            b, q = block[hit], (suffix - start)[hit]
            left, right = cover[b << level], cover[suffix[hit] + size - 1]
            known = (left >= 0) & (left == right) & (q % period[left] == 0)
            blocks.append(b[~known])
            periods.append(q[~known])
    if not blocks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(blocks), np.concatenate(periods)


def _merged(block: np.ndarray, q: np.ndarray) -> Iterator[np.ndarray]:
    """(period, first block, blocks) of squares of one period in neighbouring blocks."""
    order = np.lexsort((block, q))
    block, q = block[order], q[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (block[1:] != block[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(q)))
    return q[at], block[at], count


def _extend(words: np.ndarray, lo: int, hi: int, q: int, reach: int) -> tuple[int, int]:
    """The stretch around [lo, hi) in which each word equals the one q words later."""
    while lo > 0:
        step = min(reach, lo)
        differ = np.flatnonzero(words[lo - step:lo] != words[lo - step + q:lo + q])
        lo -= step if not len(differ) else step - 1 - differ[-1]
        if len(differ):
            break
    while hi + q < len(words):
        step = min(reach, len(words) - q - hi)
        differ = np.flatnonzero(words[hi:hi + step] != words[hi + q:hi + q + step])
        hi += step if not len(differ) else differ[0]
        if len(differ):
            break
    return lo, hi


def find(words: np.ndarray, bounds: np.ndarray, exponent: int = EXPONENT, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (text, start, length, period), by text, start and period, of the runs of texts
    whose word keys are ``words[bounds[i]:bounds[i + 1]]``.  ``exponent`` is 2 or more."""
    if exponent < 2:
        raise ValueError("a square has two periods")
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")  # the longest first: high levels read only these
    take = C.ranges(lengths[order]) + np.repeat(bounds[:-1][order], lengths[order])
    ends = np.concatenate(([0], np.cumsum(lengths[order])))
    stack = _stack(words[take], ends)
    opens = ends[:-1] + np.arange(len(order))  # first place of each text
    cover = np.full(len(stack), -1, np.int32)  # number of a run that holds the word
    found, period = [], np.ones(1, np.int64)  # of each run; the last one stands for none
    hashes, level = stack.copy(), 0
    while True:
        size, first = 1 << level, (2 << level) - 1
        fits = int(np.searchsorted(-lengths[order], -max(exponent * first, min_length), side="right"))
        if not fits:
            break
        top = ends[fits] + fits  # words of the texts that are long enough for this level
        block, q = _squares(hashes[:max(top - size + 1, 0)], level, cover, period)
        fresh = set()
        if len(block):
            q, block, count = _merged(block, q)
            least = np.maximum((exponent - 1) * q, min_length - q) - 2 * (size - 1)  # words in whole blocks
            for i in np.flatnonzero(count * size >= least):
                lo, hi = _extend(stack[:top], block[i] << level, (block[i] + count[i]) << level, int(q[i]), size)
                if hi + q[i] - lo >= max(exponent * q[i], min_length):
                    fresh.add((int(lo), int(hi + q[i] - lo), int(q[i])))
        if fresh:
            # of several periods of one stretch the smallest is the run's own
            own = {}
            for lo, n, p in sorted(fresh):
                own.setdefault((lo, n), p)
            for (lo, n), p in own.items():
                cover[lo:lo + n] = len(found)
                found.append((lo, n, p))
            period = np.array([p for _, _, p in found] + [1], np.int64)
        level += 1
        top = min(top, len(hashes))
        if top <= size:
            break
        hashes = C.mix64(hashes[:top - size] * np.uint64(0x9E3779B97F4A7C15) + hashes[size:top])
    if not found:
        return np.zeros((0, 4), np.int64)
    best = {}
    for lo, n, p in found:
        best[lo, n] = min(p, best.get((lo, n), p))
    rows = np.array([(lo, n, p) for (lo, n), p in best.items()], np.int64)
    text = np.searchsorted(opens, rows[:, 0], side="right") - 1
    out = np.column_stack((order[text], rows[:, 0] - opens[text], rows[:, 1], rows[:, 2]))
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


# --- texts --------------------------------------------------------------------------------------------------------


def planted(bounds: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Word number that stands at each place once the stretches are planted: where the
    seed h is divisible by 10, with g = h // 10, the words from a = g % n on repeat the
    p = 1 + (n - a) // (3 + g % 8) words there."""
    at = np.arange(bounds[-1])
    for i in np.flatnonzero((seeds % 10 == 0) & (np.diff(bounds) > 0)):
        n, g = int(bounds[i + 1] - bounds[i]), int(seeds[i]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[bounds[i] + a:bounds[i + 1]] = bounds[i] + a + np.arange(n - a) % p
    return at


def _first_copies(bounds: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those outside each run's words after its first period."""
    change = np.zeros(bounds[-1] + 1, np.int64)
    if len(runs):
        base = bounds[runs[:, 0]] + runs[:, 1]
        np.add.at(change, base + runs[:, 3], 1)
        np.add.at(change, base + runs[:, 2], -1)
    return np.cumsum(change[:-1]) == 0


RESULT = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string")
NAMES = ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")


def _scan(texts: pa.Array, seeds: np.ndarray | None, exponent: int, min_length: int, whole: bool) -> list[tuple]:
    buf, off = C.raw(texts)
    mapped = C.SPACE[buf]
    s, e = C.word_spans(mapped, off)
    bounds = np.searchsorted(s, off)
    keys = C.hash_spans(mapped, s, e)
    if seeds is not None:
        at = planted(bounds, seeds)
        keys, s, e = keys[at], s[at], e[at]
    runs = find(keys, bounds, exponent, min_length)
    keep = _first_copies(bounds, runs)
    first = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    # kept words, each with one space behind it
    width = e[keep] - s[keep] + 1
    stop = np.cumsum(width)
    padded = np.append(buf, np.uint8(32))
    joined = padded[C.ranges(width) + np.repeat(s[keep], width)]
    joined[stop - 1] = 32
    left = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(keep)))[bounds]]
    rows = []
    for i in range(len(texts)):
        own = runs[first[i]:first[i + 1], 1:]
        text = joined[left[i]:max(left[i + 1] - 1, left[i])].tobytes()
        best = None, None, None, None
        if len(own):
            start, n, p = max(map(tuple, own.tolist()), key=lambda r: (_Ratio(r[1], r[2]), -r[0], -r[2]))
            best = start, n, p, 1000 * n // p
        said = "".join(f"{a},{n},{p}\n" for a, n, p in own.tolist())
        rows.append((int(bounds[i + 1] - bounds[i]), len(own), *best, hashlib.sha256(said.encode()).hexdigest(),
                     hashlib.sha256(text).hexdigest(),
                     [dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()] if whole else None,
                     text.decode() if whole else None))
    return rows


class _Ratio:
    """An exact fraction that only compares."""

    __slots__ = ("a", "b")

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b

    def __lt__(self, other):
        return self.a * other.b < other.a * self.b

    def __gt__(self, other):
        return other < self

    def __eq__(self, other):
        return self.a * other.b == other.a * self.b


def _worker(text: str, seed: str | None, exponent: int, min_length: int, whole: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = C.strings(b.column(b.schema.get_field_index(text)))
            seeds = None
            if seed is not None:
                seeds = b.column(b.schema.get_field_index(seed)).fill_null(1).to_numpy(zero_copy_only=False)
            for lo, hi in C.slices(texts):
                part = b.slice(lo, hi - lo)
                rows = _scan(texts.slice(lo, hi - lo), None if seeds is None else seeds[lo:hi], exponent, min_length, whole)
                cols = [part.column(part.schema.get_field_index(f)) for f in schema.names[:-len(NAMES)]]
                cols += [pa.array(v, schema.field(n).type) for n, v in zip(NAMES, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def detect(docs: DataFrame, text: str = "text", seed: str | None = None, exponent: int = EXPONENT,
           min_length: int = MIN_LENGTH, whole: bool = True) -> DataFrame:
    """``docs`` plus n_words, n_runs, the run with the most periods (start, length, period,
    exponent_milli; ties: smallest start, then period), runs_sha256 (all runs as lines
    ``start,length,period``), collapsed_sha256, and with ``whole`` the runs themselves
    and the collapsed text (the words outside each run's repeats, joined by a space).

    Words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has no words, no runs, nulls for
    the best run and the hashes of the empty string.  Each row is judged by its own text: repeated
    rows have equal results, a very long text is one piece of work of its task, an empty table gives
    no rows.  Columns named like a result are replaced.  ``seed`` names a column of hashes
    by which periodic stretches are planted first (see ``planted``); a null seed plants nothing."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if text in NAMES:
        raise ValueError(f"the text column must not be named like a result: {text}")
    kept = [c for c in docs.columns if c not in NAMES and c != seed]
    base = docs.select(*kept, *([seed] if seed else []))
    out = T.StructType([f for f in base.schema.fields if f.name != seed] + T.StructType.fromDDL(RESULT).fields)
    return base.mapInArrow(_worker(text, seed, exponent, min_length, whole, to_arrow_schema(out)), out)


CONTRACT = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def query(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, in a tenth of which (by the hash of the id) a periodic stretch is planted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    seeded = docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    return detect(seeded, seed="_h", whole=False).select(*CONTRACT)
