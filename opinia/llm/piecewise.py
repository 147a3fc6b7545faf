"""Fingerprints of documents by context-triggered piecewise hashing.

A hash rolls over the UTF-8 bytes: at each byte it depends on the last ``WINDOW`` = 7 bytes alone.
Its number of leading zero bits is the byte's level; at block size 2^k a chunk ends behind
each byte of level k or more, and behind the last byte.  So an edit changes the chunks near
it, and all others stay.  A chunk's symbol is twelve bits (two letters of base 64) of a hash of its
rolling hashes and its length.  The block size is the smallest with at most ``CHUNKS`` = 64 chunks,
found by counting, so a signature is short however long or repetitive the text is, and it always covers
the whole text.  A fingerprint is ``k:s0:s1:s2`` with the signatures at 2^k, 2^(k+1) and 2^(k+2).

Two fingerprints are compared where their block sizes meet (equal, or up to four times the other):
1 - d / (a + b), d the edit distance in symbols (insertions and deletions; a change is both) and a, b
the lengths; the better of the sizes they share.  Others have likeness 0.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinia.llm import common as C

WINDOW = 7
CHUNKS = 64
SIZES = 3  # block sizes of a fingerprint
LEVELS = 32
HEAD_SPLITS = 4  # id ranges per shuffle partition
BATCH_BYTES = 1 << 20


# --- fingerprints -------------------------------------------------------------------------------------------------


def _rolling(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the last ``WINDOW`` bytes at each byte (fewer at the start)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[WINDOW:WINDOW + len(data)] = data
    seven = np.ndarray((len(data),), "<u8", padded, offset=1, strides=(1,)) & np.uint64((1 << 8 * WINDOW) - 1)
    return C.mix64(seven)


def _levels(h: np.ndarray) -> np.ndarray:
    """Leading zero bits of the upper 32 bits, as its float's exponent tells them."""
    top = (h >> np.uint64(32)).astype(np.float32).view(np.uint32) >> np.uint32(23)
    return np.clip(np.int16(158) - top.astype(np.int16), 0, LEVELS).astype(np.uint8)


def _signature(h: np.ndarray, ends: np.ndarray) -> str:
    starts = np.concatenate(([0], ends[:-1]))
    sums = np.add.reduceat(h, starts) + (ends - starts).astype(np.uint64)
    symbols = (C.mix64(sums) >> np.uint64(52)).astype(">u2")
    # twelve bits are two letters: of the three bytes of each pair of symbols
    wide = np.zeros((len(symbols) + 1) // 2 * 2, np.uint32)
    wide[:len(symbols)] = symbols
    packed = (wide[::2] << np.uint32(12) | wide[1::2]).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
    return base64.b64encode(packed.tobytes()).decode()[:2 * len(symbols)]


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Fingerprints of the texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8 bytes)."""
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = hi - lo
        if not n:
            out.append("0" + ":" * SIZES)
            continue
        h = _rolling(data[lo:hi])
        level = _levels(h)
        # a chunk ends behind the last byte at any block size
        inner = np.bincount(level[:-1], minlength=LEVELS + 1)[::-1].cumsum()[::-1] + 1
        k = int(np.argmax(inner <= CHUNKS)) if inner[-1] <= CHUNKS else LEVELS + 1
        signs = []
        for at in range(k, k + SIZES):
            ends = np.flatnonzero(level[:-1] >= at) + 1
            signs.append(_signature(h, np.append(ends, n)))
        out.append(":".join((str(k), *signs)))
    return out


def fingerprint(text: str | None) -> str:
    """Fingerprint of one text (null: empty)."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return fingerprints(data, np.array([0, len(data)]))[0]


# --- likeness -----------------------------------------------------------------------------------------------------


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; one step per match (Hunt and Szymanski)."""
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    tails: list[int] = []
    for x in a:
        for j in reversed(places.get(x, ())):
            at = bisect.bisect_left(tails, j)
            if at == len(tails):
                tails.append(j)
            else:
                tails[at] = j
    return len(tails)


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x = [a[i:i + 2] for i in range(0, len(a), 2)]
    y = [b[i:i + 2] for i in range(0, len(b), 2)]
    distance = len(x) + len(y) - 2 * _common(x, y)
    return 1.0 - distance / (len(x) + len(y))


def likeness(one: str, other: str) -> float:
    """0 (nothing shared) to 1 (equal signatures at a block size they share)."""
    k, *a = one.split(":")
    m, *b = other.split(":")
    if not a[0] or not b[0]:
        return float(a[0] == b[0])
    shift = int(m) - int(k)  # a[i + shift] and b[i] are at one block size
    pairs = [(a[i + shift], b[i]) for i in range(SIZES) if 0 <= i + shift < SIZES]
    return max((_alike(x, y) for x, y in pairs), default=0.0)


# --- documents and their successors -------------------------------------------------------------------------------


def _lead(buf: np.ndarray, lo: int, hi: int, chars: int) -> int:
    """Byte at which the first ``chars`` code points of [lo, hi) end (hi if there are no more)."""
    if hi - lo <= chars:
        return hi
    heads = np.flatnonzero((buf[lo:min(hi, lo + 4 * chars + 4)] & 0xC0) != 0x80)
    return lo + int(heads[chars]) if chars < len(heads) else hi


RESULT = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
NAMES = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _judge(own: list[bytes], following: list[bytes]) -> list[tuple]:
    """Result rows of texts whose successors are given."""
    edited, sizes = [], []
    for text, nxt in zip(own, following, strict=True):
        a, b = np.frombuffer(text, np.uint8), np.frombuffer(nxt, np.uint8)
        n = int(np.count_nonzero((a & 0xC0) != 0x80))
        half = n // 2
        edited.append(text[:_lead(a, 0, len(a), n - half)] + nxt[:_lead(b, 0, len(b), half)])
        sizes.append(n)

    def prints(texts):
        return fingerprints(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))

    mine, altered = prints(own), prints(edited)
    after = mine[1:] + prints(following[-1:])
    return [(n, hashlib.sha256(e).hexdigest(), f, g, likeness(f, g), likeness(f, x))
            for n, e, f, g, x in zip(sizes, edited, mine, altered, after, strict=True)]


def _successors(schema: pa.Schema, kept: list[str]):
    """Arrow function over rows sorted by (range, ahead, order): each row that is not ``_ahead`` is
    judged with the row behind it, which its range always has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which still waits for its successor

        def judged(table: pa.Table) -> pa.RecordBatch | None:
            ahead = table["_ahead"].to_numpy(zero_copy_only=False)
            own = np.flatnonzero(~ahead[:-1])
            if not len(own):
                return None
            texts = [(t or "").encode() for t in table["_t"].to_pylist()]
            rows = []
            # stretches of rows that follow each other
            for part in np.split(own, np.flatnonzero(np.diff(own) != 1) + 1):
                rows += _judge([texts[i] for i in part], [texts[i + 1] for i in part])
            cols = [table.column(c).combine_chunks().take(pa.array(own)) for c in kept]
            cols += [pa.array(v, schema.field(n).type) for n, v in zip(NAMES, zip(*rows, strict=True), strict=True)]
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            for lo, hi in C.slices(batch.column(batch.schema.get_field_index("_t")), BATCH_BYTES):
                rows = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if held is not None:
                    rows = pa.concat_tables([held, rows])
                done = judged(rows)
                if done is not None:
                    yield done
                held = rows.take([len(rows) - 1])  # a copy: a slice would hold its whole batch

    return run


def compare(docs: DataFrame, text: str = "text", order: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus n_chars, fingerprint, and edited_sha256, edited_fingerprint, near_edited and near_next of
    the text whose last half was replaced by the start of the next document's, and of the next document.

    The next document is the one behind in the order of ``order`` (a number; nulls first; equal ones by a hash of
    the text), after the last the first; a lone document follows itself.  A null text is empty; empty
    texts are alike to each other and unlike all others; equal texts have equal fingerprints, so repeated
    rows have likeness 1 to their next copy.  Texts of any length are taken whole.  An empty table
    gives no rows.  Columns named like a result are replaced; ``keep`` names the columns to return (all).

    One exchange: rows go to ranges of ids, and each range also gets the first row of the range behind
    it (one row per range, found by an aggregate), so no global sort and no second copy of the texts is needed."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    if {text, order} & set(NAMES):
        raise ValueError("the text and order columns must not be named like a result")
    kept = [c for c in docs.columns if c not in NAMES and (keep is None or c in keep)]
    base = docs.select(*dict.fromkeys([*kept, order, text]))
    out = T.StructType(docs.select(*kept).schema.fields + T.StructType.fromDDL(RESULT).fields)
    others = [c for c in kept if c != text]  # the text goes along once
    tasks = C.partitions(spark)
    ranges = HEAD_SPLITS * tasks
    cuts = base.select(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    cuts = sorted({float(c) for c in cuts or []} - {inf, -inf})
    x = base.select(*others, F.col(text).alias("_t"), F.col(order).alias("_o"), F.col(order).cast("double").alias("_d"),
                    F.xxhash64(C.text_or_empty(text)).alias("_h"))
    if cuts:
        x = Bucketizer(splits=[-inf, *cuts, inf], inputCol="_d", outputCol="_b", handleInvalid="keep").transform(x)
    else:
        x = x.withColumn("_b", F.lit(0.0))
    x = x.withColumn("_place", F.when(F.col("_o").isNull(), -1).otherwise(F.col("_b").cast("int"))).drop("_b", "_d")
    # the first row of each range: its id first, so that no text is sorted for it
    least = x.groupBy("_place").agg(F.min("_o").alias("_m")).withColumnRenamed("_place", "_p")
    heads = x.join(F.broadcast(least), (F.col("_place") == F.col("_p")) & F.col("_o").eqNullSafe(F.col("_m")))
    heads = heads.groupBy("_place").agg(F.min(F.struct("_h", "_t")).alias("_r"), F.first("_o").alias("_o"))
    heads = C.cut(heads.select("_place", "_o", "_r.*"), "piecewise-heads")
    places = [r[0] for r in heads.select("_place").orderBy("_place").collect()]  # one number per range
    if not places:
        return spark.createDataFrame([], out)
    before = {p: places[i - 1] for i, p in enumerate(places)}
    goes = F.element_at(F.create_map(*(F.lit(v) for kv in before.items() for v in kv)), F.col("_place"))
    empty = [F.lit(None).cast(base.schema[c].dataType).alias(c) for c in others]
    ahead = heads.select(*empty, goes.alias("_place"), "_t", "_o", "_h", F.lit(True).alias("_ahead"))
    own = x.select(*others, "_place", "_t", "_o", "_h", F.lit(False).alias("_ahead"))
    rows = own.unionByName(ahead).repartition(tasks, "_place").sortWithinPartitions("_place", "_ahead", "_o", "_h")
    rows = rows.select(*others, "_t", "_ahead")
    return rows.mapInArrow(_successors(to_arrow_schema(out), ["_t" if c == text else c for c in kept]), out)


def fingerprint_table(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text in the column ``out`` (null: that of the empty text);
    no exchange."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in docs.columns if c != out]
    base = docs.select(*kept, C.text_or_empty(text).alias("_t"))
    full = T.StructType(docs.select(*kept).schema.fields + [T.StructField(out, T.StringType())])
    schema = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = C.strings(b.column(len(kept)))
            signs = []
            for lo, hi in C.slices(texts, BATCH_BYTES):
                signs += fingerprints(*C.raw(texts.slice(lo, hi - lo)))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + [pa.array(signs, pa.string())], schema=schema)

    return base.mapInArrow(run, full)


CONTRACT = ["doc_id", *NAMES]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return compare(docs, keep=["doc_id"]).select(*CONTRACT)
