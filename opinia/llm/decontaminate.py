"""Benchmark decontamination (operator 9).

One Aho-Corasick automaton holds every window (``window`` consecutive
normalised words, or the whole item if it is shorter) of the benchmark
items; each text is scanned once.  Matches are mapped from the normalised
string to word positions and to character offsets of the original text.

The automaton is built from the benchmark, in blocks of at most
``block_words`` words (a documented bound on what one broadcast holds); a
larger benchmark is scanned block by block and the hits are united, so no
item is left out.

Defined results: null or empty texts have no words and no hits; items without
a word never match; repeated items and rows each count; input columns keep
their names, clashing result columns replace them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinia.llm import common as C

WINDOW = 13
BLOCK_WORDS = 200_000


def normalise(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    return data.split()


_TABLE = bytes(int(b) if b else 0x20 for b in C.ALNUM)


def windows(words: list[bytes], size: int) -> list[str]:
    """Each window as one string with a space at both ends (bytes as latin-1)."""
    if not words:
        return []
    n = max(1, len(words) - size + 1)
    return [" " + b" ".join(words[i:i + size]).decode("latin-1") + " " for i in range(n)]


def automaton(items: list[tuple[str, list[bytes]]], size: int):
    """Automaton whose values are (number of words, item ids)."""
    import ahocorasick

    held: dict[str, tuple[int, set]] = {}
    for item, words in items:
        for w in windows(words, size):
            held.setdefault(w, (min(size, len(words)), set()))[1].add(item)
    a = ahocorasick.Automaton()
    for w, (n, ids) in held.items():
        a.add_word(w, (n, tuple(sorted(ids))))
    if held:
        a.make_automaton()
    return a if held else None


def scan(a, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
    """Merged word spans [start, end) that matches cover, and the items found."""
    if a is None or not words:
        return [], [], set()
    found = list(a.iter(" " + b" ".join(words).decode("latin-1") + " "))
    if not found:
        return [], [], set()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1)  # position of the space behind each word
    ids: set[str] = set()
    spans = []
    for at, (n, its) in found:
        last = int(np.searchsorted(ends, at))
        spans.append((last - n + 1, last + 1))
        ids.update(its)
    starts, stops = [], []
    for s, e in sorted(spans):
        if stops and s <= stops[-1]:
            stops[-1] = max(stops[-1], e)
        else:
            starts.append(s)
            stops.append(e)
    return starts, stops, ids


def offsets_of(text: str, starts: list[int], stops: list[int]) -> tuple[list[int], list[int]]:
    """Character offsets in the original text of word spans."""
    if not starts:
        return [], []
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    s, e = C.word_spans(C.ALNUM[data], np.zeros(0, np.int64))
    chars = np.cumsum((data & 0xC0) != 0x80)  # characters up to and with each byte
    return [int(chars[s[i]] - 1) for i in starts], [int(chars[e[j - 1] - 1]) for j in stops]


def _result(starts: list[int], stops: list[int], items: set[str], n: int) -> tuple:
    hit = sum(stops) - sum(starts)
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n, hit, len(items), digest, hit > 0 and 20 * hit >= n


def _scanner(payload, size: int, text: str, schema: pa.Schema):
    """Arrow function: the input columns plus the results of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(payload.value, size)
        for b in batches:
            rows = []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                words = normalise(t)
                starts, stops, ids = scan(a, words)
                left, right = offsets_of(t or "", starts, stops)
                rows.append((*_result(starts, stops, ids, len(words)), sorted(ids), starts, stops, left, right))
            new = list(zip(*rows, strict=True)) if rows else [()] * 10
            cols = [b.column(b.schema.get_field_index(f)) for f in schema.names[:-10]]
            cols += [pa.array(v, schema.field(i - 10).type) for i, v in enumerate(new)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


NEW = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, "
       "hit_starts array<int>, hit_ends array<int>, char_starts array<int>, char_ends array<int>")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` plus n_words, n_hit, n_items, items_sha256, contaminated, items,
    hit_starts/hit_ends (word spans) and char_starts/char_ends (offsets in the
    original text).  contaminated: n_hit > 0 and 20 * n_hit >= n_words."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    added = StructType.fromDDL(NEW)
    kept = [c for c in docs.columns if c not in added.names]
    if text not in kept:
        raise ValueError(f"the text column must not be named like a result: {text}")
    base = docs.select(*kept)
    out = StructType(base.schema.fields + added.fields)
    arrow = to_arrow_schema(out)
    bench = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null")
    size = bench.agg(F.sum(F.size(F.split(C.text_or_empty("t"), r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_words))
    parts = []
    for k in range(blocks):
        own = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        payload = spark.sparkContext.broadcast([(r.i, normalise(r.t)) for r in own.toLocalIterator()])
        parts.append(base.mapInArrow(_scanner(payload, window, text, arrow), out))
    if blocks == 1:
        return parts[0]
    return _united(parts, kept, text, arrow, out)


def _united(parts: list[DataFrame], kept: list[str], text: str, arrow: pa.Schema, out) -> DataFrame:
    """Hits of all blocks per row: spans are merged again and items united.
    Rows are told apart by a hash of all their columns; equal rows have equal
    results, so one of them stands for all and the count is restored."""
    hits = None
    slim = "_key", "items", "hit_starts", "hit_ends"
    for p in parts:
        own = p.where("n_hit > 0").select(F.sha2(F.to_json(F.struct(*kept)), 256).alias("_key"), *slim[1:]).distinct()
        hits = own if hits is None else hits.unionByName(own)
    hits = hits.groupBy("_key").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in slim[1:]))
    first = parts[0].select(*kept).withColumn("_key", F.sha2(F.to_json(F.struct(*kept)), 256))
    joined = first.join(hits, "_key", "left").select(*kept, *(F.col(c).alias(f"_{c}") for c in slim[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                spans = sorted(zip(r["_hit_starts"] or [], r["_hit_ends"] or [], strict=True))
                starts, stops = [], []
                for s, e in spans:
                    if stops and s <= stops[-1]:
                        stops[-1] = max(stops[-1], e)
                    else:
                        starts.append(s)
                        stops.append(e)
                ids = set(r["_items"] or [])
                left, right = offsets_of(r[text] or "", starts, stops)
                rows.append((*_result(starts, stops, ids, len(normalise(r[text]))), sorted(ids), starts, stops, left, right))
            new = list(zip(*rows, strict=True)) if rows else [()] * 10
            cols = [b.column(i) for i in range(len(kept))]
            cols += [pa.array(v, arrow.field(i - 10).type) for i, v in enumerate(new)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return joined.mapInArrow(run, out)


CONTRACT = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*CONTRACT)


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM bp),
ls AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, ls WHERE len(w) >= n),
dw AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM dp),
m AS (SELECT DISTINCT rid, p, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + n - 1)) AS x FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
