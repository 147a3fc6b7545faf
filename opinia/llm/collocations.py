"""Phrase collocations mined from an FM-index per shard over word ids.

A shard is a stretch of the texts of one task, at most ``SHARD_WORDS`` words.  Its words become ids
(per language, so that no phrase crosses languages), its pieces one sequence with a
separator between them.  The index holds the Burrows-Wheeler transform of the sequence and of
its reverse, each sorted by the first ``DEPTH`` words (a phrase is no longer), with their
last-to-first maps.  A phrase is a pair of intervals, one in each index.  Extending it
by a word on the left reads the transform's symbols in its forward interval: each
symbol's count is the extended phrase's count, the last-to-first map of its first row gives
the new forward interval, and the number of smaller symbols moves the start of the reverse one; on the
right it is the same with the two exchanged.  Words are extended to the left, pairs
to the right, triples to the left, all phrases of a length together, so that each phrase
of up to four words comes out once with its count.

Counts of shards are summed.  A first pass sums hashed words and pairs; those with
enough occurrences are marked in a bit map, and the second pass extends a phrase only by
marked pairs and sums the phrases themselves, so that few rare ones leave their task.  Both passes
cover all texts, and the bit map only ever lets too much through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinia.llm import common as C

DEPTH = 4
MIN_COUNT = 30
TOP = 2000
SHARD_WORDS = (1 << 19) - 1  # with separators below 2^21 symbols, so that three ids fit into 63 bits; 100 MB of index
BITS = 21
MAX_MAP_BITS = 1 << 28  # the map has 16 bits a key up to here
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte tables: word bytes for hashing (0: between words), lower case, ends of pieces."""
    low = np.arange(256, dtype=np.uint8)
    low[0x41:0x5B] += 32
    stop = np.zeros(256, bool)
    stop[[ord(c) for c in ".,;:!?"]] = True
    stop[0x0A:0x0E] = True
    word = low.copy()
    word[0] = 0xFF  # no UTF-8 byte
    word[stop] = 0
    word[[0x20, 0x09]] = 0
    return word, low, stop


WORD, LOWER, STOP = _tables()


# --- the index of a shard -----------------------------------------------------------------------------------------


def _order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` symbols (or a few more)."""
    n = len(seq)
    at = np.arange(n, dtype=np.int64)
    rank, reach = seq.astype(np.int64), 1
    order = None
    while order is None or reach < depth:
        behind = np.zeros(n, np.int64)
        behind[:n - reach] = rank[reach:]
        packed = rank << (2 * BITS) | behind << BITS | at
        packed.sort()
        order = packed & ((1 << BITS) - 1)
        new = np.empty(n, np.int64)
        new[0] = 0
        new[1:] = (packed[1:] >> BITS) != (packed[:-1] >> BITS)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        reach *= 2
    return order.astype(np.int32)


class _Transform:
    """Burrows-Wheeler transform of a sequence with its last-to-first map."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.order = _order(seq, depth)
        self.bwt = seq[self.order - 1]  # the first symbol follows the last one, a separator
        by = np.argsort(self.bwt, kind="stable")
        self.lf = np.empty(len(seq), np.int32)
        self.lf[by] = np.arange(len(seq), dtype=np.int32)

    def extend(self, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each interval and symbol before its rows: (interval, symbol, start of the new interval, its size,
        number of rows of the interval with smaller symbols); separators are left out."""
        iv = np.repeat(np.arange(len(lo)), size)
        row = np.repeat(lo, size) + C.ranges(size)
        packed = iv << (2 * BITS) | self.bwt[row].astype(np.int64) << BITS | row
        packed.sort()
        group = packed >> BITS
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool))
        count = np.diff(np.append(first, len(group)))
        owner, symbol = group[first] >> BITS, group[first] & ((1 << BITS) - 1)
        start = np.cumsum(size) - size
        ok = symbol > 0
        return owner[ok], symbol[ok], self.lf[packed[first] & ((1 << BITS) - 1)][ok], count[ok], (first - start[owner])[ok]


@dataclass
class Phrases:
    """Phrases of one length: start and size of their forward interval, start of the reverse one, ids of the
    first and the last word."""

    words: int
    lo: np.ndarray
    size: np.ndarray
    rev: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def take(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.words, *(x[keep] for x in (self.lo, self.size, self.rev, self.first, self.last)))


class ShardIndex:
    """Bidirectional index of pieces of words: ``keys`` of the words (64 bits), ``piece`` number of each word."""

    def __init__(self, keys: np.ndarray, piece: np.ndarray, depth: int):
        self.keys, self.ids = np.unique(keys, return_inverse=True)
        gap = np.concatenate(([True], piece[1:] != piece[:-1]))
        place = np.arange(len(keys)) + np.cumsum(gap)  # of each word in the sequence
        seq = np.zeros(int(place[-1]) + 2, np.int32)
        seq[place] = self.ids + 1
        self.word = np.full(len(seq), -1, np.int32)  # number of the word at a place
        self.word[place] = np.arange(len(keys), dtype=np.int32)
        self.forward, self.reverse = _Transform(seq, depth), _Transform(seq[::-1], depth)
        self.count = np.bincount(seq, minlength=len(self.keys) + 1)

    def unigrams(self) -> Phrases:
        start = (np.cumsum(self.count) - self.count)[1:]
        ids = np.arange(1, len(self.count))
        return Phrases(1, start, self.count[1:], start, ids, ids)

    def extend_left(self, p: Phrases) -> Phrases:
        own, c, lo, size, smaller = self.forward.extend(p.lo, p.size)
        return Phrases(p.words + 1, lo, size, p.rev[own] + smaller, c, p.last[own])

    def extend_right(self, p: Phrases) -> Phrases:
        own, c, rev, size, smaller = self.reverse.extend(p.rev, p.size)
        return Phrases(p.words + 1, p.lo[own] + smaller, size, rev, p.first[own], c)

    def key(self, p: Phrases) -> np.ndarray:
        """64-bit keys of words or pairs."""
        first = self.keys[p.first - 1]
        return first if p.words == 1 else _pair_key(first, self.keys[p.last - 1])

    def example(self, p: Phrases) -> np.ndarray:
        """Number of the first word of one occurrence of each phrase."""
        return self.word[self.forward.order[p.lo]]

    def enumerate(self, depth: int, marked=None) -> Iterator[Phrases]:
        """Phrases of 1 to ``depth`` words; with ``marked`` (of keys) only those whose words and pairs it lets through."""
        p = self.unigrams()
        if marked is not None:
            p = p.take(marked(self.key(p)))
        yield p
        for n in range(2, depth + 1):
            left = n % 2 == 0
            p = self.extend_left(p) if left else self.extend_right(p)
            if marked is not None:
                p = p.take(marked(self._new_pair(p, left)))
            yield p

    def _new_pair(self, p: Phrases, left: bool) -> np.ndarray:
        """Key of the pair that the extension made: the first two words, or the last two."""
        at = self.example(p) + (0 if left else p.words - 2)
        return _pair_key(self.keys[self.ids[at]], self.keys[self.ids[at + 1]])


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return C.mix64(a * _PAIR + b)


# --- texts to shards ----------------------------------------------------------------------------------------------


@dataclass
class Words:
    """Words of some texts: key, piece, language number, and where they stand in ``low`` (lower-cased bytes)."""

    key: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray

    def cut(self, lo: int, hi: int) -> Words:
        return Words(*(x[lo:hi] for x in (self.key, self.piece, self.lang, self.start, self.end)), self.low)


def _words(texts: pa.Array, lang_key: np.ndarray, lang: np.ndarray) -> Words:
    buf, off = C.raw(texts)
    mapped = WORD[buf]
    s, e = C.word_spans(mapped, off)
    stops = np.concatenate(([0], np.cumsum(STOP[buf], dtype=np.int32)))
    doc = np.searchsorted(off, s, side="right") - 1
    return Words(C.mix64(C.hash_spans(mapped, s, e) ^ lang_key[doc]), stops[s] + doc, lang[doc], s, e, LOWER[buf])


def _join(parts: list[Words]) -> Words:
    piece, byte, out = 0, 0, []
    for w in parts:
        out.append((w.key, w.piece + piece, w.lang, w.start + byte, w.end + byte, w.low))
        piece += int(w.piece[-1]) + 1 if len(w.piece) else 0
        byte += len(w.low)
    return Words(*(np.concatenate(x) for x in zip(*out, strict=True)))


def shards(w: Words, depth: int, limit: int = SHARD_WORDS) -> Iterator[tuple[Words, int]]:
    """(words, sign): stretches of whole pieces.  A piece of more than ``limit`` words is cut with
    ``depth`` - 1 words twice, which then come once more with sign -1: sums over all are right."""
    n, at = len(w.key), 0
    while at < n:
        to = min(at + limit, n)
        if to < n:
            back = int(np.searchsorted(w.piece, w.piece[to]))  # start of the piece that would be cut
            if back > at:
                to = back
            else:
                yield w.cut(at, to), 1
                at = to - (depth - 1)
                if depth > 1:
                    yield w.cut(at, to), -1
                continue
        yield w.cut(at, to), 1
        at = to


def _phrase_texts(w: Words, first: np.ndarray, words: int) -> pa.Array:
    """The phrases of ``words`` words from each place on, joined by one space."""
    if not len(first):
        return pa.array([], pa.string())
    at = (first[:, None] + np.arange(words)).ravel()
    width = w.end[at] - w.start[at] + 1
    stop = np.cumsum(width)
    padded = np.append(w.low, np.uint8(32))
    data = padded[C.ranges(width) + np.repeat(w.start[at], width)]
    data[stop - 1] = 32
    ends = stop[words - 1::words]
    keep = np.ones(len(data), bool)
    keep[ends - 1] = False  # the space behind the last word
    offsets = np.concatenate(([0], ends - np.arange(1, len(ends) + 1))).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep])))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array]]:
    """Words of about ``SHARD_WORDS`` words and the languages' names, from batches of (lang, text)."""
    held, count, names, number = [], 0, [], {}
    for b in batches:
        texts = C.strings(b.column(1))
        own = C.strings(b.column(0)).dictionary_encode()
        for name in own.dictionary.to_pylist():
            if name not in number:
                number[name] = len(names)
                names.append(name)
        local = np.array([number[x] for x in own.dictionary.to_pylist()], np.int64)
        off, data = np.concatenate(([0], np.cumsum([len(x.encode()) for x in own.dictionary.to_pylist()]))), own.dictionary
        hashes = C.mix64(C.hash_spans(C.raw(data)[0], off[:-1], off[1:]) + np.uint64(1))
        index = own.indices.to_numpy()
        for lo, hi in C.slices(texts):
            w = _words(texts.slice(lo, hi - lo), hashes[index[lo:hi]], local[index[lo:hi]])
            if held and count + len(w.key) > SHARD_WORDS:
                whole, held, count = _join(held), [], 0
                yield whole, names
                del whole
            held.append(w)
            count += len(w.key)
            del w
    if count:
        whole, held = _join(held), []
        yield whole, names


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: (key, n) of words and pairs per shard."""
    for words, _ in _gathered(batches):
        for w, sign in shards(words, 2):
            index = ShardIndex(w.key, w.piece, 2)
            for p in index.enumerate(2):
                yield pa.RecordBatch.from_arrays([pa.array(index.key(p).view(np.int64)), pa.array(p.size * sign)], names=["key", "n"])


def _phrase_counts(held):
    """Second pass: (lang, words, phrase, n) of the phrases that the bit map lets through; words 0: all words."""

    def marked(key: np.ndarray) -> np.ndarray:
        bits = held.value
        at = key & np.uint64(len(bits) * 64 - 1)
        return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, names in _gathered(batches):
            total = np.bincount(words.lang, minlength=len(names))
            known = pa.array(names, pa.string())
            yield pa.RecordBatch.from_arrays([known, pa.array(np.zeros(len(names), np.int32)), pa.array([""] * len(names)),
                                              pa.array(total)], names=["lang", "words", "phrase", "n"])
            for w, sign in shards(words, DEPTH):
                index = ShardIndex(w.key, w.piece, DEPTH)
                for p in index.enumerate(DEPTH, marked):
                    first = index.example(p)
                    yield pa.RecordBatch.from_arrays(
                        [known.take(pa.array(w.lang[first])), pa.array(np.full(len(first), p.words, np.int32)),
                         _phrase_texts(w, first, p.words), pa.array(p.size * sign)], names=["lang", "words", "phrase", "n"])

    return run


# --- jobs ---------------------------------------------------------------------------------------------------------


def _bit_map(keys: DataFrame) -> np.ndarray:
    """A map with the bits of the keys, 16 bits a key up to ``MAX_MAP_BITS``: what it lets through is a superset."""
    n = keys.count()
    size = min(max(1 << (16 * n).bit_length(), 1 << 16), MAX_MAP_BITS)
    at = keys.select(F.expr(f"pmod(key, {size}) div 64").alias("w"), F.expr("shiftleft(1L, cast(pmod(key, 64) as int))").alias("bit"))
    table = at.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most size / 64 rows
    bits = np.zeros(size // 64, np.uint64)
    bits[table["w"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return bits


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, words, phrase, n): the phrases of 1 to 4 words with at least ``min_count`` occurrences within pieces,
    per language (null: ``und``), and per language a row of words 0 and an empty phrase with the number of
    all words."""
    base = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), C.text_or_empty(text).alias("text"))
    keys = base.mapInArrow(_key_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    frequent = C.cut(keys.where(F.col("n") >= min_count).select("key"), "phrase-keys")
    held = docs.sparkSession.sparkContext.broadcast(_bit_map(frequent))
    found = base.mapInArrow(_phrase_counts(held), "lang string, words int, phrase string, n long")
    counts = found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return C.cut(counts.where((F.col("words") == 0) | (F.col("n") >= min_count)), "phrase-counts")


def _part(first: int | Column, count: int | Column) -> Column:
    return F.concat_ws(" ", F.slice("_w", first, count))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 4 words with ``min_count``
    occurrences.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``.  a is
    the phrase's count, l and r those of the parts of its worst cut, score floor(2000000 a / (l + r)) there (ties: the cut
    nearest to the start); a phrase goes if a longer candidate that holds it has 80 % of its occurrences or
    more, of which it is enough to see those with one word more.  Order: score and a descending, phrase by bytes.

    Null texts have no words; a null language is ``und``; repeated rows count each time; texts and pieces of any
    length are taken whole; an empty table, or one without a frequent phrase, gives no rows; other columns are not read."""
    counts = phrase_counts(docs, text, lang, min_count)
    total = counts.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))  # one row per language
    grams = counts.where("words > 0").select("lang", "words", "phrase", F.col("n").alias("a"))
    some = grams.where("words > 1").withColumn("_w", F.split("phrase", " "))
    inner = some.where("words > 2").select("lang", F.explode(F.array(
        _part(1, F.col("words") - 1), _part(2, F.col("words") - 1))).alias("phrase"), F.col("a").alias("_b"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("_b").alias("_b"))
    wide = "cast({} as decimal(20, 0))"
    own = some.join(inner, ["lang", "phrase"], "left").where(
        F.expr(f"_b is null or {wide.format('_b')} * 100 < {wide.format('a')} * 80"))
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        k.alias("k"), _part(1, k).alias("left"), _part(k + 1, F.col("words") - k).alias("right")))
    cuts = own.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    known = grams.select("lang", "phrase", "a")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    score = F.expr(f"({wide.format('a')} * 2000000) div ({wide.format('l')} + {wide.format('r')})").cast("long")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("m"), F.first("a").alias("a"))
    worst = worst.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = worst.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
tot AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
ps AS (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM ps GROUP BY lang, m, phrase HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m > 1),
sub AS (SELECT c.lang, array_to_string(c.w[i:i + k - 1], ' ') AS phrase, max(c.a) AS b
        FROM c, (SELECT unnest([2, 3]) AS k), (SELECT unnest([1, 2, 3]) AS i)
        WHERE k < c.m AND i + k - 1 <= c.m GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN sub USING (lang, phrase) WHERE b IS NULL OR 100::HUGEINT * b < 80::HUGEINT * a),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS le, array_to_string(w[k + 1:], ' ') AS ri
        FROM kept, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m),
s AS (SELECT cut.lang, cut.phrase, cut.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * cut.a) // (x.f::HUGEINT + y.f) AS score
      FROM cut JOIN g x ON x.lang = cut.lang AND x.phrase = le JOIN g y ON y.lang = cut.lang AND y.phrase = ri),
w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM w)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN tot USING (lang) WHERE rank <= 2000
"""
