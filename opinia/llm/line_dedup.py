"""Line dedup (operator 2): exact set-similarity join of lines.

A line is the set of its normalised words.  A line is removed if an earlier
line (by document id, then line number) has a Jaccard similarity of at least
``threshold`` with it.  Lines of any number of words take part; ``min_tokens`` can
leave shorter ones out.

1. Words are ordered by rarity.  Frequencies are counted over all documents in
   ``SLOTS`` hashed counters (a size bound for what is broadcast); the order is
   the same everywhere, so the join stays exact whatever words share a counter.
2. Lines with equal sets form a class, first and foremost.
3. Each class posts its rarest ``n - ceil(threshold n) + 1`` words (prefix filter);
   a word that is in one line only is left out, and so are sets that are too small to be
   like any but an equal one (up to three words at 0.8).  Classes that meet at a word are
   candidates if their sizes (length filter) and the words left behind the
   shared one (positional filter) allow the threshold, and if their parity
   signatures differ in no more bits than the sets may differ in words.
4. Candidates are verified on the whole sets.  One earlier match settles a class,
   so each class first tries its nearest few candidates per word (by signature);
   those that found none among them try more, until all have been tried.  No group emits all
   its pairs.  Very frequent prefix words are split into tiles.

Defined results: null and empty texts have no lines; rows with equal id and text
count as one text and get equal decisions; null ids come first; lines at the same
place of different texts that share an id are ordered by a hash of their words;
extra columns stay, clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinia.llm import common as C
from opinia.operators.joins import bounded

THRESHOLD = 0.8
MIN_TOKENS = 1
SLOTS = 1 << 23
TILE = 20_000  # postings of a word that one task compares at once
FIRST_TRIES = 6  # nearest candidates per word that a class tries first; those that found no match then try 1000 times as many
BLOOM_BITS = 1 << 26
FEW_DOCUMENTS = 100_000  # ids that are broadcast to pick the texts that are read again


def least_overlap(total, threshold: float):
    """Smallest intersection of two sets of ``total`` elements in sum with that Jaccard."""
    return np.ceil(threshold / (1 + threshold) * np.asarray(total) - 1e-9).astype(np.int64)


def prefix_size(n, threshold: float):
    return n - np.ceil(threshold * np.asarray(n) - 1e-9).astype(np.int64) + 1


def alone(n, threshold: float):
    """Whether a set of n elements has that Jaccard with equal sets only: one more element is too many."""
    return n < threshold * (n + 1) - 1e-9


# --- tokens of lines ---------------------------------------------------------------------------------------------


def line_words(arr: pa.Array):
    """(word hash, text number, line number) of every word of a slice of texts."""
    buf, off = C.raw(arr)
    mapped = C.ALNUM[buf]
    s, e = C.word_spans(mapped, off)
    first = np.searchsorted(s, off)  # the first word of each text
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    breaks = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(buf == 10, dtype=np.int32, out=breaks[1:])
    return C.hash_spans(mapped, s, e), doc, breaks[s] - np.repeat(breaks[off[:-1]], np.diff(first))


def _sorted(h: np.ndarray, group: np.ndarray, rank: np.ndarray | None) -> np.ndarray:
    """Order by group, rank, hash: by one packed key, unless it ties different hashes."""
    if group[-1] < 1 << 20:
        low = h >> np.uint64(20) if rank is None else rank.astype(np.uint64) << np.uint64(28) | h >> np.uint64(36)
        key = group.astype(np.uint64) << np.uint64(44) | low
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        if not (same & (h[order][1:] != h[order][:-1])).any():
            return order
    return np.lexsort((h, group) if rank is None else (h, rank, group))


def line_sets(arr: pa.Array, rank: np.ndarray | None = None):
    """Distinct words of each line, by rank, then hash: (words, start of each line's
    words, their number, text number, line number)."""
    h, doc, line = line_words(arr)
    if not len(h):
        none = np.zeros(0, np.int64)
        return h, none, none, none, none
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
    group = np.cumsum(new) - 1
    order = _sorted(h, group, None if rank is None else rank[(h & np.uint64(len(rank) - 1)).astype(np.int64)])
    h, group = h[order], group[order]
    own = np.ones(len(h), bool)
    own[1:] = (h[1:] != h[:-1]) | (group[1:] != group[:-1])
    h, group = h[own], group[own]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    first = np.flatnonzero(new)
    return h, start, np.diff(np.append(start, len(h))), doc[first], line[first]


def set_hash(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set of words: sums of two hashes of the words."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.add.reduceat(C.mix64(h), start)
    b = np.add.reduceat(C.mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start)
    return a.view(np.int64), b.view(np.int64)


def word_ranks(docs: DataFrame, text: str) -> np.ndarray:
    """Rarity of each counter: 0 unused, 1 a single word place, then by frequency."""
    slots = SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint32)  # of one task's words, fewer than 2^32
        for b in batches:
            arr = C.strings(b.column(0))
            for lo, hi in C.slices(arr):
                h, _ = C.word_hashes(arr.slice(lo, hi - lo), C.ALNUM)
                np.add.at(total, (h & np.uint64(slots - 1)).astype(np.int64), np.uint32(1))
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 200_000):
            own = at[lo:lo + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own].astype(np.int64))], names=["slot", "n"])

    counted = docs.select(F.col(text)).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    code = F.when(F.col("n") <= 1, 1).otherwise(1 + F.round(F.log2("n") * 1000)).cast("int")  # as rarity_code
    table = counted.select("slot", code.alias("code")).toArrow()  # at most SLOTS rows
    rank = np.zeros(slots, np.uint16)
    rank[table["slot"].to_numpy()] = table["code"].to_numpy()
    return rank


def order_key(docs: DataFrame, doc_id: str) -> Column:
    kind = dict(docs.dtypes)[doc_id]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    key = F.col(doc_id).cast("long") if whole else F.xxhash64(doc_id)  # ids that are no integers: in the order of their hash
    return F.when(F.col(doc_id).isNull(), F.lit(-(1 << 63))).otherwise(key)


LINE_SCHEMA = "o1 long, o2 long, line int, a long, b long, n int, s long, t long, warm boolean, prefix array<int>, pos array<int>"
LINE_NAMES = [c.split()[0] for c in LINE_SCHEMA.split(", ")]
WINDOW_LINES = 100_000  # lines of a task that are looked through for equal sets at once


def rarity_code(n: float) -> float:
    return 1 + round(1000 * float(np.log2(n))) if n > 1 else 1


def line_table(keyed: DataFrame, rank, threshold: float, min_tokens: int) -> DataFrame:
    """One row per line of at least ``min_tokens`` words: place, set hash, size, parity
    signature (bit i: whether an odd number of words fall on i), and, in the first
    line of each set in its task, the words of its prefix that other lines may hold
    (32-bit hashes) with their positions; warm: one of these words is frequent."""
    hot, window = rarity_code(TILE), WINDOW_LINES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = rank.value
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            o1, o2, line, a, b, n, s, t, warm, count, word, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((o2, line, o1, b, a))
            new = np.ones(len(a), bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            first = np.zeros(len(a), bool)
            first[order[new]] = True
            use = np.repeat(first, count)
            off = np.concatenate([[0], np.cumsum(np.where(first, count, 0))])
            word, pos = word[use], pos[use]
            for lo in range(0, len(a), 20_000):
                hi = min(lo + 20_000, len(a))
                own = slice(off[lo], off[hi])
                cols = [pa.array(x[lo:hi]) for x in (o1, o2, line, a, b, n, s, t, warm)]
                cols += [C.list_array(x[own], off[lo:hi + 1] - off[lo], pa.int32()) for x in (word, pos)]
                yield pa.RecordBatch.from_arrays(cols, names=LINE_NAMES)

        for batch in batches:
            o1, o2, arr = batch.column(0).to_numpy(), batch.column(1).to_numpy(), C.strings(batch.column(2))
            for lo, hi in C.slices(arr):
                h, start, n, doc, line = line_sets(arr.slice(lo, hi - lo), ranks)
                a, b = set_hash(h, start)
                long = np.flatnonzero(n >= min_tokens)
                size = np.where(alone(n[long], threshold), 0, prefix_size(n[long], threshold))
                pos = C.ranges(size)
                word = h[np.repeat(start[long], size) + pos]
                code = ranks[(word & np.uint64(len(ranks) - 1)).astype(np.int64)]
                shared = code > 1
                ends = np.concatenate([[0], np.cumsum(size)])
                count = np.diff(np.concatenate([[0], np.cumsum(shared)])[ends])
                warm = np.diff(np.concatenate([[0], np.cumsum(code > hot)])[ends]) > 0
                bit, low = np.uint64(1) << (h >> np.uint64(58)), h & np.uint64(1 << 57) > 0
                sign = [np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), start) if len(start) else h for half in (low, ~low)]
                at = doc[long] + lo
                held.append([o1[at], o2[at], line[long].astype(np.int32), a[long], b[long], n[long].astype(np.int32),
                             *(np.where(size > 0, x[long].view(np.int64), 0) for x in sign), warm, count, (word[shared] >> np.uint64(24)).astype(np.uint32).view(np.int32),
                             pos[shared].astype(np.int32)])
                if sum(len(x[0]) for x in held) > window:
                    yield from flush()
        if held:
            yield from flush()

    return keyed.mapInArrow(run, LINE_SCHEMA)


# --- candidates ----------------------------------------------------------------------------------------------------


def grouped(batches: Iterator[pa.RecordBatch], *keys: str, rows: int = 200_000, shift: int = 0) -> Iterator[dict[str, np.ndarray]]:
    """Batches sorted by ``keys`` (of one key, its bits from ``shift`` on) as columns of whole groups."""
    held: list[pa.RecordBatch] = []
    n = 0

    def columns(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(parts)
        return {c: t[c].to_numpy() for c in t.column_names}

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        cols = columns(held)
        at = starts_of({k: cols[k] >> shift if shift else cols[k] for k in keys}, *keys)
        if len(at) == 1:
            continue  # one group so far
        cut = int(at[-1])
        yield {c: v[:cut] for c, v in cols.items()}
        held = pa.Table.from_batches(held).slice(cut).combine_chunks().to_batches()
        n -= cut
    if held:
        yield columns(held)


def starts_of(cols: dict[str, np.ndarray], *keys: str) -> np.ndarray:
    n = len(cols[keys[0]])
    change = np.zeros(n, bool)
    change[:1] = True
    for k in keys:
        change[1:] |= cols[k][1:] != cols[k][:-1]
    return np.flatnonzero(change)


def distance(x: dict, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the postings i, j of one word pass the positional and signature filters, and
    the share of the allowed difference that their signatures show: two sets that differ
    in d words differ in at most d bits of their parities."""
    total = x["n"][i] + x["n"][j]
    need = least_overlap(total, threshold)
    at = np.flatnonzero(np.minimum(x["left"][i], x["left"][j]) >= need)
    i, j, may = i[at], j[at], (total - 2 * need)[at]
    bits = np.bitwise_count(x["s"][i] ^ x["s"][j]).astype(np.int64) + np.bitwise_count(x["t"][i] ^ x["t"][j])
    ok = bits <= may
    return at[ok], bits[ok]


def nearest(i: np.ndarray, j: np.ndarray, bits: np.ndarray, tries: int) -> tuple[np.ndarray, ...]:
    """The ``tries`` nearest j of each i, and the i that have more."""
    order = np.lexsort((j, bits, i))
    i, j, bits = i[order], j[order], bits[order]
    new = np.ones(len(i), bool)
    new[1:] = i[1:] != i[:-1]
    turn = C.ranges(np.diff(np.append(np.flatnonzero(new), len(i))))
    own = turn < tries
    return i[own], j[own], bits[own], i[turn == tries]


def pairs_of(x: dict, start: np.ndarray, size: np.ndarray, tries: int, threshold: float):
    """For each open posting the ``tries`` nearest possible ones of earlier lines in its
    group, and the postings that have more.  Postings are in the order of their sizes
    within each group, so those far apart are too different in size (length filter)."""
    place = C.ranges(size)
    rest = np.flatnonzero(place > 0)
    xs, ys, ds, more, held = [], [], [], [], 0
    d = 0
    while len(rest):
        d += 1
        rest = rest[place[rest] >= d]
        rest = rest[x["n"][rest - d] >= threshold * x["n"][rest] - 1e-9]
        at, bits = distance(x, rest, rest - d, threshold)
        i = rest[at]
        later = x["rank"][i] > x["rank"][i - d]
        u, v = np.where(later, i, i - d), np.where(later, i - d, i)
        own = x["open"][u]
        xs.append(u[own])
        ys.append(v[own])
        ds.append(bits[own])
        held += int(own.sum())
        if held > 2_000_000:
            u, v, w, left = nearest(np.concatenate(xs), np.concatenate(ys), np.concatenate(ds), tries)
            xs, ys, ds, held = [u], [v], [w], len(u)
            more.append(left)
    if not xs:
        none = np.zeros(0, np.int64)
        return none, none, none
    u, v, _, left = nearest(np.concatenate(xs), np.concatenate(ys), np.concatenate(ds), tries)
    return u, v, np.unique(np.concatenate([*more, left]))


def postings_of(lines: DataFrame) -> DataFrame:
    """(token, pos, a, o1, ln, s, t, warm) of all lines that post; ln packs line and size."""
    p = lines.where(F.size("prefix") > 0).select("a", "o1", "s", "t", "warm", "line", "n", F.explode(F.arrays_zip("prefix", "pos")).alias("p"))
    ln = F.shiftleft(F.col("line").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    return p.select(F.col("p.prefix").alias("token"), F.col("p.pos").alias("pos"), "a", "o1", ln.alias("ln"), "s", "t", "warm")


def candidates(postings: DataFrame, tries: int, threshold: float) -> DataFrame:
    """(xa, xo, ya, yo): the nearest candidates of each open set x at each of its words,
    with a document that holds each; y is null where x has more of them.  Very frequent
    words are split into blocks of TILE postings, and each two blocks meet in one tile."""
    spark = postings.sparkSession
    cold, warm = postings.where("NOT warm"), postings.where("warm")
    hot = warm.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > TILE)
    hot = hot.select("token", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    warm = warm.join(hot, "token", "left")
    block = F.pmod(F.xxhash64("a"), F.col("tiles"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.hash("token", F.least(block, k), F.greatest(block, k)))
    warm = warm.withColumn("token", F.explode(F.when(F.col("tiles").isNull(), F.array("token")).otherwise(tiles)))
    both = cold.unionByName(warm.select(cold.columns))
    key = F.shiftleft(F.col("token").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    extra = ["open"] if "open" in both.columns else []
    p = both.select(key.alias("k"), "a", "o1", "ln", "s", "t", *extra)
    p = p.repartition(C.partitions(spark), F.shiftright("k", 32)).sortWithinPartitions("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in grouped(batches, "k", shift=32):
            token, pos, line = c["k"] >> 32, c["k"] & 0xFFFFFFFF, c["ln"] >> 32
            order = np.lexsort((pos, line, c["o1"], c["a"], token))  # one posting of each set
            t, a = token[order], c["a"][order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (a[1:] != a[:-1])
            order = order[new]
            n = (c["ln"] & 0xFFFFFFFF)
            rank = np.empty(len(order), np.int64)
            rank[np.lexsort((c["a"][order], line[order], c["o1"][order]))] = np.arange(len(order))  # earlier lines are lower
            by_size = np.lexsort((n[order], token[order]))
            order, rank = order[by_size], rank[by_size]
            token, n = token[order], n[order]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            x = {"n": n, "rank": rank, "left": n - pos[order], "s": c["s"][order].view(np.uint64), "t": c["t"][order].view(np.uint64)}
            x["open"] = c["open"][order] if "open" in c else np.ones(len(order), bool)
            i, j, more = pairs_of(x, start, np.diff(np.append(start, len(token))), tries, threshold)
            a, o1 = c["a"][order], c["o1"][order]
            seen = np.lexsort((a[j], a[i]))  # a pair that several words of this batch give counts once
            i, j = i[seen], j[seen]
            if len(i):
                new = np.ones(len(i), bool)
                new[1:] = (a[i][1:] != a[i][:-1]) | (a[j][1:] != a[j][:-1])
                i, j = i[new], j[new]
            gap = np.concatenate([np.zeros(len(i), bool), np.ones(len(more), bool)])
            i, j = np.concatenate([i, more]), np.concatenate([j, more])
            cols = [pa.array(a[i]), pa.array(o1[i]), pa.array(a[j], mask=gap), pa.array(o1[j], mask=gap)]
            yield pa.RecordBatch.from_arrays(cols, names=["xa", "xo", "ya", "yo"])

    return p.mapInArrow(run, "xa long, xo long, ya long, yo long").distinct()


# --- verification ---------------------------------------------------------------------------------------------------


def whole_sets(keyed: DataFrame, places: DataFrame, min_tokens: int) -> DataFrame:
    """(a, b, words) of the wanted sets ``places`` (o: a document that holds it, a), read from
    the texts again; a bit map of BLOOM_BITS bits says which texts to look at, another one
    which lines to hand on."""
    maps = [_bit_map(places, "xxhash64(o)"), _bit_map(places, "a")]
    held = keyed.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, sets = held.value
        for b in batches:
            b = b.take(pa.array(np.flatnonzero(_marked(texts, b.column(2).to_numpy()))))
            o1, arr = b.column(0).to_numpy(), C.strings(b.column(1))
            for lo, hi in C.slices(arr):
                h, start, n, doc, line = line_sets(arr.slice(lo, hi - lo))
                a, bb = set_hash(h, start)
                own = np.flatnonzero((n >= min_tokens) & _marked(sets, a & (BLOOM_BITS - 1)))
                off = np.concatenate([[0], np.cumsum(n[own])])
                words = h[np.repeat(start[own], n[own]) + C.ranges(n[own])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(o1[doc[own] + lo]), pa.array(a[own]), pa.array(bb[own]), C.list_array(words.view(np.int64), off, pa.int64())],
                    names=["o", "a", "b", "words"])

    slotted = keyed.select("o1", "_text", F.pmod(F.xxhash64("o1"), F.lit(BLOOM_BITS)).alias("_slot"))
    documents = places.select(F.col("o").alias("o1")).distinct()
    if documents.limit(FEW_DOCUMENTS + 1).count() <= FEW_DOCUMENTS:  # then only their texts go to Python
        slotted = slotted.join(F.broadcast(documents), "o1", "left_semi").select(*slotted.columns)
    found = slotted.mapInArrow(run, "o long, a long, b long, words array<long>").join(places, ["o", "a"], "left_semi")
    return found.groupBy("a", "b").agg(F.first("words").alias("words"))


def _bit_map(rows: DataFrame, value: str) -> np.ndarray:
    """BLOOM_BITS bits with those set that the values (modulo BLOOM_BITS) name."""
    slot = f"pmod({value}, {BLOOM_BITS})"
    words = rows.select(F.expr(f"cast({slot} div 64 as int)").alias("w"), F.expr(f"shiftleft(1L, cast({slot} % 64 as int))").alias("bit"))
    table = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most BLOOM_BITS / 64 rows
    bits = np.zeros(BLOOM_BITS // 64, np.uint64)
    bits[table["w"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return bits


def _marked(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)) > 0


def later_classes(keyed: DataFrame, lines: DataFrame, threshold: float, min_tokens: int) -> DataFrame:
    """(a, b) of the sets that have an earlier similar set."""
    done, open_sets, tries = None, None, FIRST_TRIES
    postings = postings_of(lines)
    while True:
        p = postings
        if open_sets is not None:  # only words that an open set posts
            tokens = C.cut(postings.join(bounded(open_sets), "a", "left_semi").select("token").distinct(), "line-open-words")
            p = postings.join(bounded(tokens), "token", "left_semi")
            p = p.join(bounded(open_sets.withColumn("open", F.lit(True))), "a", "left").fillna({"open": False})
        pairs = C.cut(candidates(p, tries, threshold), "line-candidates")
        real = pairs.where("ya IS NOT NULL")
        places = real.selectExpr("xo o", "xa a").union(real.selectExpr("yo", "ya")).distinct()
        sets = C.cut(whole_sets(keyed, places, min_tokens), "line-sets")
        x = sets.selectExpr("a xa", "b xb", "words wx")
        y = sets.selectExpr("a ya", "b yb", "words wy")
        both = F.size(F.array_intersect("wx", "wy"))
        similar = real.select("xa", "ya").distinct().join(x, "xa").join(y, "ya").where(
            both >= threshold * (F.size("wx") + F.size("wy") - both) - 1e-9)
        found = C.cut(similar.selectExpr("xa a", "xb b").distinct(), "line-matches")
        done = found if done is None else done.union(found)
        left = pairs.where("ya IS NULL").selectExpr("xa a").distinct().join(found, "a", "left_anti")
        open_sets = C.cut(left, "line-open")
        if open_sets.isEmpty():
            return done.distinct()
        tries *= 1000


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
              min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(o1, o2, removed): numbers of the removed lines of each text that loses any;
    o1 is the id's order key, o2 the text's hash."""
    if not 0 < threshold <= 1 or min_tokens < 1:
        raise ValueError("threshold must be in (0, 1] and min_tokens at least 1")
    keyed = docs.select(order_key(docs, doc_id).alias("o1"), F.xxhash64(text).alias("o2"), F.col(text).alias("_text"))
    rank = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text))
    lines = C.cut(line_table(keyed, rank, threshold, min_tokens), "lines")
    later = later_classes(keyed, lines, threshold, min_tokens).withColumn("later", F.lit(True))
    here = F.struct("o1", "line", "o2")
    classes = lines.groupBy("a", "b").agg(F.min(here).alias("first"), F.count("*").alias("m"))
    flagged = classes.join(later, ["a", "b"], "left").where("m > 1 OR later")
    gone = lines.select("o1", "o2", "line", "a", "b").join(flagged, ["a", "b"]).where(F.col("later").isNotNull() | ~here.eqNullSafe(F.col("first")))
    return gone.groupBy("o1", "o2").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def _with_decisions(docs: DataFrame, narrow: DataFrame, doc_id: str, text: str, **options) -> tuple[DataFrame, DataFrame]:
    gone = decisions(docs, doc_id, text, **options).withColumnsRenamed({"o1": "_g1", "o2": "_g2", "removed": "_gone"})
    own = narrow.withColumns({"_o1": order_key(docs, doc_id), "_o2": F.xxhash64(text)})
    return own, gone


def _join(own: DataFrame, gone: DataFrame) -> DataFrame:
    joined = own.join(gone, (F.col("_o1") == F.col("_g1")) & (F.col("_o2") == F.col("_g2")), "left")
    return joined.withColumn("_removed", F.coalesce("_gone", F.array().cast("array<int>"))).drop("_gone", "_o1", "_o2", "_g1", "_g2")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``, plus n_lines, n_removed.
    Null texts stay null."""
    docs = docs.drop("n_lines", "n_removed")
    own, gone = _with_decisions(docs, docs, doc_id, text, **options)
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("_removed", i))
    n = F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(F.size(lines))
    new = F.when(F.size("_removed") == 0, F.col(text)).otherwise(F.array_join(kept, "\n"))
    return _join(own, gone).withColumns({"n_lines": n, "n_removed": F.size("_removed"), text: new}).drop("_removed")


def summary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, removed_lines."""
    n = F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(F.size(F.split(text, "\n")))
    own, gone = _with_decisions(docs, docs.select(doc_id, text).withColumn("n_lines", n.cast("long")), doc_id, text, **options)
    out = _join(own.drop(text), gone)
    return out.select(F.col(doc_id).alias("doc_id"), "n_lines", F.size("_removed").cast("long").alias("n_removed"),
                      F.array_join(F.transform("_removed", lambda x: x.cast("string")), ",").alias("removed_lines"))


def query(spark, sf_dir: str) -> DataFrame:
    return summary(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
