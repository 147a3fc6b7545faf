"""N-gram Jaccard join (operator 10): chosen-path join of documents' word shingles.

A document is the set of its ``SHINGLE``-word shingles (a shorter text is one
shingle).  Equal sets form a class.  In each of several independent runs every
set starts in one bucket and is split, recursively, on sampled shingles: at a
bucket, a set of n shingles goes on with each shingle whose hash, seeded by the
bucket, is below KAPPA / (threshold n), so two sets at the threshold share
KAPPA chosen shingles or more on average.  Buckets of at most ``LIMIT`` sets,
and larger ones whose sets are alike on average (splitting would not part
them), are compared by brute force; larger ones are split in tiles for that.
The number of runs follows from the target recall: a pair at the threshold is
missed by a run with the extinction probability of the branching process.

Inside a bucket, pairs whose 64-byte sketches (one-permutation minhash) agree in
less than half of the bins are passed over; the rest is verified on the whole
sets.  A pair that meets in several buckets is counted in the first one only
(each set carries its buckets), so no group emits its pairs: tasks return link
counts and a spanning forest, and groups are the connected components.

Defined results: null texts and texts without a word have no shingles, no links and
a group each; rows with equal id and text count as copies; ids that are null come
first; extra columns stay, clashing ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinia.llm import common as C
from opinia.llm.line_dedup import BLOOM_BITS, _bit_map, _marked, grouped, order_key, starts_of

SHINGLE, THRESHOLD = 5, 0.8
RECALL = 0.999  # of pairs at the threshold; more similar pairs are found more surely
KAPPA = 2.0
MAX_DEPTH = 4
LIMIT = 64
ALIKE = 0.6  # mean agreement of sketches from which a bucket is not split
TILE = 1024
BINS, SKETCHED = 64, 128  # sketch bins; sets of fewer shingles are verified without it
MAP_BITS = 1 << 26
_COEF = C.mix64(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)


def runs_for(recall: float, kappa: float = KAPPA, depth: int = MAX_DEPTH) -> int:
    miss = 0.0
    for _ in range(depth):
        miss = math.exp(-kappa * (1 - miss))
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def shingles(arr: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, ascending; offsets of the texts)."""
    h, off = C.word_hashes(arr, C.ALNUM)
    n_docs = len(off) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(off))
    left = off[1:][doc] - np.arange(len(h))  # words from here to the end of the text
    total = np.zeros(len(h), np.uint64)
    for j in range(size):
        part = np.zeros(len(h), np.uint64)
        part[:len(h) - j] = h[j:] * _COEF[j]
        total += np.where(left > j, part, np.uint64(0))
    keep = (left >= size) | (np.arange(len(h)) == off[:-1][doc])
    s, doc = C.mix64(total[keep]), doc[keep]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.searchsorted(doc[new], np.arange(n_docs + 1))


def set_hash(s: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set; 0, 0 for an empty one."""
    out = []
    for seed in (0x1234567890ABCDEF, 0x0FEDCBA987654321):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(C.mix64(s ^ np.uint64(seed)), dtype=np.uint64)])
        out.append((sums[off[1:]] - sums[off[:-1]]).view(np.int64))
    return out[0], out[1]


def sketches(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of BINS bytes: of each bin of the hash space the smallest shingle's, 0 if there is none."""
    n_docs = len(off) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(off))
    cell = doc * BINS + (s >> np.uint64(64 - 6)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(s) else np.zeros(0, np.int64)
    out = np.zeros(n_docs * BINS, np.uint8)
    out[cell[first]] = (C.mix64(s[first]) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out.reshape(n_docs, BINS)


def limit_of(n: np.ndarray, threshold: float) -> np.ndarray:
    """Hashes below this are chosen by a set of n shingles."""
    share = np.minimum(1.0, KAPPA / (threshold * np.maximum(n, 1)))
    return np.minimum(share * 2.0 ** 64, 2.0 ** 64 - 2048).astype(np.uint64)


DOC_SCHEMA = "o1 long, o2 long, a long, b long, n int, sketch binary, paths array<long>"


def doc_table(keyed: DataFrame, runs: int, threshold: float) -> DataFrame:
    """One row per document: place, set hash, size, sketch and the first level of paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = C.mix64(np.arange(1000, 1000 + runs, dtype=np.uint64))
        for b in batches:
            arr = C.strings(b.column(2))
            for lo, hi in C.slices(arr):
                s, off = shingles(arr.slice(lo, hi - lo))
                n = np.diff(off)
                a, bb = set_hash(s, off)
                doc = np.repeat(np.arange(len(n)), n)
                limit = limit_of(n, threshold)[doc]
                who, path = [], []
                for seed in seeds:
                    h = C.mix64(s ^ seed)
                    own = h < limit
                    who.append(doc[own])
                    path.append(h[own])
                who, path = np.concatenate(who), np.concatenate(path)
                order = np.argsort(who, kind="stable")
                sketch = sketches(s, off)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(a), pa.array(bb), pa.array(n, pa.int32()),
                    pa.array([r.tobytes() for r in sketch], pa.binary()),
                    C.list_array(path[order].view(np.int64), np.searchsorted(who[order], np.arange(len(n) + 1)), pa.int64())],
                    names=["o1", "o2", "a", "b", "n", "sketch", "paths"])

    return keyed.mapInArrow(run, DOC_SCHEMA)


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)


def first_members(classes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, a, b, n, sketch) for the first paths of the classes, without most paths of one set only (a bit map of
    ``sizes``, the paths of several, says which), so that few rows carry a sketch."""
    held = classes.sparkSession.sparkContext.broadcast(_bit_map(sizes, "path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(0)
            size = paths.value_lengths().to_numpy()
            path = paths.flatten().to_numpy()
            own = np.flatnonzero(_marked(held.value, _slots(path)))
            who = pa.array(np.repeat(np.arange(len(size)), size)[own])
            yield pa.RecordBatch.from_arrays([pa.array(path[own]), *(b.column(i).take(who) for i in range(1, 5))], names=["path", "a", "b", "n", "sketch"])

    return classes.select("paths", "a", "b", "n", "sketch").mapInArrow(run, "path long, a long, b long, n int, sketch binary")


def _of_members(sets: DataFrame, members: DataFrame) -> DataFrame:
    """The sets of ``members`` (and a few more), by a bit map: a level's join takes no other set along."""
    held = sets.sparkSession.sparkContext.broadcast(_bit_map(members, "a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_marked(held.value, _slots(b.column(0).to_numpy()))))

    return sets.select("a", "b", "s").mapInArrow(run, "a long, b long, s array<long>")


def alike_paths(big: DataFrame) -> DataFrame:
    """Buckets whose sketches agree in ALIKE of the cases on average, over four bins: of m
    values, k_1, k_2, ... equal ones agree in the sum of k^2 / m^2 of the pairs."""
    counts = [big.groupBy("path", F.substring("sketch", i + 1, 1).alias("v")).agg(F.count("*").alias("k"), F.first("m").alias("m"))
              for i in range(0, BINS, BINS // 4)]
    same = counts[0].union(counts[1]).union(counts[2]).union(counts[3])
    mean = same.groupBy("path").agg((F.sum(F.col("k") * F.col("k")) / (4.0 * F.first("m") * F.first("m"))).alias("mean"))
    return mean.where(F.col("mean") >= ALIKE).select("path")


def partners(small: DataFrame, threshold: float) -> DataFrame:
    """Of each small bucket the sets that have a possible partner in it, under one number
    for all buckets that hold the same sets: (sig, a, b)."""
    p = small.select("path", "a", "b", "n", "sketch").repartition(C.partitions(small.sparkSession), "path").sortWithinPartitions("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in grouped(batches, "path", rows=50_000):
            start = starts_of(c, "path")
            size = np.diff(np.append(start, len(c["path"])))
            sketch = np.frombuffer(b"".join(c["sketch"]), np.uint8).reshape(-1, BINS)
            n = c["n"].astype(np.int64)
            keep = np.zeros(len(n), bool)
            for shift in range(1, int(size.max(initial=1))):
                at = np.repeat(start, np.maximum(size - shift, 0)) + C.ranges(np.maximum(size - shift, 0))
                to = at + shift
                near = np.minimum(n[at], n[to]) >= threshold * np.maximum(n[at], n[to]) - 1e-9
                at, to = at[near], to[near]
                same = ((sketch[at] == sketch[to]) & (sketch[at] > 0)).sum(axis=1)
                used = ((sketch[at] > 0) | (sketch[to] > 0)).sum(axis=1)
                ok = (2 * same >= used) | (np.minimum(n[at], n[to]) < SKETCHED)
                keep[at[ok]] = keep[to[ok]] = True
            mixed = np.where(keep, C.mix64(c["a"].view(np.uint64)), np.uint64(0))
            sig = np.repeat(np.add.reduceat(mixed, start), size)
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), pa.array(c["a"][keep]), pa.array(c["b"][keep])],
                                             names=["sig", "a", "b"])

    return p.mapInArrow(run, "sig long, a long, b long").distinct()


def set_rows(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, b, s): the shingles of the wanted classes (and of a few more), a row for each, read from the texts
    again; a bit map of MAP_BITS bits keeps the others from leaving their tasks."""
    bits = np.zeros(MAP_BITS // 64, np.uint64)
    words = wanted.select(F.expr(f"pmod(a, {MAP_BITS}) div 64").alias("w"), F.expr("shiftleft(1L, cast(pmod(a, 64) as int))").alias("bit"))
    table = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most MAP_BITS / 64 rows
    bits[table["w"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    held = keyed.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arr = C.strings(b.column(2))
            for lo, hi in C.slices(arr):
                s, off = shingles(arr.slice(lo, hi - lo))
                a, bb = set_hash(s, off)
                at = a.view(np.uint64) & np.uint64(MAP_BITS - 1)
                hit = held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
                own = np.flatnonzero((hit > 0) & (np.diff(off) > 0))
                _, first = np.unique(a[own], return_index=True)
                own = own[first]
                n = np.diff(off)[own]
                values = s[np.repeat(off[own], n) + C.ranges(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(a[own]), pa.array(bb[own]),
                    C.list_array(values.view(np.int64), np.concatenate([[0], np.cumsum(n)]), pa.int64())], names=["a", "b", "s"])

    return keyed.mapInArrow(run, "a long, b long, s array<long>").groupBy("a", "b").agg(F.first("s").alias("s"))


def with_sets(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets in ``members`` (path, a, b, n, sketch) with their paths and shingles."""
    per_set = members.groupBy("a", "b").agg(F.collect_set("path").alias("at"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    return per_set.join(sets, ["a", "b"]).select("a", "b", "n", "sketch", "at", "s")


def split(full: DataFrame, threshold: float) -> DataFrame:
    """The next level of paths of the sets of ``with_sets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, path = [], []
            for i, (at, s) in enumerate(zip(b.column(4), b.column(5), strict=True)):
                s, at = s.values.to_numpy().view(np.uint64), at.values.to_numpy().view(np.uint64)
                limit = limit_of(np.array([len(s)]), threshold)[0]
                for p in at:
                    h = C.mix64(s ^ C.mix64(p[None])[0])
                    own = h[h < limit]
                    who += [i] * len(own)
                    path.append(own)
            at = pa.array(who, pa.int64())
            paths = np.concatenate(path) if path else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), *(b.column(i).take(at) for i in range(4))],
                                             names=["path", "a", "b", "n", "sketch"])

    return full.mapInArrow(run, "path long, a long, b long, n int, sketch binary")


def _overlaps(s: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets."""
    token, owner = np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])
    _, col, times = np.unique(token, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    col, owner = np.unique(col[shared], return_inverse=True)[1], owner[shared]
    out = np.zeros((len(s), len(s)), np.float32)
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    width = int(col[-1]) + 1 if len(col) else 0
    for lo in range(0, width, 4096):
        i, j = np.searchsorted(col, [lo, lo + 4096])
        x = np.zeros((len(s), min(4096, width - lo)), np.float32)
        x[owner[i:j], col[i:j] - lo] = 1
        out += x @ x.T
    return out


def verify(leaves: DataFrame, keyed: DataFrame, threshold: float) -> DataFrame:
    """leaves: (sig, a, b, tiles).  (a, b, links, ra, rb): links counted in this bucket, and
    the first set of its group there.  The shingles go by set to its buckets' numbers, then by bucket."""
    per_set = leaves.groupBy("a", "b").agg(F.collect_set(F.struct("sig", "tiles")).alias("at"))
    full = per_set.join(set_rows(keyed, leaves.select("a", "b").distinct()), ["a", "b"]).withColumn("sigs", F.array_sort(F.col("at.sig")))
    rows = full.select("a", "b", "sigs", "s", F.explode("at").alias("at"))
    block = F.pmod(F.xxhash64("a", "b"), F.col("at.tiles")).cast("int")
    rows = rows.select("a", "b", "sigs", "s", F.col("at.sig").alias("sig"), F.col("at.tiles").alias("tiles"), block.alias("block"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tile = F.least("block", "k") * F.col("tiles") + F.greatest("block", "k")
    rows = rows.select("sig", tile.cast("long").alias("tile"), "tiles", "block", "a", "b", "sigs", "s")
    rows = rows.repartition(C.partitions(leaves.sparkSession), "sig", "tile").sortWithinPartitions("sig", "tile", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for c in grouped(batches, "sig", "tile", rows=4_000):
            start = starts_of(c, "sig", "tile")
            for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(c["sig"])], strict=True):
                if hi - lo < 2:
                    continue
                s = list(c["s"][lo:hi])
                n = np.array([len(x) for x in s])
                both = _overlaps(s)
                alike = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-6
                block = c["block"][lo:hi]
                if c["tile"][lo] // c["tiles"][lo] != c["tile"][lo] % c["tiles"][lo]:  # two different blocks
                    alike &= block[:, None] != block[None, :]
                np.fill_diagonal(alike, False)
                member = np.flatnonzero(alike.any(axis=1))
                if not len(member):
                    continue
                alike = alike[np.ix_(member, member)]
                own = [x[x < c["sig"][lo]] for x in c["sigs"][lo:hi][member]]  # buckets that come before this one
                earlier = _overlaps(own) > 0 if any(map(len, own)) else np.zeros_like(alike)
                links = (alike & ~earlier).sum(axis=1)
                label = np.arange(len(member))
                while True:
                    least = np.minimum(label, np.where(alike, label[None, :], len(member)).min(axis=1))
                    least = least[least]
                    if (least == label).all():
                        break
                    label = least
                a, b = c["a"][lo:hi][member], c["b"][lo:hi][member]
                out += zip(a.tolist(), b.tolist(), links.tolist(), a[label].tolist(), b[label].tolist(), strict=True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names=["a", "b", "links", "ra", "rb"])
                out = []

    return rows.mapInArrow(run, "a long, b long, links long, ra long, rb long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of the nodes of ``edges`` (u, v), by large-star and small-star steps; each
    step is a group minimum and a join, and is written."""
    low, high = F.least("u", "v"), F.greatest("u", "v")
    edges = C.cut(edges.where("u != v").select(high.alias("u"), low.alias("v")).distinct(), "group-edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("p"), F.least("v", "m").alias("q"))
        new = small.union(least).toDF("u", "v").where("u != v").distinct()
        new = C.cut(new, "group-edges")
        if new.select(F.col("v")).join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and not _forks(new):
            return new.withColumnRenamed("v", "root")
        edges = new


def _forks(edges: DataFrame) -> bool:
    """Whether a node hangs on two others."""
    return not edges.groupBy("u").count().where("count > 1").isEmpty()


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL):
    """(documents, classes): documents have o1, o2, a, b, n; classes have a, b, first,
    copies, links and the group's root."""
    keyed = docs.select(order_key(docs, doc_id).alias("o1"), F.xxhash64(text).alias("o2"), F.col(text).alias("_text"))
    table = C.cut(doc_table(keyed, runs_for(recall), threshold), "path-documents")
    classes = C.cut(table.where("n > 0").groupBy("a", "b").agg(
        F.min(F.struct("o1", "o2")).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"),
        F.first("sketch").alias("sketch"), F.first("paths").alias("paths")), "path-classes")

    members = classes.select(F.explode("paths").alias("path"))
    leaves, sets = [], None
    for depth in range(1, MAX_DEPTH + 1):
        sizes = C.cut(members.groupBy("path").agg(F.count("*").alias("m")).where("m > 1"), "path-sizes")
        if depth == 1:
            members = first_members(classes, sizes)
        held = C.cut(members.join(sizes, "path"), "path-members")
        leaf = C.cut(partners(held.where(F.col("m") <= LIMIT), threshold), "path-leaves").withColumn("tiles", F.lit(1))
        leaves.append(leaf)
        big = held.where(F.col("m") > LIMIT)
        tiled = big.select(F.col("path").alias("sig"), "a", "b", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
        if depth == MAX_DEPTH:
            leaves.append(tiled)
            break
        alike = C.cut(alike_paths(big), "path-alike")
        leaves.append(tiled.join(alike.withColumnRenamed("path", "sig"), "sig", "left_semi"))
        rest = big.join(alike, "path", "left_anti")
        if rest.isEmpty():
            break
        if sets is None:  # what is left at deeper levels is a part of these
            full = C.cut(with_sets(rest, set_rows(keyed, rest.select("a", "b").distinct())), "path-sets")
            sets = full.select("a", "b", "s")
        else:
            full = with_sets(rest, _of_members(sets, rest))
        members = C.cut(split(full, threshold), "path-split")
    every = leaves[0]
    for leaf in leaves[1:]:
        every = every.unionByName(leaf)
    found = C.cut(verify(every, keyed, threshold), "path-links")
    node = F.struct("a", "b")
    edges = found.select(node.alias("u"), F.struct(F.col("ra").alias("a"), F.col("rb").alias("b")).alias("v"))
    roots = components(edges).select(F.col("u.a").alias("a"), F.col("u.b").alias("b"), F.col("root"))
    counts = found.groupBy("a", "b").agg(F.sum("links").alias("links"))
    out = classes.select("a", "b", "first", "copies").join(counts, ["a", "b"], "left").join(roots, ["a", "b"], "left")
    return table.select("o1", "o2", "a", "b", "n"), out.withColumn("root", F.coalesce("root", node))


def grouped_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(o1, o2, set_first, group_first, n_copies, n_links), one row per different (id, text)
    with a word: set_first and group_first are the (o1, o2) of the first document with
    the same set and in the same group."""
    table, classes = links(docs, doc_id, text, **options)
    heads = classes.groupBy("root").agg(F.min("first").alias("group_first"))
    info = classes.join(heads, "root").select("a", "b", F.col("first").alias("set_first"), "group_first",
                                              F.col("copies").alias("n_copies"), F.coalesce("links", F.lit(0)).alias("n_links"))
    return table.where("n > 0").select("o1", "o2", "a", "b").distinct().join(info, ["a", "b"]).drop("a", "b")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` plus class_id (order key of the group's first document: its id where ids are
    integers), set_id (of the first document with the same set), n_links (other sets
    with Jaccard of at least the threshold), n_copies (documents with the same set) and
    keep (true for the first document of each group)."""
    fresh = ["class_id", "set_id", "n_links", "n_copies", "keep"]
    docs = docs.drop(*fresh)
    info = grouped_documents(docs, doc_id, text, **options)
    info = info.select(*(F.col(c).alias(f"_{c}") for c in info.columns))
    own = docs.withColumns({"_k1": order_key(docs, doc_id), "_k2": F.xxhash64(text)})
    out = own.join(info, (F.col("_k1") == F.col("_o1")) & (F.col("_k2") == F.col("_o2")), "left")
    here = F.struct(F.col("_k1").alias("o1"), F.col("_k2").alias("o2"))
    return out.select(
        *docs.columns, F.coalesce("_group_first.o1", "_k1").alias("class_id"), F.coalesce("_set_first.o1", "_k1").alias("set_id"),
        F.coalesce("_n_links", F.lit(0)).alias("n_links"), F.coalesce("_n_copies", F.lit(1)).alias("n_copies"),
        (F.col("_group_first").isNull() | here.eqNullSafe(F.col("_group_first"))).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join(docs).select("doc_id", "class_id", "set_id", "n_links", "n_copies")
