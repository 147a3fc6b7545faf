"""Toxicity (operator 7): nearest labelled examples by exact TF-IDF cosine.

1. A bounded sample of labelled rows (``sample`` per class) is the example set.
2. Features are all words of the examples and the beginnings (``PREFIX`` bytes) of the longer
   ones (told apart by 64-bit hashes), which inflected forms share.  Document frequencies are counted over all documents.
3. A feature's weight is its idf times 1 + ``STRENGTH`` (z - ``LEAST_Z``)^2, z being the signed root of its
   likelihood ratio with the toxic label, where z is above ``LEAST_Z``: association weighs, it selects nothing.
4. The examples' normalised vectors form an inverted index whose postings are grouped by blocks of
   examples (sorted by their heaviest feature) with the largest weight of each block; a text's nearest
   examples are found exactly by visiting blocks in order of their bound until no block can
   hold a better one.
5. The ``k`` nearest vote with weight cos^2 / (1 - cos + 0.05), classes weighted
   back to their true share; votes are calibrated by an isotonic map fitted on
   the examples' leave-one-out votes.  Neighbours and the associated words are the evidence.

Defined results: null and empty texts, and texts that share no feature with an example, get the
toxic share of such examples (of all where there are none); without usable labels every score is 0; ties
among neighbours go to the example that comes first by id; labels that are
null are not used, of contradicting labels of one id the larger counts;
repeated rows each get a row; a very long text is read whole; an empty table gives no rows; extra columns
stay, clashing ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinia.llm import common as C

SAMPLE = 1000  # labelled rows per class
PREFIX = 5
LEAST_Z, STRENGTH = 3.0, 4.0
K, BLOCK, BINS = 15, 256, 20
DENSE, TOGETHER = 20, 256
PRIOR_MASS = 1.0
THRESHOLD = 0.7
_TABLE = bytes(int(b) if b else 0x20 for b in C.ALNUM)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def features_of(word: bytes) -> list[bytes]:
    return [word, word[:PREFIX] + b"*"] if len(word) > PREFIX else [word]


_BEGINS = np.uint64(0xA24BAED4963EE407)


def feature_hashes(mapped: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the features of each word span, and the number of the word."""
    long = np.flatnonzero(e - s > PREFIX)
    begins = C.hash_spans(mapped, s[long], s[long] + PREFIX) ^ _BEGINS
    return np.concatenate((C.hash_spans(mapped, s, e), begins)), np.concatenate((np.arange(len(s)), long))


def hashes_of(terms: list[bytes]) -> np.ndarray:
    """The same hashes of given features."""
    plain = [t.removesuffix(b"*") for t in terms]
    ends = np.cumsum([len(t) for t in plain], dtype=np.int64)
    sizes = np.diff(ends, prepend=0)
    h = C.hash_spans(np.frombuffer(b"".join(plain), np.uint8), ends - sizes, ends) if terms else np.zeros(0, np.uint64)
    return np.where([t.endswith(b"*") for t in terms], h ^ _BEGINS, h) if terms else h


class Index:
    """Inverted index of unit vectors (ids, weights); a cell holds the postings of one term in one block.  Terms that
    more than a ``DENSE``-th of the vectors have are columns of a matrix instead of postings, so that a batch of
    texts meets them in one product."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.given = vectors, n_terms, block
        self.n, self.block = len(vectors), block
        self.n_blocks = max(1, -(-self.n // block))
        heavy = [int(i[np.argmax(w)]) if len(i) else -1 for i, w in vectors]
        self.own = np.argsort(np.array(heavy, np.int64), kind="stable")  # example at each place
        size = np.array([len(vectors[e][0]) for e in self.own], np.int64)
        empty = np.zeros(0, np.int64)
        term = np.concatenate([vectors[e][0] for e in self.own]).astype(np.int64) if self.n else empty
        weight = np.concatenate([vectors[e][1] for e in self.own]) if self.n else np.zeros(0)
        row = np.repeat(np.arange(self.n), size)
        common = np.bincount(term, minlength=n_terms) * DENSE > self.n
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.matrix = np.zeros((int(common.sum()), self.n))
        in_matrix = common[term]
        self.matrix[self.column[term[in_matrix]], row[in_matrix]] = weight[in_matrix]
        term, weight, row = term[~in_matrix], weight[~in_matrix], row[~in_matrix]
        cell = term * self.n_blocks + row // block
        by = np.argsort(cell, kind="stable")
        self.row, self.weight, cell = row[by].astype(np.int32), weight[by], cell[by]
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else empty
        self.at = np.append(first, len(cell))  # postings of each cell
        self.cell_block = (cell[first] % self.n_blocks).astype(np.int32)
        self.cell_max = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(cell[first], np.arange(n_terms + 1) * self.n_blocks)  # cells of each term

    def __reduce__(self):
        """Only the vectors travel; each Python worker builds the index once."""
        vectors, n_terms, block = self.given
        size = np.array([len(i) for i, _ in vectors], np.int32)
        ids = np.concatenate([i for i, _ in vectors]).astype(np.int32) if vectors else np.zeros(0, np.int32)
        weights = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        return _rebuilt, (size, ids, weights, n_terms, block)

    def top_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[list[tuple[int, float]]]:
        """``top`` of each query, the common terms of ``TOGETHER`` of them at a time."""
        out = []
        for lo in range(0, len(queries), TOGETHER):
            part = queries[lo:lo + TOGETHER]
            q = np.zeros((len(part), len(self.matrix)))
            for j, (ids, w) in enumerate(part):
                at = self.column[ids]
                q[j, at[at >= 0]] = w[at >= 0]
            base = q @ self.matrix
            out += [self.top(ids, w, k, -1 if skip is None else skip[lo + j], base[j]) for j, (ids, w) in enumerate(part)]
        return out

    def top(self, ids: np.ndarray, q: np.ndarray, k: int, skip: int = -1, base: np.ndarray | None = None) -> list[tuple[int, float]]:
        """The k nearest (example, cosine > 0), best first, ties by example; ``base``: what the common terms add to
        each.  Blocks are visited by falling bound, 2, 4, 8 ... at a time, until no bound reaches the k-th."""
        if not len(ids) or not self.n:
            return []
        if base is None:
            return self.top_many([(ids, q)], k, [skip])[0]
        spans = self.cells[ids + 1] - self.cells[ids]
        cell = np.repeat(self.cells[ids], spans) + C.ranges(spans)
        weight = np.repeat(q, spans)
        block = self.cell_block[cell]
        bound = np.bincount(block, weight * self.cell_max[cell], minlength=self.n_blocks) + np.maximum.reduceat(base, np.arange(0, self.n, self.block))
        order = np.argsort(-bound, kind="stable")
        order = order[:int((bound > 0).sum())]
        turn = np.full(self.n_blocks, len(order))
        turn[order] = np.arange(len(order))
        turns, row_turns = turn[block], np.repeat(turn, self.block)[:self.n]
        found, cos, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 2
        while at < len(order) and not (len(found) == k and bound[order[at]] + 1e-9 < cos[-1]):
            use = np.flatnonzero((turns >= at) & (turns < at + step))
            size = self.at[cell[use] + 1] - self.at[cell[use]]
            post = np.repeat(self.at[cell[use]], size) + C.ranges(size)
            score = base + np.bincount(self.row[post], self.weight[post] * np.repeat(weight[use], size), minlength=self.n)
            hit = np.flatnonzero((score > 0) & (row_turns >= at) & (row_turns < at + step))
            example = self.own[hit]
            keep = example != skip
            found, cos = np.concatenate([found, example[keep]]), np.concatenate([cos, np.round(score[hit[keep]], 9)])
            best = np.lexsort((found, -cos))[:k]
            found, cos, at, step = found[best], cos[best], at + step, step * 2
        return list(zip(found.tolist(), np.minimum(cos, 1.0).tolist(), strict=True))


def _rebuilt(size: np.ndarray, ids: np.ndarray, weights: np.ndarray, n_terms: int, block: int) -> Index:
    ends = np.cumsum(size)
    return Index([(ids[b - n:b].astype(np.int64), weights[b - n:b]) for n, b in zip(size.tolist(), ends.tolist(), strict=True)], n_terms, block)


def unit(ids, counts, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights of a text, of length one."""
    i = np.asarray(ids, np.int64)
    v = (1 + np.log(np.asarray(counts, np.float64))) * weight[i]
    norm = math.sqrt(float((v * v).sum()))
    return i, v / norm if norm else v


def lists_of(col: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column."""
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)
    return [flat[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def vote(near: list[tuple[int, float]], model: dict) -> float:
    """Distance-weighted share of toxic neighbours, shrunk to the toxic share."""
    yes, total = PRIOR_MASS * model["prior"], PRIOR_MASS
    for i, cos in near:
        w = model["class_weight"][model["y"][i]] * cos * cos / (1 - cos + 0.05)
        yes, total = yes + w * model["y"][i], total + w
    return yes / total


def association(counted: DataFrame, n_pos: int, n_neg: int) -> list[tuple[bytes, float]]:
    """(feature, z) of all features, in their order; counted: word, pos, neg (examples that hold it)."""
    both, every = F.col("pos") + F.col("neg"), n_pos + n_neg

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    ratio = 2 * (term(F.col("pos"), both * n_pos / every) + term(F.col("neg"), both * n_neg / every)
                 + term(n_pos - F.col("pos"), (every - both) * n_pos / every) + term(n_neg - F.col("neg"), (every - both) * n_neg / every))
    z = F.when(F.col("pos") * n_neg > F.col("neg") * n_pos, F.sqrt(F.greatest(ratio, F.lit(0.0)))).otherwise(0.0)
    rows = counted.select("word", z.alias("z")).toArrow()  # the words of a bounded sample
    return sorted(zip(rows["word"].to_pylist(), rows["z"].to_pylist(), strict=True))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (word, toxic), one row per distinct word of a text."""
    for b in batches:
        ys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lo in range(0, len(ys), 200):
            word, y = [], []
            for k, t in zip(ys[lo:lo + 200], texts[lo:lo + 200], strict=True):
                own = list({f for w in set(words_of(t)) for f in features_of(w)})
                word += own
                y += [k] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(y, pa.int32())], names=["word", "toxic"])


def vectors(docs: DataFrame, keep: list[str], text: str, terms: list[bytes]) -> DataFrame:
    """``keep`` plus ids and counts of the features of each whole text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    base = docs.select(*keep, F.col(text).alias("_text"))
    out = StructType(base.schema.fields[:-1] + StructType.fromDDL("_ids array<int>, _counts array<int>").fields)
    schema = to_arrow_schema(out)
    hashes = hashes_of(terms)
    order = np.argsort(hashes)
    held = docs.sparkSession.sparkContext.broadcast((hashes[order], order.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = held.value
        for b in batches:
            arr = C.strings(b.column(len(keep)))
            for lo, hi in C.slices(arr):
                buf, off = C.raw(arr.slice(lo, hi - lo))
                mapped = C.ALNUM[buf]
                s, e = C.word_spans(mapped, off)
                h, word = feature_hashes(mapped, s, e)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[at] == h
                else:
                    at, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
                doc = np.searchsorted(off, s[word[hit]], side="right") - 1
                key, times = np.unique(doc * max(len(known), 1) + number[at[hit]] if len(known) else doc, return_counts=True)
                doc, ids = key // max(len(known), 1), key % max(len(known), 1)
                places = np.searchsorted(doc, np.arange(hi - lo + 1))
                cols = [b.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                cols += [C.list_array(ids.astype(np.int32), places, pa.int32()), C.list_array(times.astype(np.int32), places, pa.int32())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return base.mapInArrow(run, out)


def isotonic(x: list[float], y: list[float], w: list[float]) -> list[float]:
    """Pool adjacent violators: non-decreasing fit of y in the order of x."""
    pools: list[list[float]] = []
    for yi, wi in zip(y, w, strict=True):
        pools.append([yi, wi, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [p[0] for p in pools for _ in range(int(p[2]))]


def fit_and_score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  label: str = "toxic", sample: int = SAMPLE, k: int = K) -> DataFrame:
    """``docs`` (without ``text``) plus score, predicted, neighbours (ids of the
    nearest examples), words (the text's words that are associated with the label).  Examples are the
    rows of ``docs`` that ``labels`` (doc_id, label) marks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    marks = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_y IN (0, 1) AND _id IS NOT NULL")
    picked = C.sample_per_class(marks.groupBy("_id").agg(F.max("_y").alias("_y")), "_y", "_id", sample)
    picked = F.broadcast(C.cut(picked, "toxicity-examples"))  # about 2 * sample rows
    examples = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(picked, F.col("_doc") == F.col("_id"))
    examples = C.cut(examples.groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_text").alias("_text")), "toxicity-texts")
    sizes = {r[0]: r[1] for r in examples.groupBy("_y").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    true = {r[0]: r[1] for r in marks.groupBy("_id").agg(F.max("_y").alias("_y")).groupBy("_y").count().collect()}
    weight = {y: true.get(y, 0) / sizes[y] for y in sizes}
    known: list[tuple[str, float]] = []
    if n_pos and n_neg:
        counted = examples.select("_y", "_text").mapInArrow(_words, "word binary, toxic int").groupBy("word").agg(
            F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
        known = association(counted, n_pos, n_neg)
    terms, z = [w for w, _ in known], np.array([x for _, x in known])

    fresh = StructType.fromDDL("score double, predicted int, neighbours array<string>, words array<string>")
    keep = [c for c in docs.columns if c not in (*fresh.names, text)]
    sparse = C.cut(vectors(docs, keep, text, terms), "toxicity-vectors")
    total = sparse.count()
    df = dict(sparse.select(F.explode("_ids").alias("t")).groupBy("t").count().collect()) if terms else {}
    idf = np.array([math.log((total + 1) / (df.get(i, 0) + 1)) for i in range(len(terms))])
    strong = idf * (1 + STRENGTH * np.maximum(z - LEAST_Z, 0.0) ** 2)

    rows = sorted(vectors(examples, ["_id", "_y"], "_text", terms).collect(), key=lambda r: str(r[0])) if terms else []
    filled = [r for r in rows if r._ids]
    blank = {y: weight.get(y, 0) * sum(r._y == y for r in rows if not r._ids) for y in (0, 1)}
    share = weight.get(1, 0) * n_pos / max(1e-9, weight.get(1, 0) * n_pos + weight.get(0, 0) * n_neg)
    model = {
        "index": Index([unit(r._ids, r._counts, strong) for r in filled], len(terms)), "weight": strong, "y": [r._y for r in filled],
        "ids": [str(r._id) for r in filled], "class_weight": {0: 0.0, 1: 0.0} | weight, "prior": share, "k": k,
        "said": {i: w.decode("utf-8", "replace") for i, (w, x) in enumerate(known) if x > LEAST_Z}, "strong": z > LEAST_Z,
        "blank": blank[1] / sum(blank.values()) if sum(blank.values()) else share, "at": [], "to": [],
    }
    if filled:
        _calibrate(spark, model, filled)
    held = spark.sparkContext.broadcast(model)
    out = StructType([sparse.schema[c] for c in keep] + fresh.fields)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            res = []
            lists = [lists_of(b.column(len(keep) + j)) for j in (0, 1)]
            found = m["index"].top_many([unit(i, n, m["weight"]) for i, n in zip(*lists, strict=True)], m["k"])
            for ids, near in zip(lists[0], found, strict=True):
                s = float(np.interp(vote(near, m), m["at"], m["to"])) if near and m["at"] else m["blank"]
                res.append((s, int(s >= THRESHOLD), [m["ids"][i] for i, _ in near], [m["said"][i] for i in ids[m["strong"][ids]].tolist()]))
            new = list(zip(*res, strict=True)) if res else [()] * 4
            cols = [b.column(i) for i in range(len(keep))]
            cols += [pa.array(v, schema.field(i - 4).type) for i, v in enumerate(new)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return sparse.mapInArrow(run, out)


def _calibrate(spark, model: dict, rows: list) -> None:
    """Isotonic map of the examples' leave-one-out votes, in BINS equal bins."""
    held = spark.sparkContext.broadcast(model)
    part = spark.createDataFrame([(i, list(r._ids), list(r._counts)) for i, r in enumerate(rows)], "i int, ids array<int>, counts array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            own = []
            rows = b.to_pylist()
            found = m["index"].top_many([unit(r["ids"], r["counts"], m["weight"]) for r in rows], m["k"], [r["i"] for r in rows])
            for r, near in zip(rows, found, strict=True):
                y = m["y"][r["i"]]
                own.append((min(BINS - 1, int(vote(near, m) * BINS)), m["class_weight"][y] * y, m["class_weight"][y]))
            cols = list(zip(*own, strict=True)) if own else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.float64()), strict=True)],
                                             names=["bin", "yes", "n"])

    bins = (
        part.repartition(C.partitions(spark)).mapInArrow(run, "bin int, yes double, n double")
        .groupBy("bin").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n")).orderBy("bin").collect()
    )
    held.destroy()
    at = [(r.bin + 0.5) / BINS for r in bins]
    # half a pseudo-example at the vote itself keeps thin bins from jumping to 0 or 1
    to = isotonic(at, [(r.yes + 0.5 * a) / (r.n + 0.5) for r, a in zip(bins, at, strict=True)], [r.n for r in bins])
    model["at"], model["to"] = at, to


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(C.bucket("doc_id", 3) != 1)
    scored = fit_and_score(docs, labels)
    return scored.select("doc_id", F.coalesce(C.bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted",
                         "neighbours", "words")
