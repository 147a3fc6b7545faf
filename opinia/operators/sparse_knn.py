"""M1 / M9 / M8 on text: exact nearest neighbours of sparse non-negative vectors (TF-IDF).

Train rows are kept as sparse rows in slabs of at most ``slab_bytes``.  In a slab they are sorted by
their heaviest term and cut into blocks of ``BLOCK`` rows; per block and term the
largest weight is known.  So a block's best possible dot product with a query row (or,
for Manhattan distance, its largest possible sum of minima) is a few look-ups, and blocks are
visited from the most promising on until the rest cannot reach the k-th neighbour.  Where more would be
visited than the rows of the query's terms hold, all distances come from those.  Nothing is
skipped that could matter: the answer is exact.

A slab of more than ``FEW_ROWS`` rows is searched by ``sparse_search`` instead, whose bounds come from products of matrices.

Slabs: up to one, it is broadcast and query rows stream past it.  More are written once, in pieces, to the shared checkpoint
folder; each block of query rows is one task that reads them one after the other and keeps k rows per query.  So no row is
copied per slab or block: what is written and shuffled grows with the rows, only the reading with their square.

Squared distances are |q|^2 + |t|^2 - 2 q.t, rounded to nine decimals so that equal rows tie
whatever the order of summation; ties go to the smaller train id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinia.operators import knn as KNN
from opinia.operators.sparse_search import Piece, Search
from opinia.session import scratch_path

BLOCK = 64
SLAB_BYTES = 64 << 20
FEW_ROWS = 4_096  # train rows whose block maxima cost less than matrices
PIECE_BYTES = 32 << 20  # of train rows that a task holds at a time
QUERY_ROWS = 8_192  # of a task, at most
SLACK = 1e-8
DECIMALS = 9


# ---------------------------------------------------------------- rows

def sparse_rows(weights: DataFrame, ids: DataFrame, id_col: str = "id", vocab: DataFrame | None = None) -> DataFrame:
    """``ids`` plus ``idx`` and ``val``: the sparse row of each id from long weights ``(id, term, weight)``
    (or ``(id, idx, weight)`` without ``vocab``, an ``(term, idx)`` table); an id without weights has empty arrays.
    A row has at most one entry per term of the vocabulary."""
    w = weights if vocab is None else weights.join(F.broadcast(vocab.select("term", "idx")), "term")
    per = w.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("i"), F.col("weight").alias("w")))).alias("_e"))
    x = ids.join(per, ids[id_col] == per["_id"], "left").drop("_id")
    return x.select(*ids.columns, F.coalesce(F.col("_e.i"), F.array().cast("array<int>")).alias("idx"),
                    F.coalesce(F.col("_e.w"), F.array().cast("array<double>")).alias("val"))


# ---------------------------------------------------------------- one slab

def _flat(col) -> tuple[np.ndarray, np.ndarray]:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]], off - off[0]


class Slab:
    """Train rows as sparse rows with block maxima."""

    def __init__(self, table: pa.Table, p: int):
        table = table.sort_by("tid").combine_chunks()
        idx, off = _flat(table["idx"])
        val, _ = _flat(table["val"])
        n = len(off) - 1
        size = np.diff(off)
        # the heaviest term of each row; empty rows come first
        heavy = np.full(n, -1, np.int64)
        row = np.repeat(np.arange(n), size)
        if len(val):
            by = np.lexsort((val, row))
            heavy[size > 0] = idx[by[off[1:][size > 0] - 1]]
        order = np.argsort(heavy, kind="stable")
        take = np.repeat(off[:-1][order], size[order]) + _ranges(size[order])
        self.p, self.n = p, n
        self.idx, self.val = idx[take].astype(np.int64), val[take]
        self.off = np.concatenate(([0], np.cumsum(size[order])))
        self.rank = order  # place by id of each kept row
        self.tid, self.label = table["tid"].take(pa.array(order)), table["label"].take(pa.array(order))
        self.tid, self.label = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (self.tid, self.label))
        self.fold = table["fold"].to_numpy()[order] if "fold" in table.column_names else None
        row = np.repeat(np.arange(n), np.diff(self.off))
        self.norm = np.bincount(row, self.val ** 2 if p == 2 else self.val, minlength=n)
        self.blocks = -(-n // BLOCK)
        self.low = np.array([self.norm[b * BLOCK:(b + 1) * BLOCK].min() for b in range(self.blocks)])
        # largest weight per (term, block), by term
        self.width = int(self.idx.max()) + 1 if len(self.idx) else 0
        cell = self.idx * self.blocks + row // BLOCK
        by = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(cell[by]) > 0))) if len(by) else np.zeros(0, np.int64)
        self.cell_block = cell[by][first] % max(self.blocks, 1)
        self.cell_max = np.maximum.reduceat(self.val[by], first) if len(first) else np.zeros(0)
        self.term_off = np.searchsorted(cell[by][first], np.arange(self.width + 1) * self.blocks)
        # the rows of each term
        by = np.argsort(self.idx, kind="stable")
        self.post_row, self.post_val = row[by].astype(np.int32), self.val[by]
        self.post_off = np.concatenate(([0], np.cumsum(np.bincount(self.idx, minlength=self.width)))).astype(np.int64)

    def nearest(self, qi: np.ndarray, qv: np.ndarray, k: int, fold: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(kept rows, distances) of the k nearest, best first."""
        known = qi < self.width
        dense = np.zeros(self.width)
        dense[qi[known]] = qv[known]
        own = float((qv ** 2).sum() if self.p == 2 else qv.sum())
        spans = self.term_off[qi[known] + 1] - self.term_off[qi[known]]
        at = np.repeat(self.term_off[qi[known]], spans) + _ranges(spans)
        q = np.repeat(qv[known], spans)
        top = q * self.cell_max[at] if self.p == 2 else np.minimum(q, self.cell_max[at])
        bound = own + self.low - 2 * np.bincount(self.cell_block[at], top, minlength=self.blocks)
        order = np.argsort(bound, kind="stable")
        bound = bound[order]
        rows, dist = np.zeros(0, np.int64), np.zeros(0)
        step, at = max(1, -(-2 * k // BLOCK)), 0
        terms = qi[known]
        through_terms = int((self.post_off[terms + 1] - self.post_off[terms]).sum()) + self.n
        while at < self.blocks:
            if len(dist) >= k:
                if bound[at] > dist[k - 1] + SLACK:
                    break
                left = np.searchsorted(bound, dist[k - 1] + SLACK, side="right") - at
                if left * BLOCK * len(self.idx) > through_terms * self.n:  # cells of the blocks left, cells of the query's terms
                    return self._through_terms(terms, qv[known], own, k, fold)
            some = order[at:at + step]
            at, step = at + step, min(step * 2, 256)
            new = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            new = new[new < self.n]
            if fold is not None:
                new = new[self.fold[new] != fold]
            rows, dist = np.concatenate((rows, new)), np.concatenate((dist, self._distances(new, dense, own)))
            best = np.lexsort((self.rank[rows], dist))[:k]
            rows, dist = rows[best], dist[best]
        return rows, np.sqrt(dist) if self.p == 2 else dist

    def _through_terms(self, terms: np.ndarray, weights: np.ndarray, own: float, k: int, fold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(kept rows, distances) of the k nearest from the rows of the query's terms: only shared terms are read."""
        spans = [slice(a, b) for a, b in zip(self.post_off[terms], self.post_off[terms + 1], strict=True)]
        shared = np.concatenate([w * self.post_val[x] if self.p == 2 else np.minimum(w, self.post_val[x]) for w, x in zip(weights, spans, strict=True)] or [np.zeros(0)])
        rows = np.concatenate([self.post_row[x] for x in spans] or [np.zeros(0, np.int32)])
        dist = np.round(np.maximum(own + self.norm - 2 * np.bincount(rows, shared, minlength=self.n), 0.0), DECIMALS)
        if fold is not None:
            dist[self.fold == fold] = np.inf
        near = np.flatnonzero(dist <= np.partition(dist, min(k, self.n) - 1)[min(k, self.n) - 1])
        near = near[np.isfinite(dist[near])]
        best = near[np.lexsort((self.rank[near], dist[near]))][:k]
        return best, np.sqrt(dist[best]) if self.p == 2 else dist[best]

    def _distances(self, rows: np.ndarray, dense: np.ndarray, own: float) -> np.ndarray:
        size = self.off[rows + 1] - self.off[rows]
        at = np.repeat(self.off[rows], size) + _ranges(size)
        q = dense[self.idx[at]]
        shared = q * self.val[at] if self.p == 2 else np.minimum(q, self.val[at])
        dot = np.bincount(np.repeat(np.arange(len(rows)), size), shared, minlength=len(rows))
        return np.round(np.maximum(own + self.norm[rows] - 2 * dot, 0.0), DECIMALS)


def _ranges(counts: np.ndarray) -> np.ndarray:
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) if total else np.zeros(0, np.int64)


class Held:
    """Train rows that are searched for batches of query rows."""

    def __init__(self, table: pa.Table, p: int):
        self.p, self.slab = p, Slab(table, p) if table.num_rows <= FEW_ROWS else None
        self.piece = Piece(table, p) if self.slab is None else None

    def nearest(self, rows: pa.RecordBatch | pa.Table, k: int) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """(query row, train id, label, distance) of the k nearest of every row, by row, best first."""
        idx, off = _flat(rows.column("idx"))
        val, _ = _flat(rows.column("val"))
        with_fold = (self.slab or self.piece).fold is not None
        folds = rows.column("fold").to_numpy(zero_copy_only=False) if with_fold else None
        if self.slab is None:
            search = Search(idx, off, val, k, self.p, folds)
            search.meet(self.piece)
            return search.result()
        who, kept, dist = [], [], []
        for i in range(rows.num_rows):
            part = slice(off[i], off[i + 1])
            r, d = self.slab.nearest(idx[part].astype(np.int64), val[part], k, None if folds is None else folds[i])
            who.append(np.full(len(r), i))
            kept.append(r)
            dist.append(d)
        at, near, far = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, kept, dist))
        near = pa.array(near)
        return at, self.slab.tid.take(near), self.slab.label.take(near), far


def _records(qid, found: tuple, schema: pa.Schema) -> pa.RecordBatch:
    who, tid, label, dist = found
    qid = qid.combine_chunks() if isinstance(qid, pa.ChunkedArray) else qid
    return pa.RecordBatch.from_arrays([qid.take(pa.array(who)), tid, label, pa.array(dist, pa.float64())], schema=schema)


def _past_one(held, k: int, p: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for b in batches:
            rows = rows or Held(held.value, p)
            yield _records(b.column("qid"), rows.nearest(b, k), schema)

    return run


# ---------------------------------------------------------------- many slabs

def _packed(name: str, schema: pa.Schema):
    """The rows of a task as one row: the task's number and the rows, as compressed Arrow data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = pa.Table.from_batches(list(batches), schema)
        if rows.num_rows:
            to = pa.BufferOutputStream()
            with pa.ipc.new_stream(to, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(rows)
            number = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([number, pa.array([to.getvalue().to_pybytes()], pa.binary())], names=[f"{name}_number", name])

    return run


def _unpacked(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


def _past_pieces(k: int, p: int, schema: pa.Schema):
    """Pairs of a piece of train rows and a block of query rows, all pieces of a block in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple] = {}
        for b in batches:
            numbers, owners = b.column("piece_number").to_pylist(), b.column("block_number").to_pylist()
            for i, (number, owner) in enumerate(zip(numbers, owners, strict=True)):
                if owner not in blocks:
                    rows = _unpacked(b.column("block")[i])
                    idx, off = _flat(rows["idx"])
                    fold = rows["fold"].to_numpy() if "fold" in rows.column_names else None
                    blocks[owner] = rows["qid"], Search(idx, off, _flat(rows["val"])[0], k, p, fold)
                blocks[owner][1].meet(Piece(_unpacked(b.column("piece")[i]), p), number)
        for qid, search in blocks.values():
            yield _records(qid, search.result(), schema)

    return run


def _session_for_blocks(spark):
    """A session with this one's settings, for rows of tens of MB: they go to Python a few at a time."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PIECE_BYTES))
    return own


def _met_by_pieces(tr: DataFrame, qu: DataFrame, rows: int, pieces: int, k: int, p: int, out: T.StructType) -> DataFrame:
    """The k nearest of each query row, as a table in the shared folder."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = tr.sparkSession
    own, name = _session_for_blocks(spark), uuid.uuid4().hex
    path = scratch_path(spark, f"knn-{name}")
    # pieces are ranges of ids, so that ties over pieces go to the smaller id
    packed = tr.repartitionByRange(pieces, "tid").mapInArrow(_packed("piece", to_arrow_schema(tr.schema)), "piece_number long, piece binary")
    packed.write.parquet(f"{path}-train")
    train = own.read.schema(packed.schema).parquet(f"{path}-train").coalesce(1)
    blocks = max(-(-rows // QUERY_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-rows // 64)), 1)
    block = qu.repartition(blocks).mapInArrow(_packed("block", to_arrow_schema(qu.schema)), "block_number long, block binary")
    found = train.hint("shuffle_replicate_nl").crossJoin(block).mapInArrow(_past_pieces(k, p, to_arrow_schema(out)), out)
    found.write.parquet(f"{path}-found")
    return spark.read.schema(out).parquet(f"{path}-found")


# ---------------------------------------------------------------- search

def neighbours(train: DataFrame, query: DataFrame, k: int, p: int = 2, tid: str = "id", qid: str = "id", label: str = "label",
               fold: str | None = None, slab_bytes: int = SLAB_BYTES, query_rows: int | None = None) -> DataFrame:
    """``(qid, tid, label, dist, rank)``: the k nearest train rows (``idx``, ``val``, sorted by index) of every
    query row.  With ``fold``, a column of both sides, a query row only sees train rows of other folds.  ``query_rows``
    says how many query rows there are at most, where counting them would make them once more."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if p not in (1, 2):
        raise ValueError("p must be 1 or 2")
    spark = train.sparkSession
    more = [F.col(fold).cast("int").alias("fold")] if fold else []
    # every column under an alias: both sides may be parts of one table, and a cogroup of columns with one origin is ambiguous
    row = [F.col(c).alias(c) for c in ("idx", "val")] + more
    tr = train.select(F.col(tid).alias("tid"), F.col(label).alias("label"), *row)
    qu = query.select(F.col(qid).alias("qid"), *row)
    out = T.StructType([T.StructField("qid", qu.schema["qid"].dataType), tr.schema["tid"], tr.schema["label"],
                        T.StructField("dist", T.DoubleType())])
    rows, cells = tr.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("idx")), F.lit(0))).first()
    if rows < k:
        raise ValueError("fewer train rows than k")
    size = cells * 16 + rows * 32
    if size <= slab_bytes:
        arrow = to_arrow_schema(out)
        held = spark.sparkContext.broadcast(tr.toArrow())
        # a stratified split leaves a task per class, and few bytes are coalesced: the search is dealt by a fixed number
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = qu.repartition(min(tasks, 2 * spark.sparkContext.defaultParallelism), "qid").mapInArrow(_past_one(held, k, p, arrow), out)
    else:
        found = _met_by_pieces(tr, qu, qu.count() if query_rows is None else query_rows, -(-size // min(PIECE_BYTES, slab_bytes)), k, p, out)
    w = Window.partitionBy("qid").orderBy("dist", "tid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)



def predict(train: DataFrame, query: DataFrame, k: int = 5, p: int = 2, weights: str = "uniform", **kw) -> DataFrame:
    """M1 on sparse rows: ``(qid, prediction)``."""
    return KNN.vote(neighbours(train, query, k, p, **kw), weights=weights)


def sweep(train: DataFrame, dev: DataFrame, ks=(1, 3, 5, 7, 9, 11), p: int = 2, qid: str = "id", label: str = "label", **kw) -> DataFrame:
    """M9 on sparse rows: ``(k, accuracy, best)`` from one search with the largest k; ties go to the smallest k."""
    points = [(k, "uniform") for k in ks]
    # few rows, read twice below: kept, else the search runs twice
    acc = kept(accuracies(neighbours(train, dev, max(ks), p, qid=qid, label=label, **kw), dev, points, qid, label))
    best = acc.agg(F.min_by("k", F.struct((-F.col("accuracy")).alias("a"), F.col("k").alias("b"))).alias("_b"))
    return acc.join(best, F.col("k") == F.col("_b"), "left").select("k", "accuracy", F.col("_b").isNotNull().alias("best"))


def kept(df: DataFrame) -> DataFrame:
    """The few rows of a result (one per grid point and fold), computed now."""
    rows = df.toArrow()
    return df.sparkSession.createDataFrame(rows).select(*df.columns)


def accuracies(found: DataFrame, truth: DataFrame, points: list[tuple[int, str]], qid: str = "id", label: str = "label",
               by: list[str] | None = None) -> DataFrame:
    """``(*by, k, weights, accuracy)`` of all points (k, weights) from one set of neighbours; ``by`` are columns
    of ``truth``, such as the fold."""
    by = by or []
    zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("qid", "k"))
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("weights")) for k, w in points])
    x = found.select("qid", "label", "dist", "rank", F.explode(grid).alias("g")).select("qid", "label", "dist", "rank", "g.*").where("rank <= k")
    x = x.withColumn("_z", zero)
    w = F.when(F.col("weights") == "uniform", 1.0).when(F.col("_z") == 1, F.when(F.col("dist") == 0, 1.0).otherwise(0.0)).otherwise(1.0 / F.col("dist"))
    votes = x.groupBy("k", "weights", "qid", "label").agg(F.sum(w).alias("_s"))
    pred = votes.groupBy("k", "weights", "qid").agg(
        F.min_by("label", F.struct((-F.round("_s", DECIMALS)).alias("a"), F.col("label").alias("b"))).alias("_y"))
    known = truth.select(F.col(qid).alias("qid"), F.col(label).alias("_t"), *by)
    return pred.join(known, "qid").groupBy(*by, "k", "weights").agg(F.avg((F.col("_y") == F.col("_t")).cast("double")).alias("accuracy"))


# ---------------------------------------------------------------- model

@dataclass
class SparseKnnModel:
    """Train rows (``tid``, ``label``, ``idx``, ``val``) with the chosen k, p and weights."""

    rows: DataFrame
    k: int = 5
    p: int = 2
    weights: str = "uniform"

    def predict(self, query: DataFrame, id_col: str = "id", slab_bytes: int = SLAB_BYTES, query_rows: int | None = None) -> DataFrame:
        """``(id, prediction)`` of sparse query rows."""
        found = predict(self.rows, query, self.k, self.p, self.weights, tid="tid", qid=id_col, slab_bytes=slab_bytes, query_rows=query_rows)
        return found.withColumnRenamed("qid", id_col)


def fit(train: DataFrame, k: int = 5, p: int = 2, weights: str = "uniform", tid: str = "id", label: str = "label") -> SparseKnnModel:
    if p not in (1, 2) or weights not in ("uniform", "distance"):
        raise ValueError("p must be 1 or 2, weights uniform or distance")
    return SparseKnnModel(train.select(F.col(tid).alias("tid"), F.col(label).alias("label"), "idx", "val"), k, p, weights)
