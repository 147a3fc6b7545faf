"""M1 / M9: exact k-nearest-neighbour classification on dense vectors.

MLlib has no kNN.  Train rows of at most ``block_bytes`` of vectors are broadcast
and the query rows stream past them in Arrow batches.  More train rows stay on
the executors: train and query rows are hashed into blocks of about that size, and
each pair of blocks meets in one cogrouped task.  A task keeps the k nearest of
its train block for each query, so k rows per query and train block come out, never
all pairs; a last ``row_number() <= k`` per query merges them.

The answer is exact.  Ties: distance, then train id; vote ties go to the
smallest label; with ``distance`` weights, zero distances alone vote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinia.operators.spread import spread

BLOCK_BYTES = 64 << 20
QUERY_ROWS = 500  # of a task that compares each with all train rows
CACHED = 32_768  # values of train rows compared at once, which stay in a core's cache


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(col) * width:
        raise ValueError("vectors differ in length")
    return flat.reshape(len(col), width)


def _distances(train: np.ndarray, q: np.ndarray, p: int, space: np.ndarray) -> np.ndarray:
    """Of a query to all train rows, as many at once as ``space`` has rows."""
    d = np.empty(len(train))
    for a in range(0, len(train), len(space)):
        part = train[a:a + len(space)]
        diff = np.subtract(part, q, out=space[:len(part)])
        (np.multiply(diff, diff, out=diff) if p == 2 else np.abs(diff, out=diff)).sum(axis=1, out=d[a:a + len(part)])
    return np.sqrt(d, out=d) if p == 2 else d


def _nearest(block: pa.Table, rows: pa.RecordBatch | pa.Table, k: int, p: int, width: int) -> list[pa.Array]:
    """(qid, tid, label, dist): the k nearest rows of a block, in the order of its ids, for
    each row (qid, q), best first."""
    train, tid, label = _matrix(block["v"], width), block["tid"].combine_chunks(), block["label"].combine_chunks()
    n = min(k, len(train))
    near, dist = [], []
    space = np.empty((max(CACHED // max(width, 1), 1), width))
    for q in _matrix(rows.column("q"), width):
        d = _distances(train, q, p, space)
        within = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])
        best = within[np.argsort(d[within], kind="stable")][:n]
        near.append(best)
        dist.append(d[best])
    at = pa.array(np.concatenate(near) if near else np.zeros(0, np.int64))
    who = pa.array(np.repeat(np.arange(rows.num_rows), n))
    values = pa.array(np.concatenate(dist) if dist else np.zeros(0))
    return [rows.column("qid").take(who), tid.take(at), label.take(at), values]


def _block_search(held, k: int, p: int, width: int, schema: pa.Schema):
    """Arrow function: (qid, q) to the k nearest rows of the one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(_nearest(held.value, b, k, p, width), schema=schema)

    return run


def _pair_search(k: int, p: int, width: int, schema: pa.Schema):
    """Arrow function of a train block and a query block."""

    def run(train: pa.Table, rows: pa.Table) -> pa.Table:
        if not train.num_rows or not rows.num_rows:
            return schema.empty_table()
        return pa.Table.from_arrays(_nearest(train.sort_by("tid"), rows, k, p, width), schema=schema)

    return run


def _block(blocks: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int")


def _each(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def neighbours(train: DataFrame, query: DataFrame, k: int, p: int = 2, tid: str = "id", qid: str = "id",
               vec: str = "vec", label: str = "label", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(qid, tid, label, dist, rank)``: the k nearest train rows of every query
    row (rank 1..k).  Rows without a vector are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if p not in (1, 2):
        raise ValueError("p must be 1 or 2")
    spark = train.sparkSession
    as_vector = F.col(vec).cast("array<double>")
    tr = train.select(F.col(tid).alias("tid"), as_vector.alias("v"), F.col(label).alias("label")).where("v IS NOT NULL")
    qu = query.select(F.col(qid).alias("qid"), as_vector.alias("q")).where("q IS NOT NULL")
    n, width = tr.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if n < k:
        raise ValueError("fewer train rows than k")
    out = T.StructType([T.StructField("qid", qu.schema["qid"].dataType), tr.schema["tid"], tr.schema["label"],
                        T.StructField("dist", T.DoubleType())])
    blocks = -(-n * max(width, 1) * 8 // block_bytes)
    if blocks <= 1:
        table = spark.sparkContext.broadcast(tr.toArrow().sort_by("tid"))
        found = spread(qu, "qid", "q", rows_per_task=QUERY_ROWS).mapInArrow(_block_search(table, k, p, width, to_arrow_schema(out)), out)
    else:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(-(-qu.count() * width * 8 // block_bytes), -(-tasks // blocks), 1)
        left = tr.withColumn("tb", _block(blocks, "tid", "v")).withColumn("qb", _each(parts))
        right = qu.withColumn("qb", _block(parts, "qid", "q")).withColumn("tb", _each(blocks))
        found = left.groupBy("tb", "qb").cogroup(right.groupBy("tb", "qb")).applyInArrow(
            _pair_search(k, p, width, to_arrow_schema(out)), out)
    w = Window.partitionBy("qid").orderBy("dist", "tid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vote(nb: DataFrame, k: int | None = None, weights: str = "uniform") -> DataFrame:
    """Majority (or 1/d-weighted) vote of the neighbours: ``(qid, prediction)``."""
    if k is not None:
        nb = nb.where(F.col("rank") <= k)
    if weights == "uniform":
        w = F.lit(1.0)
        x = nb.withColumn("_w", w)
    else:
        zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("qid"))
        x = nb.withColumn(
            "_w",
            F.when(zero == 1, F.when(F.col("dist") == 0, 1.0).otherwise(0.0)).otherwise(1.0 / F.col("dist")),
        )
    per = x.groupBy("qid", "label").agg(F.sum("_w").alias("_s"))
    return per.groupBy("qid").agg(
        F.min_by("label", F.struct((-F.col("_s")).alias("a"), F.col("label").alias("b"))).alias("prediction")
    )


def knn_predict(train: DataFrame, query: DataFrame, k: int = 5, p: int = 2, weights: str = "uniform",
                **kw) -> DataFrame:
    """M1: ``(qid, prediction)``."""
    return vote(neighbours(train, query, k, p, **kw), weights=weights)


def knn_sweep(train: DataFrame, dev: DataFrame, ks=(1, 3, 5, 7, 9, 11), p: int = 2, qid: str = "id",
              label: str = "label", **kw) -> DataFrame:
    """M9: accuracy on ``dev`` for every k from ONE neighbour search with
    k = max(ks); ``best`` marks the smallest k with the highest accuracy."""
    nb = neighbours(train, dev, max(ks), p, qid=qid, label=label, **kw).persist()
    truth = dev.select(F.col(qid).alias("qid"), F.col(label).alias("_y"))
    per_k = nb.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where(F.col("rank") <= F.col("k"))
    votes = per_k.groupBy("k", "qid", "label").agg(F.count(F.lit(1)).alias("_s"))
    pred = votes.groupBy("k", "qid").agg(
        F.min_by("label", F.struct((-F.col("_s")).alias("a"), F.col("label").alias("b"))).alias("prediction")
    )
    acc = pred.join(truth, "qid").groupBy("k").agg(
        F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("accuracy")
    )
    best = acc.agg(F.min_by("k", F.struct((-F.col("accuracy")).alias("a"), F.col("k").alias("b"))).alias("_best"))
    return acc.join(best, F.col("k") == F.col("_best"), "left").select(
        "k", "accuracy", F.col("_best").isNotNull().alias("best")
    )
