"""F1 without a full distinct: "has a column more than ``limit`` different values?"

Each task keeps a set per column that stops growing at ``limit`` + 1 values, and stops reading once all
of them are full; at most columns x (limit + 1) hashes leave it.  The sets merge by an ordinary distinct count of
those few rows.  A free-text column fills its set within the first rows, so no text is shuffled or even hashed
beyond them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _few(cols: list[str], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[set] = [set() for _ in cols]
        for b in batches:
            for seen, col in zip(held, b.columns, strict=True):
                if len(seen) > limit:
                    continue
                for v in pc.unique(col).to_pylist():
                    if v is not None:
                        seen.add(hashlib.sha256(v.encode()).digest())
                        if len(seen) > limit:
                            break
            if all(len(seen) > limit for seen in held):
                break
        rows = [(c, v) for c, seen in zip(cols, held, strict=True) for v in seen]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.binary())], names=["column", "value"])

    return run


def few_distinct(df: DataFrame, cols: list[str], limit: int) -> DataFrame:
    """``(column, n_distinct)`` of string columns: the number of non-null values, or ``limit`` + 1 if there are more.
    A column without values has no row."""
    found = df.select(*[F.col(f"`{c}`").cast("string") for c in cols]).mapInArrow(_few(cols, limit), "column string, value binary")
    return found.groupBy("column").agg(F.least(F.count_distinct("value"), F.lit(limit + 1)).cast("bigint").alias("n_distinct"))
