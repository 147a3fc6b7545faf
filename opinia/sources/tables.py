"""Unions and row slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinia.operators.prep import kth_smallest, sorted_index


def union_tables(*dfs: DataFrame) -> DataFrame:
    """Vertical concatenation by column name; missing columns -> null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def slice_rows(df: DataFrame, order_col: str, start: int, end: int | None = None) -> DataFrame:
    """Rows ``start..end`` (0-based, inclusive) in ``order_col`` order
    (files have no row order in Spark, so a unique key defines it);
    ``end=None`` slices the single row ``start``.

    With a numeric key the two bounding ranks are found by the distributed
    k-th value search, so a slice deep into a huge table never funnels the
    preceding rows through one task.  Other key types are sorted by range and numbered (a count per
    partition), so no task holds more than its range either.
    """
    n_end = end if end is not None else start
    if isinstance(df.schema[order_col].dataType, T.NumericType):
        lo = kth_smallest(df, order_col, start + 1)[0]
        total = df.where(F.col(order_col).isNotNull()).count()
        hi = kth_smallest(df, order_col, min(n_end + 1, total))[0]
        return df.where((F.col(order_col) >= F.lit(lo)) & (F.col(order_col) <= F.lit(hi)))
    numbered = sorted_index(df, [F.col(order_col)], out="_at", kind="long")
    return numbered.where(F.col("_at").between(start, n_end)).drop("_at")


def first_rows(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """The first ``n`` rows by key (a top-k)."""
    return df.orderBy(order_col).limit(n)
