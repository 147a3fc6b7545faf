"""Rows dealt over the cores before work that is heavy per row.

A scan gives at most one task per row group of a file, so a few hundred MB of texts in one group are
cleaned, cut and counted by one core, and a table kept from it is read by one."""

from __future__ import annotations

from pyspark.sql import DataFrame

SPREAD_ROWS = 2_000


def spread(df: DataFrame, *cols: str, rows_per_task: int = SPREAD_ROWS) -> DataFrame:
    """``df`` in tasks of about ``rows_per_task`` rows, at least one per core, by the hash of ``cols`` (key and
    content, so that rows of a repeated or null key part unless their content is equal).  Few rows and streams stay as they are."""
    if df.isStreaming:
        return df
    rows = df.count()
    if rows <= rows_per_task:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_task)), *cols)
