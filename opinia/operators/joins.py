"""Join helpers: broadcast only a side whose size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A look-up side above this many rows is joined by shuffle instead.
DEFAULT_BROADCAST_ROWS = 2_000_000


def bounded(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Return ``broadcast(df)`` if ``df`` has at most ``max_rows`` rows, else
    ``df`` unchanged (sort-merge / shuffled hash join; AQE may still convert
    it at run time).  The check is one small job: ``limit(max_rows+1).count()``
    stops reading as soon as the bound is exceeded."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def strongest(lexicon: DataFrame, word: str, value: str) -> DataFrame:
    """One row per word of a lexicon: of repeated words the value furthest from
    zero counts (the positive one of two that are equally far)."""
    v = F.col(value)
    return lexicon.groupBy(word).agg(F.max_by(v, F.struct(F.abs(v), v)).alias(value))


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "inner",
                max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Equi-join a large table to a look-up table (lexicon, stop list,
    class counts, fitted parameters)."""
    return big.join(bounded(small, max_rows), on=on, how=how)
