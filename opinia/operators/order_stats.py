"""Exact order statistics of many columns and classes at once.

All ranks asked for, of every column and class, are found together.  A round marks values at fixed
shares of each open band (one aggregate) and counts the rows at and between the marks exactly (another one); the
rank lies at a mark, which is then its value, or strictly between two, which is the next band.  A band shrinks about
forty-fold a round, and always by its smallest and largest value, so a handful of jobs serve any number of
columns, classes and ranks.  Bands of at most ``max_band`` rows are read by one ranked query at the end.  The marks
are approximate quantiles, the counts are exact, and so are the values.  Some eighty numbers per band come back to
the driver in a round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinia.operators.joins import lookup_join
from opinia.session import local_df

MARKS = 40
MAX_BAND_ROWS = 200_000
MAX_GROUPS = 10_000


@dataclass
class _Search:
    """One rank of one column of one class: it is number ``left`` of the ``inside`` rows strictly between lo and hi
    (None: no bound)."""

    group: int
    col: str
    left: int
    inside: int
    lo: object = None
    hi: object = None
    value: object = None


def order_statistics(df: DataFrame, wanted: dict[str, Callable[[int], Sequence[int]]], by: str | None = None,
                     max_band: int = MAX_BAND_ROWS) -> dict[tuple, list]:
    """``{(class, column): [value of each rank]}``; ``wanted`` gives, per numeric column, the ranks (1-based) as a function
    of the number of its values; null and NaN are no values.  Without ``by`` the class is None; a null class is one like
    any other."""
    cols = list(wanted)
    kinds = dict(df.dtypes)
    values = [F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in cols]
    base = df.select(F.col(by).alias("_k") if by else F.lit(None).cast("string").alias("_k"), *values)
    sizes = base.groupBy("_k").agg(*[F.count(c).alias(c) for c in cols]).limit(MAX_GROUPS + 1).collect()
    if len(sizes) > MAX_GROUPS:
        raise ValueError("too many classes")
    rows = base.withColumn("_i", F.lit(0))
    if by:
        kind = dict(base.dtypes)["_k"]
        names = local_df(df.sparkSession, [(None if r["_k"] is None else str(r["_k"]), i) for i, r in enumerate(sizes)], "_n string, _i int")
        names = names.select(F.col("_n").cast(kind).alias("_n"), "_i")
        rows = lookup_join(base, names, base["_k"].eqNullSafe(names["_n"]))
    rows = rows.select("_i", *cols)
    found: dict[tuple, list[_Search]] = {}
    for i, r in enumerate(sizes):
        for c in cols:
            own = found.setdefault((r["_k"], c), [])
            for rank in wanted[c](r[c]) if r[c] else ():
                if not 1 <= rank <= r[c]:
                    raise ValueError(f"rank {rank} outside 1..{r[c]}")
                own.append(_Search(i, c, rank, r[c]))
    every = [s for own in found.values() for s in own]
    while open_ := [s for s in every if s.value is None and s.inside > max_band]:
        _narrow(rows, open_)
    _read(rows, [s for s in every if s.value is None])
    return {k: [s.value for s in own] for k, own in found.items()}


def _shared(searches: list[_Search]) -> list[list[_Search]]:
    """Searches by band."""
    bands: dict[tuple, list[_Search]] = {}
    for s in searches:
        bands.setdefault((s.group, s.col, s.lo, s.hi), []).append(s)
    return list(bands.values())


def _in_bands(rows: DataFrame, bands: list[_Search]) -> DataFrame:
    """``(j, v_<column>...)``: a row for each band that a value lies in, the value under its column's name."""
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    cols = sorted({s.col for s in bands})
    limits = local_df(spark, [(s.group, s.col, None if s.lo is None else str(s.lo), None if s.hi is None else str(s.hi), j)
                              for j, s in enumerate(bands)], "_i int, c string, lo string, hi string, j int")
    limits = limits.groupBy("_i").agg(*[F.collect_list(F.when(F.col("c") == c, F.struct(
        F.col("lo").cast(kinds[c]).alias("lo"), F.col("hi").cast(kinds[c]).alias("hi"), "j"))).alias(f"_b_{c}") for c in cols])
    x = lookup_join(rows, limits, "_i")  # one row per class

    def hits(c: str) -> Column:
        v = F.col(c)
        own = F.filter(f"_b_{c}", lambda b: v.isNotNull() & (b["lo"].isNull() | (v > b["lo"])) & (b["hi"].isNull() | (v < b["hi"])))
        one = F.transform(own, lambda b: F.struct(b["j"].alias("j"), *[
            (v if c == d else F.lit(None).cast(kinds[d])).alias(f"v_{d}") for d in cols]))
        empty = "array<struct<j:int," + ",".join(f"`v_{d}`:{kinds[d]}" for d in cols) + ">>"
        return F.coalesce(one, F.array().cast(empty))

    return x.select(F.explode(F.concat(*map(hits, cols))).alias("e")).select("e.*")


def _narrow(rows: DataFrame, searches: list[_Search]) -> None:
    bands = _shared(searches)
    inside = _in_bands(rows, [own[0] for own in bands])
    cols = sorted({s.col for s in searches})
    shares = [i / MARKS for i in range(MARKS + 1)]
    marks = inside.groupBy("j").agg(*[F.array_distinct(F.percentile_approx(f"v_{c}", shares, 100 * MARKS)).alias(f"m_{c}") for c in cols])
    marks = rows.sparkSession.createDataFrame(marks.toArrow()).select(marks.columns)  # one row per band
    # cell 2 i: between the marks i - 1 and i; cell 2 i + 1: at mark i
    cell = None
    for c in cols:
        below = F.size(F.filter(f"m_{c}", lambda m: m < F.col(f"v_{c}")))  # noqa: B023
        own = 2 * below + F.array_contains(f"m_{c}", F.col(f"v_{c}")).cast("int")
        cell = F.when(F.col(f"v_{c}").isNotNull(), own) if cell is None else cell.when(F.col(f"v_{c}").isNotNull(), own)
    counts: dict[int, dict[int, int]] = {}
    for r in inside.join(F.broadcast(marks), "j").groupBy("j", cell.alias("cell")).count().collect():
        counts.setdefault(r["j"], {})[r["cell"]] = r["count"]
    at = {r["j"]: r for r in marks.collect()}
    for j, own in enumerate(bands):
        values = sorted(at[j][f"m_{own[0].col}"])
        for s in own:
            for k in sorted(counts[j]):
                if s.left > counts[j][k]:
                    s.left -= counts[j][k]
                    continue
                if k % 2:
                    s.value = values[k // 2]
                else:
                    s.lo, s.hi = values[k // 2 - 1] if k else s.lo, values[k // 2] if k // 2 < len(values) else s.hi
                    s.inside = counts[j][k]
                break


def _read(rows: DataFrame, searches: list[_Search]) -> None:
    """The values of ranks in small bands: one query."""
    if not searches:
        return
    bands = _shared(searches)
    cols = sorted({s.col for s in searches})
    ranks = local_df(rows.sparkSession, [(j, r) for j, own in enumerate(bands) for r in sorted({s.left for s in own})], "j int, r long")
    order = Window.partitionBy("j").orderBy(*[F.col(f"v_{c}") for c in cols])  # the others are null
    ranked = _in_bands(rows, [own[0] for own in bands]).withColumn("r", F.row_number().over(order).cast("long"))
    held = {(r["j"], r["r"]): r for r in ranked.join(F.broadcast(ranks), ["j", "r"]).collect()}
    for j, own in enumerate(bands):
        for s in own:
            s.value = held[j, s.left][f"v_{s.col}"]
