"""Feature preparation.

Fitted parameters (means, bounds, modes, codes, class counts) are small and
come back to the driver as one row, like MLlib's fitted models; applying them
is a narrow ``select`` with literals.  Ranking inside a class (resampling,
stratified splits, exact median) never uses a window over the class: the k-th
value is found by ``kth_smallest``, which narrows a value band with
``percentile_approx`` until it is small, so no task ever holds a whole class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinia.operators.few_values import few_distinct
from opinia.operators.joins import lookup_join
from opinia.operators.order_stats import order_statistics
from opinia.session import local_df

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
MAX_BAND_ROWS = 200_000
MAX_CLASSES = 10_000


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- hashing

def hash_unit(key, seed: int) -> Column:
    """Uniform [0,1) from the first 32 bits of md5(key:seed) — identical in
    DuckDB (``('0x'||substr(md5(k||':'||seed),1,8))::BIGINT / 2^32``)."""
    h = F.md5(F.concat(_c(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_rank_key(key, seed: int) -> Column:
    """60-bit md5 prefix of key:seed — the order used for seeded ranking."""
    h = F.md5(F.concat(_c(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


# ---------------------------------------------------------------- k-th value

def kth_smallest(df: DataFrame, col: str, k: int, tie: str | None = None,
                 max_band: int = MAX_BAND_ROWS, accuracy: int = 100_000):
    """Exact k-th smallest (1-based) non-null value of a numeric column, with
    an optional tie-break column: returns ``(value, tie_value)``.

    The band [lo, hi] that holds rank k is narrowed with approximate
    quantiles and verified by exact counts; when it holds at most ``max_band``
    rows, the answer is a top-k on the band.  Every step is a distributed
    aggregate; no partition or task sees more than the band.
    """
    cols = [col] + ([tie] if tie else [])
    band = df.select(*cols).where(F.col(col).isNotNull())
    n = band.count()
    if not 1 <= k <= n:
        raise ValueError(f"k={k} outside 1..{n}")
    r = k
    eps = 10.0 / accuracy
    while n > max_band:
        q = r / n
        lo_q, hi_q = max(0.0, q - eps), min(1.0, q + eps)
        lo, hi = band.agg(F.percentile_approx(col, [lo_q, hi_q], accuracy)).first()[0]
        st = band.agg(
            F.count_if(F.col(col) < lo).alias("below"),
            F.count_if((F.col(col) >= lo) & (F.col(col) <= hi)).alias("inside"),
        ).first()
        if st.below < r <= st.below + st.inside and st.inside < n:
            band = band.where((F.col(col) >= lo) & (F.col(col) <= hi))
            r -= st.below
            n = st.inside
            eps = 10.0 / accuracy
        elif lo_q == 0.0 and hi_q == 1.0:
            # massive ties: step over the smallest value, or settle on it
            low, times = band.groupBy(col).count().orderBy(col).limit(1).first()
            if r > times:
                band, r, n = band.where(F.col(col) > low), r - times, n - times
            elif tie is None:
                return low, None
            else:
                return low, kth_of_ties(band.where(F.col(col) == low).select(tie), tie, r, times, max_band)
        else:
            eps *= 4
    order = [F.col(c) for c in cols]
    row = band.orderBy(*order).offset(r - 1).limit(1).first()
    return row[0], (row[1] if tie else None)


def kth_of_ties(df: DataFrame, col: str, k: int, n: int, max_band: int):
    """k-th smallest of a column of any type: bands between sampled values, counted
    exactly, until one holds at most ``max_band`` rows."""
    while n > max_band:
        marks = sorted({r[0] for r in df.orderBy(F.xxhash64(col)).limit(200).collect()})
        slot = F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m < F.col(col)))
        sizes = {r[0]: r[1] for r in df.groupBy(slot.alias("s")).count().collect()}
        at = 0
        while k > sizes.get(at, 0):
            k -= sizes.get(at, 0)
            at += 1
        if sizes[at] == n:  # all rows hold one value, or one hash-sampled mark parts nothing
            low, times = df.groupBy(col).count().orderBy(col).limit(1).first()
            if k <= times:
                return low
            df, k, n = df.where(F.col(col) > low), k - times, n - times
            continue
        df, n = df.where(slot == at), sizes[at]
    return df.orderBy(col).offset(k - 1).limit(1).first()[0]


def rank_at_most(col: str, tie: str | None, threshold) -> Column:
    """Rows ranked at or before the threshold returned by ``kth_smallest``."""
    v, t = threshold
    c = F.col(col) < F.lit(v)
    if tie is None:
        return F.col(col) <= F.lit(v)
    return c | ((F.col(col) == F.lit(v)) & (F.col(tie) <= F.lit(t)))


def exact_median(df: DataFrame, col: str) -> float | None:
    n = df.where(F.col(col).isNotNull()).count()
    if n == 0:
        return None
    if n % 2:
        return float(kth_smallest(df, col, (n + 1) // 2)[0])
    a = kth_smallest(df, col, n // 2)[0]
    b = kth_smallest(df, col, n // 2 + 1)[0]
    return (float(a) + float(b)) / 2.0


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact medians of all columns by one search (``order_stats``)."""
    both = order_statistics(df, {c: lambda n: sorted({(n + 1) // 2, n // 2 + 1}) for c in cols}) if cols else {}
    return {c: sum(map(float, both[None, c])) / len(both[None, c]) if both.get((None, c)) else None for c in cols}


# ---------------------------------------------------------------- F1 roles

@dataclass
class Roles:
    numeric: list[str]
    categorical: list[str]
    text: list[str]
    n_distinct: dict[str, int] = field(default_factory=dict)


def column_roles(df: DataFrame, target: str | None = None, threshold: int = 51) -> Roles:
    """numeric = numeric types (minus target); categorical = string with
    at most ``threshold`` distinct non-null values; text = other strings.
    One job counts the distinct values of the string columns, up to ``threshold`` + 1 of each
    (``few_values``); ``n_distinct`` has these counts."""
    numeric, strings = [], []
    for f in df.schema.fields:
        if f.name == target:
            continue
        if isinstance(f.dataType, NUMERIC_TYPES):
            numeric.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            strings.append(f.name)
    counts = dict.fromkeys(strings, 0)
    if strings:
        counts |= {r["column"]: r["n_distinct"] for r in few_distinct(df, strings, threshold).collect()}
    cat = [c for c in strings if counts[c] <= threshold]
    text = [c for c in strings if counts[c] > threshold]
    return Roles(numeric, cat, text, counts)


def roles_table(df: DataFrame, target: str | None = None, threshold: int = 51) -> DataFrame:
    """F1 as a DataFrame ``(column, role)`` built without a driver loop over
    data: the distinct counts come from one aggregate, the role is an
    expression on it."""
    numeric, strings = [], []
    for f in df.schema.fields:
        if f.name == target:
            continue
        if isinstance(f.dataType, NUMERIC_TYPES):
            numeric.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            strings.append(f.name)
    spark = df.sparkSession
    num = local_df(spark, [(c, "numeric") for c in numeric], "column string, role string")
    if not strings:
        return num
    n = few_distinct(df, strings, threshold)
    long = local_df(spark, strings, "column string").join(n, "column", "left").select(
        "column", F.when(F.coalesce("n_distinct", F.lit(0)) <= threshold, "categorical").otherwise("text").alias("role")
    )
    return num.unionByName(long)


# ---------------------------------------------------------------- F2 impute

def mode_value(df: DataFrame, col: str):
    """Most frequent non-null value; the smallest one on ties.  Partial
    aggregation per value, then a top-1."""
    row = (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), F.asc(col))
        .limit(1)
        .first()
    )
    return None if row is None else row[0]


@dataclass
class Imputer:
    fill: dict

    def transform(self, df: DataFrame) -> DataFrame:
        present = {k: v for k, v in self.fill.items() if v is not None and k in df.columns}
        return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in present.items()})


def fit_impute(df: DataFrame, num: list[str], cat: list[str], strategy: str = "mean") -> Imputer:
    """numeric columns by mean / exact median / most frequent; categorical
    columns always by the mode."""
    fill = {}
    if num and strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in num]).first()
        fill.update({c: row[c] for c in num})
    elif strategy == "median":
        fill.update(exact_medians(df, num))
    elif strategy in ("most_frequent", "mode"):
        fill.update({c: mode_value(df, c) for c in num})
    elif num:
        raise ValueError(f"unknown strategy {strategy}")
    fill.update({c: mode_value(df, c) for c in cat})
    return Imputer(fill)


def impute(df: DataFrame, num: list[str], cat: list[str], strategy: str = "mean") -> DataFrame:
    return fit_impute(df, num, cat, strategy).transform(df)


# ---------------------------------------------------------------- F4 scale

@dataclass
class Scaler:
    kind: str
    params: dict

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        if self.kind == "standard":
            return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in p.items()})
        if self.kind == "minmax":
            return df.withColumns(
                {c: F.when(F.lit(hi - lo) == 0, F.lit(0.0)).otherwise((F.col(c) - F.lit(lo)) / F.lit(hi - lo))
                 for c, (lo, hi) in p.items()}
            )
        if self.kind == "maxabs":
            return df.withColumns({c: F.col(c) / F.lit(m) for c, m in p.items()})
        if self.kind == "normalizer":
            cols = p["cols"]
            norm = F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))
            safe = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
            return df.withColumns({c: F.col(c) / safe for c in cols})
        raise ValueError(self.kind)


def fit_scale(df: DataFrame, cols: list[str], kind: str = "standard") -> Scaler:
    """``standard`` (population sigma; sigma 0 -> 1), ``minmax`` (constant
    -> 0), ``maxabs`` (0 -> 1), ``normalizer`` (row L2, no fit)."""
    if kind == "normalizer":
        return Scaler(kind, {"cols": list(cols)})
    if kind == "standard":
        row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
        return Scaler(kind, {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in cols})
    if kind == "minmax":
        row = df.agg(*[F.min(c).alias(f"a_{c}") for c in cols], *[F.max(c).alias(f"b_{c}") for c in cols]).first()
        return Scaler(kind, {c: (float(row[f"a_{c}"]), float(row[f"b_{c}"])) for c in cols})
    if kind == "maxabs":
        row = df.agg(*[F.max(F.abs(c)).alias(c) for c in cols]).first()
        return Scaler(kind, {c: (float(row[c]) or 1.0) for c in cols})
    raise ValueError(kind)


def scale(df: DataFrame, cols: list[str], kind: str = "standard") -> DataFrame:
    return fit_scale(df, cols, kind).transform(df)


# ---------------------------------------------------------------- F5 encode

def label_codes(df: DataFrame, col: str) -> DataFrame:
    """F5 fitted table ``(value, code)``: code = rank of the sorted distinct
    values from 0, null last.  Ranked by ``sorted_index`` (no single-partition
    window, whatever the number of distinct values)."""
    d = df.select(F.col(col).alias("value")).distinct()
    return sorted_index(d, [F.col("value").asc_nulls_last()], out="code")


def label_encode(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """replace each column by its code (null-safe join to the codes)."""
    codes = {}
    out = df
    for c in cols:
        t = label_codes(df, c)
        codes[c] = t
        m = t.select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_k_{c}"))
        out = lookup_join(out, m, out[c].eqNullSafe(m[f"_v_{c}"]), "left").drop(c, f"_v_{c}").withColumnRenamed(
            f"_k_{c}", c
        )
    return out.select(*df.columns), codes


# ---------------------------------------------------------------- F8/F9 resample

def class_counts(df: DataFrame, label: str, max_classes: int = MAX_CLASSES) -> dict:
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} classes")
    return {r[label]: r["n"] for r in rows}


def resample(df: DataFrame, label: str, how: str, key: str, seed: int = 42) -> DataFrame:
    """F8 (``over``): the smallest class is copied up to the size of the
    largest: ``max // min`` copies of every row plus one more for the first
    ``max % min`` rows in seeded hash order.  F9 (``under``): the largest
    class keeps its first ``min`` rows in that order.  Other classes are
    untouched; sizes are exact and the result is deterministic.  Null is a class
    like any other."""
    counts = class_counts(df, label)
    small = min(counts, key=lambda k: (counts[k], str(k)))
    large = max(counts, key=lambda k: (counts[k], str(k)))
    n_min, n_max = counts[small], counts[large]
    h = df.withColumn("_h", hash_rank_key(key, seed)).withColumn("_t", F.col(key).cast("string"))
    if how == "over":
        base, extra = divmod(n_max, n_min)
        cls = h.where(F.col(label).eqNullSafe(F.lit(small)))
        if extra:
            thr = kth_smallest(cls, "_h", extra, tie="_t")
            reps = F.lit(base) + F.when(rank_at_most("_h", "_t", thr), 1).otherwise(0)
        else:
            reps = F.lit(base)
        grown = cls.withColumn("_copy", F.explode(F.sequence(F.lit(1), reps))).drop("_copy")
        rest = h.where(~F.col(label).eqNullSafe(F.lit(small)))
        return rest.unionByName(grown).drop("_h", "_t")
    if how == "under":
        cls = h.where(F.col(label).eqNullSafe(F.lit(large)))
        thr = kth_smallest(cls, "_h", n_min, tie="_t")
        kept = cls.where(rank_at_most("_h", "_t", thr))
        rest = h.where(~F.col(label).eqNullSafe(F.lit(large)))
        return rest.unionByName(kept).drop("_h", "_t")
    raise ValueError(how)


# ---------------------------------------------------------------- F10 split

def split_column(df: DataFrame, key: str, ratios=(0.6, 0.2, 0.2), seed: int = 42,
                 names=("train", "dev", "test"), stratify: str | None = None, exact: bool = False) -> DataFrame:
    """add a ``part`` column.

    Plain: md5 bucket of ``key:seed`` against cumulative ratios — scalable,
    plan-independent, sizes approximate.  ``exact``: the rows are ranked by the 60-bit md5
    key and cut at ``round(cum_ratio * n)``.  Stratified: the same within each class
    — exact per-class sizes; rows of equal keys stay together.  Classes of at most ``MAX_BAND_ROWS`` rows are
    ranked together by one window (bounded groups); larger classes get their
    cut points from distributed k-th-value searches, so no task holds a big
    class.
    """
    cum = []
    acc = 0.0
    for r in ratios[:-1]:
        acc += r
        cum.append(acc)
    if stratify is None and exact:
        return _cut_by_hash(df.withColumn("_h", hash_rank_key(key, seed)), cum, names, None).drop("_h")
    if stratify is None:
        u = hash_unit(key, seed)
        expr = F.lit(names[-1])
        for name, c in reversed(list(zip(names[:-1], cum))):
            expr = F.when(u < F.lit(c), F.lit(name)).otherwise(expr)
        return df.withColumn("part", expr)
    from pyspark.sql import Window

    h = df.withColumn("_h", hash_rank_key(key, seed))
    counts = class_counts(df, stratify)
    small = {c: n for c, n in counts.items() if n <= MAX_BAND_ROWS}
    large = {c: n for c, n in counts.items() if n > MAX_BAND_ROWS}

    def cut(i: int, n: Column) -> Column:
        return F.floor(F.lit(cum[i]) * n + 0.5)

    parts = []
    if small:
        # classes of bounded size: one window ranks them all in a single job
        is_small = F.col(stratify).isin(list(small)) if None not in small else (
            F.col(stratify).isin([c for c in small if c is not None]) | F.col(stratify).isNull())
        sub = h.where(is_small)
        w = Window.partitionBy(stratify).orderBy("_h")
        # rank: rows that share a key stay together, as below
        sub = sub.withColumn("_rn", F.rank().over(w)).withColumn(
            "_n", F.count(F.lit(1)).over(Window.partitionBy(stratify)))
        expr = F.lit(names[-1])
        for i in reversed(range(len(cum))):
            expr = F.when(F.col("_rn") <= cut(i, F.col("_n")), F.lit(names[i])).otherwise(expr)
        parts.append(sub.withColumn("part", expr).drop("_rn", "_n"))
    if large:
        # big classes: the cut points of all of them by one search
        sub = h.where(reduce(lambda a, c: a | F.col(stratify).eqNullSafe(F.lit(c)), large, F.lit(False)))
        parts.append(_cut_by_hash(sub, cum, names, stratify))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_h")


def _cut_by_hash(h: DataFrame, cum: list[float], names, by: str | None) -> DataFrame:
    """``part`` of rows with their hash ``_h``: exact ranks within each class of ``by``, from one search for all
    classes and cuts."""
    found = order_statistics(h, {"_h": lambda n: [max(int(math.floor(c * n + 0.5)), 1) for c in cum]}, by=by, max_band=MAX_BAND_ROWS)
    sizes = class_counts(h, by) if by else {None: h.count()}
    expr = F.lit(names[-1])
    for i in reversed(range(len(cum))):
        cond = F.lit(False)
        for (cls, _), values in found.items():
            if values and math.floor(cum[i] * sizes[cls] + 0.5) >= 1:
                cond = cond | ((F.col(by).eqNullSafe(F.lit(cls)) if by else F.lit(True)) & (F.col("_h") <= F.lit(values[i])))
        expr = F.when(cond, F.lit(names[i])).otherwise(expr)
    return h.withColumn("part", expr)


def sorted_index(df: DataFrame, order: list[Column], out: str = "idx", kind: str = "int") -> DataFrame:
    """Position (0-based) of every row in a global order, without a
    single-partition window: a range-partitioned sort, one count per
    partition (a row per partition comes back), then
    ``offset[partition] + position in partition``."""
    s = (
        df.orderBy(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        .persist()
    )
    counts = sorted((r["_pid"], r["n"]) for r in s.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc = {}, 0
    for pid, n in counts:
        offsets[pid] = acc
        acc += n
    if not offsets:
        return s.drop("_pid", "_mid").withColumn(out, F.lit(None).cast(kind))
    off = F.create_map(*[x for pid, o in offsets.items() for x in (F.lit(pid), F.lit(o))])
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return s.withColumn(out, (off[F.col("_pid")] + pos).cast(kind)).drop("_pid", "_mid")
