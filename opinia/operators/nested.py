"""Nested data held as Python literals in listing columns.

Parsing is ``from_json`` (see ``opinia.functions.literal``); unnesting is
``inline``/``posexplode``.  Nothing groups rows: every operator is a narrow
transformation, except ``first_comments`` (a top-k, by design).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinia.functions import literal as LIT
from opinia.functions.labels import overall_rating as _overall
from opinia.functions.text import strip_ws

# Distinct keys of a dict column become column names: bound them.
MAX_FLATTEN_KEYS = 1000


def explode_reviews(df: DataFrame, id_col: str = "_id", col: str = "reviews",
                    keep_empty: bool = False, group_col: str = "pais") -> DataFrame:
    """N2 (``keep_empty=False``): ``(_id, comment_id, review)`` for each list
    element with a non-empty id and text; malformed cells give no rows.

    N3 (``keep_empty=True``): ``(pais, hotel_id, fecha_review, review)`` for
    every element; a missing (or null) ``date``/``comments`` becomes ``''``.
    """
    parsed = LIT.parse_literal(col, LIT.REVIEW_SCHEMA, require="list")
    if not keep_empty:
        x = df.select(F.col(id_col).alias("_id"), F.explode(parsed).alias("r"))
        cid, txt = F.col("r._id"), F.col("r.comments")
        return x.where(cid.isNotNull() & (cid != "") & txt.isNotNull() & (txt != "")).select(
            "_id", cid.alias("comment_id"), txt.alias("review")
        )
    x = df.select(F.col(group_col).alias("pais"), F.col(id_col).alias("hotel_id"), F.explode(parsed).alias("r"))
    return x.select(
        "pais", "hotel_id",
        F.coalesce(F.col("r.date"), F.lit("")).alias("fecha_review"),
        F.coalesce(F.col("r.comments"), F.lit("")).alias("review"),
    )


def first_comments(df: DataFrame, order_cols: list[str], col: str = "reviews", n: int = 100) -> DataFrame:
    """The first ``n`` non-blank comments overall, in row order then list
    order.  ``orderBy(...).limit(n)`` plans as a TakeOrdered top-k: each task
    keeps n rows, the driver merges n x tasks rows."""
    parsed = LIT.parse_literal(col, LIT.REVIEW_SCHEMA, require="list")
    x = df.select(*order_cols, F.posexplode(parsed).alias("_pos", "r"))
    txt = F.col("r.comments")
    return (
        x.where(txt.isNotNull() & (F.length(strip_ws(txt)) > 0))
        .orderBy(*order_cols, "_pos")
        .limit(n)
        .select(*order_cols, "_pos", txt.alias("review"))
    )


def map_keys_of(df: DataFrame, col: str, max_keys: int = MAX_FLATTEN_KEYS) -> list[str]:
    """Distinct keys of a map column (one small distributed job; the result
    is bounded because it becomes a schema)."""
    keys = (
        df.select(F.explode(F.map_keys(F.col(col))).alias("k")).distinct().limit(max_keys + 1).collect()
    )
    if len(keys) > max_keys:
        raise ValueError(f"{col} has more than {max_keys} distinct keys")
    return sorted(r.k for r in keys)


def flatten_map(df: DataFrame, col: str, keys: list[str] | None = None,
                value_type: T.DataType = T.DoubleType()) -> DataFrame:
    """A dict literal column -> one column per key (original dropped).  A value
    that is not of ``value_type`` is null; it does not touch the others."""
    m = F.from_json(LIT.to_json_text(F.col(col)), T.MapType(T.StringType(), T.StringType()), LIT.JSON_OPTIONS)
    tmp = df.withColumn("_m", m)
    keys = keys if keys is not None else map_keys_of(tmp, "_m")
    return tmp.select(*[c for c in df.columns if c != col], *[F.col("_m")[k].try_cast(value_type).alias(k) for k in keys])


def flatten_array(df: DataFrame, col: str, prefix: str = "review_score_", n: int | None = None) -> DataFrame:
    """List column (or list literal: numbers) -> ``prefix1..prefixN`` (N = longest
    list unless given; finding it is one aggregate job)."""
    values = F.col(col)
    if isinstance(df.schema[col].dataType, T.StringType):
        values = F.transform(LIT.parse_literal(col, LIT.SCORE_LIST_SCHEMA, require="list"), lambda x: x.try_cast("double"))
    if n is None:
        n = df.agg(F.max(F.size(values))).first()[0] or 0
    return df.select(
        *[c for c in df.columns if c != col], *[F.get(values, i).alias(f"{prefix}{i + 1}") for i in range(n)]
    )


def overall_rating(df: DataFrame, col: str = "review_scores", key: str = "review_scores_rating",
                   out: str = "review_score") -> DataFrame:
    """``round(scores[key] / 10, 1)`` half-even; absent/bad -> null."""
    m = LIT.parse_literal(col, LIT.SCORES_SCHEMA, require="dict")
    if key == "review_scores_rating":
        expr = _overall(m)
    else:
        expr = F.bround(m.getItem(key).try_cast("double") / 10.0, 1)
    return df.withColumn(out, expr)


def address_fields(df: DataFrame, col: str = "address", drop: bool = True) -> DataFrame:
    """Address literal -> ``city`` (market), ``latitude``, ``longitude``.
    Coordinates are stored (lon, lat); anything but two values gives nulls."""
    a = LIT.parse_literal(col, LIT.ADDRESS_SCHEMA, require="dict")
    coords = a["location"]["coordinates"]
    two = F.size(coords) == 2
    out = df.withColumns(
        {
            "city": a["market"],
            "latitude": F.when(two, F.get(coords, 1)),
            "longitude": F.when(two, F.get(coords, 0)),
        }
    )
    return out.drop(col) if drop else out


def address_country(col) -> Column:
    """The ``country`` of an address literal (null if malformed)."""
    return LIT.parse_literal(col, LIT.ADDRESS_SCHEMA, require="dict")["country"]


def split_reviews(df: DataFrame, col: str, sep: str = "\n", keep: list[str] | None = None) -> DataFrame:
    """One text holding several reviews -> one row per piece
    ``(*keep, pos, review)``; pieces are stripped, blank ones dropped;
    ``pos`` is the 0-based piece index before dropping."""
    keep = keep if keep is not None else [c for c in df.columns if c != col]
    pattern = "\\|" if sep == "|" else sep.replace("\n", "\\n")
    x = df.select(*keep, F.posexplode(F.split(F.col(col), pattern)).alias("pos", "_p"))
    return x.select(*keep, "pos", strip_ws("_p").alias("review")).where(F.col("review") != "")


def transform_nested(df: DataFrame, col: str, field: str | None, fn) -> DataFrame:
    """Apply a column function to one field of every element of a nested
    column.  An array of structs keeps its type; a literal becomes an array of
    maps with all keys of each dict (values as text), or, with ``field=None``,
    an array of the transformed strings; a literal that is no list is
    transformed as a whole and comes back as its one element."""
    c = F.col(col)
    if not isinstance(df.schema[col].dataType, T.StringType):
        return df.withColumn(col, F.transform(c, lambda x: x.withField(field, fn(x[field]))))
    if field is None:
        items = LIT.parse_literal(col, T.ArrayType(T.StringType()), require="list")
        return df.withColumn(col, F.when(c.isNotNull(), F.coalesce(F.transform(items, fn), F.array(fn(c)))))
    items = LIT.parse_literal(col, T.ArrayType(T.MapType(T.StringType(), T.StringType())), require="list")
    changed = F.transform(items, lambda x: F.transform_values(x, lambda k, v: F.when(k == field, fn(v)).otherwise(v)))
    return df.withColumn(col, changed)


def count_nested(df: DataFrame, cols: list[str], field: str = "comments") -> DataFrame:
    """Number of work items in nested columns: per list cell the number
    of elements having ``field``, otherwise 1 per non-null cell."""
    parts = []
    for c in cols:
        parsed = LIT.parse_literal(c, LIT.REVIEW_SCHEMA, require="list")
        n = F.when(parsed.isNotNull(), F.size(F.filter(parsed, lambda x: x[field].isNotNull()))).when(
            F.col(c).isNotNull(), F.lit(1)
        ).otherwise(F.lit(0))
        parts.append(F.sum(n).cast("bigint").alias(f"{c}_items"))
    return df.agg(*parts)


def flatten_dict(df: DataFrame, col: str, max_keys: int = MAX_FLATTEN_KEYS) -> DataFrame:
    """N5 (nested dicts): a dict literal column -> one column per leaf key of any
    row, nested keys joined with ``.`` (the original column is dropped).  The
    keys are gathered from the whole column, one job per level of nesting.  A
    column is a whole number, a double or text, whatever all its values are."""
    level = {"": F.from_json(LIT.to_json_text(F.col(col)), T.MapType(T.StringType(), T.StringType()), LIT.JSON_OPTIONS)}
    leaves: dict[str, Column] = {}
    while level:
        deeper = {}
        for path, m in level.items():
            pairs = df.select(F.explode(m).alias("k", "v"))
            nested = F.col("v").startswith("{")
            plain = F.when(~nested, F.col("v"))
            kinds = pairs.groupBy("k").agg(
                F.coalesce(F.bool_or(nested), F.lit(False)).alias("nested"), F.count(plain).alias("n"),
                F.count(plain.try_cast("bigint")).alias("whole"), F.count(plain.try_cast("double")).alias("number"),
            ).limit(max_keys + 1).collect()
            if len(kinds) > max_keys:
                raise ValueError(f"{col} has more than {max_keys} distinct keys")
            for r in sorted(kinds, key=lambda r: r.k):
                name, value = f"{path}{r.k}", m[r.k]
                if r.n or not r.nested:
                    kind = "bigint" if r.whole == r.n else "double" if r.number == r.n else "string"
                    leaves[name] = F.when(~value.startswith("{"), value).try_cast(kind)
                if r.nested:
                    deeper[f"{name}."] = F.from_json(F.when(value.startswith("{"), value), T.MapType(T.StringType(), T.StringType()),
                                                     LIT.JSON_OPTIONS)
        level = deeper
    return df.select(*[c for c in df.columns if c != col], *[leaves[k].alias(k) for k in sorted(leaves)])
