"""Catalogue: feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinia.operators import prep as P
from opinia.plans.q_nested import EVENTS_WITH_NULLS, events_with_nulls
from opinia.operators.order_stats import order_statistics
from opinia.plans.registry import register
from opinia.session import local_df, table

F1_SQL = """
SELECT 'p_partkey' AS "column", 'numeric' AS role UNION ALL SELECT 'p_retailprice', 'numeric'
UNION ALL SELECT 'p_name', CASE WHEN count(DISTINCT p_name) <= 51 THEN 'categorical' ELSE 'text' END FROM part
UNION ALL SELECT 'p_brand', CASE WHEN count(DISTINCT p_brand) <= 51 THEN 'categorical' ELSE 'text' END FROM part
UNION ALL SELECT 'p_type', CASE WHEN count(DISTINCT p_type) <= 51 THEN 'categorical' ELSE 'text' END FROM part
"""


@register("f1_column_roles", F1_SQL, "F1 G4")
def f1_column_roles(spark, d):
    return P.roles_table(table(spark, d, "part"), target="p_size", threshold=51)


def _impute_sql(num_fill: str) -> str:
    u, v, p = EVENTS_WITH_NULLS["user_id"], EVENTS_WITH_NULLS["value"], EVENTS_WITH_NULLS["props"]
    return f"""
WITH e AS (SELECT event_id, event_type, {u} AS user_id, {v} AS value, {p} AS props FROM events)
SELECT event_id,
  round(coalesce(CAST(user_id AS DOUBLE), {num_fill.format(c='user_id')}), 6) AS user_id,
  round(coalesce(value, {num_fill.format(c='value')}), 6) AS value,
  coalesce(props, (SELECT props FROM e WHERE props IS NOT NULL GROUP BY props ORDER BY count(*) DESC, props LIMIT 1)) AS props
FROM e
"""


def _impute(spark, d, strategy):
    ev = events_with_nulls(spark, d).withColumn("user_id", F.col("user_id").cast("double"))
    out = P.impute(ev, ["user_id", "value"], ["props"], strategy)
    return out.select("event_id", F.round("user_id", 6).alias("user_id"), F.round("value", 6).alias("value"), "props")


MODE_SQL = "(SELECT {c} FROM e WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@register("f2_impute_mean", _impute_sql("(SELECT avg({c}) FROM e)"), "F2")
def f2_impute_mean(spark, d):
    return _impute(spark, d, "mean")


@register("f2_impute_median", _impute_sql("(SELECT quantile_cont({c}, 0.5) FROM e)"), "F2")
def f2_impute_median(spark, d):
    return _impute(spark, d, "median")


@register("f2_impute_mode", _impute_sql(MODE_SQL), "F2")
def f2_impute_mode(spark, d):
    return _impute(spark, d, "most_frequent")


SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scale_sql(kind: str) -> str:
    if kind == "standard":
        e = {c: f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)" for c in SCALE_COLS}
    elif kind == "minmax":
        e = {c: f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
             for c in SCALE_COLS}
    elif kind == "maxabs":
        e = {c: f"{c} / coalesce(nullif(max(abs({c})) OVER (), 0), 1)" for c in SCALE_COLS}
    else:
        norm = "sqrt(" + " + ".join(f"{c} * {c}" for c in SCALE_COLS) + ")"
        e = {c: f"{c} / (CASE WHEN {norm} = 0 THEN 1 ELSE {norm} END)" for c in SCALE_COLS}
    cols = ", ".join(f"round({x}, 6) AS {c}" for c, x in e.items())
    return f"SELECT l_orderkey, l_linenumber, {cols} FROM lineitem"


def _scale(spark, d, kind):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *SCALE_COLS)
    out = P.scale(li, SCALE_COLS, kind)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in SCALE_COLS])


for _kind, _tag in (("standard", "F4a"), ("minmax", "F4b"), ("maxabs", "F4c"), ("normalizer", "F4d")):
    register(f"f4_scale_{_kind}", _scale_sql(_kind), _tag)(lambda spark, d, _k=_kind: _scale(spark, d, _k))


F5_SQL = """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand,
       CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type
FROM part
"""


@register("f5_label_encode", F5_SQL, "F5")
def f5_label_encode(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    out, _ = P.label_encode(part, ["p_brand", "p_type"])
    return out


H60 = "('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 15))::BIGINT"

RESAMPLE_SQL = f"""
WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic),
small AS (SELECT toxic, n FROM c ORDER BY n, CAST(toxic AS VARCHAR) LIMIT 1),
large AS (SELECT toxic, n FROM c ORDER BY n DESC, CAST(toxic AS VARCHAR) DESC LIMIT 1),
r AS (SELECT l.doc_id, l.toxic, row_number() OVER (PARTITION BY l.toxic ORDER BY {H60}, CAST(l.doc_id AS VARCHAR)) AS rn
      FROM labels l)
"""
F8_SQL = RESAMPLE_SQL + """
SELECT doc_id, toxic FROM r WHERE toxic <> (SELECT toxic FROM small)
UNION ALL
SELECT doc_id, toxic FROM (
  SELECT doc_id, toxic, unnest(range(((SELECT n FROM large) // (SELECT n FROM small))
         + CASE WHEN rn <= (SELECT n FROM large) % (SELECT n FROM small) THEN 1 ELSE 0 END)) AS copy
  FROM r WHERE toxic = (SELECT toxic FROM small))
"""


@register("f8_oversample", F8_SQL, "F8")
def f8_oversample(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "toxic")
    return P.resample(lab, "toxic", "over", key="doc_id", seed=42)


F9_SQL = RESAMPLE_SQL + """
SELECT doc_id, toxic FROM r WHERE toxic <> (SELECT toxic FROM large)
   OR rn <= (SELECT n FROM small)
"""


@register("f9_undersample", F9_SQL, "F9")
def f9_undersample(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "toxic")
    return P.resample(lab, "toxic", "under", key="doc_id", seed=42)


F10A_SQL = """
SELECT doc_id, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'dev' ELSE 'test' END AS part
FROM (SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents)
"""


@register("f10a_split", F10A_SQL, "F10a")
def f10a_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return P.split_column(docs, "doc_id", (0.6, 0.2, 0.2), seed=42)


F10B_SQL = f"""
SELECT doc_id, CASE WHEN rn <= floor({0.6!r} * n + 0.5) THEN 'train'
                    WHEN rn <= floor({0.6 + 0.2!r} * n + 0.5) THEN 'dev' ELSE 'test' END AS part
FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY {H60}, CAST(doc_id AS VARCHAR)) AS rn,
             count(*) OVER (PARTITION BY quality) AS n FROM labels)
"""


@register("f10b_stratified_split", F10B_SQL, "F10b F10c")
def f10b_stratified_split(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return P.split_column(lab, "doc_id", (0.6, 0.2, 0.2), seed=42, stratify="quality").select("doc_id", "part")


# ---------------------------------------------------------------- one search for many ranks

F2_MANY = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
F2_MANY_SQL = " UNION ALL ".join(f"SELECT '{c}' AS column, CAST(quantile_cont(CAST({c} AS DOUBLE), 0.5) AS DOUBLE) AS median FROM lineitem" for c in F2_MANY)


@register("f2_medians_of_all_columns", F2_MANY_SQL, "F2")
def f2_medians_of_all_columns(spark, d):
    """Exact medians of four columns by one search, in bands of at most 1,000 rows."""
    items = table(spark, d, "lineitem").select(*F2_MANY)
    found = order_statistics(items, {c: lambda n: [(n + 1) // 2, n // 2 + 1] for c in F2_MANY}, max_band=1000)
    return local_df(spark, [(c, (float(found[None, c][0]) + float(found[None, c][1])) / 2) for c in F2_MANY], "column string, median double")


RANK_SQL = """
SELECT l_returnflag, CAST(CASE WHEN rn = 1 THEN 0 WHEN rn = n THEN 100 ELSE 10 END AS INTEGER) AS share, CAST(l_extendedprice AS DOUBLE) AS price
FROM (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn,
             count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
WHERE rn IN (1, (n + 9) // 10, n)
"""


@register("f2_order_statistics_by_class", RANK_SQL, "F2 F10b")
def f2_order_statistics_by_class(spark, d):
    """Smallest, tenth-share and largest price of each class, by one search for all classes."""
    items = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    found = order_statistics(items, {"l_extendedprice": lambda n: [1, (n + 9) // 10, n]}, by="l_returnflag", max_band=1000)
    rows = [(k, share, float(v)) for (k, _), values in found.items() for share, v in zip((0, 10, 100), values, strict=True)]
    return local_df(spark, rows, "l_returnflag string, share int, price double")


F10A_EXACT_SQL = f"""
SELECT doc_id, CASE WHEN rn <= floor({0.6!r} * n + 0.5) THEN 'train' WHEN rn <= floor({0.6 + 0.2!r} * n + 0.5) THEN 'dev' ELSE 'test' END AS part
FROM (SELECT doc_id, row_number() OVER (ORDER BY {H60}, CAST(doc_id AS VARCHAR)) AS rn, count(*) OVER () AS n FROM documents)
"""


@register("f10a_split_exact", F10A_EXACT_SQL, "F10a")
def f10a_split_exact(spark, d):
    return P.split_column(table(spark, d, "documents").select("doc_id"), "doc_id", (0.6, 0.2, 0.2), seed=42, exact=True)


F10C_SQL = f"""
SELECT doc_id, CASE WHEN rn <= floor({0.8!r} * n + 0.5) THEN 'train' ELSE 'test' END AS part
FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY {H60}, CAST(doc_id AS VARCHAR)) AS rn,
             count(*) OVER (PARTITION BY quality) AS n FROM labels)
"""


@register("f10c_split_80_20", F10C_SQL, "F10c")
def f10c_split_80_20(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return P.split_column(lab, "doc_id", (0.8, 0.2), seed=42, names=("train", "test"), stratify="quality").select("doc_id", "part")


F10C_PLAIN_SQL = """
SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' ELSE 'test' END AS part
FROM (SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents)
"""


@register("f10c_split_80_20_plain", F10C_PLAIN_SQL, "F10c")
def f10c_split_80_20_plain(spark, d):
    return P.split_column(table(spark, d, "documents").select("doc_id"), "doc_id", (0.8, 0.2), seed=42, names=("train", "test"))
