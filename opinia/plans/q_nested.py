"""Catalogue: nested literal columns (N1-N12) and aggregations.

Listing-style tables are derived from the test tables by Spark:
``conversations`` become listings whose ``reviews`` cell is a Python-literal
list of at most 8 ``{_id, date, comments}`` dicts (key: conversation, role and
turn // 8 — a bounded group, so no cell grows with the data), and
``customer ⋈ nation`` gives address literals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from opinia.functions.text import clean_output, py_str_literal
from opinia.operators import aggregates as G
from opinia.operators import clean as C
from opinia.operators import nested as N
from opinia.plans import sqlfrag as S
from opinia.plans.registry import register
from opinia.session import table

CHUNK = 8
LISTING_ID_SQL = f"concat_ws('-', conv_id, role, turn // {CHUNK})"


def listings(spark, d):
    conv = table(spark, d, "conversations")
    item = F.concat(
        F.lit("{'_id': '"), F.col("turn").cast("string"), F.lit("', 'date': 't"), F.col("turn").cast("string"),
        F.lit("', 'comments': "), py_str_literal("text"), F.lit("}"),
    )
    chunk = F.floor(F.col("turn") / CHUNK).cast("bigint")
    grouped = conv.groupBy("conv_id", "role", chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn"), item.alias("s")))).alias("items")
    )
    return grouped.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), "role", F.col("chunk").cast("string")).alias("_id"),
        F.col("role").alias("pais"),
        F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["s"]), ", "), F.lit("]")).alias("reviews"),
    )


def addresses(spark, d):
    cust = table(spark, d, "customer")
    nat = table(spark, d, "nation")
    coords = F.when(
        F.col("c_acctbal") >= 0,
        F.concat(F.col("c_acctbal").cast("string"), F.lit(", "), F.col("c_custkey").cast("double").cast("string")),
    ).otherwise(F.col("c_custkey").cast("double").cast("string"))
    lit = F.concat(
        F.lit("{'country': '"), F.col("n_name"), F.lit("', 'market': '"), F.col("c_mktsegment"),
        F.lit("', 'location': {'type': 'Point', 'coordinates': ["), coords, F.lit("]}, 'is_location_exact': True}"),
    )
    return cust.join(nat, cust.c_nationkey == nat.n_nationkey).select("c_custkey", "c_name", lit.alias("address"))


N2_SQL = f"""
SELECT {LISTING_ID_SQL} AS _id, CAST(turn AS VARCHAR) AS comment_id, text AS review
FROM conversations WHERE text IS NOT NULL AND text <> ''
"""


@register("n2_explode_reviews", N2_SQL, "N1 N2")
def n2_explode_reviews(spark, d):
    return N.explode_reviews(listings(spark, d))


N3_SQL = f"""
SELECT role AS pais, {LISTING_ID_SQL} AS hotel_id, 't' || turn AS fecha_review, coalesce(text, '') AS review
FROM conversations
"""


@register("n3_explode_dated", N3_SQL, "N1 N3")
def n3_explode_dated(spark, d):
    return N.explode_reviews(listings(spark, d), keep_empty=True)


N4_SQL = f"""
SELECT _id, _pos, review FROM (
  SELECT {LISTING_ID_SQL} AS _id,
         CAST(row_number() OVER (PARTITION BY conv_id, role, turn // {CHUNK} ORDER BY turn) - 1 AS INTEGER) AS _pos,
         text AS review
  FROM conversations)
WHERE review IS NOT NULL AND length({S.strip_ws('review')}) > 0
ORDER BY _id, _pos LIMIT 100
"""


@register("n4_first_comments", N4_SQL, "N4")
def n4_first_comments(spark, d):
    return N.first_comments(listings(spark, d), ["_id"], n=100)


@register(
    "n5_flatten_map",
    "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events",
    "N5",
)
def n5_flatten_map(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type", "props")
    return N.flatten_map(ev, "props")


N6_SQL = "SELECT vec_id, label, " + ", ".join(f"embedding[{i}] AS review_score_{i}" for i in range(1, 65)) + " FROM embeddings"


@register("n6_flatten_array", N6_SQL, "N6")
def n6_flatten_array(spark, d):
    return N.flatten_array(table(spark, d, "embeddings"), "embedding")


@register(
    "n7_overall_rating",
    "SELECT event_id, round_even(CAST(json_extract(props, '$.k') AS DOUBLE) / 10.0, 1) AS review_score FROM events",
    "N7",
)
def n7_overall_rating(spark, d):
    ev = table(spark, d, "events").select("event_id", "props")
    return N.overall_rating(ev, "props", key="k").select("event_id", "review_score")


N8_SQL = """
SELECT c_custkey, c_name, c_mktsegment AS city,
       CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey AS DOUBLE) END AS latitude,
       CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS longitude
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
"""


@register("n8_address_fields", N8_SQL, "N1 N8")
def n8_address_fields(spark, d):
    return N.address_fields(addresses(spark, d))


N9_SQL = """
SELECT c_custkey, m.pais FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN (VALUES ('NATION_7', 'España'), ('NATION_19', 'Portugal')) AS m(country, pais) ON n.n_name = m.country
"""


@register("n9_address_country", N9_SQL, "N1 N9 P8")
def n9_address_country(spark, d):
    a = addresses(spark, d).select("c_custkey", N.address_country("address").alias("country"))
    return C.by_country(a, "country", {"NATION_7": "España", "NATION_19": "Portugal"}).select("c_custkey", "pais")


N10_SQL = f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, {S.strip_ws('parts[i]')} AS review
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
WHERE {S.strip_ws('parts[i]')} <> ''
"""


@register("n10_split_reviews", N10_SQL, "N10")
def n10_split_reviews(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return N.split_reviews(docs, "text", "\n", keep=["doc_id"])


N11_SQL = f"""
SELECT {LISTING_ID_SQL} AS _id, CAST(turn AS VARCHAR) AS comment_id, {S.clean_output('text')} AS review
FROM conversations WHERE text IS NOT NULL AND {S.clean_output('text')} <> ''
"""


@register("n11_transform_nested", N11_SQL, "N11 T8")
def n11_transform_nested(spark, d):
    li = N.transform_nested(listings(spark, d), "reviews", "comments", clean_output)
    x = li.select("_id", F.explode("reviews").alias("r"))
    return x.where((F.col("r.comments") != "") & (F.col("r._id") != "")).select(
        "_id", F.col("r._id").alias("comment_id"), F.col("r.comments").alias("review")
    )


@register(
    "n12_count_nested",
    "SELECT CAST(count(text) AS BIGINT) AS reviews_items FROM conversations",
    "N12",
)
def n12_count_nested(spark, d):
    return N.count_nested(listings(spark, d), ["reviews"])


# ---------------------------------------------------------------- aggregations

G1_TEXT = (
    "CASE l_returnflag WHEN 'R' THEN '' WHEN 'A' THEN CAST(l_quantity AS VARCHAR) "
    "ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END"
)
G1_SQL = f"""
SELECT CAST(count(*) AS BIGINT) AS items,
       CAST(coalesce(sum(CASE WHEN regexp_matches(trim(v), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(v) AS BIGINT) END), 0) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE trim(v) <> '' AND NOT regexp_matches(trim(v), '^[+-]?[0-9]+$')) AS BIGINT) AS invalid
FROM (SELECT {G1_TEXT} AS v FROM lineitem)
"""


@register("g1_count_items", G1_SQL, "G1 S4")
def g1_count_items(spark, d):
    li = table(spark, d, "lineitem")
    # number_of_reviews as text: blank for 'R', a decimal ('17.0', invalid) for 'A'
    v = (
        F.when(F.col("l_returnflag") == "R", F.lit(""))
        .when(F.col("l_returnflag") == "A", F.col("l_quantity").cast("string"))
        .otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    )
    return G.count_items(li.select(v.alias("number_of_reviews")), "number_of_reviews")


G4_SQL = """
SELECT * FROM (SELECT CAST(count(DISTINCT p_partkey) AS BIGINT) AS p_partkey, CAST(count(DISTINCT p_name) AS BIGINT) AS p_name,
  CAST(count(DISTINCT p_brand) AS BIGINT) AS p_brand, CAST(count(DISTINCT p_type) AS BIGINT) AS p_type,
  CAST(count(DISTINCT p_size) AS BIGINT) AS p_size, CAST(count(DISTINCT p_retailprice) AS BIGINT) AS p_retailprice FROM part)
UNPIVOT (n_distinct FOR "column" IN (p_partkey, p_name, p_brand, p_type, p_size, p_retailprice))
"""


@register("g4_distinct_counts", G4_SQL, "G4")
def g4_distinct_counts(spark, d):
    return G.distinct_counts(table(spark, d, "part"))


EVENTS_WITH_NULLS = {
    "value": "CASE WHEN event_type = 'error' THEN NULL ELSE value END",
    "props": "CASE WHEN event_type = 'view' THEN NULL ELSE props END",
    "user_id": "CASE WHEN value > 19 THEN NULL ELSE user_id END",
}


def events_with_nulls(spark, d):
    ev = table(spark, d, "events")
    return ev.select(
        "event_id", "event_type",
        F.when(F.col("value") > 19, F.lit(None)).otherwise(F.col("user_id")).alias("user_id"),
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("props")).alias("props"),
    )


G5_SQL = f"""
SELECT * FROM (SELECT CAST(count(*) FILTER (WHERE event_id IS NULL) AS BIGINT) AS event_id,
  CAST(count(*) FILTER (WHERE event_type IS NULL) AS BIGINT) AS event_type,
  CAST(count(*) FILTER (WHERE ({EVENTS_WITH_NULLS['user_id']}) IS NULL) AS BIGINT) AS user_id,
  CAST(count(*) FILTER (WHERE ({EVENTS_WITH_NULLS['value']}) IS NULL) AS BIGINT) AS value,
  CAST(count(*) FILTER (WHERE ({EVENTS_WITH_NULLS['props']}) IS NULL) AS BIGINT) AS props FROM events)
UNPIVOT (n_null FOR "column" IN (event_id, event_type, user_id, value, props))
"""


@register("g5_missing_report", G5_SQL, "G5")
def g5_missing_report(spark, d):
    return G.missing_report(events_with_nulls(spark, d))


G6_SQL = """
SELECT doc_id, lang, source FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 5
"""


@register("g6_sample_per_group", G6_SQL, "G6")
def g6_sample_per_group(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return G.sample_per_group(docs, "lang", ["doc_id"], 5)


@register(
    "g7_shape",
    "SELECT source, CAST(count(*) AS BIGINT) AS n_rows, CAST(4 AS BIGINT) AS n_cols FROM documents GROUP BY source",
    "G7",
)
def g7_shape(spark, d):
    return G.shape(table(spark, d, "documents"), "source")


@register(
    "n5b_flatten_dict",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "N5",
)
def n5b_flatten_dict(spark, d):
    ev = table(spark, d, "events").select("event_id", "props")
    return N.flatten_dict(ev, "props")
