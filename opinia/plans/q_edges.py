"""Catalogue: the same operators on inputs that the plain queries do not hold -
dict keys that differ per row, list literals, null labels, repeated look-up
rows, single-byte files.  All inputs are derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinia.operators import aggregates as G
from opinia.operators import nested as N
from opinia.operators import prep as P
from opinia.operators import text as TX
from opinia.operators.tfidf import english_stop_words
from opinia.plans.fixtures import lemma_df, lexicon_df
from opinia.plans.q_io import _fresh
from opinia.plans.q_text import G2_SQL, _t2_sql
from opinia.plans.registry import register
from opinia.session import local_df, table
from opinia.sources import csv as CSV

N5_SQL = """
SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS a,
       CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus WHEN o_orderkey % 3 = 2 THEN '7' END AS b,
       CAST(CASE WHEN o_orderkey % 3 = 2 THEN o_custkey END AS BIGINT) AS "n.x",
       CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice END AS "n.y.z"
FROM orders
"""


@register("n5_flatten_nested", N5_SQL, "N5 N1")
def n5_flatten_nested(spark, d):
    o = table(spark, d, "orders")
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")
    plain = F.concat(F.lit("{'a': "), key, F.lit("}"))
    word = F.concat(F.lit("{'a': "), key, F.lit(", 'b': '"), F.col("o_orderstatus"), F.lit("'}"))
    deep = F.concat(F.lit("{'a': "), key, F.lit(", 'b': 7, 'n': {'x': "), F.col("o_custkey").cast("string"),
                    F.lit(", 'y': {'z': "), price, F.lit("}}}"))
    third = F.col("o_orderkey") % 3
    cells = o.select("o_orderkey", F.when(third == 0, plain).when(third == 1, word).otherwise(deep).alias("scores"))
    return N.flatten_dict(cells, "scores")


N6_SQL = """
SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS review_score_1, c_acctbal AS review_score_2,
       CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS DOUBLE) END AS review_score_3 FROM customer
"""


@register("n6_list_literal", N6_SQL, "N6 N1")
def n6_list_literal(spark, d):
    c = table(spark, d, "customer")
    numbers = F.concat_ws(", ", F.col("c_nationkey").cast("string"), F.col("c_acctbal").cast("string"),
                          F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")))
    return N.flatten_array(c.select("c_custkey", F.concat(F.lit("["), numbers, F.lit("]")).alias("scores")), "scores")


F8_SQL = """
WITH l AS (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE toxic END AS y FROM labels),
c AS (SELECT y, count(*) AS n FROM l GROUP BY y),
small AS (SELECT y, n FROM c ORDER BY n, coalesce(CAST(y AS VARCHAR), 'None') LIMIT 1)
SELECT coalesce(CAST(c.y AS VARCHAR), 'none') AS label,
       CAST(CASE WHEN c.y IS NOT DISTINCT FROM (SELECT y FROM small) THEN (SELECT max(n) FROM c) ELSE c.n END AS BIGINT) AS n
FROM c
"""


@register("f8_null_label", F8_SQL, "F8")
def f8_null_label(spark, d):
    lab = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("toxic")).alias("y"))
    out = P.resample(lab, "y", "over", key="doc_id", seed=42)
    return out.groupBy(F.coalesce(F.col("y").cast("string"), F.lit("none")).alias("label")).agg(F.count("*").alias("n"))


@register("g2_duplicate_lexicon", G2_SQL, "G2")
def g2_duplicate_lexicon(spark, d):
    lexicon = lexicon_df(spark)
    return G.word_sentiment(table(spark, d, "documents"), "lang", "text", lexicon.union(lexicon))


@register("t2_duplicate_lemma", _t2_sql(), "T2")
def t2_duplicate_lemma(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    lemmas = lemma_df(spark).union(local_df(spark, [("is", "is"), ("was", "zzz")], "word string, lemma string"))
    return TX.normalise_words(docs, "doc_id", "text", english_stop_words(), lemmas).select("doc_id", "Review_Procesado")


S1_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'pris ' || o_orderpriority || ' – 5 €' AS note FROM orders"


@register("s1_single_byte_file", S1_SQL, "S1 S3")
def s1_single_byte_file(spark, d):
    """A file in windows-1252 (bytes 0x96 and 0x80), written byte by byte."""
    path = _fresh(spark, "s1b")
    note = F.concat(F.lit("pris "), F.col("o_orderpriority"), F.lit(" \x96 5 \x80"))
    out = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), note.alias("note"))
    out.write.option("header", "true").option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return CSV.read_reviews(spark, path)
