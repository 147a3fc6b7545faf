"""Catalogue: word sentiment (flagship), text expressions, row clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinia.functions import labels as L
from opinia.functions import text as T
from opinia.operators import aggregates as G
from opinia.operators import clean as C
from opinia.plans import sqlfrag as S
from opinia.plans.fixtures import DEMO_LEXICON, lexicon_df, values_sql
from opinia.plans.registry import register
from opinia.session import table

LEX_SQL = values_sql(DEMO_LEXICON, "word, valence")

# ---------------------------------------------------------------- G2 / T5

G2_SQL = f"""
WITH c AS (
  SELECT lang AS g, cm FROM documents, unnest(string_split(text, '|')) AS u(cm)
  WHERE text IS NOT NULL
), w AS (
  SELECT g, {S.clean_word('tok')} AS w
  FROM c, unnest(string_split_regex(cm, {S.WS})) AS u(tok)
), n AS (
  SELECT g, w, count(*) AS n FROM w WHERE w <> '' AND length(w) >= 2 GROUP BY g, w
)
SELECT g AS pais, w AS palabra, CAST(n AS BIGINT) AS frecuencia,
       CASE WHEN valence > 0 THEN 'positivo' ELSE 'negativo' END AS sentimiento
FROM n JOIN {LEX_SQL} ON n.w = t.word
WHERE t.valence <> 0
"""


@register("g2_word_sentiment", G2_SQL, "G2 T5 N10 N1")
def g2_word_sentiment(spark, d):
    docs = table(spark, d, "documents")
    return G.word_sentiment(docs, "lang", "text", lexicon_df(spark))


T5_SQL = f"""
SELECT lang, w AS word, CAST(count(*) AS BIGINT) AS n
FROM (SELECT lang, unnest({S.clean_words('text')}) AS w FROM documents)
GROUP BY lang, w
"""


@register("t5_word_frequency", T5_SQL, "T5")
def t5_word_frequency(spark, d):
    docs = table(spark, d, "documents")
    return (
        docs.select("lang", F.explode(T.clean_words("text")).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    )


# ---------------------------------------------------------------- T1 T4 T6 T7 T8

@register("t1_letters_only", f"SELECT doc_id, {S.letters_only('text')} AS clean FROM documents", "T1")
def t1_letters_only(spark, d):
    return table(spark, d, "documents").select("doc_id", T.letters_only("text").alias("clean"))


T6_SQL = f"""
SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tk)) AS BIGINT) AS n_distinct
FROM (SELECT doc_id, {S.tokens('text')} AS tk FROM documents)
"""


@register("t6_tokens", T6_SQL, "T6")
def t6_tokens(spark, d):
    tk = T.tokens("text")
    return table(spark, d, "documents").select(
        "doc_id",
        F.size(tk).cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct(tk)).cast("bigint").alias("n_distinct"),
    )


T6_ALL_SQL = f"SELECT doc_id, md5(array_to_string({S.tokens('text')}, ' ')) AS digest FROM documents"


@register("t6_tokens_digest", T6_ALL_SQL, "T6")
def t6_tokens_digest(spark, d):
    """All tokens of each text in order, as a digest."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(T.tokens("text"), " ")).alias("digest"))


T7_ALL_SQL = f"""
SELECT doc_id, md5(array_to_string(g, '|')) AS digest
FROM (SELECT doc_id, {S.ngrams('tk', 1, 3)} AS g FROM (SELECT doc_id, {S.tokens('text')} AS tk FROM documents))
"""


@register("t7_ngrams_digest", T7_ALL_SQL, "T7 T6")
def t7_ngrams_digest(spark, d):
    """All n-grams of each text in order, as a digest."""
    x = table(spark, d, "documents").select("doc_id", T.tokens("text").alias("tk"))
    return x.select("doc_id", F.md5(F.array_join(T.ngrams("tk", 1, 3), "|")).alias("digest"))


T7_SQL = f"""
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_grams, CAST(len(list_distinct(g)) AS BIGINT) AS n_distinct,
       g[len(g)] AS last_gram
FROM (SELECT doc_id, {S.ngrams('tk', 1, 3)} AS g FROM (SELECT doc_id, {S.tokens('text')} AS tk FROM documents))
"""


@register("t7_ngrams", T7_SQL, "T7 T6")
def t7_ngrams(spark, d):
    # tokens are projected once; the n-gram lambdas then read the column
    return (
        table(spark, d, "documents")
        .select("doc_id", T.tokens("text").alias("tk"))
        .select("doc_id", T.ngrams("tk", 1, 3).alias("g"))
        .select(
            "doc_id",
            F.size("g").cast("bigint").alias("n_grams"),
            F.size(F.array_distinct("g")).cast("bigint").alias("n_distinct"),
            F.get(F.col("g"), F.size("g") - 1).alias("last_gram"),
        )
    )


@register(
    "t8_clean_output",
    f"SELECT conv_id, turn, {S.clean_output('text')} AS clean FROM conversations",
    "T8",
)
def t8_clean_output(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean_output("text").alias("clean"))


T4_SQL = f"""
SELECT doc_id,
  CAST(len({S.split_words('text')}) AS BIGINT) AS review_length,
  CAST({S.char_count('text', '!')} AS BIGINT) AS num_exclam,
  CAST({S.char_count('text', '?')} AS BIGINT) AS num_question,
  CAST({S.upper_count('text')} AS BIGINT) AS num_upper,
  CAST(length(text) AS BIGINT) AS char_length,
  round({S.upper_count('text')} / greatest(1, length(text)), 6) AS prop_upper,
  round({S.char_count('text', '!')} / greatest(1, len({S.split_words('text')})), 6) AS prop_exclam,
  round({S.char_count('text', '?')} / greatest(1, len({S.split_words('text')})), 6) AS prop_question
FROM documents
"""


@register("t4_review_stats", T4_SQL, "T4")
def t4_review_stats(spark, d):
    cols = T.review_stat_columns("text")
    cols.pop("polarity")
    out = table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in cols.items()])
    return out.select(
        *[F.round(c, 6).alias(c) if c.startswith("prop_") else F.col(c) for c in out.columns]
    )


# ---------------------------------------------------------------- P1-P11

@register(
    "p1_drop_columns",
    "SELECT * EXCLUDE (l_comment_absent, l_tax, l_shipdate) FROM (SELECT *, NULL AS l_comment_absent FROM lineitem)",
    "P1",
)
def p1_drop_columns(spark, d):
    li = table(spark, d, "lineitem")
    # lenient drop: an absent column name is ignored
    return C.drop_columns(li, ["l_comment_absent", "l_tax", "l_shipdate"])


@register(
    "p2_harmonise",
    "SELECT text AS Review, lang, doc_id FROM documents",
    "P2",
)
def p2_harmonise(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return C.harmonise(docs, {"Review": ["review", "texto", "comentario", "text", "comment"]}).select(
        "Review", "lang", "doc_id"
    )


P3_SQL = """
SELECT event_id, event_type, v AS value FROM (
  SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events)
WHERE v IS NOT NULL
"""


@register("p3_drop_missing", P3_SQL, "P3 F3")
def p3_drop_missing(spark, d):
    ev = table(spark, d, "events").select(
        "event_id", "event_type",
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value")).alias("value"),
    )
    return C.drop_missing(ev, ["value"])


@register(
    "p4_non_blank",
    r"SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND regexp_matches(text, '\S')",
    "P4",
)
def p4_non_blank(spark, d):
    return C.non_blank(table(spark, d, "conversations"), "text").select("conv_id", "turn")


@register(
    "p5_binary_label",
    "SELECT event_id, CAST(CASE WHEN trim(event_type) IN ('0','negative','neg') OR TRY_CAST(trim(event_type) AS DOUBLE) = 0 "
    "OR event_type = 'error' THEN 0 ELSE 1 END AS INTEGER) AS label FROM events",
    "P5",
)
def p5_binary_label(spark, d):
    ev = table(spark, d, "events")
    # 'error' events stand for negatively labelled reviews: map to 'neg' first
    src = F.when(F.col("event_type") == "error", F.lit("neg")).otherwise(F.col("event_type"))
    return ev.select("event_id", L.binary_label(src).alias("label"))


RATING = "substr(o_orderpriority, 1, 1)"
P6_SQL = f"""
SELECT o_orderkey, CAST(CASE WHEN TRY_CAST(trim({RATING}) AS DOUBLE) <= 2 THEN 0 ELSE 1 END AS INTEGER) AS label
FROM orders WHERE NOT (trim({RATING}) = '3' OR TRY_CAST(trim({RATING}) AS DOUBLE) = 3)
"""


def order_rating(spark, d):
    o = table(spark, d, "orders")
    return o.withColumn("rating", F.substring("o_orderpriority", 1, 1))


@register("p6_rating_to_binary", P6_SQL, "P6")
def p6_rating_to_binary(spark, d):
    o = order_rating(spark, d)
    return C.rating_to_binary(o, "rating", out="label").select("o_orderkey", "label")


@register(
    "p7_shift_label",
    f"SELECT o_orderkey, CAST(CAST({RATING} AS INTEGER) - 1 AS INTEGER) AS label0 FROM orders",
    "P7",
)
def p7_shift_label(spark, d):
    o = order_rating(spark, d)
    return o.select("o_orderkey", L.shift_label("rating", -1).alias("label0"))


P8_SQL = """
SELECT c.c_custkey, c.c_name, m.pais
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN (VALUES ('NATION_7', 'España'), ('NATION_19', 'Portugal')) AS m(country, pais) ON n.n_name = m.country
"""


@register("p8_by_country", P8_SQL, "P8 N9")
def p8_by_country(spark, d):
    cust = table(spark, d, "customer")
    nat = table(spark, d, "nation")
    with_country = cust.join(nat, cust.c_nationkey == nat.n_nationkey).select(
        "c_custkey", "c_name", F.col("n_name").alias("country")
    )
    return C.by_country(with_country, "country", {"NATION_7": "España", "NATION_19": "Portugal"}).select(
        "c_custkey", "c_name", "pais"
    )


@register(
    "p9_fill_text",
    "SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE props END, '') AS props FROM events",
    "P9",
)
def p9_fill_text(spark, d):
    ev = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("props")).alias("props")
    )
    return C.fill_text(ev, "props")


P10_SQL = f"""
SELECT doc_id, lang, CAST(len({S.split_words('text')}) AS BIGINT) AS review_length,
       {S.letters_only('text')} = lower(text) AS letters_only_same
FROM documents
"""


@register("p10_with_columns", P10_SQL, "P10")
def p10_with_columns(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return docs.withColumns(
        {
            "review_length": T.word_count("text").cast("bigint"),
            "letters_only_same": T.letters_only("text") == F.lower("text"),
        }
    ).drop("text")


P11_SQL = f"""
WITH b AS (
  SELECT d.text AS Review, CAST(CASE WHEN trim(CAST(l.quality AS VARCHAR)) IN ('0','negative','neg')
         OR l.quality = 0 THEN 0 ELSE 1 END AS INTEGER) AS "Positive or Negative", d.doc_id AS k
  FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL AND l.quality IS NOT NULL
), r AS (
  SELECT d.text AS Review, CAST(CASE WHEN TRY_CAST(trim({RATING}) AS DOUBLE) <= 2 THEN 0 ELSE 1 END AS INTEGER)
         AS "Positive or Negative", d.doc_id + 1000000000 AS k
  FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id
  WHERE d.text IS NOT NULL AND o.o_orderpriority IS NOT NULL
    AND NOT (trim({RATING}) = '3' OR TRY_CAST(trim({RATING}) AS DOUBLE) = 3)
)
SELECT Review, "Positive or Negative" FROM b UNION ALL SELECT Review, "Positive or Negative" FROM r
"""


@register("p11_fuse_corpora", P11_SQL, "P11 P2 P3 P5 P6 S7")
def p11_fuse_corpora(spark, d):
    docs = table(spark, d, "documents")
    binary = docs.join(table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text").alias("texto"), F.col("quality").alias("label")
    )
    rated = docs.join(
        order_rating(spark, d).select(F.col("o_orderkey").alias("doc_id"), "rating"), "doc_id"
    ).select((F.col("doc_id") + 1_000_000_000).alias("id"), F.col("text").alias("comment"), F.col("rating").alias("Nota"))
    return C.fuse_corpora(binary, rated, key="id").select("Review", "Positive or Negative")


# ---------------------------------------------------------------- T2 T3 T9

from opinia.operators import text as TX  # noqa: E402
from opinia.operators.tfidf import english_stop_words  # noqa: E402
from opinia.plans.fixtures import DEMO_LEMMAS, PROMPTS, lemma_df  # noqa: E402


def _map_sql(rows) -> str:
    return "MAP {" + ", ".join(f"{S.q(a)}: {S.q(b)}" for a, b in rows) + "}"


def _t2_sql() -> str:
    stop = S.str_list(english_stop_words())
    words = f"list_filter({S.split_words(S.letters_only('text'))}, lambda w: NOT list_contains({stop}, w))"
    lem = f"list_transform({words}, lambda w: coalesce(map_extract({_map_sql(DEMO_LEMMAS)}, w)[1], w))"
    return f"SELECT doc_id, array_to_string({lem}, ' ') AS Review_Procesado FROM documents"


@register("t2_normalise_words", _t2_sql(), "T2 T1")
def t2_normalise_words(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = TX.normalise_words(docs, "doc_id", "text", english_stop_words(), lemma_df(spark))
    return out.select("doc_id", "Review_Procesado")


def _t3_sql() -> str:
    stop = S.str_list(english_stop_words())
    toks = f"regexp_extract_all(lower(text), {S.q(TX.WORD_TOKEN)})"
    keep = f"list_filter({toks}, lambda w: NOT list_contains({stop}, w) AND instr({S.PUNCT}, w) = 0)"
    stem = f"list_transform({keep}, lambda w: coalesce(map_extract({_map_sql(DEMO_LEMMAS)}, w)[1], w))"
    return f"SELECT doc_id, array_to_string(list_sort({stem}), ' ') AS text FROM documents"


@register("t3_bag_text", _t3_sql(), "T3")
def t3_bag_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    stems = lemma_df(spark).withColumnRenamed("lemma", "stem")
    return TX.bag_text(docs, "doc_id", "text", english_stop_words(), stems).select("doc_id", "text")


def _prompt_sql(name: str) -> str:
    before, after = PROMPTS[name].split("{comment}")
    return f"SELECT conv_id, turn, {S.q(before)} || text || {S.q(after)} AS prompt FROM conversations"


def _prompt(spark, d, name):
    conv = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return TX.render_prompt(conv, "text", PROMPTS[name]).select("conv_id", "turn", "prompt")


for _name, _query in (("zero_shot", "t9_prompt_zero_shot"), ("one_shot", "t9_prompt_one_shot"), ("two_shot", "t9_prompt_two_shot"),
                      ("few_shot", "t9_prompt_few_shot"), ("translate", "t9_prompt_translate")):
    register(_query, _prompt_sql(_name), "T9")(lambda s, d, name=_name: _prompt(s, d, name))
