"""Catalogue: lexicon sentiment (L1, L2, L3, L3b, G3) and score mapping /
review scoring (L4-L9)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinia.functions import labels as L
from opinia.operators import lexicon as LX
from opinia.operators import scoring as SC
from opinia.operators.scorers import lexicon_stars
from opinia.plans import sqlfrag as S
from opinia.plans.fixtures import (
    DEMO_BOOSTERS, DEMO_LEXICON, DEMO_NEGATORS, POLARITY_ROWS, boosters_df, lexicon_df, polarity_lexicon,
    values_sql,
)
from opinia.plans.registry import register
from opinia.session import table

POL_SQL = values_sql(POLARITY_ROWS, "word, polarity", "lex")
LEX_SQL = values_sql(DEMO_LEXICON, "word, valence", "lex")
BOOST_SQL = values_sql(DEMO_BOOSTERS, "word, increment", "bst")
NEGATORS = ["not", "never", "no"]


def token_ctes(src: str) -> str:
    """``t(id, pos, tok, w)`` from ``src`` (a SELECT of ``id, text``)."""
    return f"""
src AS ({src}),
tk AS (SELECT id, i - 1 AS pos, trim(parts[i], {S.PUNCT}) AS tok
       FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS i
             FROM (SELECT id, string_split_regex(coalesce(text, ''), {S.WS}) AS parts FROM src))),
t AS (SELECT id, pos, tok, lower(tok) AS w FROM tk WHERE length(tok) > 1)"""


def polarity_ctes(src: str) -> str:
    neg = ", ".join(S.q(w) for w in NEGATORS)
    return token_ctes(src) + f""",
tn AS (SELECT *, lag(w) OVER (PARTITION BY id ORDER BY pos) IN ({neg}) AS neg FROM t),
h AS (SELECT tn.id, CASE WHEN neg THEN lex.polarity * -0.5 ELSE lex.polarity END AS v FROM tn JOIN {POL_SQL} ON tn.w = lex.word),
per AS (SELECT id, avg(v) AS pol FROM h GROUP BY id),
pol AS (SELECT src.id, CASE WHEN src.text IS NULL OR NOT regexp_matches(src.text, '\\S') THEN NULL
                            ELSE coalesce(per.pol, 0.0) END AS polarity
        FROM src LEFT JOIN per ON per.id = src.id)"""


L2_SQL = "WITH " + polarity_ctes("SELECT doc_id AS id, text FROM documents") + """
SELECT id AS doc_id, round(polarity, 6) AS polarity FROM pol"""


@register("l2_polarity", L2_SQL, "L2")
def l2_polarity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = LX.polarity(docs, "doc_id", "text", polarity_lexicon(spark), NEGATORS)
    return out.select("doc_id", F.round("polarity", 6).alias("polarity"))


L3B_SQL = f"""
WITH pieces AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, {S.strip_ws('parts[i]')} AS review
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
  WHERE {S.strip_ws('parts[i]')} <> ''),
{polarity_ctes("SELECT doc_id || ':' || pos AS id, review AS text FROM pieces")},
lab AS (SELECT p.doc_id, p.pos, p.review,
               CASE WHEN pol.polarity IS NULL THEN NULL WHEN pol.polarity > 0 THEN 'positive'
                    WHEN pol.polarity < 0 THEN 'negative' ELSE 'neutral' END AS sentiment,
               pol.polarity * 4 + 5 AS polarity
        FROM pieces p JOIN pol ON pol.id = p.doc_id || ':' || p.pos),
cnt AS (SELECT doc_id, sentiment, count(*) AS n, min(pos) AS fp FROM lab WHERE sentiment IS NOT NULL GROUP BY doc_id, sentiment),
best AS (SELECT doc_id, sentiment AS overall_sentiment FROM cnt
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, fp) = 1)
SELECT lab.doc_id, lab.pos, lab.review, lab.sentiment, round(lab.polarity, 6) AS polarity,
       coalesce(best.overall_sentiment, 'neutral') AS overall_sentiment
FROM lab LEFT JOIN best USING (doc_id)
"""


@register("l3b_review_sentiment", L3B_SQL, "L3b L3 L2 N10 G3")
def l3b_review_sentiment(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = LX.review_sentiment(docs, "doc_id", "text", polarity_lexicon(spark))
    return out.select("doc_id", "pos", "review", "sentiment", F.round("polarity", 6).alias("polarity"),
                      "overall_sentiment")


def _l1_sql() -> str:
    r = LX.ValenceRules()
    neg = ", ".join(S.q(w) for w in DEMO_NEGATORS)
    boosts = " + ".join(
        f"CASE WHEN v0 <> 0 AND i{j} IS NOT NULL THEN sign(v0) * abs(i{j}) * sign(i{j}) * {dec!r} ELSE 0 END"
        for j, dec in enumerate(r.booster_decay, start=1)
    )
    caps = "(tok = upper(tok) AND tok <> lower(tok))"
    return "WITH " + token_ctes("SELECT doc_id AS id, text FROM documents") + f""",
t2 AS (SELECT t.*, lex.valence AS v0raw, bst.increment AS inc, t.w IN ({neg}) AS isneg
       FROM t LEFT JOIN {LEX_SQL} ON t.w = lex.word LEFT JOIN {BOOST_SQL} ON t.w = bst.word),
t3 AS (SELECT *, coalesce(v0raw, 0.0) AS v0, {caps} AS is_caps,
         lag(inc, 1) OVER w AS i1, lag(inc, 2) OVER w AS i2, lag(inc, 3) OVER w AS i3,
         coalesce(lag(isneg, 1) OVER w, false) OR coalesce(lag(isneg, 2) OVER w, false)
           OR coalesce(lag(isneg, 3) OVER w, false) AS negated,
         min(CASE WHEN w = 'but' THEN pos END) OVER (PARTITION BY id) AS but_pos,
         max(CASE WHEN {caps} THEN 0 ELSE 1 END) OVER (PARTITION BY id) = 1 AS mixed
       FROM t2 WINDOW w AS (PARTITION BY id ORDER BY pos)),
t4 AS (SELECT id, pos, but_pos, negated, v0,
         v0 + CASE WHEN is_caps AND mixed AND v0 <> 0 THEN sign(v0) * {r.caps!r} ELSE 0 END + {boosts} AS v1 FROM t3),
t5 AS (SELECT id, pos, but_pos, CASE WHEN negated AND v0 <> 0 THEN v1 * {r.negation!r} ELSE v1 END AS v2 FROM t4),
t6 AS (SELECT id, CASE WHEN but_pos IS NULL THEN v2 WHEN pos < but_pos THEN v2 * {r.but_before!r}
                       WHEN pos > but_pos THEN v2 * {r.but_after!r} ELSE v2 END AS s FROM t5),
agg AS (SELECT id, sum(s) AS s, sum(CASE WHEN s > 0 THEN s + 1 END) AS P, sum(CASE WHEN s < 0 THEN s - 1 END) AS N,
               count(*) FILTER (WHERE s = 0) AS U FROM t6 GROUP BY id),
e AS (SELECT doc_id AS id,
        least({S.char_count("coalesce(text, '')", '!')}, {r.exclam_max}) * {r.exclam!r}
        + CASE WHEN {S.char_count("coalesce(text, '')", '?')} > 3 THEN {r.question_large!r}
               WHEN {S.char_count("coalesce(text, '')", '?')} > 1 THEN {S.char_count("coalesce(text, '')", '?')} * {r.question_small!r}
               ELSE 0.0 END AS e FROM documents),
j AS (SELECT e.id, e.e, coalesce(agg.s, 0.0) AS s, coalesce(agg.P, 0.0) AS P, coalesce(agg.N, 0.0) AS N,
             coalesce(agg.U, 0) AS U FROM e LEFT JOIN agg USING (id)),
k AS (SELECT *, CASE WHEN s > 0 THEN s + e WHEN s < 0 THEN s - e ELSE s END AS se,
             CASE WHEN P > abs(N) THEN P + e ELSE P END AS P2,
             CASE WHEN abs(N) > P THEN N - e ELSE N END AS N2 FROM j),
m AS (SELECT *, CASE WHEN P2 + abs(N2) + U = 0 THEN 1.0 ELSE P2 + abs(N2) + U END AS safe FROM k)
SELECT id AS doc_id,
  CASE WHEN P + abs(N) + U = 0 THEN 0.0 ELSE round(se / sqrt(se * se + {r.alpha!r}), 4) END AS compound,
  round(abs(P2 / safe), 3) AS pos, round(abs(U / safe), 3) AS neu, round(abs(N2 / safe), 3) AS neg
FROM m
"""


@register("l1_valence_scores", _l1_sql(), "L1")
def l1_valence_scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return LX.valence_scores(docs, "doc_id", "text", lexicon_df(spark), boosters_df(spark), DEMO_NEGATORS)


RATING = "substr(o_orderpriority, 1, 1)"


@register(
    "l4_scale_rating",
    f"SELECT o_orderkey, greatest(1.0, least(9.0, round_even(CAST({RATING} AS DOUBLE) * 2.25, 0))) AS Scaled_Rating FROM orders",
    "L4",
)
def l4_scale_rating(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", L.scale_rating(F.substring("o_orderpriority", 1, 1)).alias("Scaled_Rating"))


L5_SQL = """
SELECT event_id, CAST(CASE WHEN lab = 'POSITIVE' THEN round_even(5 + 4 * s, 0) ELSE round_even(5 - 4 * s, 0) END AS INTEGER) AS score
FROM (SELECT event_id, CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'POSITIVE' ELSE 'NEGATIVE' END AS lab,
             least(value / 20.0, 1.0) AS s FROM events)
"""


@register("l5_confidence_to_score", L5_SQL, "L5")
def l5_confidence_to_score(spark, d):
    ev = table(spark, d, "events")
    lab = F.when(F.col("event_type").isin("click", "purchase", "signup"), "POSITIVE").otherwise("NEGATIVE")
    return ev.select("event_id", L.confidence_to_score(lab, F.least(F.col("value") / 20.0, F.lit(1.0))).alias("score"))


L6_SQL = f"""
SELECT o_orderkey, Sentimiento, CAST(CASE WHEN lower(Sentimiento) = 'negative' THEN r ELSE r + 4 END AS INTEGER) AS Puntuacion_Final_1_9
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Negative' ELSE 'Positive' END AS Sentimiento,
             CAST({RATING} AS INTEGER) AS r FROM orders)
"""


@register("l6_final_score", L6_SQL, "L6 L7")
def l6_final_score(spark, d):
    o = table(spark, d, "orders")
    sent = L.sentiment_name(F.when(F.col("o_orderstatus") == "F", 0).otherwise(1))
    x = o.select("o_orderkey", sent.alias("Sentimiento"), F.substring("o_orderpriority", 1, 1).alias("r"))
    return x.select("o_orderkey", "Sentimiento", L.final_score("Sentimiento", "r").alias("Puntuacion_Final_1_9"))


@register(
    "l7_sentiment_name",
    "SELECT doc_id, CASE WHEN quality = 1 THEN 'Positive' WHEN quality IS NOT NULL THEN 'Negative' END AS Sentimiento FROM labels",
    "L7",
)
def l7_sentiment_name(spark, d):
    lab = table(spark, d, "labels")
    return lab.select("doc_id", L.sentiment_name("quality").alias("Sentimiento"))


# ---------------------------------------------------------------- L8

def lexicon_stars_scorer():
    """Deterministic stand-in for a text model (built once per task)."""
    return lexicon_stars(DEMO_LEXICON)


L8_SQL = f"""
WITH w AS (SELECT doc_id, unnest({S.clean_words('text')}) AS w FROM documents),
s AS (SELECT w.doc_id, sum(CASE WHEN lex.valence > 0 THEN 1 ELSE -1 END) AS n
      FROM w JOIN {LEX_SQL} ON w.w = lex.word WHERE lex.valence <> 0 GROUP BY w.doc_id)
SELECT d.doc_id, CAST(greatest(1, least(5, 3 + coalesce(s.n, 0))) AS INTEGER) AS stars
FROM documents d LEFT JOIN s USING (doc_id)
"""


@register("l8_score_texts", L8_SQL, "L8")
def l8_score_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = SC.score_texts(docs, "text", lexicon_stars_scorer, out="stars", out_type=T.IntegerType(), batch=16)
    return out.select("doc_id", "stars")


L9_SQL = L8_SQL.replace("SELECT d.doc_id, CAST(", "SELECT d.doc_id, d.text AS Review, CAST(").replace(
    "AS stars\nFROM documents d LEFT JOIN s USING (doc_id)",
    "AS stars, l.quality FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN labels l USING (doc_id)",
)
L9_SQL = "WITH base AS (" + L9_SQL + """)
SELECT doc_id, Review, CASE WHEN quality = 1 THEN 'Positive' WHEN quality IS NOT NULL THEN 'Negative' END AS Sentimiento,
       CAST(stars AS INTEGER) AS Score_1_5,
       CAST(CASE WHEN quality = 1 THEN stars + 4 WHEN quality IS NOT NULL THEN stars END AS INTEGER) AS Puntuacion_Final_1_9
FROM base"""


@register("l9_score_reviews", L9_SQL, "L9 L8 L7 L6 P7")
def l9_score_reviews(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    stars = SC.score_texts(docs, "text", lexicon_stars_scorer, out="stars", out_type=T.IntegerType())
    stars_pred = stars.select(F.col("doc_id").alias("id"), (F.col("stars") - 1).alias("prediction"))
    binary_pred = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("prediction"))
    out = SC.score_reviews(docs.withColumnRenamed("doc_id", "id"), "text", binary_pred, stars_pred)
    return out.withColumnRenamed("id", "doc_id")
