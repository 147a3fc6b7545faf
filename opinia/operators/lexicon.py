"""Lexicon sentiment (L1, L2, L3b) as token-table jobs.

Each text's tokens are an array in its row, where the context rules look back;
they are then exploded to one row per token, the lexicon (and booster list) are
joined by broadcast after a size check, and one aggregation per document,
summed up in its task first, is the only shuffle.  Lexicons are input tables; the
reference gets them from external libraries.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinia.functions.labels import polarity_label
from opinia.functions.text import PUNCTUATION, WHITESPACE_RUN, strip_ws
from opinia.operators.aggregates import majority_label
from opinia.operators.joins import lookup_join, strongest
from opinia.operators.nested import split_reviews
from opinia.operators.spread import spread


@dataclass(frozen=True)
class ValenceRules:
    """Constants of the published valence rules (parameters, not code)."""

    booster: float = 0.293
    booster_decay: tuple = (1.0, 0.95, 0.9)
    caps: float = 0.733
    negation: float = -0.74
    but_before: float = 0.5
    but_after: float = 1.5
    exclam: float = 0.292
    exclam_max: int = 4
    question_small: float = 0.18
    question_large: float = 0.96
    alpha: float = 15.0


def _tokens(df: DataFrame, id_col: str, text_col: str, back: int, **extra) -> DataFrame:
    """``(id, *extra, pos, tok, w, p1 .. p<back>)``: whitespace tokens with
    punctuation stripped (case kept in ``tok``, lower in ``w``) and the
    lower-cased tokens before each; tokens of one character are dropped (the
    analyser ignores them).  Looking back is done in the row's token array, so
    no token is shuffled.  A text without tokens keeps one row of nulls.
    ``extra`` are expressions of the arrays ``_toks`` and ``_low`` and of ``_text``."""
    df = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_raw")), "id", "_raw")
    base = df.select("id", "_raw", F.coalesce("_raw", F.lit("")).alias("_text"))
    pieces = F.transform(F.split("_text", WHITESPACE_RUN), lambda t: F.btrim(t, F.lit(PUNCTUATION)))
    x = base.withColumn("_toks", F.filter(pieces, lambda t: F.length(t) > 1))
    x = x.withColumn("_low", F.transform("_toks", lambda t: F.lower(t)))
    item = F.transform("_toks", lambda t, i: F.struct(
        i.alias("pos"), t.alias("tok"), F.get("_low", i).alias("w"), *(F.get("_low", i - k).alias(f"p{k}") for k in range(1, back + 1))))
    # Below the explode: beside it, Spark would compute them once per token, from the copied text.
    below = x.select("id", *(e.alias(n) for n, e in extra.items()), item.alias("_items"))
    return below.select("id", *extra, F.explode_outer("_items").alias("_r")).select("id", *extra, "_r.*")


def polarity(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame,
             negators: list[str] | None = None, negation: float = -0.5) -> DataFrame:
    """L2: ``(id, polarity)`` = mean polarity of the matched words, a word
    preceded by a negator counting ``negation`` times its polarity; 0.0 when
    nothing matches; null for a null or blank text.  ``lexicon`` has
    ``(word, polarity)`` with polarity in [-1, 1]."""
    negators = negators or ["not", "never", "no"]
    blank = F.col("_raw").isNull() | (F.length(strip_ws("_raw")) == 0)
    toks = _tokens(df, id_col, text_col, 1, _blank=blank)
    lex = strongest(lexicon, "word", "polarity").select(F.col("word").alias("w"), F.col("polarity").alias("_p"))
    hits = lookup_join(toks, lex, "w", "left").select(
        "id", "_blank", F.when(F.col("p1").isin(negators), F.col("_p") * negation).otherwise(F.col("_p")).alias("_v")
    )
    per = hits.groupBy("id").agg(F.avg("_v").alias("_pol"), F.first("_blank").alias("_blank"))
    return per.select(
        F.col("id").alias(id_col),
        F.when(F.col("_blank"), F.lit(None).cast("double")).otherwise(F.coalesce("_pol", F.lit(0.0))).alias("polarity"),
    )


def valence_scores(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame,
                   boosters: DataFrame, negators: list[str], rules: ValenceRules = ValenceRules()) -> DataFrame:
    """L1: ``(id, compound, pos, neu, neg)`` from a valence lexicon
    ``(word, valence)`` and a booster table ``(word, increment)``; texts with
    no tokens score 0 / 0 / 0 / 0.

    Nothing but the per-text sums is shuffled: the tokens before each token
    come from the row's own array, lexicon and boosters are probed."""
    text = F.col("_text")
    n_ex = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    n_q = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    emph = F.least(n_ex, F.lit(rules.exclam_max)) * rules.exclam + F.when(n_q > 3, rules.question_large).when(
        n_q > 1, n_q * rules.question_small).otherwise(0.0)

    def caps(t):
        return (t == F.upper(t)) & (t != F.lower(t))

    back = len(rules.booster_decay)
    toks = _tokens(df, id_col, text_col, back, _e=emph, _mixed=F.exists("_toks", lambda t: ~caps(t)),
                   _but=F.nullif(F.array_position("_low", F.lit("but")), F.lit(0)) - 1)
    lex = strongest(lexicon, "word", "valence").select(F.col("word").alias("w"), F.col("valence").alias("_v0"))
    bst = strongest(boosters, "word", "increment")
    toks = lookup_join(toks, lex, "w", "left")
    for j in range(1, back + 1):
        toks = lookup_join(toks, bst.select(F.col("word").alias(f"p{j}"), F.col("increment").alias(f"_i{j}")), f"p{j}", "left")
    # Each part of the value stands once in the expression: repeated in the branches of a CASE, the code of a token grew past
    # what the JVM compiles, and every token was interpreted.
    toks = toks.withColumn("_v0", F.coalesce(F.col("_v0"), F.lit(0.0)))
    v0 = F.col("_v0")
    sign = F.signum(v0)
    v = v0 + F.when((v0 != 0) & F.col("_mixed") & caps(F.col("tok")), sign * rules.caps).otherwise(0.0)
    for j, decay in enumerate(rules.booster_decay, start=1):
        inc = F.col(f"_i{j}")
        v = v + F.when((v0 != 0) & inc.isNotNull(), sign * F.abs(inc) * F.signum(inc) * decay).otherwise(0.0)
    negated = reduce(lambda a, j: a | F.coalesce(F.col(f"p{j}").isin(negators), F.lit(False)), range(1, back + 1), F.lit(False))
    but_pos = F.col("_but")
    v = v * F.when((v0 != 0) & negated, rules.negation).otherwise(1.0) * F.when(F.col("pos") < but_pos, rules.but_before).when(
        F.col("pos") > but_pos, rules.but_after).otherwise(1.0)
    scored = toks.select("id", "_e", F.when(F.col("tok").isNotNull(), v).alias("_s"))
    j = scored.groupBy("id").agg(
        F.coalesce(F.sum("_s"), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(F.when(F.col("_s") > 0, F.col("_s") + 1)), F.lit(0.0)).alias("P"),
        F.coalesce(F.sum(F.when(F.col("_s") < 0, F.col("_s") - 1)), F.lit(0.0)).alias("N"),
        F.count_if(F.col("_s") == 0).alias("U"),
        F.first("_e").alias("_e"),
    )
    s = F.col("s")
    s_e = F.when(s > 0, s + F.col("_e")).when(s < 0, s - F.col("_e")).otherwise(s)
    compound = F.when(F.col("P") + F.abs(F.col("N")) + F.col("U") == 0, F.lit(0.0)).otherwise(
        F.round(s_e / F.sqrt(s_e * s_e + rules.alpha), 4)
    )
    P = F.when(F.col("P") > F.abs(F.col("N")), F.col("P") + F.col("_e")).otherwise(F.col("P"))
    N = F.when(F.abs(F.col("N")) > F.col("P"), F.col("N") - F.col("_e")).otherwise(F.col("N"))
    total = P + F.abs(N) + F.col("U")
    safe = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return j.select(
        F.col("id").alias(id_col),
        compound.alias("compound"),
        F.round(F.abs(P / safe), 3).alias("pos"),
        F.round(F.abs(F.col("U") / safe), 3).alias("neu"),
        F.round(F.abs(N / safe), 3).alias("neg"),
    )


def review_sentiment(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame,
                     legacy: bool = False) -> DataFrame:
    """Split each text into reviews (newlines), score each review's
    polarity (L2), label it (L3) and attach the row's majority label (G3).
    Output ``(id, pos, review, sentiment, polarity, overall_sentiment)`` with
    ``polarity`` rescaled to 1-9 as the reference writes it."""
    pieces = split_reviews(spread(df.select(id_col, text_col), id_col, text_col), text_col, "\n", keep=[id_col])
    pieces = pieces.withColumn("_rid", F.concat_ws(":", F.col(id_col).cast("string"), F.col("pos").cast("string")))
    pol = polarity(pieces, "_rid", "review", lexicon)
    lab = pieces.join(pol, "_rid").select(
        id_col, "pos", "review",
        polarity_label("polarity", legacy=legacy).alias("sentiment"),
        (F.col("polarity") * 4 + 5).alias("polarity"),
    )
    return majority_label(lab, id_col, "sentiment", "pos")
