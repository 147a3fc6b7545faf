"""Aggregations (G1-G7).  All are ``groupBy().agg`` with partial (map-side)
aggregation before the exchange, so a hot key never moves more than one
partial row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinia.functions.literal import REVIEW_SCHEMA, is_bracketed, parse_literal
from opinia.functions.text import WHITESPACE_RUN, clean_word
from opinia.operators.joins import strongest

INTEGER_TEXT = r"^[+-]?[0-9]+$"
BROADCAST_LEXICON_ROWS = 1_000_000


def count_items(df: DataFrame, col: str) -> DataFrame:
    """G1: one row ``(items, total, invalid)``: number of rows, sum of an
    integer-as-text column (blank or absent -> 0), and how many values were
    not integers (skipped, as the reference warns and skips them)."""
    v = F.trim(F.coalesce(F.col(col).cast("string"), F.lit("0")))
    ok = v.rlike(INTEGER_TEXT)
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("items"),
        F.coalesce(F.sum(F.when(ok, v.try_cast("bigint"))), F.lit(0)).cast("bigint").alias("total"),
        F.count_if((v != "") & ~ok).cast("bigint").alias("invalid"),
    )


def review_comments(col) -> "F.Column":
    """The reference's reading of a ``reviews`` cell: a bracketed Python list
    of dicts gives the ``comments`` values present (null ones skipped; a
    malformed list gives null, i.e. the row is skipped); any other text is
    split on ``|``."""
    c = F.col(col) if isinstance(col, str) else col
    parsed = parse_literal(c, REVIEW_SCHEMA, require="list")
    from_list = F.transform(F.filter(parsed, lambda x: x["comments"].isNotNull()), lambda x: x["comments"])
    return F.when(is_bracketed(c), from_list).otherwise(F.split(c, r"\|"))


def exploded_words(df: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """``(*keep, _w)``: one row per cleaned word of every review.  Splitting
    and cleaning are plain projections behind an explode each."""
    pieces = df.where(F.col(text_col).isNotNull()).select(*keep, F.explode(review_comments(text_col)).alias("_r"))
    names = [c for c in pieces.columns if c != "_r"]
    raw = pieces.select(*names, F.explode(F.split("_r", WHITESPACE_RUN)).alias("_w"))
    return raw.select(*names, clean_word("_w").alias("_w")).where(F.col("_w") != "")


def word_counts(df: DataFrame, group_col: str, text_col: str) -> DataFrame:
    """Words of every review per group with their frequency:
    ``(group, word, n)``.  Partial aggregation runs before the exchange."""
    return (
        exploded_words(df, text_col, F.col(group_col).alias("_g"))
        .groupBy("_g", "_w")
        .agg(F.count(F.lit(1)).cast("bigint").alias("_n"))
    )


def word_sentiment(df: DataFrame, group_col: str, text_col: str, lexicon: DataFrame,
                   min_length: int = 2, out_group: str = "pais", neutral_words: list[str] | None = None) -> DataFrame:
    """G2 (flagship): per group, frequency of every word whose lexicon valence
    is non-zero, labelled ``positivo``/``negativo``.

    Output ``(pais, palabra, frecuencia, sentimiento)``.  Words shorter than
    ``min_length`` score zero (the sentiment analyser drops one-character
    tokens).  Plan: a lexicon that passes the size check is broadcast and
    probed per token before the partial count, so the one exchange carries
    only (group, lexicon word) partial counts; a larger lexicon is joined
    after the aggregation.  ``neutral_words`` (such as the booster list) are
    never labelled.
    """
    lex = strongest(lexicon, "word", "valence").select(F.col("word").alias("_w"), F.col("valence").alias("_v")).where(F.col("_v") != 0)
    if neutral_words:
        # e.g. booster words: scored 0 on their own even when the lexicon has them
        lex = lex.where(~F.col("_w").isin(list(neutral_words)))
    if lex.limit(BROADCAST_LEXICON_ROWS + 1).count() <= BROADCAST_LEXICON_ROWS:
        # bounded lexicon: probe it per token (broadcast hash join, no
        # shuffle) so that only lexicon words reach the exchange
        words = exploded_words(df, text_col, F.col(group_col).alias("_g")).where(F.length("_w") >= min_length)
        counts = words.join(F.broadcast(lex), "_w").groupBy("_g", "_w", "_v").agg(
            F.count(F.lit(1)).cast("bigint").alias("_n"))
    else:
        # huge lexicon: aggregate first, then one shuffle join of the
        # distinct (group, word) rows
        counts = word_counts(df, group_col, text_col).where(F.length("_w") >= min_length).join(lex, "_w")
    return counts.select(
        F.col("_g").alias(out_group),
        F.col("_w").alias("palabra"),
        F.col("_n").alias("frecuencia"),
        F.when(F.col("_v") > 0, "positivo").otherwise("negativo").alias("sentimiento"),
    )


def majority_label(df: DataFrame, key: str, label: str, pos: str,
                   out: str = "overall_sentiment", empty: str = "neutral") -> DataFrame:
    """Attach to each row the most frequent ``label`` among the rows of its
    ``key``; ties go to the label seen first (smallest ``pos``).  A key whose
    labels are all null gets ``empty``."""
    per_label = (
        df.where(F.col(label).isNotNull())
        .groupBy(key, label)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_p"))
    )
    best = per_label.groupBy(key).agg(
        F.min_by(F.col(label), F.struct((-F.col("_n")).alias("a"), F.col("_p").alias("b"))).alias(out)
    )
    return df.join(best, on=key, how="left").withColumn(out, F.coalesce(F.col(out), F.lit(empty)))


def distinct_counts(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Number of distinct non-null values per column, long form
    ``(column, n_distinct)``; one aggregation job."""
    cols = cols or df.columns
    fn = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    wide = df.agg(*[fn(F.col(c)).cast("bigint").alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_distinct")


def missing_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column, n_null)`` for every column, one aggregation job."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_null")


def sample_per_group(df: DataFrame, group: str, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows per group by ``order``.  Spark plans the
    ``row_number() <= n`` filter as a group limit before the shuffle, so a
    hot group sends at most ``n`` rows per task."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def shape(df: DataFrame, source_col: str | None = None) -> DataFrame:
    """Loaded-row report: ``(source, n_rows, n_cols)``."""
    ncols = len(df.columns) - (1 if source_col else 0)
    g = df.groupBy(source_col) if source_col else df.groupBy(F.lit("all").alias("source"))
    out = g.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
    if source_col:
        out = out.withColumnRenamed(source_col, "source")
    return out.withColumn("n_cols", F.lit(ncols).cast("bigint"))
