"""Projections, filters and row clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinia.functions import labels as L
from opinia.functions.text import strip_ws
from opinia.operators.joins import lookup_join
from opinia.session import local_df

# Column names under which a text, a binary label and a rating are found.
TEXT_SYNONYMS = ["review", "texto", "comentario", "text", "comment"]
BINARY_SYNONYMS = ["positive or negative", "sentimiento", "label", "binary", "class"]
RATING_SYNONYMS = ["rating", "nota", "score", "puntuacion", "stars"]


def require_columns(df: DataFrame, cols) -> DataFrame:
    """Raise if a required column is missing (metadata only, no job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def drop_columns(df: DataFrame, cols, strict: bool = False) -> DataFrame:
    """Drop columns; lenient ignores absent ones, strict raises."""
    if strict:
        require_columns(df, cols)
    return df.drop(*[c for c in cols if c in df.columns])


def find_column(df: DataFrame, synonyms) -> str | None:
    """First column (in file order) whose lower-cased name is a synonym."""
    syn = {s.lower() for s in synonyms}
    return next((c for c in df.columns if c.lower() in syn), None)


def harmonise(df: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """Rename the first column matching each synonym list to the
    standard name; raise if one is not found."""
    for std, syns in mapping.items():
        found = find_column(df, syns)
        if found is None:
            raise ValueError(f"no column for {std!r} among {syns}")
        if found != std:
            df = df.withColumnRenamed(found, std)
    return df


def drop_missing(df: DataFrame, cols) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.na.drop(subset=list(cols))


def non_blank(df: DataFrame, col: str) -> DataFrame:
    """Keep rows whose text is not null and not blank."""
    return df.where(F.col(col).isNotNull() & (F.length(strip_ws(col)) > 0))


def fill_text(df: DataFrame, col: str, value: str = "") -> DataFrame:
    """Null text -> ``value``."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


def rating_to_binary(df: DataFrame, col: str, out: str = "Positive or Negative") -> DataFrame:
    """Drop neutral (3) ratings, then <= 2 -> 0, else 1."""
    return df.where(~L.is_neutral_rating(col)).withColumn(out, L.rating_to_binary(col))


def by_country(df: DataFrame, country_col: str, labels: dict[str, str], out: str = "pais") -> DataFrame:
    """Keep rows of the given countries and tag them with a label.  The
    label map is a small look-up table joined by broadcast."""
    spark = df.sparkSession
    m = local_df(spark, list(labels.items()), f"_country string, {out} string")
    return lookup_join(df, m, df[country_col] == m["_country"]).drop("_country")


def binary_corpus(df: DataFrame) -> DataFrame:
    """P2+P3+P5: a binary review table with variable column names ->
    ``(Review, Positive or Negative)``."""
    text = find_column(df, TEXT_SYNONYMS)
    lab = find_column(df, BINARY_SYNONYMS)
    if not text or not lab:
        raise ValueError("required columns (review and label) not found")
    return drop_missing(df, [text, lab]).select(
        F.col(text).alias("Review"), L.binary_label(lab).alias("Positive or Negative"), *[
            c for c in df.columns if c not in (text, lab)
        ]
    )


def rated_corpus(df: DataFrame) -> DataFrame:
    """P2+P3+P6: a rated review table -> ``(Review, Positive or Negative)``."""
    text = find_column(df, TEXT_SYNONYMS)
    rating = find_column(df, RATING_SYNONYMS)
    if not text or not rating:
        raise ValueError("required columns (review and rating) not found")
    out = rating_to_binary(drop_missing(df, [text, rating]), rating)
    return out.withColumnRenamed(text, "Review").drop(rating)


def fuse_corpora(bin_df: DataFrame, rated_df: DataFrame, key: str | None = None,
                 seed: int | None = None) -> DataFrame:
    """Binary corpus UNION ALL rated corpus (by name).  A seeded shuffle
    order is only meaningful for an ordered sink: with ``seed`` the result is
    sorted by ``md5(key:seed)``, otherwise row order is left to Spark."""
    out = binary_corpus(bin_df).unionByName(rated_corpus(rated_df), allowMissingColumns=True)
    if seed is not None and key is not None:
        out = out.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    return out
