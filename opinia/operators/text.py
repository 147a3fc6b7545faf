"""Text operators that need look-up tables or templates.

Stop words, lemmas and stems are *tables* (the reference calls external
libraries for them).  A table up to ``MAP_ENTRIES`` entries becomes a map
literal used inside the per-row array expressions — no shuffle, whole-stage
codegen; a larger one is joined: explode (doc, pos, word), broadcast or
shuffle join, regroup per document.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinia.functions.text import letters_only, review_stat_columns, split_words
from opinia.operators.joins import bounded

MAP_ENTRIES = 10_000
# word_tokenize approximation: runs of word characters, or runs of other
# non-space characters (punctuation becomes separate tokens).
WORD_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def one_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key: of several values the first in alphabetical order counts."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value)).select(key, value)


def table_map(df: DataFrame, key: str, value: str, max_entries: int = MAP_ENTRIES) -> Column | None:
    """A bounded look-up table as a map literal, or None when too large."""
    rows = one_value(df, key, value).limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        return None
    if not rows:
        return F.create_map().cast("map<string,string>")
    return F.map_from_arrays(F.array(*[F.lit(r[0]) for r in rows]), F.array(*[F.lit(r[1]) for r in rows]))


def _lookup_words(df: DataFrame, id_col: str, words: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """Replace each element of the array column ``words`` by its table value
    (unchanged when absent)."""
    m = table_map(table, key, value)
    if m is not None:
        return df.withColumn(words, F.transform(words, lambda w: F.coalesce(F.element_at(m, w), w)))
    ex = df.select(id_col, F.posexplode(words).alias("_pos", "_w"))
    t = bounded(one_value(table, key, value).select(F.col(key).alias("_w"), F.col(value).alias("_v")))
    mapped = ex.join(t, "_w", "left").select(id_col, "_pos", F.coalesce("_v", "_w").alias("_w"))
    back = mapped.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("_pos", "_w"))).alias("_a"))
    return df.drop(words).join(back.select(id_col, F.col("_a._w").alias(words)), id_col, "left").withColumn(
        words, F.coalesce(F.col(words), F.array().cast("array<string>")))


def normalise_words(df: DataFrame, id_col: str, col: str, stop_words: list[str], lemmas: DataFrame,
                    out: str = "Review_Procesado") -> DataFrame:
    """Letters only + lower, whitespace split, stop words removed (order
    kept), lemma look-up, re-joined with single spaces."""
    stop = list(stop_words)
    x = df.withColumn("_ws", F.filter(split_words(letters_only(col)), lambda w: ~w.isin(stop)))
    x = _lookup_words(x, id_col, "_ws", lemmas, "word", "lemma")
    return x.withColumn(out, F.array_join("_ws", " ")).drop("_ws")


def bag_text(df: DataFrame, id_col: str, col: str, stop_words: list[str], stems: DataFrame,
             sort_tokens: bool = True, out: str | None = None) -> DataFrame:
    """Lower, tokenise, drop stop words and punctuation tokens (a token
    that is a substring of the punctuation string), stem by look-up, sort the
    tokens alphabetically (``sort_tokens``), re-join."""
    stop = list(stop_words)
    punct = string.punctuation
    toks = F.regexp_extract_all(F.lower(F.col(col)), F.lit(WORD_TOKEN), 0)
    keep = F.filter(toks, lambda w: ~w.isin(stop) & (F.instr(F.lit(punct), w) == 0))
    x = df.withColumn("_ws", keep)
    x = _lookup_words(x, id_col, "_ws", stems, "word", "stem")
    arr = F.array_sort("_ws") if sort_tokens else F.col("_ws")
    return x.withColumn(out or col, F.array_join(arr, " ")).drop("_ws")


def render_prompt(df: DataFrame, col: str, template: str, slot: str = "comment", out: str = "prompt") -> DataFrame:
    """The template with the row's text in place of ``{slot}``."""
    before, after = template.split("{" + slot + "}")
    return df.withColumn(out, F.concat(F.lit(before), F.col(col), F.lit(after)))


def review_stats(df: DataFrame, col: str, polarity: Column | None = None, full: bool = True) -> DataFrame:
    """T4 as a DataFrame operator."""
    return df.withColumns(review_stat_columns(col, polarity, full))
