"""Scoring review tables.

``score_texts`` runs a caller-supplied batch scorer (a transformer, an LLM
client, ...) inside ``mapInPandas``: the scorer is built once per task, sees
Arrow batches of at most ``batch`` texts, and only *distinct* texts are
scored (the result is joined back).  A scorer error on a batch gives nulls
for that batch (or the original text for translations) instead of failing
the job, as the reference does per request.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinia.functions.labels import final_score, sentiment_name, shift_label
from opinia.functions.text import strip_ws


def score_texts(df: DataFrame, col: str, make_scorer: Callable[[], Callable[[list[str]], list]],
                out: str = "score", out_type: T.DataType = T.IntegerType(), batch: int = 16,
                on_error: str = "null", dedup: bool = True) -> DataFrame:
    """Add ``out`` = scorer(text) for every row.  ``make_scorer()`` is
    called once per task and returns ``f(list_of_texts) -> list_of_values``.
    ``on_error='text'`` keeps the original text (translation).

    ``dedup=True`` scores each distinct text once (worth its two exchanges
    when the model is expensive and copies are common); ``dedup=False``
    scores rows in place with no exchange at all."""
    schema = T.StructType([T.StructField("_key", T.BinaryType()), T.StructField(out, out_type)])
    if not dedup:
        keep = df.columns
        full = T.StructType(df.schema.fields + [T.StructField(out, out_type)])
        run_rows = _runner(make_scorer, col, out, batch, on_error, keep)
        return df.mapInPandas(run_rows, full)
    # texts are told apart by 256 bits: what is shuffled and joined by is a hash, not the text itself
    keyed = df.withColumn("_key", F.unhex(F.sha2(F.col(col), 256)))
    texts = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.first(col).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            vals = []
            items, keys = pdf["_text"].tolist(), pdf["_key"].tolist()
            for i in range(0, len(items), batch):
                chunk = items[i:i + batch]
                try:
                    vals.extend(scorer(chunk))
                except Exception:  # noqa: BLE001  (one failed request -> null)
                    vals.extend(chunk if on_error == "text" else [None] * len(chunk))
            yield pd.DataFrame({"_key": keys, out: pd.Series(vals, dtype="object")})

    scored = texts.mapInPandas(run, schema)
    return keyed.join(scored, "_key", "left").drop("_key")


def _runner(make_scorer, col, out, batch, on_error, keep):
    def run_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            items = pdf[col].tolist()
            vals = [None] * len(items)
            idx = [i for i, t in enumerate(items) if t is not None]
            for i in range(0, len(idx), batch):
                chunk = idx[i:i + batch]
                texts = [items[j] for j in chunk]
                try:
                    res = scorer(texts)
                except Exception:  # noqa: BLE001
                    res = texts if on_error == "text" else [None] * len(texts)
                for j, v in zip(chunk, res):
                    vals[j] = v
            res_pdf = pdf[keep].copy()
            res_pdf[out] = pd.Series(vals, dtype="object")
            yield res_pdf

    return run_rows


def score_reviews(df: DataFrame, col: str, binary_pred: DataFrame, stars_pred: DataFrame,
                  id_col: str = "id", keep_all: bool = False, stars_name: str = "Score_1_5") -> DataFrame:
    """Combine a binary prediction (0/1) and a 0-4 star prediction per
    review id into ``Review, Sentimiento, <stars_name>, Puntuacion_Final_1_9``.
    ``keep_all`` keeps every input column; a blank review gives nulls, and a
    missing prediction gives a null name and final score."""
    b = binary_pred.select(F.col(id_col).alias("_id"), F.col("prediction").alias("_b"))
    s = stars_pred.select(F.col(id_col).alias("_id"), F.col("prediction").alias("_s"))
    x = df.join(b, df[id_col] == b["_id"], "left").drop("_id")
    x = x.join(s, x[id_col] == s["_id"], "left").drop("_id")
    blank = F.col(col).isNull() | (F.length(strip_ws(col)) == 0)
    sent = F.when(blank, F.lit(None)).otherwise(sentiment_name("_b"))
    stars = F.when(blank, F.lit(None)).otherwise(shift_label("_s", 1))
    x = x.withColumns({"Sentimiento": sent, stars_name: stars}).withColumn(
        "Puntuacion_Final_1_9",
        F.when(blank | F.col("Sentimiento").isNull(), F.lit(None)).otherwise(final_score("Sentimiento", stars_name))
    )
    cols = ([c for c in df.columns] if keep_all else [id_col, F.col(col).alias("Review")])
    return x.select(*cols, "Sentimiento", stars_name, "Puntuacion_Final_1_9")
