"""The corpus pipeline: five stages over ``documents``, each written as Parquet and
read again as the next one's input.  All but the last return the columns of
``documents``; ORACLE_SQL is None, since SQL cannot express the fitted stages (the
tests hold them against brute force)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinia.llm import chosen_path, decontaminate, line_dedup, mixing, toxicity
from opinia.llm.common import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    scored = toxicity.fit_and_score(keyed.select("doc_id", "_h", "text"), labels)
    bad = scored.where("predicted = 1").select("doc_id", "_h").distinct().withColumnsRenamed({"doc_id": "_id", "_h": "_k"})
    kept = keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k")), "left_anti")
    return kept.select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are like an earlier line go; a document that loses all its text with
    them goes too."""
    found = line_dedup.dedup(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = found.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the first by id; of rows that equal
    each other in id and text one stays."""
    keep = chosen_path.join(docs).where("keep").select(*docs.columns)
    keyed = keep.withColumn("_h", F.xxhash64("text"))
    return keyed.dropDuplicates(["doc_id", "_h"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words or more go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items).where("NOT contaminated").select(*docs.columns)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates for equal shares of the languages; documents of rate 0 go."""
    return mixing.mix(docs, mixing.fit(docs, "lang"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_languages),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
