"""the whole preparation chain driven by a config dictionary (the
reference's ``preprocessing`` block): column roles -> text simplification and
TF-IDF of every text column -> label encoding -> missing values ->
scaling -> resampling.

Every step is fitted once and kept, so ``PreparedTable.transform`` applies
the *same* parameters to new data (the reference refits at test time; trap
7).  The key column is carried through untouched and is not a feature.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinia.operators import prep as P
from opinia.operators import tfidf as TF
from opinia.operators.joins import lookup_join
from opinia.operators.text import bag_text
from opinia.session import local_df

DEFAULT_CONFIG = {
    "unique_category_threshold": 51,
    "missing_values": "impute",
    "impute_strategy": "mean",
    "scaling": "minmax",
    "text_process": "tf-idf",
    "sampling": "oversampling",
    "max_text_features": 3000,
    "text_min_df": 5,
    "text_max_df": 0.75,
}


@dataclass
class PreparedTable:
    df: DataFrame
    roles: P.Roles
    codes: dict = field(default_factory=dict)
    imputer: P.Imputer | None = None
    scaler: P.Scaler | None = None
    tfidf: dict = field(default_factory=dict)  # of each text column
    key: str = "id"
    target: str | None = None
    config: dict = field(default_factory=dict)

    def transform(self, new: DataFrame) -> DataFrame:
        """Apply the fitted steps (no refit, no resampling) to new rows."""
        return _apply(new, self, fit=False).df


def _encode_with(df: DataFrame, col: str, codes: DataFrame) -> DataFrame:
    m = codes.select(F.col("value").alias("_v"), F.col("code").alias("_k"))
    return lookup_join(df, m, df[col].eqNullSafe(m["_v"]), "left").drop(col, "_v").withColumnRenamed("_k", col)


def _with_text(x: DataFrame, pt: PreparedTable, fit: bool) -> DataFrame:
    """The vectors of all text columns, one after the other, as ``text_features``."""
    cfg, vectors = pt.config, []
    none = local_df(x.sparkSession, [], "word string, stem string")
    for tcol in pt.roles.text:
        y = bag_text(x.select(pt.key, tcol), pt.key, tcol, TF.english_stop_words(), none)
        if fit:
            spec = TF.TfidfSpec(lo=1, hi=2, max_features=cfg.get("max_text_features"), min_df=cfg.get("text_min_df", 1),
                                max_df=cfg.get("text_max_df", 1.0), sublinear=True)
            pt.tfidf[tcol] = TF.fit_tfidf(y, pt.key, tcol, spec)
            pt.tfidf[tcol].vocab = pt.tfidf[tcol].vocab.persist()  # bounded by max_text_features
        w = pt.tfidf[tcol].transform(y, pt.key, tcol)
        vec = TF.to_vectors(w, pt.tfidf[tcol], ids=y.select(pt.key))
        x = x.join(vec.select(F.col("id").alias(pt.key), F.col("features").alias(f"_vec_{len(vectors)}")), pt.key, "left")
        size = max(pt.tfidf[tcol].vocab.count(), 1)
        x = VectorSizeHint(inputCol=f"_vec_{len(vectors)}", size=size, handleInvalid="optimistic").transform(x)
        vectors.append(f"_vec_{len(vectors)}")
    x = VectorAssembler(inputCols=vectors, outputCol="text_features").transform(x)
    return x.drop(*vectors, *pt.roles.text)


def _apply(df: DataFrame, pt: PreparedTable, fit: bool) -> PreparedTable:
    cfg = pt.config
    roles = pt.roles
    x = df
    if roles.text and cfg.get("text_process") == "tf-idf":
        x = _with_text(x, pt, fit)
    cats = list(roles.categorical) + ([pt.target] if pt.target and pt.target in x.columns else [])
    for c in cats:
        if fit:
            pt.codes[c] = P.label_codes(x, c).persist()
        x = _encode_with(x, c, pt.codes[c])
    feats = [c for c in roles.numeric if c != pt.key]
    if cfg.get("missing_values") == "drop":
        x = x.na.drop(subset=feats + list(roles.categorical))
    else:
        if fit:
            pt.imputer = P.fit_impute(x, feats, list(roles.categorical), cfg.get("impute_strategy", "mean"))
        x = pt.imputer.transform(x)
    if cfg.get("scaling") and feats:
        if fit:
            pt.scaler = P.fit_scale(x, feats, cfg["scaling"])
        x = pt.scaler.transform(x)
    pt.df = x
    return pt


def prepare(df: DataFrame, target: str, key: str, config: dict | None = None, seed: int = 42) -> PreparedTable:
    """Fit all steps on ``df``, which should be the train part, and resample it; ``transform`` of the result prepares the
    other parts with the same parameters and no resampling."""
    cfg = dict(DEFAULT_CONFIG, **(config or {}))
    roles = P.column_roles(df, target, cfg["unique_category_threshold"])
    roles.numeric = [c for c in roles.numeric if c != key]
    pt = _apply(df, PreparedTable(df, roles, key=key, target=target, config=cfg), fit=True)
    sampling = cfg.get("sampling")
    if sampling in ("oversampling", "undersampling"):
        pt.df = P.resample(pt.df, target, "over" if sampling == "oversampling" else "under", key=key, seed=seed)
    return pt
