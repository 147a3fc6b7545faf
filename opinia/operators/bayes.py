"""M4: multinomial naive Bayes, fitted and applied relationally on long
feature tables ``(id, term, value)``.

``ln p(t|c) = ln((N_ct + a) / (N_c + a V))``; prior ``ln(n_c / n)`` or
``-ln K`` when ``fit_prior`` is false; the prediction is the arg-max, ties to
the smallest label.  The class x vocabulary grid is never built: a
document's score is

    prior_c + X_doc * ln(a / (N_c + a V)) + sum_{t in doc, N_ct > 0} x_t * ln((N_ct + a) / a)

so only terms that occur in a class are joined, and the per-class constant
needs the document's total mass ``X_doc`` only.  Classes are few (bounded and
checked); each document is scored against each by exploding a literal array.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinia.operators.joins import lookup_join
from opinia.operators.prep import MAX_CLASSES


@dataclass
class NaiveBayesModel:
    classes: list  # sorted
    prior: dict
    base: dict  # ln(a / (N_c + a V))
    delta: DataFrame  # (term, cls, d)
    alpha: float

    def predict(self, ids: DataFrame, feats: DataFrame, id_col: str = "id") -> DataFrame:
        """``(id, prediction)`` for every id of ``ids``; ``feats`` is the long
        feature table ``(id, term, value)`` (absent terms are 0)."""
        mass = feats.groupBy("id").agg(F.sum("value").alias("_x"))
        per_class = F.array(*[
            F.struct(F.lit(c).alias("cls"), F.lit(self.prior[c]).alias("prior"), F.lit(self.base[c]).alias("base"))
            for c in self.classes
        ])
        grid = (
            ids.select(F.col(id_col).alias("id")).distinct()
            .join(mass, "id", "left")
            .select("id", F.coalesce("_x", F.lit(0.0)).alias("_x"), F.explode(per_class).alias("k"))
            .select("id", F.col("k.cls").alias("cls"), (F.col("k.prior") + F.col("_x") * F.col("k.base")).alias("s0"))
        )
        hits = (
            lookup_join(feats.select("id", "term", "value"), self.delta, "term")
            .groupBy("id", "cls")
            .agg(F.sum(F.col("value") * F.col("d")).alias("s1"))
        )
        scored = grid.join(hits, ["id", "cls"], "left").select(
            "id", "cls", (F.col("s0") + F.coalesce("s1", F.lit(0.0))).alias("score")
        )
        return scored.groupBy("id").agg(
            F.min_by("cls", F.struct((-F.col("score")).alias("a"), F.col("cls").alias("b"))).alias("prediction")
        ).withColumnRenamed("id", id_col)


def fit_naive_bayes(feats: DataFrame, labels: DataFrame, n_features: int, alpha: float = 1.0,
                    fit_prior: bool = True, id_col: str = "id", label_col: str = "label") -> NaiveBayesModel:
    """Fit on long features ``(id, term, value)`` (non-negative) and a label
    table ``(id, label)``.  ``n_features`` = vocabulary size V."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("cls"))
    counts = lab.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError("too many classes")
    n = sum(r.n for r in counts)
    classes = sorted(r.cls for r in counts)
    k = len(classes)
    nc = {r.cls: r.n for r in counts}
    fc = feats.join(lab, "id").groupBy("cls", "term").agg(F.sum("value").alias("fc"))
    fc = fc.persist()
    tot = {r.cls: r.t for r in fc.groupBy("cls").agg(F.sum("fc").alias("t")).collect()}
    prior = {c: (math.log(nc[c] / n) if fit_prior else -math.log(k)) for c in classes}
    base = {c: math.log(alpha / (tot.get(c, 0.0) + alpha * n_features)) for c in classes}
    delta = fc.where(F.col("fc") > 0).select("term", "cls", F.log((F.col("fc") + alpha) / alpha).alias("d"))
    return NaiveBayesModel(classes, prior, base, delta, alpha)
