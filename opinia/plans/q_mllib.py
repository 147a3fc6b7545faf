"""Catalogue: MLlib models (M2, M3, M5-M8, M10, M11, F7, F11).  Results of
fitted models have no SQL oracle; the driver checks their row counts."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from opinia.functions.vectors import dense_vector
from opinia.operators import evaluate as E
from opinia.operators import lexicon as LX
from opinia.operators import mllib as ML
from opinia.operators import model_tables as MT
from opinia.operators import prep as P
from opinia.operators import tfidf as TF
from opinia.plans.fixtures import DEMO_NEGATORS, boosters_df, lemma_df, lexicon_df
from opinia.plans.registry import register
from opinia.session import local_df, scratch_path, table
from opinia.sources.models import load_model, save_model


def _emb(spark, d):
    emb = table(spark, d, "embeddings")
    x = emb.select(F.col("vec_id").alias("id"), dense_vector(F.col("embedding").cast("array<double>")).alias("features"),
                   F.col("label").cast("double").alias("label"))
    return P.split_column(x, "id", (0.6, 0.2, 0.2), seed=42)


def _fit_apply(spark, d, est):
    parts = _emb(spark, d)
    model = est.fit(parts.where(F.col("part") == "train"))
    pred = model.transform(parts.where(F.col("part") == "test"))
    return pred.select(F.col("id").alias("vec_id"), F.col("prediction").cast("int").alias("prediction"))


M2_PARAMS = {"criterion": "gini", "max_depth": 10, "min_samples_leaf": 2, "max_features": "sqrt", "min_samples_split": 5}
M3_PARAMS = {"n_estimators": 50, "max_depth": 10, "max_features": "sqrt", "bootstrap": False}


@register("m2_decision_tree", None, "M2 F7")
def m2_decision_tree(spark, d):
    return _fit_apply(spark, d, ML.decision_tree(M2_PARAMS))


@register("m3_random_forest_balanced", None, "M3")
def m3_random_forest_balanced(spark, d):
    parts = ML.balanced_weights(_emb(spark, d), "label", "w")
    est = ML.random_forest(M3_PARAMS, weight_col="w")
    model = est.fit(parts.where(F.col("part") == "train"))
    pred = model.transform(parts.where(F.col("part") == "test"))
    return pred.select(F.col("id").alias("vec_id"), F.col("prediction").cast("int").alias("prediction"))


@register("m5_logistic_regression", None, "M5")
def m5_logistic_regression(spark, d):
    parts = _emb(spark, d)
    train = parts.where(F.col("part") == "train")
    est = ML.logistic_regression(C=1.0, n_rows=train.count(), max_iter=200)
    model = est.fit(train)
    pred = model.transform(parts.where(F.col("part") == "test"))
    return pred.select(F.col("id").alias("vec_id"), F.col("prediction").cast("int").alias("prediction"))


def stacking(train):
    bases = [
        ML.random_forest({"n_estimators": 20, "max_depth": 8}),
        ML.logistic_regression(C=1.0, n_rows=train.count(), max_iter=100),
    ]
    return ML.fit_stacking(
        train, bases, lambda col: LogisticRegression(featuresCol=col, labelCol="label", maxIter=100), folds=5
    )


@register("m6_stacking", None, "M6 M3 M5")
def m6_stacking(spark, d):
    parts = _emb(spark, d)
    model = stacking(parts.where(F.col("part") == "train"))
    pred = model.transform(parts.where(F.col("part") == "test"))
    return pred.select(F.col("id").alias("vec_id"), F.col("prediction").cast("int").alias("prediction"))


def clustered_reviews(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return ML.fit_review_clusters(docs, "doc_id", "text", list(TF.english_stop_words()), lemma_df(spark), k=9, seed=42)


@register("m7_kmeans_reviews", None, "M7 F6 T2")
def m7_kmeans_reviews(spark, d):
    _, out = clustered_reviews(spark, d)
    return out.select("doc_id", "Review_Procesado", "Cluster")


@register("m7_cluster_samples", None, "M7 G6")
def m7_cluster_samples(spark, d):
    """Five reviews of each cluster."""
    _, out = clustered_reviews(spark, d)
    return ML.cluster_samples(out.select("doc_id", "text", "Cluster"), "doc_id", 5)


@register("m7_nearest_centre_check", "SELECT doc_id, true AS nearest FROM documents", "M7")
def m7_nearest_centre_check(spark, d):
    """Whether each document's cluster is that of the nearest centre, recomputed by joins with the fitted centres."""
    model, out = clustered_reviews(spark, d)
    found = ML.nearest_centres(out, model.stages[-1].clusterCenters(), "doc_id")
    x = out.select("doc_id", "Cluster").join(found, out["doc_id"] == found["id"], "left")
    return x.select("doc_id", F.coalesce(F.col("Cluster") == F.col("nearest"), F.lit(False)).alias("nearest"))


@register("m8_grid_search", None, "M8 M2")
def m8_grid_search(spark, d):
    parts = _emb(spark, d)
    train = parts.where(F.col("part") != "test")
    est = ML.decision_tree({"max_depth": 5})
    _, params, score = ML.grid_search(est, {"maxDepth": [3, 5, 8], "minInstancesPerNode": [1, 4]}, train,
                                      folds=5, key="id")
    rows = [(k, str(v)) for k, v in sorted(params.items())] + [("cv_accuracy", f"{score:.6f}")]
    return local_df(spark, rows, "Parametro string, Valor string")


def lexicon_scores(spark, docs):
    scores = LX.valence_scores(docs, "doc_id", "text", lexicon_df(spark), boosters_df(spark), DEMO_NEGATORS)
    path = scratch_path(spark, f"scores-{uuid.uuid4().hex[:12]}")
    scores.withColumnRenamed("doc_id", "id").write.parquet(path)  # four numbers a text, read by each pass of the forest
    return ML.dealt(spark.read.parquet(path), "id")


def rated_scores(spark, d, scores=None):
    rating = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("Rating"))
    scores = lexicon_scores(spark, table(spark, d, "documents").select("doc_id", "text")) if scores is None else scores
    return scores.join(rating, "id")


@register("m10_rating_from_lexicon", None, "M10 L1 L4 M3")
def m10_rating_from_lexicon(spark, d):
    _, out = ML.rating_from_lexicon(rated_scores(spark, d), "Rating", key="id")
    return out.select(F.col("id").alias("doc_id"), "Scaled_Rating", "Predicted_Rating")


@register("m10_rating_report", None, "M10 E4 E5")
def m10_rating_report(spark, d):
    """Report and matrix of the train and the test part."""
    _, out = ML.rating_from_lexicon(rated_scores(spark, d), "Rating", key="id")
    return E.result_bundle(out, "part", "Scaled_Rating", "Predicted_Rating")


@register("m10_apply_to_new_reviews", "SELECT doc_id, true AS agree FROM documents", "M10 S9 L1")
def m10_apply_to_new_reviews(spark, d):
    """The saved and loaded model on reviews without a rating (all documents); agree: the prediction equals the one that the
    saved trees give on the four scores, clipped to 1-9."""
    scores = lexicon_scores(spark, table(spark, d, "documents").select("doc_id", "text"))
    model, _ = ML.rating_from_lexicon(rated_scores(spark, d, scores), "Rating", key="id")
    path = scratch_path(spark, f"model-{uuid.uuid4().hex[:12]}")
    save_model(model, path, spark=spark)
    out = ML.apply_rating(load_model(spark, path), scores)
    forest = scratch_path(spark, f"forest-{uuid.uuid4().hex[:12]}")
    save_model(model.stages[-1], forest, spark=spark)
    rows = scores.select("id", F.array("compound", "pos", "neu", "neg").alias("vec"))
    again = MT.forest_predict(rows, MT.forest_nodes(spark, f"{forest}/model")).withColumnRenamed("prediction", "_b")
    x = out.join(again, "id", "left")
    return x.select(F.col("id").alias("doc_id"), F.coalesce(F.col("Predicted_Rating") == F.greatest(F.lit(1), F.least(F.lit(9), F.col("_b"))), F.lit(False)).alias("agree"))


def m11_model(train):
    return ML.random_forest({"n_estimators": 20, "max_depth": 8}).fit(train)


@register("m11_predict", None, "M11 M3")
def m11_predict(spark, d):
    parts = _emb(spark, d)
    model = m11_model(parts.where(F.col("part") == "train"))
    test = parts.where(F.col("part") == "test").drop("part")
    return ML.predict(model, test, target="label").select(F.col("id").alias("vec_id"), "label_pred")


@register("f11_prepare", None, "F11 F1 F2 F4 F5 F6 F8 T3")
def f11_prepare(spark, d):
    from opinia.plans.prepare import prepare

    part = table(spark, d, "part")
    pt = prepare(part, target="p_type", key="p_partkey", config={"max_text_features": 3000, "text_min_df": 2})
    return pt.df.select("p_partkey", "p_type", "p_brand", "p_size", "p_retailprice", "text_features")


# The decision-tree grid of the reference's configuration.
TREE_GRID = {
    "criterion": ["gini"],
    "max_depth": [5, 10, 20, 30],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["sqrt", "log2"],
    "splitter": ["best"],
}


@register("m12_run_train", None, "M12 M8 M2")
def m12_run_train(spark, d):
    parts = _emb(spark, d)
    train = parts.where(F.col("part") != "test").drop("part")
    _, params, score = ML.run({"decision_tree": TREE_GRID}, "train", "decision_tree", train_df=train)
    rows = [(k, str(v)) for k, v in sorted(params.items())] + [("cv_accuracy", f"{score:.6f}")]
    return local_df(spark, rows, "Parametro string, Valor string")


# ---------------------------------------------------------------- F11 on the train part only

F11_SQL = """
WITH p AS (SELECT *, ('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || ':42'), 1, 8))::BIGINT / 4294967296.0 < 0.8 AS tr FROM part),
t AS (SELECT min(p_size) AS a, max(p_size) AS b, avg(p_size) AS m, min(CAST(p_retailprice AS DOUBLE)) AS c, max(CAST(p_retailprice AS DOUBLE)) AS e FROM p WHERE tr),
br AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM p WHERE tr))
SELECT p.p_partkey, CAST(br.code AS INTEGER) AS p_brand, round((coalesce(p_size, t.m) - t.a) / (t.b - t.a), 6) AS p_size,
       round((CAST(p_retailprice AS DOUBLE) - t.c) / (t.e - t.c), 6) AS p_retailprice
FROM p CROSS JOIN t LEFT JOIN br USING (p_brand) WHERE NOT tr
"""


@register("f11_prepare_train_only", F11_SQL, "F11 F1 F2 F4 F5 F10c")
def f11_prepare_train_only(spark, d):
    """The test part, prepared with the parameters of the train part."""
    from opinia.plans.prepare import prepare

    part = P.split_column(table(spark, d, "part"), "p_partkey", (0.8, 0.2), seed=42, names=("train", "test"))
    pt = prepare(part.where("part = 'train'").drop("part"), target="p_type", key="p_partkey", config={"text_min_df": 2})
    out = pt.transform(part.where("part = 'test'").drop("part"))
    return out.select("p_partkey", F.col("p_brand").cast("int").alias("p_brand"), F.round("p_size", 6).alias("p_size"),
                      F.round("p_retailprice", 6).alias("p_retailprice"))
