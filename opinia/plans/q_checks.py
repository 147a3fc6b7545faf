"""Catalogue: fitted models against a second way to the same answer.

Trees, forests and logistic models are saved, and each test row's prediction is recomputed from the saved
nodes or coefficients by joins and dot products (``operators.model_tables``); a row of the result says
whether the loaded model agrees.  The grid's scores are recomputed by a separate fit per fold.  One
more query tells models that have learned from those that always give the most frequent class."""

from __future__ import annotations

import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from opinia.operators import mllib as ML
from opinia.operators import model_tables as MT
from opinia.plans import q_mllib as Q
from opinia.plans.q_models import EMB_SPLIT
from opinia.plans.registry import register
from opinia.session import local_df, scratch_path
from opinia.sources.models import load_model, save_model

AGREE_SQL = f"WITH {EMB_SPLIT} SELECT vec_id, true AS agree FROM emb WHERE part = 'test'"


def _saved(spark, model):
    path = scratch_path(spark, f"model-{uuid.uuid4().hex[:12]}")
    save_model(model, path, spark=spark)
    return path, load_model(spark, path)


def _agreement(rows, predicted, again):
    """Per test row: whether both predictions are there and equal."""
    x = rows.select("id").join(predicted.select("id", F.col("prediction").cast("int").alias("_a")), "id", "left")
    x = x.join(again.select("id", F.col("prediction").cast("int").alias("_b")), "id", "left")
    return x.select(F.col("id").alias("vec_id"), F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("agree"))


def _test_rows(spark, d):
    return Q._emb(spark, d).where(F.col("part") == "test").withColumn("vec", vector_to_array("features"))


def _forest_check(fit):
    def build(spark, d):
        path, model = _saved(spark, fit(Q._emb(spark, d).where(F.col("part") == "train")))
        rows = _test_rows(spark, d)
        return _agreement(rows, model.transform(rows), MT.forest_predict(rows, MT.forest_nodes(spark, f"{path}/model")))

    return build


register("m2_decision_tree_check", AGREE_SQL, "M2 S9")(_forest_check(lambda train: ML.decision_tree(Q.M2_PARAMS).fit(train)))
register("m2_whole_tree_check", AGREE_SQL, "M2 S9")(_forest_check(lambda train: ML.decision_tree({"max_depth": 5}).fit(train)))
register("m3_random_forest_check", AGREE_SQL, "M3 S9")(_forest_check(
    lambda train: ML.random_forest(Q.M3_PARAMS, weight_col="w").fit(ML.balanced_weights(train, "label", "w"))))


@register("m5_logistic_check", AGREE_SQL, "M5 S9")
def m5_logistic_check(spark, d):
    train = Q._emb(spark, d).where(F.col("part") == "train")
    _, model = _saved(spark, ML.logistic_regression(C=1.0, n_rows=train.count(), max_iter=200).fit(train))
    rows = _test_rows(spark, d)
    return _agreement(rows, model.transform(rows), MT.logistic_predict(model, rows))


@register("m6_stacking_check", AGREE_SQL, "M6 S9")
def m6_stacking_check(spark, d):
    """The meta model's margins from its coefficients and the base models' probabilities."""
    _, model = _saved(spark, Q.stacking(Q._emb(spark, d).where(F.col("part") == "train")))
    rows = _test_rows(spark, d)
    parts = None
    for base in model.bases:
        one = base.transform(rows).select("id", vector_to_array("probability").alias("_p"))
        parts = one if parts is None else parts.join(one.withColumnRenamed("_p", "_q"), "id").select("id", F.concat("_p", "_q").alias("_p"))
    return _agreement(rows, model.transform(rows), MT.logistic_predict(model.meta, parts, vec="_p"))


@register("m11_predict_check", AGREE_SQL, "M11 S9")
def m11_predict_check(spark, d):
    """Predictions appended to a table whose target was dropped first."""
    path, model = _saved(spark, Q.m11_model(Q._emb(spark, d).where(F.col("part") == "train")))
    rows = _test_rows(spark, d)
    out = ML.predict(model, rows.drop("part"), target="label").withColumnRenamed("label_pred", "prediction")
    return _agreement(rows, out, MT.forest_predict(rows, MT.forest_nodes(spark, f"{path}/model")))


MODELS = ("decision_tree", "random_forest", "logistic_regression")


@register("m_models_beat_majority", " UNION ALL ".join(f"SELECT '{m}' AS model, true AS above_majority" for m in MODELS), "M2 M3 M5 E1")
def m_models_beat_majority(spark, d):
    """Per model: whether it has learned, that is, its accuracy on the part it was fitted on is above the share of the most
    frequent class there (the test part is too small and too noisy for such a statement)."""
    train = Q._emb(spark, d).where(F.col("part") == "train").persist()
    common = train.groupBy("label").count().orderBy(F.desc("count"), "label").first()[0]
    fitted = {"decision_tree": ML.decision_tree(Q.M2_PARAMS).fit(train),
              "random_forest": ML.random_forest(Q.M3_PARAMS, weight_col="w").fit(ML.balanced_weights(train, "label", "w")),
              "logistic_regression": ML.logistic_regression(C=1.0, n_rows=train.count(), max_iter=200).fit(train)}
    out = None
    for name in MODELS:
        one = fitted[name].transform(train).agg((F.count_if(F.col("prediction") == F.col("label")) > F.count_if(F.col("label") == common)).alias("above_majority"))
        one = one.select(F.lit(name).alias("model"), "above_majority")
        out = one if out is None else out.unionByName(one)
    return out


GRID_THREADS = 8
M8_GRID = {"maxDepth": [3, 5, 8], "minInstancesPerNode": [1, 4]}
M8_SQL = f"""
SELECT CAST(d AS INTEGER) AS max_depth, CAST(n AS INTEGER) AS min_rows, true AS agree
FROM (SELECT unnest({M8_GRID["maxDepth"]}) AS d), (SELECT unnest({M8_GRID["minInstancesPerNode"]}) AS n)
"""


@register("m8_grid_candidates", M8_SQL, "M8")
def m8_grid_candidates(spark, d):
    """One row per grid point; agree: its score is the mean of the accuracies of a separate fit per fold, and the best
    point's is the largest."""
    train = Q._emb(spark, d).where(F.col("part") != "test")
    _, points, best = ML.scored_grid(ML.decision_tree({"max_depth": 5}), M8_GRID, train, folds=5, key="id", parallelism=GRID_THREADS)
    data = ML.dealt(ML.fold_column(train, "id", "label", 5, 42), "id").persist()
    ev = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")

    def accuracy(task):
        p, f = task
        est = ML.decision_tree({"max_depth": p["maxDepth"], "min_samples_leaf": p["minInstancesPerNode"]})
        return ev.evaluate(est.fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f)))

    # the fits are many short jobs that leave most cores idle one by one
    with ThreadPool(GRID_THREADS) as pool:
        scores = pool.map(inheritable_thread_target(spark)(accuracy), [(p, f) for p, _ in points for f in range(5)], chunksize=1)
    rows = []
    for i, (p, x) in enumerate(points):
        each = scores[5 * i:5 * i + 5]
        rows.append((p["maxDepth"], p["minInstancesPerNode"], bool(abs(sum(each) / 5 - x) < 1e-9 and x <= points[best][1])))
    data.unpersist()
    return local_df(spark, rows, "max_depth int, min_rows int, agree boolean")
