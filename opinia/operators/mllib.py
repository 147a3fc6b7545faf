"""MLlib estimators with the reference's hyper-parameters (M2, M3, M5-M8,
M10-M12, F7).

Mapping of parameters that have no exact MLlib twin:
* ``max_depth=None`` -> 30 (MLlib's maximum);
* ``min_samples_leaf`` -> ``minInstancesPerNode``;
* ``min_samples_split`` and ``splitter`` are accepted and ignored (warned);
* a tree with ``max_features`` other than all -> a one-tree forest without
  bootstrap and with that ``featureSubsetStrategy``;
* ``class_weight='balanced'`` -> a weight column ``n / (k * n_c)``;
* logistic ``C`` -> ``regParam = 1 / (C * n)``, no elastic net, no
  standardisation.
Folds for cross validation come from the seeded hash, stratified by label, so
they are reproducible and independent of partitioning.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinia.functions.text import tokens
from opinia.operators import grid as grid_search_of
from opinia.operators.aggregates import sample_per_group
from opinia.operators.bayes import NaiveBayesModel, fit_naive_bayes
from opinia.operators.prep import class_counts, split_column
from opinia.operators.review_features import sparse_columns
from opinia.operators.sparse_knn import SparseKnnModel
from opinia.operators.sparse_knn import fit as fit_knn
from opinia.operators.spread import spread
from opinia.operators.text import normalise_words
from opinia.session import local_df

MAX_DEPTH = 30
IGNORED = ("min_samples_split", "splitter", "algorithm", "leaf_size", "class_prior")


def _depth(v):
    if v is not None and int(v) > MAX_DEPTH:
        warnings.warn(f"max_depth {v} is above MLlib's limit; {MAX_DEPTH} is used", stacklevel=3)
    return MAX_DEPTH if v is None else min(int(v), MAX_DEPTH)


def _warn_ignored(params: dict):
    for k in IGNORED:
        if k in params:
            warnings.warn(f"{k} has no MLlib equivalent and is ignored", stacklevel=3)


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """stack sparse text vectors and dense numeric columns."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def decision_tree(params: dict, features: str = "features", label: str = "label", seed: int = 42):
    """M2."""
    _warn_ignored(params)
    mf = params.get("max_features")
    common = dict(
        featuresCol=features, labelCol=label, seed=seed,
        maxDepth=_depth(params.get("max_depth")),
        minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
        impurity=params.get("criterion", "gini"),
    )
    if mf in (None, "all", "auto"):
        common.pop("seed")
        return DecisionTreeClassifier(**common)
    return RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy=str(mf), **common)


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """``n / (k * n_c)`` per row (class counts are few and checked)."""
    counts = class_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    m = F.create_map(*[x for c, v in counts.items() for x in (F.lit(c), F.lit(n / (k * v)))])
    return df.withColumn(out, m[F.col(label)])


def random_forest(params: dict, features: str = "features", label: str = "label", seed: int = 42,
                  weight_col: str | None = None):
    """M3."""
    _warn_ignored(params)
    rf = RandomForestClassifier(
        featuresCol=features, labelCol=label, seed=seed,
        numTrees=int(params.get("n_estimators", 100)),
        maxDepth=_depth(params.get("max_depth")),
        minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
        impurity=params.get("criterion", "gini"),
        bootstrap=bool(params.get("bootstrap", True)),
        featureSubsetStrategy=str(params.get("max_features", "sqrt")),
    )
    if weight_col:
        rf.setWeightCol(weight_col)
    return rf


def logistic_regression(C: float, n_rows: int, max_iter: int = 100, features: str = "features",
                        label: str = "label"):
    """M5."""
    return LogisticRegression(
        featuresCol=features, labelCol=label, maxIter=max_iter,
        regParam=1.0 / (C * n_rows), elasticNetParam=0.0, standardization=False,
    )


HASHED_WORDS = 1 << 14


def kmeans_reviews(df: DataFrame, k: int = 9, seed: int = 42, features: str = "features",
                   out: str = "Cluster") -> DataFrame:
    """M7 on given vectors: adds the cluster id."""
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol=out).fit(df)
    return model.transform(df).withColumn(out, F.col(out).cast("int"))


def fit_review_clusters(df: DataFrame, id_col: str, text_col: str, stop_words: list[str], lemmas: DataFrame, k: int = 9,
                        seed: int = 42, width: int = HASHED_WORDS, max_iter: int = 20) -> tuple[PipelineModel, DataFrame]:
    """M7: normalised words (T2) as ``Review_Procesado``, their TF-IDF by feature hashing to ``width`` places (so the
    vectors and the k centres have a fixed size, whatever the vocabulary), k-means.  Returns the fitted
    pipeline and the table with ``Review_Procesado``, ``features`` and ``Cluster``."""
    x = normalise_words(spread(df, id_col, text_col).withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))), id_col, "_text", stop_words, lemmas).drop("_text")
    x = x.withColumn("_words", tokens(F.col("Review_Procesado"))).persist()
    try:
        pipe = Pipeline(stages=[
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=width), IDF(inputCol="_tf", outputCol="_w"),
            Normalizer(inputCol="_w", outputCol="features"),
            KMeans(k=k, seed=seed, featuresCol="features", predictionCol="Cluster", maxIter=max_iter)])
        model = pipe.fit(x)
    finally:
        x.unpersist()
    return model, model.transform(x).drop("_words", "_tf", "_w")


def cluster_samples(clustered: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """M7's sample: the first ``n`` reviews of each cluster by id."""
    return sample_per_group(clustered, "Cluster", [id_col], n)


def nearest_centres(clustered: DataFrame, centres: list, id_col: str) -> DataFrame:
    """``(id, nearest, distance2)`` recomputed by joins: a vector's places meet the centres' places; ties go to the
    smallest cluster."""
    spark = clustered.sparkSession
    places = local_df(spark, [(i, c, float(v)) for c, x in enumerate(centres) for i, v in enumerate(x.tolist()) if v], "i int, c int, v double")
    norms = local_df(spark, [(c, float((x * x).sum())) for c, x in enumerate(centres)], "c int, n double")
    v = F.unwrap_udt("features")
    own = clustered.select(F.col(id_col).alias("id"), F.explode(F.arrays_zip(v["indices"].alias("i"), v["values"].alias("x"))).alias("e"))
    own = own.select("id", F.col("e.i").alias("i"), F.col("e.x").alias("x"))
    dots = own.join(F.broadcast(places), "i").groupBy("id", "c").agg(F.sum(F.col("x") * F.col("v")).alias("d"))
    sizes = own.groupBy("id").agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    every = clustered.select(F.col(id_col).alias("id"), F.explode(F.sequence(F.lit(0), F.lit(len(centres) - 1))).alias("c"))
    both = every.join(F.broadcast(norms), "c").join(dots, ["id", "c"], "left").join(sizes, "id", "left")
    far = F.col("n") + F.coalesce("s", F.lit(0.0)) - 2 * F.coalesce("d", F.lit(0.0))
    return both.select("id", "c", F.round(far, 9).alias("f")).groupBy("id").agg(
        F.min_by("c", F.struct("f", "c")).alias("nearest"), F.min("f").alias("distance2"))


def fold_column(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42,
                out: str = "fold") -> DataFrame:
    """Stratified, seeded fold ids 0..folds-1 (exact per-class sizes)."""
    ratios = tuple([1.0 / folds] * folds)
    names = tuple(str(i) for i in range(folds))
    x = split_column(df, key, ratios, seed=seed, names=names, stratify=label)
    return x.withColumn(out, F.col("part").cast("int")).drop("part")


DEALT_ROWS = 10_000
ROWS_PER_TASK = 50_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows spread over the cores by ``key``: a stratified split leaves those of a class in one task, where every pass of a
    fit would read them.  Few rows stay as they are."""
    rows = df.count()
    if rows <= DEALT_ROWS:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)), key)


def grid_search(estimator, grid: dict, df: DataFrame, folds: int = 5, metric: str = "accuracy",
                label: str = "label", key: str = "id", seed: int = 42, parallelism: int = 4):
    """M8: ``CrossValidator`` over a grid ``{param_name: [values]}`` with
    reproducible stratified folds.  Returns ``(best_model, best_params,
    best_score)``; ties go to the first grid point."""
    model, scored, best = scored_grid(estimator, grid, df, folds, metric, label, key, seed, parallelism)
    return model, *scored[best]


def scored_grid(estimator, grid: dict, df: DataFrame, folds: int = 5, metric: str = "accuracy",
                label: str = "label", key: str = "id", seed: int = 42, parallelism: int = 4):
    """M8: ``(best model, [(params, score)] of every grid point, number of the best)``."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    maps = builder.build()
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    data = dealt(fold_column(df, key, label, folds, seed), key).persist()
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=ev, foldCol="fold", numFolds=folds,
                        parallelism=parallelism, seed=seed)
    try:
        model = cv.fit(data)
    finally:
        data.unpersist()
    scores = list(model.avgMetrics)
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    return model.bestModel, [({p.name: v for p, v in m.items()}, x) for m, x in zip(maps, scores, strict=True)], best


@dataclass
class StackingModel:
    bases: list
    meta: object
    features: str
    prob_cols: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        x = df
        for i, m in enumerate(self.bases):
            x = _probabilities(m.transform(x), f"_p{i}")
        x = VectorAssembler(inputCols=self.prob_cols, outputCol="_meta").transform(x)
        return self.meta.transform(x).drop(*self.prob_cols, "_meta")


def _probabilities(pred: DataFrame, out: str) -> DataFrame:
    return pred.withColumn(out, F.col("probability")).drop("rawPrediction", "probability", "prediction")


def fit_stacking(df: DataFrame, bases: list, meta_factory, folds: int = 5, label: str = "label",
                 key: str = "id", features: str = "features", seed: int = 42) -> StackingModel:
    """M6: the meta learner is fitted on out-of-fold class probabilities of
    the base learners; the bases are then refitted on all rows.  Each fold
    step is a distributed fit; rows never pass through the driver."""
    data = dealt(fold_column(df, key, label, folds, seed), key).persist()
    cols = [f"_p{i}" for i in range(len(bases))]
    parts = []
    for f in range(folds):
        rest = data.where(F.col("fold") != f)
        hold = data.where(F.col("fold") == f)
        x = hold
        for i, est in enumerate(bases):
            x = _probabilities(est.fit(rest).transform(x), cols[i])
        parts.append(x)
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    oof = VectorAssembler(inputCols=cols, outputCol="_meta").transform(oof)
    meta = meta_factory("_meta").fit(oof)
    fitted = [est.fit(data) for est in bases]
    return StackingModel(fitted, meta, features, cols)


def rating_from_lexicon(scores: DataFrame, rating_col: str = "Rating", seed: int = 42,
                        train_ratio: float = 0.8, key: str = "id") -> tuple[PipelineModel, DataFrame]:
    """Random forest on ``compound, pos, neu, neg`` -> the 1-9 scaled
    rating; returns the fitted pipeline and the table with
    ``Scaled_Rating`` and ``Predicted_Rating`` (clipped to 1-9)."""
    from opinia.functions.labels import scale_rating

    x = scores.withColumn("Scaled_Rating", scale_rating(rating_col))
    x = dealt(split_column(x, key, (train_ratio, 1 - train_ratio), seed=seed, names=("train", "test")), key)
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=["compound", "pos", "neu", "neg"], outputCol="_f"),
        RandomForestClassifier(featuresCol="_f", labelCol="Scaled_Rating", seed=seed, numTrees=100,
                               predictionCol="_pred"),
    ])
    model = pipe.fit(x.where(F.col("part") == "train"))
    return model, apply_rating(model, x)


def apply_rating(model: PipelineModel, scores: DataFrame) -> DataFrame:
    """M10 on new reviews: ``scores`` (``compound, pos, neu, neg``) plus ``Predicted_Rating``, clipped to 1-9."""
    out = model.transform(scores)
    return out.withColumn("Predicted_Rating", F.greatest(F.lit(1.0), F.least(F.lit(9.0), F.col("_pred")))).drop(
        "_f", "_pred", "rawPrediction", "probability")


def predict(model, df: DataFrame, target: str | None = None, prediction_col: str = "prediction") -> DataFrame:
    """Drop the target if present, apply the model, append
    ``<target>_pred``."""
    x = df.drop(target) if target and target in df.columns else df
    out = model.transform(x)
    name = f"{target}_pred" if target else "pred"
    keep = [c for c in x.columns] + [F.col(prediction_col).alias(name)]
    return out.select(*keep)


ESTIMATORS = {
    "decision_tree": decision_tree,
    "random_forest": random_forest,
}


# Names of the configuration and the MLlib parameters that they set.
TUNABLE = {
    "max_depth": ("maxDepth", _depth),
    "min_samples_leaf": ("minInstancesPerNode", int),
    "n_estimators": ("numTrees", int),
    "criterion": ("impurity", lambda v: "entropy" if v == "log_loss" else v),
    "max_features": ("featureSubsetStrategy", lambda v: "all" if v is None else str(v)),
    "bootstrap": ("bootstrap", bool),
}


def run(config: dict, mode: str, algorithm: str, train_df: DataFrame | None = None, model=None,
        test_df: DataFrame | None = None, label: str = "label", key: str = "id", metric: str = "accuracy"):
    """``train`` picks the algorithm by name (kNN, decision_tree, random_forest, naive_bayes) and tunes it on all values
    of the grid ``config[algorithm]`` that it has a parameter for; the others are named in a warning.  Returns
    ``(model, best parameters, best score)``.  ``test`` applies a model and appends its prediction.

    Trees and forests are tuned by MLlib's cross validation for ``metric``; nearest neighbours and naive Bayes by
    one pass over the folds (``operators.grid``) for accuracy, on the vectors' non-zero places."""
    if mode == "train":
        grid = config.get(algorithm, {})
        if algorithm in ("kNN", "naive_bayes"):
            if metric != "accuracy":
                raise ValueError(f"{algorithm} is tuned for accuracy")
            return _train_relational(algorithm, grid, train_df, label, key)
        if algorithm not in ESTIMATORS:
            raise ValueError(f"unknown algorithm {algorithm}")
        first = {k: v[0] for k, v in grid.items()}
        est = ESTIMATORS[algorithm](first, label=label)
        tunable = {}
        for k, v in grid.items():
            name, convert = TUNABLE.get(k, (None, None))
            if name and est.hasParam(name):
                tunable[name] = list(dict.fromkeys(convert(x) for x in v))
            elif k not in IGNORED and len(v) > 1:
                warnings.warn(f"{k} has no MLlib equivalent; its values are not searched", stacklevel=2)
        return grid_search(est, tunable, train_df, label=label, key=key, metric=metric)
    if mode == "test":
        return _test_relational(model, test_df, label, key) if isinstance(model, (SparseKnnModel, NaiveBayesModel)) else predict(model, test_df, label)
    raise ValueError(mode)


def _long(rows: DataFrame, key: str) -> DataFrame:
    """``(id, term, value)`` of sparse rows; the term is the place."""
    x = rows.select(F.col(key).alias("id"), F.explode(F.arrays_zip("idx", "val")).alias("e"))
    return x.select("id", F.col("e.idx").cast("string").alias("term"), F.col("e.val").alias("value"))


def _train_relational(algorithm: str, grid: dict, df: DataFrame, label: str, key: str):
    for k in grid:
        if k in IGNORED and len(grid[k]) > 1:
            warnings.warn(f"{k} changes no result and is ignored", stacklevel=3)
    rows = fold_column(sparse_columns(df).select(F.col(key).alias("id"), F.col(label).alias("label"), "idx", "val", "features"), "id", "label")
    rows = dealt(rows, "id").persist()
    try:
        if algorithm == "kNN":
            names = ("k", "weights", "p")
            points = [grid.get(c, d) for c, d in (("n_neighbors", [5]), ("weights", ["uniform"]), ("p", [2]))]
            scores = grid_search_of.knn_grid(rows, *points)
            best = scores.where("best").first()
            model = fit_knn(rows, **{n: best[n] for n in names})
            model.rows = model.rows.persist()
            model.rows.count()  # before the shared rows are released
            return model, {"n_neighbors": best["k"], "weights": best["weights"], "p": best["p"]}, best["accuracy"]
        v = F.unwrap_udt("features")
        size = rows.select(F.coalesce(v["size"], F.size(v["values"])).alias("n")).first()[0]
        if rows.where(F.exists("val", lambda x: x < 0)).limit(1).count():
            raise ValueError("naive Bayes needs features of zero or more")
        feats = _long(rows, "id")
        alphas, priors = grid.get("alpha", [1.0]), grid.get("fit_prior", [True])
        best = grid_search_of.naive_bayes_grid(feats, rows.select("id", "label", "fold"), size, alphas, priors).where("best").first()
        model = fit_naive_bayes(feats, rows.select("id", "label"), size, best["alpha"], best["fit_prior"])
        model.delta = model.delta.persist()
        model.delta.count()
        return model, {"alpha": best["alpha"], "fit_prior": best["fit_prior"]}, best["accuracy"]
    finally:
        rows.unpersist()


def _test_relational(model, df: DataFrame, label: str, key: str) -> DataFrame:
    x = df.drop(label)
    rows = sparse_columns(x).select(F.col(key).alias("id"), "idx", "val")
    pred = model.predict(rows) if isinstance(model, SparseKnnModel) else model.predict(rows.select("id"), _long(rows, "id"))
    return x.join(pred.select(F.col("id").alias("_id"), F.col("prediction").alias(f"{label}_pred")), F.col(key) == F.col("_id"), "left").drop("_id")
