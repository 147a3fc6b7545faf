"""Evaluation (E1-E5), all relational: one aggregation over the predictions
gives per-class counts; everything else is arithmetic on that small table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinia.operators.prep import MAX_CLASSES
from opinia.session import local_df


def accuracy(pred: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """One row ``(accuracy)``."""
    return pred.agg(F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy"))


def confusion(pred: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """E3 long form: ``(label, prediction, n)`` for observed pairs."""
    return pred.groupBy(F.col(y).alias("label"), F.col(yhat).alias("prediction")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n")
    )


def _labels(pred: DataFrame, y: str, yhat: str) -> list:
    """All true and predicted labels, sorted; at most MAX_CLASSES (checked)."""
    both = pred.select(F.explode(F.array(F.col(y).cast("string"), F.col(yhat).cast("string"))).alias("l"))
    found = [r[0] for r in both.distinct().where("l IS NOT NULL").limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels")
    return sorted(found)


def confusion_wide(pred: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """E3 wide form: one row per true label, one column per label (0-filled)."""
    wide = confusion(pred.select(F.col(y).alias("y"), F.col(yhat).cast("string").alias("p")), "y", "p").groupBy("label")
    return wide.pivot("prediction", _labels(pred, y, yhat)).agg(F.first("n")).na.fill(0)


def class_counts(pred: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """``(label, tp, n_pred, support)`` over the union of true and predicted
    labels — one aggregation after an explode of two roles per row."""
    roles = pred.select(
        F.explode(
            F.array(
                F.struct(F.col(y).cast("string").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                         (F.col(y) == F.col(yhat)).cast("int").alias("tp")),
                F.struct(F.col(yhat).cast("string").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"),
                         F.lit(0).alias("tp")),
            )
        ).alias("r")
    )
    return roles.groupBy(F.col("r.c").alias("label")).agg(
        F.sum("r.tp").cast("bigint").alias("tp"),
        F.sum("r.p").cast("bigint").alias("n_pred"),
        F.sum("r.t").cast("bigint").alias("support"),
    )


def _per_class(counts: DataFrame) -> DataFrame:
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    x = counts.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return x.withColumn("f1_score", f1)


def report(pred: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """Precision, recall, F1, support per class, then ``accuracy``,
    ``macro avg`` and ``weighted avg`` rows (the accuracy row carries the
    accuracy in ``f1_score``)."""
    per = _per_class(class_counts(pred, y, yhat)).persist()
    cls = per.select("label", "precision", "recall", "f1_score", "support")
    tot = per.agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1_score") * F.col("support")).alias("wf"),
    )
    acc = tot.select(
        F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1_score"),
        F.col("n").cast("bigint").alias("support"),
    )
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1_score"), F.col("n").cast("bigint").alias("support"))
    weighted = tot.select(
        F.lit("weighted avg").alias("label"), (F.col("wp") / F.col("n")).alias("precision"),
        (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1_score"),
        F.col("n").cast("bigint").alias("support"),
    )
    return cls.unionByName(acc).unionByName(macro).unionByName(weighted)


def f_scores(pred: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """One row ``(f1_micro, f1_macro)``; macro over the union of true and
    predicted labels, 0 for a class with 0/0."""
    per = _per_class(class_counts(pred, y, yhat))
    return per.agg(
        (F.sum("tp") / F.sum("support")).alias("f1_micro"),
        F.avg("f1_score").alias("f1_macro"),
    )


def evaluate(pred: DataFrame, split_col: str = "part", y: str = "label", yhat: str = "prediction") -> DataFrame:
    """E5: accuracy and macro F1 per split (dev/test) in one job."""
    per = (
        pred.select(F.col(split_col).alias("split"), F.col(y).cast("string").alias("y"),
                    F.col(yhat).cast("string").alias("p"))
        .select("split", F.explode(F.array(
            F.struct(F.col("y").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("q"), (F.col("y") == F.col("p")).cast("int").alias("tp")),
            F.struct(F.col("p").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("q"), F.lit(0).alias("tp")),
        )).alias("r"))
        .groupBy("split", F.col("r.c").alias("label"))
        .agg(F.sum("r.tp").alias("tp"), F.sum("r.q").alias("n_pred"), F.sum("r.t").alias("support"))
    )
    per = _per_class(per)
    return per.groupBy("split").agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1_score").alias("f1_macro"),
        F.sum("support").cast("bigint").alias("n"),
    )


def _cells(pred: DataFrame, split_col: str, y: str, yhat: str) -> DataFrame:
    """``(split, label, prediction, n, kind)``: one aggregate of the rows by grouping sets; kind 0: a cell of the
    matrix, 1: a true label's sum, 2: a predicted one's, 3: all rows of the split."""
    x = pred.select(F.col(split_col).alias("split"), F.col(y).cast("string").alias("label"), F.col(yhat).cast("string").alias("prediction"))
    x = x.where("label IS NOT NULL AND prediction IS NOT NULL")
    sets = [["split", "label", "prediction"], ["split", "label"], ["split", "prediction"], ["split"]]
    by = [F.col(c) for c in sets[0]]
    found = x.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("kind"))
    return found.select(*sets[0], F.col("n").cast("bigint").alias("n"), F.col("kind").cast("int").alias("kind"))


def confusion_square(pred: DataFrame, split_col: str, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """E3 proper: ``(split, label, prediction, n)`` for every pair of the split's true and predicted labels, 0 where there
    is none.  Rows without a label or prediction are left out."""
    return _square(_cells(pred, split_col, y, yhat))


def _square(cells: DataFrame) -> DataFrame:
    names = cells.where("kind IN (1, 2)").groupBy("split").agg(F.collect_set(F.coalesce("label", "prediction")).alias("l"))
    grid = names.select("split", "l", F.explode("l").alias("label")).select("split", "label", F.explode("l").alias("prediction"))
    seen = cells.where("kind = 0").select("split", "label", "prediction", "n")
    return grid.join(seen, ["split", "label", "prediction"], "left").na.fill(0, ["n"])


def result_bundle(pred: DataFrame, split_col: str = "part", y: str = "label", yhat: str = "prediction", params: dict | None = None,
                  score: float | None = None) -> DataFrame:
    """E5 whole: ``(split, section, name, measure, value, said)`` with, per split, the ``matrix`` (name: true,
    measure: predicted label; zero-filled), the ``report`` (per class, then accuracy and both averages), the ``scores``
    (accuracy, micro and macro F1), and once the ``model`` (best parameters in ``said``, best score in ``value``).

    The rows are read by one aggregate over grouping sets; all else is arithmetic on its few rows."""
    cells = _cells(pred, split_col, y, yhat).persist()  # at most classes^2 rows per split
    square = _square(cells)
    matrix = square.select("split", F.lit("matrix").alias("section"), F.col("label").alias("name"), F.col("prediction").alias("measure"),
                           F.col("n").cast("double").alias("value"))
    sums = cells.where("kind IN (1, 2)").select("split", F.coalesce("label", "prediction").alias("label"),
                                                F.when(F.col("kind") == 1, F.col("n")).alias("t"), F.when(F.col("kind") == 2, F.col("n")).alias("p"),
                                                F.lit(None).cast("bigint").alias("tp"))
    hits = cells.where("kind = 0 AND label = prediction").select("split", "label", F.lit(None).cast("bigint").alias("t"),
                                                                 F.lit(None).cast("bigint").alias("p"), F.col("n").alias("tp"))
    zero = F.lit(0).cast("bigint")
    counts = sums.unionByName(hits).groupBy("split", "label").agg(
        F.coalesce(F.sum("tp"), zero).alias("tp"), F.coalesce(F.sum("p"), zero).alias("n_pred"), F.coalesce(F.sum("t"), zero).alias("support"))
    per = _per_class(counts)
    total = per.groupBy("split").agg(
        F.sum("support").cast("double").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"m_{c}") for c in REPORT], *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in REPORT])
    lines = [_lines(per, F.col("label"), {**{c: F.col(c) for c in REPORT}, "support": F.col("support").cast("double")}),
             _lines(total, F.lit("accuracy"), {"f1_score": F.col("accuracy"), "support": F.col("n")}),
             _lines(total, F.lit("macro avg"), {**{c: F.col(f"m_{c}") for c in REPORT}, "support": F.col("n")}),
             _lines(total, F.lit("weighted avg"), {**{c: F.col(f"w_{c}") for c in REPORT}, "support": F.col("n")})]
    scores = _lines(total, F.lit("all"), {"accuracy": F.col("accuracy"), "f1_micro": F.col("accuracy"), "f1_macro": F.col("m_f1_score")}, "scores")
    out = matrix
    for x in (*lines, scores):
        out = out.unionByName(x)
    out = out.withColumn("said", F.lit(None).cast("string"))
    model = [(None, "model", str(k), "best parameter", None, str(v)) for k, v in (params or {}).items()]
    if score is not None:
        model.append((None, "model", "Best Score", "score", float(score), None))
    if model:
        out = out.unionByName(local_df(pred.sparkSession, model, "split string, section string, name string, measure string, value double, said string"))
    return out


REPORT = ("precision", "recall", "f1_score")


def _lines(df: DataFrame, name, values: dict, section: str = "report") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in values.items()])
    return df.select("split", F.lit(section).alias("section"), name.alias("name"), F.explode(pairs).alias("e")).select("split", "section", "name", "e.*")
