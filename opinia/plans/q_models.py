"""Catalogue: evaluation (E1-E5) and relational models (M4 naive Bayes,
M1/M9 nearest neighbours)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinia.operators import bayes as B
from opinia.operators import evaluate as E
from opinia.operators import prep as P
from opinia.operators import tfidf as TF
from opinia.plans import sqlfrag as S
from opinia.plans.q_prep import F10B_SQL
from opinia.plans.registry import register
from opinia.session import table


def _labels_pred(spark, d):
    return table(spark, d, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


@register("e1_accuracy", "SELECT round(avg(CAST(quality = toxic AS DOUBLE)), 6) AS accuracy FROM labels", "E1")
def e1_accuracy(spark, d):
    return E.accuracy(_labels_pred(spark, d)).select(F.round("accuracy", 6).alias("accuracy"))


PER_CLASS_SQL = """
r AS (SELECT CAST({y} AS VARCHAR) AS c, 1 AS t, 0 AS p, CAST({y} = {p} AS INTEGER) AS tp FROM {src}
      UNION ALL SELECT CAST({p} AS VARCHAR), 0, 1, 0 FROM {src}),
k AS (SELECT c AS label, sum(tp) AS tp, sum(p) AS n_pred, sum(t) AS support FROM r GROUP BY c),
m AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
                CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM k),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
"""
LABELS_PC = PER_CLASS_SQL.format(y="quality", p="toxic", src="labels")

E2_SQL = "WITH " + LABELS_PC + "SELECT round(sum(tp) / sum(support), 6) AS f1_micro, round(avg(f1), 6) AS f1_macro FROM f"


@register("e2_f_scores", E2_SQL, "E2")
def e2_f_scores(spark, d):
    out = E.f_scores(_labels_pred(spark, d))
    return out.select(F.round("f1_micro", 6).alias("f1_micro"), F.round("f1_macro", 6).alias("f1_macro"))


@register(
    "e3_confusion",
    "SELECT quality AS label, toxic AS prediction, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY quality, toxic",
    "E3",
)
def e3_confusion(spark, d):
    return E.confusion(_labels_pred(spark, d))


E4_SQL = "WITH " + LABELS_PC + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1_score,
       CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
"""


def _round_report(df):
    return df.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")], "support")


@register("e4_report", E4_SQL, "E4")
def e4_report(spark, d):
    return _round_report(E.report(_labels_pred(spark, d)))


E5_SQL = f"""
WITH sp AS ({F10B_SQL}),
src AS (SELECT s.part AS split, CAST(l.quality AS VARCHAR) AS y, CAST(l.toxic AS VARCHAR) AS p
        FROM labels l JOIN sp s USING (doc_id)),
r AS (SELECT split, y AS c, 1 AS t, 0 AS q, CAST(y = p AS INTEGER) AS tp FROM src
      UNION ALL SELECT split, p, 0, 1, 0 FROM src),
k AS (SELECT split, c, sum(tp) AS tp, sum(q) AS n_pred, sum(t) AS support FROM r GROUP BY split, c),
m AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM k),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m)
SELECT split, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro, CAST(sum(support) AS BIGINT) AS n
FROM f GROUP BY split
"""


@register("e5_evaluate_by_split", E5_SQL, "E5 F10b")
def e5_evaluate_by_split(spark, d):
    lab = table(spark, d, "labels")
    parts = P.split_column(lab.select("doc_id", "quality"), "doc_id", (0.6, 0.2, 0.2), 42, stratify="quality")
    pred = lab.join(parts.select("doc_id", "part"), "doc_id").select(
        "part", F.col("quality").alias("label"), F.col("toxic").alias("prediction")
    )
    out = E.evaluate(pred, "part")
    return out.select("split", F.round("accuracy", 6).alias("accuracy"), F.round("f1_macro", 6).alias("f1_macro"), "n")


SPLIT_PRED = f"""
sp AS ({F10B_SQL}),
src AS (SELECT s.part AS split, CAST(l.quality AS VARCHAR) AS y, CAST(l.toxic AS VARCHAR) AS p FROM labels l JOIN sp s USING (doc_id))"""
SQUARE_CTES = """
lb AS (SELECT DISTINCT split, l FROM (SELECT split, y AS l FROM src UNION ALL SELECT split, p FROM src)),
cm AS (SELECT split, y, p, count(*) AS n FROM src GROUP BY split, y, p),
sq AS (SELECT a.split, a.l AS label, b.l AS prediction, coalesce(cm.n, 0) AS n
       FROM lb a JOIN lb b ON a.split = b.split LEFT JOIN cm ON cm.split = a.split AND cm.y = a.l AND cm.p = b.l)"""


def _split_pred(spark, d):
    lab = table(spark, d, "labels")
    parts = P.split_column(lab.select("doc_id", "quality"), "doc_id", (0.6, 0.2, 0.2), 42, stratify="quality")
    return lab.join(parts.select("doc_id", "part"), "doc_id").select("part", F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


@register("e3_confusion_square", f"WITH {SPLIT_PRED},{SQUARE_CTES} SELECT split, label, prediction, CAST(n AS BIGINT) AS n FROM sq", "E3 F10b")
def e3_confusion_square(spark, d):
    return E.confusion_square(_split_pred(spark, d), "part")


def _bundle_sql(head: str, params: dict, score: float | None) -> str:
    """``head``: CTEs up to ``src(split, y, p)``."""
    model = [f"SELECT NULL, 'model', '{k}', 'best parameter', NULL, '{v}'" for k, v in params.items()]
    if score is not None:
        model.append(f"SELECT NULL, 'model', 'Best Score', 'score', {score!r}, NULL")
    lines = []
    for name, values in (("macro avg", ("avg(pr)", "avg(rc)", "avg(f1)")),
                         ("weighted avg", tuple(f"sum({c} * support) / sum(support)" for c in ("pr", "rc", "f1")))):
        for m, v in zip(("precision", "recall", "f1_score"), values, strict=True):
            lines.append(f"SELECT split, 'report', '{name}', '{m}', {v}, NULL FROM f GROUP BY split")
        lines.append(f"SELECT split, 'report', '{name}', 'support', sum(support), NULL FROM f GROUP BY split")
    more = "\nUNION ALL ".join(["", *lines, *model])
    return f"""WITH {head},{SQUARE_CTES},
k AS (SELECT split, label, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp, sum(n) AS support FROM sq GROUP BY split, label),
k2 AS (SELECT split, prediction AS label, sum(n) AS n_pred FROM sq GROUP BY split, prediction),
m AS (SELECT split, label, tp, support, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc
      FROM k JOIN k2 USING (split, label)),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m),
o(split, section, name, measure, value, said) AS (
  SELECT split, 'matrix', label, prediction, CAST(n AS DOUBLE), NULL FROM sq
  UNION ALL SELECT split, 'report', label, 'precision', pr, NULL FROM f UNION ALL SELECT split, 'report', label, 'recall', rc, NULL FROM f
  UNION ALL SELECT split, 'report', label, 'f1_score', f1, NULL FROM f UNION ALL SELECT split, 'report', label, 'support', support, NULL FROM f
  UNION ALL SELECT split, 'report', 'accuracy', 'f1_score', sum(tp) / sum(support), NULL FROM f GROUP BY split
  UNION ALL SELECT split, 'report', 'accuracy', 'support', sum(support), NULL FROM f GROUP BY split
  UNION ALL SELECT split, 'scores', 'all', 'accuracy', sum(tp) / sum(support), NULL FROM f GROUP BY split
  UNION ALL SELECT split, 'scores', 'all', 'f1_micro', sum(tp) / sum(support), NULL FROM f GROUP BY split
  UNION ALL SELECT split, 'scores', 'all', 'f1_macro', avg(f1), NULL FROM f GROUP BY split{more})
SELECT split, section, name, measure, round(value, 6) AS value, CAST(said AS VARCHAR) AS said FROM o
"""


BUNDLE_PARAMS, BUNDLE_SCORE = {"n_neighbors": 5, "weights": "uniform"}, 0.75


@register("e5_result_bundle", _bundle_sql(SPLIT_PRED, BUNDLE_PARAMS, BUNDLE_SCORE), "E5 E3 E4 E2 E1 F10b")
def e5_result_bundle(spark, d):
    out = E.result_bundle(_split_pred(spark, d), "part", params=BUNDLE_PARAMS, score=BUNDLE_SCORE)
    return out.withColumn("value", F.round("value", 6))


# ---------------------------------------------------------------- M4

LABELLED_SRC = "SELECT d.doc_id AS id, d.text FROM documents d JOIN labels l USING (doc_id)"


def _nb_sql(alpha: float, fit_prior: bool) -> str:
    prior = "ln(c.n / (SELECT sum(n) FROM cls))" if fit_prior else "-ln((SELECT count(*) FROM cls))"
    return f"""
WITH {S.tfidf_ctes(LABELLED_SRC, TF.SETTING_B)},
sp AS ({F10B_SQL}),
lab AS (SELECT s.doc_id, s.part, l.quality FROM sp s JOIN labels l USING (doc_id)),
tr AS (SELECT w.term, w.weight AS value, lab.quality AS cls FROM tf_w w JOIN lab ON w.id = lab.doc_id WHERE lab.part = 'train'),
cls AS (SELECT quality AS cls, count(*) AS n FROM lab WHERE part = 'train' GROUP BY quality),
vv AS (SELECT count(*) AS v FROM tf_voc),
fc AS (SELECT cls, term, sum(value) AS fc FROM tr GROUP BY cls, term),
tot AS (SELECT c.cls, coalesce(sum(fc.fc), 0) AS t FROM cls c LEFT JOIN fc USING (cls) GROUP BY c.cls),
te AS (SELECT doc_id FROM lab WHERE part = 'test'),
grid AS (SELECT te.doc_id, c.cls, {prior} AS prior, tot.t FROM te CROSS JOIN cls c JOIN tot USING (cls)),
sc AS (
  SELECT g.doc_id, g.cls,
         g.prior + coalesce(sum(w.weight * ln((coalesce(fc.fc, 0) + {alpha!r}) / (g.t + {alpha!r} * (SELECT v FROM vv)))), 0) AS score
  FROM grid g LEFT JOIN tf_w w ON w.id = g.doc_id LEFT JOIN fc ON fc.cls = g.cls AND fc.term = w.term
  GROUP BY g.doc_id, g.cls, g.prior)
SELECT doc_id, cls AS prediction FROM sc
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cls) = 1
"""


def _nb(spark, d, alpha: float, fit_prior: bool):
    docs = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    labelled = docs.join(lab.select("doc_id"), "doc_id").select("doc_id", "text")
    spec = TF.SETTING_B
    model = TF.fit_tfidf(labelled, "doc_id", "text", spec)
    vocab = model.vocab = model.vocab.persist()
    w = model.transform(labelled, "doc_id", "text").select("id", "term", F.col("weight").alias("value"))
    w = w.persist()  # read for the fit, the mass and the hits; a recomputation would tokenise the texts again
    parts = P.split_column(lab.select("doc_id", "quality"), "doc_id", (0.6, 0.2, 0.2), 42, stratify="quality")
    parts = parts.persist()
    train = parts.where(F.col("part") == "train").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    test = parts.where(F.col("part") == "test").select(F.col("doc_id").alias("id"))
    nb = B.fit_naive_bayes(w.join(train.select("id"), "id"), train, vocab.count(), alpha, fit_prior)
    pred = nb.predict(test, w.join(test, "id"))
    return pred.select(F.col("id").alias("doc_id"), "prediction")


register("m4_naive_bayes", _nb_sql(1.0, True), "M4 F6 F10b")(lambda s, d: _nb(s, d, 1.0, True))
register("m4_naive_bayes_uniform_prior", _nb_sql(0.5, False), "M4 F6 F10b")(lambda s, d: _nb(s, d, 0.5, False))


# ---------------------------------------------------------------- M1 / M9

from opinia.operators import knn as KNN  # noqa: E402

EMB_SPLIT = """
emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label,
               CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'dev' ELSE 'test' END AS part
        FROM (SELECT *, ('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':42'), 1, 8))::BIGINT / 4294967296.0 AS u
              FROM embeddings))"""


def _dist_sql(p: int) -> str:
    if p == 2:
        return "sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - t.e[i]) * (q.e[i] - t.e[i]))))"
    return "list_sum(list_transform(range(1, len(q.e) + 1), lambda i: abs(q.e[i] - t.e[i])))"


def _knn_sql(k: int, p: int, weights: str, query_part: str = "test") -> str:
    w = "1.0" if weights == "uniform" else (
        "CASE WHEN max(CAST(dist = 0 AS INTEGER)) OVER (PARTITION BY qid) = 1 "
        "THEN CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / dist END"
    )
    return f"""
WITH {EMB_SPLIT},
d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label, {_dist_sql(p)} AS dist
      FROM emb q, emb t WHERE q.part = '{query_part}' AND t.part = 'train'),
r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, tid) <= {k}),
v AS (SELECT qid, label, sum(wt) AS s FROM (SELECT *, {w} AS wt FROM r) GROUP BY qid, label)
SELECT qid AS vec_id, label AS prediction FROM v
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, label) = 1
"""


def _emb_parts(spark, d):
    emb = table(spark, d, "embeddings")
    return P.split_column(emb, "vec_id", (0.6, 0.2, 0.2), seed=42)


def _knn(spark, d, k, p, weights):
    parts = _emb_parts(spark, d)
    train = parts.where(F.col("part") == "train")
    test = parts.where(F.col("part") == "test")
    pred = KNN.knn_predict(train, test, k=k, p=p, weights=weights, tid="vec_id", qid="vec_id", vec="embedding")
    return pred.select(F.col("qid").alias("vec_id"), "prediction")


register("m1_knn_euclid_uniform", _knn_sql(5, 2, "uniform"), "M1")(lambda s, d: _knn(s, d, 5, 2, "uniform"))
register("m1_knn_manhattan_distance", _knn_sql(7, 1, "distance"), "M1")(lambda s, d: _knn(s, d, 7, 1, "distance"))

KS = (1, 3, 5, 7, 9, 11)
M9_SQL = f"""
WITH {EMB_SPLIT},
d AS (SELECT q.vec_id AS qid, q.label AS y, t.vec_id AS tid, t.label, {_dist_sql(2)} AS dist
      FROM emb q, emb t WHERE q.part = 'dev' AND t.part = 'train'),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d),
kk AS (SELECT unnest({list(KS)}) AS k),
v AS (SELECT kk.k, r.qid, r.y, r.label, count(*) AS s FROM r JOIN kk ON r.rn <= kk.k GROUP BY kk.k, r.qid, r.y, r.label),
p AS (SELECT k, qid, y, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY k, qid ORDER BY s DESC, label) = 1),
a AS (SELECT k, avg(CAST(prediction = y AS DOUBLE)) AS accuracy FROM p GROUP BY k)
SELECT k, round(accuracy, 6) AS accuracy,
       k = (SELECT k FROM a ORDER BY accuracy DESC, k LIMIT 1) AS best FROM a
"""


@register("m9_knn_sweep", M9_SQL, "M9 M1 E1")
def m9_knn_sweep(spark, d):
    parts = _emb_parts(spark, d)
    train = parts.where(F.col("part") == "train")
    dev = parts.where(F.col("part") == "dev")
    out = KNN.knn_sweep(train, dev, KS, p=2, qid="vec_id", tid="vec_id", vec="embedding")
    return out.select(F.col("k").cast("integer").alias("k"), F.round("accuracy", 6).alias("accuracy"), "best")


def _nb_report_sql() -> str:
    nb = _nb_sql(1.0, True).strip()
    body = nb[len("WITH "):]
    body = body.replace("\nSELECT doc_id, cls AS prediction FROM sc\nQUALIFY", ",\npred AS (SELECT doc_id, cls AS prediction FROM sc\nQUALIFY")
    pc = PER_CLASS_SQL.format(y="y", p="p", src="yp")
    return f"""WITH {body}),
yp AS (SELECT l.quality AS y, pred.prediction AS p FROM pred JOIN labels l USING (doc_id)),
{pc}SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1_score,
       CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
"""


@register("e4_report_naive_bayes", _nb_report_sql(), "E4 M4 F6 F10b")
def e4_report_naive_bayes(spark, d):
    pred = _nb(spark, d, 1.0, True)
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return _round_report(E.report(pred.join(lab, "doc_id")))
