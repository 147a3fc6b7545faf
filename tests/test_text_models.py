"""Models on text: sparse nearest neighbours, grids, the fitted text pipeline, scoring in batch and stream."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinia.operators import grid as G
from opinia.operators import mllib as ML
from opinia.operators import sparse_knn as SK
from opinia.operators.review_features import STATISTICS, ReviewFeatures, sparse_columns
from opinia.operators.review_models import ReviewScorer
from opinia.plans import q_review_models as Q
from opinia.sources.models import load_model, save_model

from .conftest import SF_SMALL


def sparse_table(spark, n, seed, folds=False):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = int(rnd.integers(0, 9)) if i % 17 else 0  # some rows are empty
        idx = sorted(rnd.choice(40, k, replace=False).tolist())
        val = rnd.integers(1, 5, k).astype(float)
        val = (val / np.linalg.norm(val)).tolist() if k else []
        rows.append((i, idx, val, int(rnd.integers(0, 3)), i % 4))
    rows += [(n + i, *rows[i][1:]) for i in range(0, n, 7)]  # copies tie
    return spark.createDataFrame(rows, "id int, idx array<int>, val array<double>, label int, fold int"), rows


def brute(train, query, k, p, fold=False):
    def dense(r):
        v = np.zeros(40)
        v[r[1]] = r[2]
        return v

    out = set()
    for q in query:
        near = []
        for t in train:
            if fold and t[4] == q[4]:
                continue
            a, b = dense(q), dense(t)
            d2 = (a ** 2).sum() + (b ** 2).sum() - 2 * (a * b).sum() if p == 2 else a.sum() + b.sum() - 2 * np.minimum(a, b).sum()
            near.append((round(max(d2, 0.0), 9), t[0], t[3]))
        out |= {(q[0], t, y, rank) for rank, (_, t, y) in enumerate(sorted(near)[:k], 1)}
    return out


@pytest.mark.parametrize("p,fold", [(2, False), (1, False), (2, True)])
def test_sparse_neighbours_equal_brute_force(spark, p, fold):
    train, t = sparse_table(spark, 400, 1)
    query, q = sparse_table(spark, 60, 2)
    want = brute(t, q, 6, p, fold)
    for slab in (1 << 26, 6_000):  # one broadcast slab, several cogrouped ones
        got = SK.neighbours(train, query, 6, p, fold="fold" if fold else None, slab_bytes=slab)
        assert {(r.qid, r.tid, r.label, r["rank"]) for r in got.collect()} == want


@pytest.mark.parametrize("p", [1, 2])
def test_parts_of_one_table_meet_in_several_slabs(spark, p):
    """Train and query rows of one table share their columns' origin."""
    rows, r = sparse_table(spark, 300, 4)
    want = brute([x for x in r if x[0] % 3], [x for x in r if x[0] % 3 == 0], 5, p)
    for slab in (1 << 26, 6_000):
        got = SK.neighbours(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), 5, p, slab_bytes=slab)
        assert {(x.qid, x.tid, x.label, x["rank"]) for x in got.collect()} == want


@pytest.mark.parametrize("p", [1, 2])
def test_distances_through_terms_equal_those_of_rows(p):
    import pyarrow as pa

    rnd = np.random.default_rng(7)
    idx = [np.sort(rnd.choice(30, rnd.integers(0, 9), replace=False)).tolist() for _ in range(500)]
    table = pa.table({"tid": list(range(500)), "label": [0] * 500, "idx": pa.array(idx, pa.list_(pa.int32())),
                      "val": pa.array([rnd.random(len(x)).tolist() for x in idx], pa.list_(pa.float64())), "fold": [i % 5 for i in range(500)]})
    slab = SK.Slab(table, p)
    for i, fold in ((0, None), (3, 3), (11, 1)):
        qi, qv = np.array(idx[i], np.int64), np.array(table["val"][i].as_py())
        dense = np.zeros(slab.width)
        dense[qi] = qv
        own = float((qv ** 2).sum() if p == 2 else qv.sum())
        every = np.flatnonzero(slab.fold != fold) if fold is not None else np.arange(500)
        d = slab._distances(every, dense, own)
        best = every[np.lexsort((slab.rank[every], d))[:7]]
        got, dist = slab._through_terms(qi, qv, own, 7, fold)
        assert got.tolist() == best.tolist()
        assert slab.nearest(qi, qv, 7, fold)[0].tolist() == best.tolist()


def test_blocks_are_skipped_and_the_answer_stays(monkeypatch):
    import pyarrow as pa

    rnd = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        idx = np.sort(rnd.choice(20, 5, replace=False)) + 20 * (i % 10)
        val = rnd.random(5)
        rows.append((i, idx.tolist(), (val / np.linalg.norm(val)).tolist(), 0))
    table = pa.table({"tid": [r[0] for r in rows], "label": [0] * 3000, "idx": pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                      "val": pa.array([r[2] for r in rows])})
    slab, seen = SK.Slab(table, 2), []
    real = SK.Slab._distances
    monkeypatch.setattr(SK.Slab, "_distances", lambda self, new, *a: seen.append(len(new)) or real(self, new, *a))
    near, dist = slab.nearest(np.array(rows[7][1]), np.array(rows[7][2]), 5)
    assert slab.tid[int(near[0])].as_py() == 7 and dist[0] == 0
    assert sum(seen) < 1000  # of 3,000 rows, those of a tenth share terms with the query


def test_naive_bayes_grid_equals_separate_fits(spark):
    rnd = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(90):
        y = int(i % 3)
        labels.append((i, y, i % 5))
        for t in rnd.choice(12, 5, replace=False):
            rows.append((i, f"t{t}", float(rnd.integers(1, 4) + (3 if t % 3 == y else 0))))
    labels.append((99, 1, 0))  # a document without features
    feats = spark.createDataFrame(rows, "id int, term string, value double")
    lab = spark.createDataFrame(labels, "id int, label int, fold int")
    got = {(r.alpha, r.fit_prior): r.accuracy for r in G.naive_bayes_grid(feats, lab, 12, (0.1, 1.0, 2.0), (True, False)).collect()}
    for alpha, prior in itertools.product((0.1, 1.0, 2.0), (True, False)):
        scores = []
        for f in range(5):
            train = [r for r in labels if r[2] != f]
            cls = sorted({y for _, y, _ in train})
            count = {c: sum(y == c for _, y, _ in train) for c in cls}
            of = {i: y for i, y, _ in train}
            mass = {c: {} for c in cls}
            for i, t, v in rows:
                if i in of:
                    mass[of[i]][t] = mass[of[i]].get(t, 0) + v
            right = []
            for i, y, _ in (r for r in labels if r[2] == f):
                s = {c: (math.log(count[c] / len(train)) if prior else -math.log(len(cls))) + sum(
                    v * math.log((mass[c].get(t, 0) + alpha) / (sum(mass[c].values()) + alpha * 12)) for j, t, v in rows if j == i) for c in cls}
                right.append(min(cls, key=lambda c: (-round(s[c], 9), c)) == y)
            scores.append(np.mean(right))
        assert got[alpha, prior] == pytest.approx(np.mean(scores))


def test_knn_grid_has_one_best_point(spark):
    rows, _ = sparse_table(spark, 120, 9)
    out = G.knn_grid(rows, (3, 5), ("uniform", "distance"), (1, 2)).collect()
    assert len(out) == 8 and sum(r.best for r in out) == 1
    assert next(r for r in out if r.best).accuracy == pytest.approx(max(r.accuracy for r in out))


def texts(spark):
    rows = [(1, "Good good hotel, not bad!"), (2, None), (3, ""), (4, "AWFUL?! never good"), (5, "the the the"), (6, "hotel hotel room")]
    return spark.createDataFrame(rows, "doc_id int, text string")


def test_features_survive_saving_and_have_the_statistics(spark, tmp_path):
    docs = texts(spark)
    est = ReviewFeatures(maxFeatures=4, statistics=True, lexiconWords=["good", "bad", "awful"], lexiconValues=[0.5, -0.6, -0.8])
    model = est.fit(docs)
    save_model(model, str(tmp_path / "m"), spark=spark)
    again = load_model(spark, str(tmp_path / "m"))
    one = {r.doc_id: r.features for r in model.transform(docs).collect()}
    assert {r.doc_id: r.features for r in again.transform(docs).collect()} == one
    assert all(v.size == 4 + len(STATISTICS) for v in one.values()) and again.vocabulary == sorted(again.vocabulary)
    stats = model.with_statistics(docs, F.coalesce("text", F.lit(""))).select("doc_id", "_stats.*").collect()
    polarity = {r.doc_id: round(r.polarity, 6) for r in stats}
    assert polarity == {1: round((0.5 + 0.5 + 0.3) / 3, 6), 2: 0, 3: 0, 4: round((-0.8 - 0.25) / 2, 6), 5: 0, 6: 0}
    assert ReviewFeatures.load is not None and model.transform(docs.where("false")).count() == 0
    nothing = ReviewFeatures(minDF=50).fit(docs)
    assert nothing.vocabulary == [] and nothing.transform(docs).first().features.numNonzeros() == 0


def test_features_plan_has_no_python_and_no_exchange(spark):
    docs = texts(spark)
    model = ReviewFeatures(maxFeatures=4, statistics=True, lexiconWords=["good"], lexiconValues=[0.5]).fit(docs)
    plan = sparse_columns(model.transform(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_scoring_reads_no_label_and_keeps_blank_reviews_null(spark, tmp_path):
    train = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate([("good fine", 1), ("good nice", 1), ("bad poor", 0), ("bad awful", 0)] * 3)],
                                  "doc_id int, text string, label int")
    features = ReviewFeatures(maxFeatures=10).fit(train)
    rows = sparse_columns(features.transform(train)).select(F.col("doc_id").alias("id"), "label", "idx", "val")
    from pyspark.ml.classification import NaiveBayes

    def pair(swap):
        own = rows.withColumn("label", 1 - F.col("label")) if swap else rows
        stars = NaiveBayes().fit(features.transform(train.withColumn("label", F.col("label").cast("double"))))
        return ReviewScorer(features, SK.fit(own, k=3), features, stars)

    docs = spark.createDataFrame([(1, "good good"), (2, "awful bad"), (3, " \n"), (4, None)], "doc_id int, text string")

    def names(scorer):
        return {r.doc_id: (r.Sentimiento, r.Score_1_5, r.Puntuacion_Final_1_9) for r in scorer.transform(docs).collect()}

    one = names(pair(False))
    assert one == {1: ("Positive", 2, 6), 2: ("Negative", 1, 1), 3: (None, None, None), 4: (None, None, None)}
    two = names(pair(True))  # a scorer that read labels instead of its models would not turn
    assert (two[1][0], two[2][0]) == ("Negative", "Positive")
    save_model(pair(False), str(tmp_path / "s"), spark=spark)
    assert names(load_model(spark, str(tmp_path / "s"))) == one


def test_stars_pipeline_saved_and_loaded(spark, tmp_path):
    parts = Q.rated_documents(spark, SF_SMALL)
    features, model = Q.fit_stars(parts.where("part = 'train'"), max_features=200, trees=5, folds=2, iterations=10)
    test = features.transform(parts.where("part = 'test'").select("doc_id", "text"))
    save_model(model, str(tmp_path / "stack"), spark=spark)
    save_model(features, str(tmp_path / "features"), spark=spark)
    again = load_model(spark, str(tmp_path / "stack")).transform(load_model(spark, str(tmp_path / "features")).transform(
        parts.where("part = 'test'").select("doc_id", "text")))
    one = {r.doc_id: r.prediction for r in model.transform(test).collect()}
    assert one and {r.doc_id: r.prediction for r in again.collect()} == one and set(one.values()) <= set(map(float, range(5)))


def test_folds_of_the_grid_are_those_of_cross_validation(spark):
    ids = spark.range(50).select("id", (F.col("id") % 2).cast("int").alias("label"))
    folds = ML.fold_column(ids, "id", "label", 5)
    assert sorted(r["count"] for r in folds.groupBy("label", "fold").count().collect()) == [5] * 10


def test_models_of_several_slabs_score_rows_and_streams(spark, tmp_path):
    """Repeated vectors, repeated keys and empty vectors, by one slab, by several, and as a stream by batches."""
    from opinia.operators.review_models import knn_in_place
    from opinia.streaming.score import score_stream

    train, _ = sparse_table(spark, 300, 8)
    query, _ = sparse_table(spark, 60, 9)
    query = query.select(F.col("id").alias("key"), "idx", "val").unionByName(
        spark.createDataFrame([(0, [], []), (None, [], []), (0, [3], [1.0])], "key int, idx array<int>, val array<double>"))
    model = SK.fit(train, k=5)

    def rows(df):
        return sorted((-1 if r.key is None else r.key, r.idx, r.prediction) for r in df.collect())

    one = rows(knn_in_place(query, model))
    assert len(one) == query.count() and rows(knn_in_place(query, model, slab_bytes=6_000)) == one
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    query.repartition(2).write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        score_stream(spark, src, query.schema, lambda b: knn_in_place(b, model, slab_bytes=6_000), out, str(tmp_path / "ckpt"), by_batch=True)
        assert rows(spark.read.parquet(out).drop("batch")) == one


def test_rows_of_a_class_are_dealt_to_several_tasks(spark, monkeypatch):
    from opinia.operators import mllib as ML

    df = spark.range(500).select("id", (F.col("id") % 2).alias("label"))
    folds = ML.fold_column(df, "id", "label")
    assert ML.dealt(folds, "id") is folds
    monkeypatch.setattr(ML, "DEALT_ROWS", 100)
    spread = ML.dealt(folds, "id")
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, folds.collect()))
    assert spread.where("label = 0").select(F.spark_partition_id().alias("p")).distinct().count() > 2


def _arrow_rows(n, seed, columns=300):
    import pyarrow as pa

    rnd = np.random.default_rng(seed)
    common = 1 / np.arange(1, columns + 1)
    idx = [np.sort(rnd.choice(columns, rnd.integers(0, 25), replace=False, p=common / common.sum())) for _ in range(n)]
    val = [(v := rnd.integers(1, 4, len(x)).astype(float)) / max(np.linalg.norm(v), 1) for x in idx]
    idx, val = idx + idx[:40], val + val[:40]  # copies tie
    return pa.table({"tid": list(range(len(idx))), "label": [i % 3 for i in range(len(idx))], "idx": pa.array([x.tolist() for x in idx], pa.list_(pa.int32())),
                     "val": pa.array([v.tolist() for v in val], pa.list_(pa.float64())), "fold": [i % 4 for i in range(len(idx))]})


@pytest.mark.parametrize("p,fold", [(2, True), (1, True), (2, False), (1, False)])
def test_matrix_search_equals_block_search_over_any_pieces(p, fold):
    from opinia.operators.sparse_search import Piece, Search

    table = _arrow_rows(900, 11)
    table = table if fold else table.drop_columns(["fold"])
    query = table.slice(0, 130)
    slab, (idx, off), (val, _) = SK.Slab(table, p), SK._flat(query["idx"]), SK._flat(query["val"])
    for cuts in ([0, 940], [0, 3, 500, 940]):
        search = Search(idx, off, val, 7, p, query["fold"].to_numpy() if fold else None)
        for number, (a, b) in reversed(list(enumerate(itertools.pairwise(cuts)))):
            search.meet(Piece(table.slice(a, b - a), p), number)
        who, tid, label, dist = search.result()
        for i in range(130):
            near, far = slab.nearest(idx[off[i]:off[i + 1]].astype(np.int64), val[off[i]:off[i + 1]], 7, i % 4 if fold else None)
            mine = np.flatnonzero(who == i)
            assert [tid[j].as_py() for j in mine] == [slab.tid[int(j)].as_py() for j in near]
            assert [label[j].as_py() for j in mine] == [slab.label[int(j)].as_py() for j in near]
            assert np.allclose(dist[mine], far, atol=1e-8)


def test_larger_slabs_are_searched_by_products():
    """The rows of a model of more than ``FEW_ROWS``, as a scorer or a search holds them."""
    table = _arrow_rows(SK.FEW_ROWS, 12)
    held, slab = SK.Held(table, 2), SK.Slab(table, 2)
    assert held.slab is None and held.piece.n == table.num_rows
    query = table.slice(0, 20).rename_columns(["qid", *table.column_names[1:]])
    who, tid, _, _ = held.nearest(query, 5)
    for i in range(20):
        idx, val = (np.array(query[c][i].as_py()) for c in ("idx", "val"))
        want = slab.nearest(idx.astype(np.int64), val.astype(float), 5, i % 4)[0]
        assert tid.take(np.flatnonzero(who == i)).to_pylist() == slab.tid.take(want).to_pylist()


def test_many_slabs_copy_no_rows_and_a_grid_searches_once(spark):
    rows, _ = sparse_table(spark, 200, 9, folds=True)
    plan = SK.neighbours(rows, rows, 5, fold="fold", slab_bytes=6_000)._jdf.queryExecution().toString()
    assert "CoGroup" not in plan
    for scores in (G.knn_scores(rows, (3,), ("uniform",), (1, 2)), SK.sweep(rows, rows, (1, 3))):
        assert "InArrow" not in scores._jdf.queryExecution().toString()


def test_rows_that_meet_a_large_model_are_counted_without_their_vectors(spark, monkeypatch):
    from opinia.operators.review_models import knn_in_place

    rows, _ = sparse_table(spark, 120, 3)
    seen, real = [], SK.neighbours
    monkeypatch.setattr(SK, "neighbours", lambda *a, **kw: seen.append(kw.get("query_rows")) or real(*a, **kw))
    model = SK.fit(rows, k=3)
    assert knn_in_place(rows.select("id", "idx", "val"), model, slab_bytes=6_000).count() == rows.count() == seen[0]
