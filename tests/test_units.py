"""Hand fixtures for the semantic traps and invariants of the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from opinia.functions import labels as L
from opinia.functions import literal as LIT
from opinia.operators import aggregates as G
from opinia.operators import evaluate as E
from opinia.operators import knn as KNN
from opinia.operators import nested as N
from opinia.operators import prep as P
from opinia.operators import tfidf as TF
from opinia.plans.fixtures import lexicon_df

from .conftest import SF_SMALL


def test_literal_parser_fixtures(spark):
    cases = [
        ("[{'_id': '1', 'comments': 'Nice place'}, {'_id': '2', 'comments': \"It's ok\"}]", 2),
        ("[{'_id': '1', 'comments': None, 'ok': True}]", 0),
        ("[{'_id': '3', 'comments': 'has True and None inside'}]", 1),
        ("[{'comments': 'trunc", 0),
        ("not a list", 0),
        (None, 0),
        ("[]", 0),
        ("[{'a': 1}]", 0),
        ("{'comments':'x'}", 0),
    ]
    df = spark.createDataFrame([(str(i), c) for i, (c, _) in enumerate(cases)], "_id string, reviews string")
    got = {r["_id"]: r["n"] for r in N.explode_reviews(df).groupBy("_id").agg(F.count("*").alias("n")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got.get(str(i), 0) == want, cases[i]
    texts = [r.review for r in N.explode_reviews(df).where(F.col("_id") == "2").collect()]
    assert texts == ["has True and None inside"]


def test_literal_escapes_and_absent_keys(spark):
    lit = "[{'comments': 'It\\'s \"fine\" caf\\xe9\\nnew'}]"
    df = spark.createDataFrame([("h1", "Portugal", lit), ("h2", "Portugal", "[{'a': 1}]")],
                               "_id string, pais string, reviews string")
    n3 = {r.hotel_id: r.review for r in N.explode_reviews(df, keep_empty=True).collect()}
    assert n3["h1"] == "It's \"fine\" café\nnew"
    assert n3["h2"] == ""  # absent key -> ''


def test_word_sentiment_invariants(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = G.word_sentiment(docs, "lang", "text", lexicon_df(spark)).collect()
    keys = [(r.pais, r.palabra) for r in out]
    assert len(keys) == len(set(keys))
    assert all(r.frecuencia >= 1 for r in out)
    assert {r.sentimiento for r in out} <= {"positivo", "negativo"}
    assert all(r.palabra == r.palabra.lower() for r in out)


def test_word_sentiment_list_literals(spark):
    rows = [("Portugal", "[{'_id': '1', 'comments': 'Best stay, BEST host!'}, {'_id': '2', 'comments': None}]"),
            ("Portugal", "worthless|no way"), ("España", "[{'_id': '1', 'comments': 'trunc")]
    df = spark.createDataFrame(rows, "pais string, reviews string")
    got = {(r.pais, r.palabra): (r.frecuencia, r.sentimiento)
           for r in G.word_sentiment(df, "pais", "reviews", lexicon_df(spark)).collect()}
    assert got == {("Portugal", "best"): (2, "positivo"), ("Portugal", "worthless"): (1, "negativo"),
                   ("Portugal", "no"): (1, "negativo")}


def test_kth_smallest_band_refinement_matches_sort(spark):
    random.seed(7)
    vals = [random.randint(0, 5000) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v long")
    srt = sorted(vals)
    for k in (1, 17, 1500, 2999, 3000):
        got = P.kth_smallest(df, "v", k, max_band=50, accuracy=100)[0]
        assert got == srt[k - 1]


def test_split_disjoint_complete_and_stratified_sizes(spark):
    lab = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    parts = P.split_column(lab, "doc_id", (0.6, 0.2, 0.2), seed=42, stratify="quality").collect()
    assert len(parts) == lab.count()
    assert len({r.doc_id for r in parts}) == len(parts)
    for q in {r.quality for r in parts}:
        n = sum(1 for r in parts if r.quality == q)
        tr = sum(1 for r in parts if r.quality == q and r.part == "train")
        assert tr == math.floor(0.6 * n + 0.5)


def test_resample_exact_sizes(spark):
    lab = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    counts = P.class_counts(lab, "toxic")
    over = P.class_counts(P.resample(lab, "toxic", "over", key="doc_id"), "toxic")
    under = P.class_counts(P.resample(lab, "toxic", "under", key="doc_id"), "toxic")
    small = min(counts, key=counts.get)
    large = max(counts, key=counts.get)
    assert over[small] == counts[large] and over[large] == counts[large]
    assert under[large] == counts[small] and under[small] == counts[small]


def test_tfidf_rows_have_unit_norm(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    w = TF.tfidf(docs, "doc_id", "text", TF.SETTING_A)
    norms = w.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert norms and all(abs(r.n - 1.0) < 1e-9 for r in norms)


def test_confusion_sums_to_n(spark):
    lab = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select(
        F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
    assert E.confusion(lab).agg(F.sum("n")).first()[0] == lab.count()


def test_rounding_half_even(spark):
    df = spark.createDataFrame([(2,), (1,), (4,)], "r int")
    got = [r[0] for r in df.select(L.scale_rating("r")).collect()]
    assert got == [4.0, 2.0, 9.0]
    df = spark.createDataFrame([("POSITIVE", 0.625), ("NEGATIVE", 0.625)], "l string, s double")
    assert [r[0] for r in df.select(L.confidence_to_score("l", "s")).collect()] == [8, 2]


def test_polarity_label_legacy(spark):
    df = spark.createDataFrame([(-0.5,), (0.0,), (None,)], "p double")
    assert [r[0] for r in df.select(L.polarity_label("p")).collect()] == ["negative", "neutral", None]
    assert [r[0] for r in df.select(L.polarity_label("p", legacy=True)).collect()] == ["positive", "positive", None]


def test_knn_matches_brute_force(spark):
    random.seed(3)
    pts = [(i, [random.random() for _ in range(4)], random.randint(0, 2)) for i in range(200)]
    df = spark.createDataFrame(pts, "id long, vec array<double>, label int")
    train, query = df.where("id < 150"), df.where("id >= 150")
    got = {r.qid: r.prediction for r in KNN.knn_predict(train, query, k=5, p=2).collect()}
    blocks = {r.qid: r.prediction for r in KNN.knn_predict(train, query, k=5, p=2, block_bytes=1000).collect()}
    assert blocks == got and KNN.neighbours(train, query, 5).count() == 5 * 50
    for qi, qv, _ in pts[150:]:
        ds = sorted((math.dist(qv, tv), ti, tl) for ti, tv, tl in pts[:150])[:5]
        votes = {}
        for _, _, lab in ds:
            votes[lab] = votes.get(lab, 0) + 1
        best = min(votes, key=lambda c: (-votes[c], c))
        assert got[qi] == best


def test_model_store_roundtrip(spark, tmp_path):
    from opinia.sources.models import load_model, save_model

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    m = TF.fit_tfidf(docs, "doc_id", "text", TF.SETTING_B)
    save_model(m, str(tmp_path / "tfidf"), metrics={"n_docs": m.n_docs})
    back = load_model(spark, str(tmp_path / "tfidf"))
    assert back.n_docs == m.n_docs and back.vocab.count() == m.vocab.count()


def test_require_columns():
    from opinia.operators.clean import require_columns

    class Fake:
        columns = ["a"]

    with pytest.raises(ValueError):
        require_columns(Fake(), ["a", "b"])


def test_bad_csv_rows(spark, tmp_path):
    from opinia.sources.csv import read_reviews

    p = tmp_path / "x.csv"
    p.write_text('a,b,c\n1,2,3\n4,5\n6,7,8,9\n"x, y",z,w\n')
    rows = read_reviews(spark, str(p)).collect()
    assert [tuple(r) for r in rows] == [("1", "2", "3"), ("4", "5", None), ("x, y", "z", "w")]


def test_score_texts_modes_agree(spark):
    from opinia.operators.scorers import lexicon_stars
    from opinia.operators.scoring import score_texts
    from opinia.plans.fixtures import DEMO_LEXICON

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    a = score_texts(docs, "text", lambda: lexicon_stars(DEMO_LEXICON), out="s").select("doc_id", "s")
    b = score_texts(docs, "text", lambda: lexicon_stars(DEMO_LEXICON), out="s", dedup=False).select("doc_id", "s")
    assert sorted(a.collect()) == sorted(b.collect())


def test_stratified_split_large_class_path_matches_window_path(spark, monkeypatch):
    lab = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", "quality")
    small = {r.doc_id: r.part for r in P.split_column(lab, "doc_id", (0.6, 0.2, 0.2), 42, stratify="quality").collect()}
    monkeypatch.setattr(P, "MAX_BAND_ROWS", 5)
    big = {r.doc_id: r.part for r in P.split_column(lab, "doc_id", (0.6, 0.2, 0.2), 42, stratify="quality").collect()}
    assert small == big


def test_flatten_nested_dict(spark):
    rows = [("1", "{'review_scores_rating': 95, 'sub': {'clean': 9, 'loc': 10}}"),
            ("2", "{'review_scores_rating': 80, 'sub': {'clean': 7, 'loc': None}}"), ("3", None)]
    df = spark.createDataFrame(rows, "id string, review_scores string")
    out = N.flatten_dict(df, "review_scores")
    assert out.columns == ["id", "review_scores_rating", "sub.clean", "sub.loc"]
    got = {r[0]: tuple(r[1:]) for r in out.collect()}
    assert got == {"1": (95, 9, 10), "2": (80, 7, None), "3": (None, None, None)}


def test_csv_encoding_fallback(spark, tmp_path):
    from opinia.sources.csv import read_reviews

    p = tmp_path / "latin.csv"
    p.write_bytes("Review;Rating\ncafé olé;5\nmal;1\n".encode("latin-1"))
    rows = read_reviews(spark, str(p)).collect()
    assert [tuple(r) for r in rows] == [("café olé", "5"), ("mal", "1")]


def test_sorted_index_is_a_dense_global_rank(spark):
    random.seed(11)
    vals = random.sample(range(100000), 3000)
    df = spark.createDataFrame([(v,) for v in vals], "v long").repartition(7)
    got = {r.v: r.idx for r in P.sorted_index(df, [F.col("v")]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(vals))}
    codes = P.label_codes(spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string"), "c").collect()
    assert {r.value: r.code for r in codes} == {"a": 0, "b": 1, None: 2}


def test_word_sentiment_neutral_words(spark):
    df = spark.createDataFrame([("PT", "best no best")], "pais string, reviews string")
    got = {r.palabra for r in G.word_sentiment(df, "pais", "reviews", lexicon_df(spark), neutral_words=["no"]).collect()}
    assert got == {"best"}
