"""Inputs that the test tables do not hold: nulls, repeats, odd literals, other
encodings; both sides of plan switches."""

import pytest
from pyspark.sql import functions as F

from opinia.functions import literal as LIT
from opinia.operators import aggregates as G
from opinia.operators import clean as C
from opinia.operators import nested as N
from opinia.operators import prep as P
from opinia.operators import scoring as SC
from opinia.operators import text as TX
from opinia.sources.csv import read_reviews


def test_flatten_dict_keeps_keys_of_every_row(spark):
    rows = [(1, "{'a': 1}"), (2, "{'a': 2, 'b': 7, 'n': {'x': 1, 'y': {'z': 'q'}}}"), (3, "{'a': 3, 'b': 'x', 'n': 5}"), (4, "{'c': 1.5}")]
    out = N.flatten_dict(spark.createDataFrame(rows, "id int, d string"), "d")
    assert out.columns == ["id", "a", "b", "c", "n", "n.x", "n.y.z"]
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == {
        1: (1, None, None, None, None, None), 2: (2, "7", None, None, 1, "q"), 3: (3, "x", None, 5, None, None),
        4: (None, None, 1.5, None, None, None)}


def test_one_bad_value_does_not_spoil_a_dict(spark):
    df = spark.createDataFrame([(1, "{'a': 1, 'b': 'x'}"), (2, "{'a': 2, 'n': {'x': 1}}"), (3, "{'review_scores_rating': 95, 'note': 'fine'}")], "id int, d string")
    assert {r.id: r.a for r in N.flatten_map(df, "d", ["a"]).collect()} == {1: 1.0, 2: 2.0, 3: None}
    assert {r.id: r.review_score for r in N.overall_rating(df, "d").collect()} == {1: None, 2: None, 3: 9.5}


def test_list_literal_columns(spark):
    df = spark.createDataFrame([(1, "[1.0, 2.0]"), (2, "[3]"), (3, None), (4, "no list")], "id int, s string")
    assert {r[0]: tuple(r[1:]) for r in N.flatten_array(df, "s").collect()} == {1: (1.0, 2.0), 2: (3.0, None), 3: (None, None), 4: (None, None)}


def test_literal_strings_stay_as_they_are(spark):
    lit = "[{'comments': 'maybe, None, thanks: True, [False]', 'ok': None, \"x\": True, 'smile': '\\U0001F600 \\xe9'}]"
    df = spark.createDataFrame([(lit,)], "s string").select(F.from_json(LIT.to_json_text("s"), "array<map<string,string>>", LIT.JSON_OPTIONS).alias("p"))
    assert df.first().p[0] == {"comments": "maybe, None, thanks: True, [False]", "ok": None, "x": "true", "smile": "\U0001F600 é"}
    long = "[" + ", ".join("{'c': 'a, None, b', 'n': None}" for _ in range(20_000)) + "]"
    got = spark.createDataFrame([(long,)], "s string").select(LIT.to_json_text("s").alias("t")).first().t
    assert got == long.replace("'n': None", "'n': null")


def test_transform_nested_leaves_the_rest_intact(spark):
    df = spark.createDataFrame([(1, "[{'_id': '1', 'reviewer': 'Ann', 'comments': 'Good'}]"), (2, None), (3, "plain")], "id int, r string")
    got = {r.id: r.r for r in N.transform_nested(df, "r", "comments", F.upper).collect()}
    assert got == {1: [{"_id": "1", "reviewer": "Ann", "comments": "GOOD"}], 2: None, 3: None}
    texts = spark.createDataFrame([(1, "['a', 'b']"), (2, "plain"), (3, None)], "id int, r string")
    assert {r.id: r.r for r in N.transform_nested(texts, "r", None, F.upper).collect()} == {1: ["A", "B"], 2: ["PLAIN"], 3: None}


def test_blank_is_any_white_space(spark):
    df = spark.createDataFrame([(1, "\n\t "), (2, " x "), (3, None), (4, "")], "id int, t string")
    assert [r.id for r in C.non_blank(df, "t").collect()] == [2]


def test_no_prediction_gives_no_sentiment(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "\n"), (4, "d")], "id int, t string")
    binary = spark.createDataFrame([(1, 1), (3, 0), (4, 0)], "id int, prediction int")
    stars = spark.createDataFrame([(1, 3), (2, 2), (3, 1), (4, 0)], "id int, prediction int")
    got = {r.id: (r.Sentimiento, r.Score_1_5, r.Puntuacion_Final_1_9) for r in SC.score_reviews(df, "t", binary, stars).collect()}
    assert got == {1: ("Positive", 4, 8), 2: (None, 3, None), 3: (None, None, None), 4: ("Negative", 1, 1)}


@pytest.mark.parametrize("bound", [1, 1_000_000])
def test_repeated_lexicon_words_count_once(spark, monkeypatch, bound):
    monkeypatch.setattr(G, "BROADCAST_LEXICON_ROWS", bound)
    lexicon = spark.createDataFrame([("good", 1.9), ("good", 1.9), ("bad", -2.0), ("bad", 1.0), ("meh", 0.0)], "word string, valence double")
    df = spark.createDataFrame([("PT", "good good bad meh")], "pais string, reviews string")
    got = {(r.palabra, r.frecuencia, r.sentimiento) for r in G.word_sentiment(df, "pais", "reviews", lexicon).collect()}
    assert got == {("good", 2, "positivo"), ("bad", 1, "negativo")}


@pytest.mark.parametrize("bound", [1, 10_000])
def test_repeated_lemmas(spark, monkeypatch, bound):
    real = TX.table_map
    monkeypatch.setattr(TX, "table_map", lambda df, k, v, max_entries=bound: real(df, k, v, max_entries))
    lemmas = spark.createDataFrame([("cats", "kat"), ("cats", "cat"), ("runs", "run")], "word string, lemma string")
    out = TX.normalise_words(spark.createDataFrame([(1, "cats runs far")], "id int, t string"), "id", "t", [], lemmas)
    assert out.first().Review_Procesado == "cat run far"


def test_null_labels_stay(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 40, None).when(F.col("id") < 90, "a").otherwise("b").alias("y"))
    over = {r.y: r["count"] for r in P.resample(df, "y", "over", "id").groupBy("y").count().collect()}
    under = {r.y: r["count"] for r in P.resample(df, "y", "under", "id").groupBy("y").count().collect()}
    assert over == {None: 40, "a": 50, "b": 50} and under == {None: 40, "a": 10, "b": 10}


def test_stratified_split_is_the_same_on_both_paths(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 250).alias("id"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("y"))
    small = sorted(map(tuple, P.split_column(df, "id", stratify="y").select("id", F.coalesce("y", F.lit(-1)), "part").collect()))
    monkeypatch.setattr(P, "MAX_BAND_ROWS", 20)
    assert sorted(map(tuple, P.split_column(df, "id", stratify="y").select("id", F.coalesce("y", F.lit(-1)), "part").collect())) == small


def test_kth_smallest_of_tied_values(spark):
    values = [5] * 300 + [7] * 200 + [1, 2, 9]
    df = spark.createDataFrame([(v, f"k{i:04d}") for i, v in enumerate(values)], "v int, t string")
    pairs = sorted((v, f"k{i:04d}") for i, v in enumerate(values))
    for k in (1, 3, 150, 302, 303, 400, 503):
        assert P.kth_smallest(df, "v", k, max_band=20)[0] == pairs[k - 1][0]
        assert P.kth_smallest(df, "v", k, tie="t", max_band=20) == pairs[k - 1]


def test_knn_blocks_stay_off_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from opinia.operators import knn

    rows = [(i, [float(i * 37 % 101), float(i * i % 53), float(i % 7)], i % 3) for i in range(400)] + [(900, [1.0, 2.0, 3.0], 0)] * 3
    train = spark.createDataFrame(rows, "id int, vec array<double>, label int")
    query = spark.createDataFrame([(i, [float(i % 90), float(i % 41), 3.0]) for i in range(60)], "id int, vec array<double>").repartition(3)
    for p in (1, 2):
        whole = sorted(map(tuple, knn.neighbours(train, query, 5, p).collect()))
        with monkeypatch.context() as m:
            m.setattr(DataFrame, "toArrow", lambda self: pytest.fail("train rows fetched"))
            blocks = knn.neighbours(train, query, 5, p, block_bytes=1000)
        assert sorted(map(tuple, blocks.collect())) == whole and len(whole) == 300


def test_late_windows_1252_byte(spark, tmp_path):
    p = tmp_path / "late.csv"
    p.write_bytes(b"Review;Rating\n" + b"plain;3\n" * 12_000 + "It’s €5;4\n".encode("cp1252"))
    df = read_reviews(spark, str(p))
    assert df.columns == ["Review", "Rating"] and df.count() == 12_001
    assert df.where("Rating = '4'").first().Review == "It’s €5"
    q = tmp_path / "quoted.csv"
    q.write_text('Review,Rating\n"two\nlines, one field",5\n')
    assert [tuple(r) for r in read_reviews(spark, str(q)).collect()] == [("two\nlines, one field", "5")]


def test_streams_with_the_same_folder_name(spark, tmp_path):
    from opinia.streaming.score import score_stream

    src = tmp_path / "in"
    spark.range(5).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    for parent in ("a", "b"):
        out = str(tmp_path / parent / "out")
        score_stream(spark, str(src), schema, lambda df: df, out)
        assert spark.read.parquet(out).count() == 5
