"""Work per token, n-gram and compared vector is done once."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinia.functions.text import split_words
from opinia.operators import knn as KNN
from opinia.operators import lexicon as LX
from opinia.operators import tfidf as TF
from opinia.plans.fixtures import DEMO_NEGATORS, boosters_df, lexicon_df

TEXTS = ["a red, red Red car", "red car", "", None, "car", "red car", "Straße ÉTÉ été 42 a_b a_b"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(None if i % 3 == 2 else i % 2, t) for i, t in enumerate(TEXTS)], "id long, text string")


def test_each_part_of_a_valence_stands_once(spark, texts):
    """Copied into the branches of a CASE, the code of a token was too long for the JVM to compile."""
    p = _plan(LX.valence_scores(texts, "id", "text", lexicon_df(spark), boosters_df(spark), DEMO_NEGATORS))
    assert p.count("0.733") == 1 and p.count("-0.74") == 1


def test_term_statistics_explode_each_text_once(spark, texts):
    spec = TF.TfidfSpec(lo=1, hi=2)
    got = TF.term_stats(texts, "id", "text", spec)
    assert _plan(got).count("Generate ") == 1
    df, total = Counter(), Counter()
    for (words,) in texts.select(TF.term_array(F.coalesce("text", F.lit("")), spec)).collect():
        grams = [*words, *(" ".join(p) for p in zip(words, words[1:], strict=False))]
        df.update(set(grams))
        total.update(grams)
    assert {r.term: (r.df, r.total) for r in got.collect()} == {t: (df[t], total[t]) for t in df}


def test_words_are_split_without_a_lambda(spark, texts):
    x = texts.select("text", split_words("text").alias("w"))
    assert "lambda" not in _plan(x)
    assert all(r.w == (None if r.text is None else r.text.split()) for r in x.collect())


@pytest.mark.parametrize("p", [1, 2])
def test_a_query_copies_no_block_of_train_rows(p):
    rng = np.random.default_rng(1)
    train, query = rng.normal(size=(20_000, 64)), rng.normal(size=(3, 64))

    def lists(x):
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())

    block = pa.table({"tid": np.arange(len(train)), "v": lists(train), "label": np.zeros(len(train), np.int64)})
    tracemalloc.start()
    try:
        _, at, _, dist = KNN._nearest(block, pa.table({"qid": np.arange(3), "q": lists(query)}), 5, p, 64)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < train.nbytes / 2
    for i, q in enumerate(query):
        diff = train - q
        d = np.sqrt((diff * diff).sum(axis=1)) if p == 2 else np.abs(diff).sum(axis=1)
        best = np.argsort(d, kind="stable")[:5]
        assert np.concatenate([c.to_numpy() for c in [at]])[5 * i:5 * i + 5].tolist() == best.tolist()
        assert np.array_equal(np.asarray(dist)[5 * i:5 * i + 5], d[best])
