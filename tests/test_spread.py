"""Rows are dealt over the cores before work that is heavy per row."""

import pytest
from pyspark.sql import functions as F

from opinia.operators import knn as KNN
from opinia.operators import lexicon as LX
from opinia.operators import mllib as ML
from opinia.operators import tfidf as TF
from opinia.operators.spread import SPREAD_ROWS, spread
from opinia.plans.fixtures import DEMO_NEGATORS, boosters_df, lemma_df, lexicon_df

N = 3 * SPREAD_ROWS


@pytest.fixture(scope="module")
def one_task(spark):
    """More rows than a task should have, all in one; keys repeat and are null."""
    key = F.when(F.col("id") % 3 > 0, F.col("id") % 50)
    x = spark.range(N, numPartitions=1).select(key.alias("doc_id"), F.concat(F.lit("good not bad "), F.col("id").cast("string")).alias("text"))
    return x.union(x.where("false")).coalesce(1)


def test_spread_keeps_rows_and_parts_null_keys(spark, one_task):
    x = spread(one_task, "doc_id", "text")
    sizes = [r["n"] for r in x.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == N and max(sizes) <= 2 * SPREAD_ROWS and len(sizes) >= 3
    assert x.exceptAll(one_task).count() == 0 and one_task.exceptAll(x).count() == 0


def test_few_rows_stay(spark):
    x = spark.range(10, numPartitions=1)
    assert spread(x, "id") is x


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_heavy_steps_do_not_run_in_the_scan(spark, one_task):
    scores = LX.valence_scores(one_task, "doc_id", "text", lexicon_df(spark), boosters_df(spark), DEMO_NEGATORS)
    pieces = LX.review_sentiment(one_task, "doc_id", "text", lexicon_df(spark).withColumnRenamed("valence", "polarity"))
    weights = TF.tfidf(one_task, "doc_id", "text", TF.SETTING_A)
    for df in (scores, pieces, weights):
        assert "REPARTITION_BY_NUM" in _plan(df)


def test_neighbour_search_is_dealt(spark):
    rows = spark.range(2 * KNN.QUERY_ROWS, numPartitions=1).select("id", F.array(F.col("id").cast("double")).alias("vec"), F.lit(1).alias("label"))
    found = KNN.neighbours(rows, rows, 1)
    assert "REPARTITION_BY_NUM" in _plan(found)
    assert found.where("qid = tid AND dist = 0").count() == 2 * KNN.QUERY_ROWS


def test_clusters_keep_no_table_in_one_task(spark):
    docs = spark.range(N, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.translate(F.md5(F.col("id").cast("string")), "0123456789", "ghijkl    ")).alias("text"))
    _, out = ML.fit_review_clusters(docs, "doc_id", "text", [], lemma_df(spark), k=2, max_iter=2)
    assert out.count() == N and "REPARTITION_BY_NUM" in _plan(out)
