"""The versioned table of the word counts: restarts, crashes and readers."""

import pytest
from pyspark.sql import functions as F

from opinia.operators.aggregates import word_sentiment
from opinia.streaming import versions
from opinia.streaming.score import WORD_KEYS, read_word_sentiment, word_sentiment_stream

LEXICON = [("good", 1.9), ("bad", -2.5), ("fine", 0.8)]


def rows(df):
    return sorted(tuple(r) for r in df.select("pais", "palabra", "frecuencia", "sentimiento").collect())


@pytest.fixture
def stream(spark, tmp_path):
    texts = [("PT", "good bad day"), ("ES", "good good"), ("PT", "bad fine fine"), ("PT", "good"), ("ES", "fine bad")]
    for i, t in enumerate(texts):
        spark.createDataFrame([t], "pais string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.read.parquet(src).schema
    lexicon = spark.createDataFrame(LEXICON, "word string, valence double")

    def run(**more):
        return word_sentiment_stream(spark, src, schema, "pais", "text", lexicon, out, str(tmp_path / "ckpt"), files_per_batch=1, **more)

    whole = rows(word_sentiment(spark.read.parquet(src), "pais", "text", lexicon))
    return run, out, whole


def test_counts_of_many_batches_equal_the_batch_job(spark, stream):
    run, out, whole = stream
    assert read_word_sentiment(spark, out).count() == 0
    run()
    assert rows(read_word_sentiment(spark, out)) == whole
    last = versions.manifest(spark, out)
    assert last["epoch"] == 4 and len(last["folders"]) == 5
    run()  # nothing new
    assert versions.manifest(spark, out) == last


@pytest.mark.parametrize("when", ["before", "after", "between"])
def test_a_killed_stream_goes_on_and_readers_see_whole_batches(spark, stream, when, monkeypatch):
    run, out, whole = stream
    seen = []

    def dying(batch, epoch):
        if epoch == 2:
            seen.append(rows(read_word_sentiment(spark, out)))
            if when == "after":  # the batch is committed here, but not in the stream's checkpoint
                versions.update(batch, epoch, out, WORD_KEYS)
            if when == "between":  # rows are written, the manifest is not
                batch.write.parquet(f"{out}/{versions.FOLDERS}/half")
            raise RuntimeError("killed")
        versions.update(batch, epoch, out, WORD_KEYS)

    with pytest.raises(Exception, match="killed"):
        run(sink=dying)
    now = rows(read_word_sentiment(spark, out))
    assert (now == seen[0]) == (when != "after")
    run()
    assert rows(read_word_sentiment(spark, out)) == whole


def test_compacted_table_is_the_same(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, n long"
    for e in range(7):
        versions.update(spark.createDataFrame([("a", e), (f"k{e % 3}", e * 10)], schema), e, path, ["k"], compact=3)
        kind = spark.createDataFrame([], schema).schema
        got = {r.k: r.n for r in versions.read(spark, path, ["k"], kind).collect()}
        assert got["a"] == e and got[f"k{e % 3}"] == e * 10 and len(versions.manifest(spark, path)["folders"]) < 3
    versions.update(spark.createDataFrame([("a", 99)], schema), 6, path, ["k"])  # run again
    assert versions.read(spark, path, ["k"], kind).where(F.col("k") == "a").first().n == 6
