"""F7 with F6, T4 and F4: a fitted text pipeline as one MLlib estimator.

``ReviewFeatures`` learns a bounded vocabulary with its idf (the relational fit of
``tfidf.fit_tfidf``) and, if asked, mean and deviation of the nine review statistics;
``ReviewFeaturesModel`` turns a text into one sparse vector, TF-IDF followed by the
scaled statistics.  Fitted once, saved with its own writer, and applied as it is to new data.

The model is a row-by-row plan in the JVM: token arrays, MLlib's count vectoriser, element-wise
product, normaliser and assembler.  It has no Python and no exchange, so the same model works on a
stream.  Polarity (T4, L2) is counted the same way: lexicon words, with a mark where
a negator stands before them, are the terms of a second vectoriser.
"""

from __future__ import annotations

import json
import os

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinia.functions.text import PUNCTUATION, WHITESPACE_RUN, letters_only, ngrams, review_stat_columns, tokens
from opinia.operators import tfidf as TF
from opinia.operators.spread import spread

STATISTICS = ("review_length", "num_exclam", "num_question", "num_upper", "polarity", "char_length", "prop_upper", "prop_exclam",
              "prop_question")
NEGATED = "\u0001"
MAX_LEXICON = 100_000


class _Settings(HasInputCol, HasOutputCol):
    maxFeatures = Param(Params._dummy(), "maxFeatures", "size of the vocabulary", TypeConverters.toInt)
    lo = Param(Params._dummy(), "lo", "shortest n-gram", TypeConverters.toInt)
    hi = Param(Params._dummy(), "hi", "longest n-gram", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "least number of documents of a term", TypeConverters.toInt)
    maxDF = Param(Params._dummy(), "maxDF", "largest share of documents of a term", TypeConverters.toFloat)
    stopWords = Param(Params._dummy(), "stopWords", "words left out", TypeConverters.toListString)
    lettersOnly = Param(Params._dummy(), "lettersOnly", "drop all but letters first", TypeConverters.toBoolean)
    statistics = Param(Params._dummy(), "statistics", "append the scaled review statistics", TypeConverters.toBoolean)
    lexiconWords = Param(Params._dummy(), "lexiconWords", "words with a polarity", TypeConverters.toListString)
    lexiconValues = Param(Params._dummy(), "lexiconValues", "their polarities", TypeConverters.toListFloat)
    negators = Param(Params._dummy(), "negators", "words that turn the next one", TypeConverters.toListString)
    negation = Param(Params._dummy(), "negation", "factor of a negated word", TypeConverters.toFloat)

    def spec(self) -> TF.TfidfSpec:
        get = self.getOrDefault
        return TF.TfidfSpec(get("lo"), get("hi"), get("maxFeatures"), get("minDF"), get("maxDF"), False,
                            tuple(get("stopWords")) or None, get("lettersOnly"))

    def _with_polarity(self, df: DataFrame, text: Column, out: str) -> DataFrame:
        """Mean polarity of the lexicon words of a text; 0 without any."""
        words, values = self.getOrDefault("lexiconWords"), self.getOrDefault("lexiconValues")
        if not words:
            return df.withColumn(out, F.lit(0.0))
        factor, negators = self.getOrDefault("negation"), list(self.getOrDefault("negators"))
        pieces = F.transform(F.split(text, WHITESPACE_RUN), lambda t: F.lower(F.btrim(t, F.lit(PUNCTUATION))))
        x = df.withColumn("_low", F.filter(pieces, lambda t: F.length(t) > 1))
        marked = F.transform("_low", lambda t, i: F.when(F.coalesce(F.get("_low", i - 1).isin(negators), F.lit(False)), F.concat(F.lit(NEGATED), t)).otherwise(t))
        x = x.withColumn("_marked", marked)
        vocabulary = [*words, *(NEGATED + w for w in words)]
        count = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_marked", outputCol="_hits")
        weigh = ElementwiseProduct(scalingVec=Vectors.dense([*values, *(v * factor for v in values)]), inputCol="_hits", outputCol="_weighted")
        x = weigh.transform(count.transform(x))

        def total(c: str) -> Column:
            return F.aggregate(F.unwrap_udt(c)["values"], F.lit(0.0), lambda a, v: a + v)

        n = total("_hits")
        return x.withColumn(out, F.when(n > 0, total("_weighted") / n).otherwise(0.0)).drop("_low", "_marked", "_hits", "_weighted")

    def with_statistics(self, df: DataFrame, text: Column) -> DataFrame:
        """``df`` plus ``_stats``: the nine statistics as a struct."""
        x = self._with_polarity(df, text, "_polarity")
        columns = review_stat_columns(text, F.col("_polarity"))
        return x.withColumn("_stats", F.struct(*[columns[n].cast("double").alias(n) for n in STATISTICS])).drop("_polarity")


def _defaults() -> dict:
    return dict(maxFeatures=5000, lo=1, hi=1, minDF=1, maxDF=1.0, stopWords=[], lettersOnly=False, statistics=False, lexiconWords=[],
                lexiconValues=[], negators=["not", "never", "no"], negation=-0.5, inputCol="text", outputCol="features")


class ReviewFeatures(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of :class:`ReviewFeaturesModel`.  A null text is an empty one."""

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._setDefault(**_defaults())
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ReviewFeaturesModel:
        if len(self.getOrDefault("lexiconWords")) > MAX_LEXICON:
            raise ValueError(f"a lexicon of more than {MAX_LEXICON} words is joined instead (lexicon.polarity)")
        text = F.coalesce(F.col(self.getInputCol()), F.lit(""))
        docs = dataset.select(F.lit(0).alias("id"), text.alias("text"))
        fitted = TF.fit_tfidf(docs, "id", "text", self.spec())
        terms = sorted(tuple(r) for r in fitted.vocab.collect())  # at most maxFeatures
        mean = deviation = []
        if self.getOrDefault("statistics"):
            stats = self.with_statistics(spread(docs, "text"), F.col("text")).select("_stats.*")
            row = stats.agg(*[F.avg(c) for c in STATISTICS], *[F.stddev_pop(c) for c in STATISTICS]).first()
            mean = [x or 0.0 for x in row[:len(STATISTICS)]]
            deviation = [x or 1.0 for x in row[len(STATISTICS):]]
        model = ReviewFeaturesModel([t for t, _ in terms], [v for _, v in terms], list(mean), list(deviation))
        return self._copyValues(model)


class ReviewFeaturesModel(Model, _Settings, MLReadable, MLWritable):
    """Vocabulary (sorted) with idf, means and deviations of the statistics."""

    def __init__(self, vocabulary: list[str] | None = None, idf: list[float] | None = None, mean: list[float] | None = None,
                 deviation: list[float] | None = None):
        super().__init__()
        self._setDefault(**_defaults())
        self.vocabulary, self.idf, self.mean, self.deviation = vocabulary or [], idf or [], mean or [], deviation or []

    @property
    def size(self) -> int:
        return max(len(self.vocabulary), 1) + len(self.mean)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spec, out = self.spec(), self.getOutputCol()
        text = F.coalesce(F.col(self.getInputCol()), F.lit(""))
        x = dataset.withColumn("_tk", tokens(letters_only(text) if spec.letters_only else text))
        if spec.stop_words:
            stop = list(spec.stop_words)
            x = x.withColumn("_tk", F.filter("_tk", lambda w: ~w.isin(stop)))
        x = x.withColumn("_terms", ngrams("_tk", spec.lo, spec.hi))
        # an empty vocabulary still gives a vector: one term that no text has
        count = CountVectorizerModel.from_vocabulary(self.vocabulary or [NEGATED], inputCol="_terms", outputCol="_tf")
        scale = ElementwiseProduct(scalingVec=Vectors.dense(self.idf or [1.0]), inputCol="_tf", outputCol="_w")
        x = Normalizer(inputCol="_w", outputCol="_unit", p=2.0).transform(scale.transform(count.transform(x)))
        names = ["_unit"]
        if self.getOrDefault("statistics"):
            x = self.with_statistics(x, text)
            scaled = [(F.col(f"_stats.{c}") - m) / s for c, m, s in zip(STATISTICS, self.mean, self.deviation, strict=True)]
            x = x.withColumn("_dense", array_to_vector(F.array(*scaled)))
            # tells the assembler the size, which it would read a row for
            x = VectorSizeHint(inputCol="_dense", size=len(STATISTICS), handleInvalid="optimistic").transform(x)
            names.append("_dense")
        x = VectorAssembler(inputCols=names, outputCol=out).transform(x.drop(out))
        return x.select(*(c for c in dataset.columns if c != out), out)

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: ReviewFeaturesModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"mean": m.mean, "deviation": m.deviation})
        rows = [json.dumps({"i": i, "term": t, "idf": v}) for i, (t, v) in enumerate(zip(m.vocabulary, m.idf, strict=True))]
        from opinia.session import local_df

        local_df(self.sparkSession, [(r,) for r in rows], "value string").write.text(os.path.join(path, "data"))


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ReviewFeaturesModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = sorted((json.loads(r[0]) for r in self.sparkSession.read.text(os.path.join(path, "data")).collect()), key=lambda r: r["i"])
        model = self.cls([r["term"] for r in rows], [r["idf"] for r in rows], meta["mean"], meta["deviation"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


def sparse_columns(df: DataFrame, features: str = "features") -> DataFrame:
    """``df`` with ``idx`` and ``val`` of a sparse (or dense) vector column, for ``sparse_knn``; no Python."""
    v = F.unwrap_udt(features)
    at = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    return df.withColumns({"_i": at, "_v": v["values"]}).withColumn(
        "_p", F.filter(F.arrays_zip("_i", "_v"), lambda p: p["_v"] != 0)).withColumns(
        {"idx": F.col("_p._i"), "val": F.col("_p._v")}).drop("_i", "_v", "_p")
