"""TF-IDF in long form ``(id, term, weight)``, fitted relationally.

Semantics of the vectoriser the reference uses (published formulae):
tokens = lower-cased runs of >= 2 word characters, optional stop list, then
n-grams; ``df`` = documents containing the term; keep ``min_df <= df <=
max_df`` (int = count, float = share of documents); ``max_features`` keeps the
terms with the highest total count (ties: term ascending); ``idf =
ln((1+n)/(1+df)) + 1``; ``tf`` raw or ``1 + ln(tf)`` (sublinear); each
document's weights are divided by their L2 norm.  A document with no kept
term has no rows (all-zero vector).

Plan (fit, then transform):
1. statistics by term: a row's distinct n-grams with their counts are
   exploded and summed by term — one exchange keyed by term, map-side
   combined, so a hot term moves one partial row per task and no
   (doc, term) pair is shuffled;
2. filters and a top-N by total count (TakeOrdered) give the vocabulary,
   bounded by ``max_features`` and broadcast after a size check;
3. transform: n-grams are probed against the vocabulary (broadcast hash
   join) *before* counting, so the (doc, term) exchange carries kept terms
   only; the L2 norm is pre-aggregated per document and joined back.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinia.functions.text import letters_only, ngrams, tokens
from opinia.operators.joins import lookup_join
from opinia.operators.spread import spread


@dataclass(frozen=True)
class TfidfSpec:
    lo: int = 1
    hi: int = 1
    max_features: int | None = None
    min_df: float = 1
    max_df: float = 1.0
    sublinear: bool = False
    stop_words: tuple[str, ...] | None = None
    letters_only: bool = False


@functools.lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    """Spark's bundled English stop list (read from the MLlib jar, so no
    running JVM is needed; falls back to asking the JVM)."""
    import glob
    import os
    import zipfile

    homes = [os.environ.get("SPARK_HOME", "")]
    try:
        from pyspark.find_spark_home import _find_spark_home

        homes.append(_find_spark_home())
    except Exception:  # noqa: BLE001
        pass
    for home in filter(None, homes):
        for jar in glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar")):
            with zipfile.ZipFile(jar) as z:
                text = z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode("utf-8")
            return tuple(w for w in text.split() if w)
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


# The four settings of the reference.
SETTING_A = TfidfSpec(lo=1, hi=2, max_features=3000, min_df=5, max_df=0.75, sublinear=True)
SETTING_B = TfidfSpec(max_features=5000, letters_only=True)
SETTING_D = TfidfSpec()


def setting_c() -> TfidfSpec:
    return TfidfSpec(lo=1, hi=3, max_features=20000, stop_words=english_stop_words())


def term_array(text: Column, spec: TfidfSpec) -> Column:
    src = letters_only(text) if spec.letters_only else text
    return tokens(src)


def doc_tokens(df: DataFrame, id_col: str, text_col: str, spec: TfidfSpec) -> DataFrame:
    """``(id, tk)``: the token array of every document (stop words removed).
    N-grams are built *inside* the generators below, reading ``tk`` as a
    column: a projection of n-grams over this projection would be collapsed
    by the optimizer, re-running the token regex in every n-gram lambda."""
    tk = df.select(F.col(id_col).alias("id"), term_array(F.coalesce(F.col(text_col), F.lit("")), spec).alias("tk"))
    if spec.stop_words:
        stop = list(spec.stop_words)
        tk = tk.select("id", F.filter("tk", lambda w: ~w.isin(stop)).alias("tk"))
    return tk


def each_gram(exploded: DataFrame) -> DataFrame:
    """The rows of an outer explode that hold a term.  For a plain ``explode`` Spark adds a filter on the array's size
    and pushes it below the projection of the tokens, where each n-gram runs the token regex again."""
    return exploded.where(F.col("term").isNotNull())


def doc_terms(df: DataFrame, id_col: str, text_col: str, spec: TfidfSpec) -> DataFrame:
    """``(id, term, tf)`` raw term counts of each document (all terms)."""
    tk = doc_tokens(df, id_col, text_col, spec)
    grams = each_gram(tk.select("id", F.explode_outer(ngrams("tk", spec.lo, spec.hi)).alias("term")))
    return grams.groupBy("id", "term").agg(F.count(F.lit(1)).cast("bigint").alias("tf"))


def term_stats(df: DataFrame, id_col: str, text_col: str, spec: TfidfSpec) -> DataFrame:
    """``(term, df, total)`` in ONE exchange keyed by term: a row's n-grams are sorted, so that each distinct one is a run
    whose length is its count there (a document is one row, so no (doc, term) shuffle is needed); partial aggregation
    leaves one row per term per task."""
    tk = doc_tokens(df, id_col, text_col, spec)
    x = tk.select(F.sort_array(ngrams("tk", spec.lo, spec.hi)).alias("_g"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_g") - 1), lambda i: (i == 0) | (F.get("_g", i) != F.get("_g", i - 1)))
    x = x.select("_g", F.when(F.size("_g") > 0, starts).alias("_at"))
    run = F.transform("_at", lambda i, j: F.struct(
        F.get("_g", i).alias("term"), (F.coalesce(F.get("_at", j + 1), F.size("_g")) - i).alias("n")))
    runs = each_gram(x.select(F.explode_outer(run).alias("_r")).select("_r.term", "_r.n"))
    return runs.groupBy("term").agg(F.count(F.lit(1)).cast("bigint").alias("df"), F.sum("n").cast("bigint").alias("total"))


@dataclass
class TfidfModel:
    spec: TfidfSpec
    vocab: DataFrame  # (term, idf)
    n_docs: int

    def transform(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``(id, term, weight)``: only vocabulary terms are counted, so the
        (doc, term) exchange carries kept terms only."""
        bounded_vocab = self.spec.max_features is not None
        tk = doc_tokens(spread(df.select(id_col, text_col), id_col, text_col), id_col, text_col, self.spec)
        grams = each_gram(tk.select("id", F.explode_outer(ngrams("tk", self.spec.lo, self.spec.hi)).alias("term")))
        kept = (lookup_join(grams, self.vocab, "term") if bounded_vocab else grams.join(self.vocab, "term"))
        tf = kept.groupBy("id", "term", "idf").agg(F.count(F.lit(1)).cast("bigint").alias("tf"))
        return _normalise(tf, self.spec)

    def indexed_vocab(self) -> DataFrame:
        """``(term, idx, idf)``: feature index = rank of the term (sorted)."""
        from opinia.operators.prep import sorted_index

        return sorted_index(self.vocab, [F.col("term")], out="idx")


def fit_tfidf(df: DataFrame, id_col: str, text_col: str, spec: TfidfSpec,
              tf: DataFrame | None = None) -> TfidfModel:
    """Fit the vocabulary and idf.  ``tf`` (an existing ``(id, term, tf)``
    table) may be given to derive the statistics from it instead."""
    n_docs = df.count()
    if tf is not None:
        stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    else:
        stats = term_stats(spread(df.select(id_col, text_col), id_col, text_col), id_col, text_col, spec)
    min_count = spec.min_df if isinstance(spec.min_df, int) else spec.min_df * n_docs
    max_count = spec.max_df * n_docs if isinstance(spec.max_df, float) else spec.max_df
    kept = stats.where((F.col("df") >= F.lit(min_count)) & (F.col("df") <= F.lit(max_count)))
    if spec.max_features is not None:
        kept = kept.orderBy(F.desc("total"), F.asc("term")).limit(spec.max_features)
    vocab = kept.select(
        "term", (F.log((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0).alias("idf")
    )
    return TfidfModel(spec, vocab, n_docs)


def _normalise(tf: DataFrame, spec: TfidfSpec) -> DataFrame:
    """L2 normalisation per document.  The norm is pre-aggregated (partial
    sums, then one row per document) and joined back, instead of a window
    that would hold a whole document in one task; a huge document is then
    an ordinary skewed join key that AQE splits."""
    tfw = (1.0 + F.log(F.col("tf"))) if spec.sublinear else F.col("tf").cast("double")
    raw = tf.select("id", "term", (tfw * F.col("idf")).alias("w"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return raw.join(norms, "id").select("id", "term", (F.col("w") / F.col("_norm")).alias("weight"))


def weigh(tf: DataFrame, vocab: DataFrame, spec: TfidfSpec, bounded: bool = True) -> DataFrame:
    """Weights from an existing ``(id, term, tf)`` table."""
    joined = lookup_join(tf, vocab, "term") if bounded else tf.join(vocab, "term")
    return _normalise(joined.select("id", "term", "tf", "idf"), spec)


def tfidf(df: DataFrame, id_col: str, text_col: str, spec: TfidfSpec) -> DataFrame:
    """Fit on ``df`` and transform it: ``(id, term, weight)``.  Two passes
    over the texts (statistics by term, then counts of kept terms) instead
    of one exchange of every distinct (doc, term) pair."""
    model = fit_tfidf(df, id_col, text_col, spec)
    model.vocab = model.vocab.persist()
    return model.transform(df, id_col, text_col)


def vocabulary(model: TfidfModel, n: int = 10) -> DataFrame:
    """The first ``n`` feature names in alphabetical order."""
    return model.vocab.select("term").orderBy("term").limit(n)


def to_vectors(weights: DataFrame, model: TfidfModel, ids: DataFrame | None = None) -> DataFrame:
    """Long weights -> ``(id, features SparseVector)`` for MLlib estimators.
    Documents without kept terms (present in ``ids``) get an empty vector."""
    from opinia.functions.vectors import sparse_vectors

    size = model.vocab.count()
    iv = model.indexed_vocab().select("term", "idx")
    per_doc = (
        lookup_join(weights, iv, "term")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("e"))
    )
    if ids is not None:
        per_doc = ids.select(F.col(ids.columns[0]).alias("id")).join(per_doc, "id", "left")
    return sparse_vectors(per_doc.select("id", F.col("e.idx").alias("idx"), F.col("e.weight").alias("val")), size)
