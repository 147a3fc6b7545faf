"""Quality rules by distribution divergence (operator 4), DataFrame functions only.

Each text's histogram over character classes, and its histogram over the
common words of all languages, are compared with those of each language's
reference (labelled good texts) by Jensen-Shannon divergence in bits.  A text
is kept if some language is close enough in both.  Texts with fewer than
``min_chars`` characters skip the character test, texts with fewer than
``min_words`` words the word test (minimum-length guards).

The references are fitted on all labelled good texts.  Plain counts (n_words, word_chars, n_symbols,
n_dup_lines, n_repeat_words) decide first: ``base_failed`` texts are not kept.

Defined results: null and empty texts have no words, fail the base rules and
are not kept; without any labelled text there is no reference and the base
rules alone decide; repeated rows each get a row.  Rows are judged without a
shuffle; for the references each text's counts and frequent words are joined with the labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinia.llm import common as C

COMMON_WORDS = 12  # common words per language
CANDIDATES = 64  # words per language that are looked at for them before any text is joined
MIN_CHARS, MIN_WORDS = 200, 40
MAX_CHAR_DIVERGENCE, MAX_WORD_DIVERGENCE = 0.10, 0.25
WINDOW = 5

WS = " \t\n\x0b\x0c\r"  # fixed values: 0x20 and 0x09-0x0D
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
CLASSES = {  # the rest of a text's characters: lower-case a-z and white space, counted apart
    "upper": r"[A-Z]", "digit": r"[0-9]", "stop": r"[.,;:!?'\"()-]", "symbol": SYMBOLS, "beyond": r"[^\x00-\x7F]",
}


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a lambda variable)."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of ``size`` words that stand twice or more in the text."""

    def count(w: Column) -> Column:
        window = F.transform(F.sequence(F.lit(0), F.size(w) - size),
                             lambda i: F.xxhash64(*(F.get(w, i + F.lit(k)) for k in range(size))))
        return bound(window, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = bound(placed, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: (
            F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        )), lambda x: x["i"])))
        # consecutive starts p, q cover min(size, q - p) words; the last one covers size words
        return bound(twice, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size)))),
            F.lit(0), lambda a, x: a + x))

    return F.when(F.size(words) < size + 1, F.lit(0)).otherwise(bound(words, count)).cast("long")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus _w (words), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed and the character-class counts c_*."""
    out = docs.withColumn("_t", C.text_or_empty(text))
    out = out.withColumn("_w", words_of(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({
        "_lines": lines, "_chars": F.char_length("_t"),
        **{f"c_{k}": F.regexp_count("_t", F.lit(p)) for k, p in CLASSES.items()},
    })
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.col("c_symbol").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_w")),
    })
    out = out.withColumns({
        "c_space": F.col("_chars") - F.col("word_chars"),
        "c_lower": F.col("word_chars") - sum((F.col(f"c_{k}") for k in CLASSES), F.lit(0)),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    })
    return out.drop("_lines", "_t")


CHAR_COLUMNS = [f"c_{k}" for k in ("lower", "space", *CLASSES)]


def char_counts(text: Column, words: Column) -> Column:
    """The character-class counts as one array of doubles, in CHAR_COLUMNS order."""
    inside = F.char_length(F.array_join(words, ""))
    others = [F.regexp_count(text, F.lit(p)) for p in CLASSES.values()]
    lower = inside - sum(others, F.lit(0))
    return F.array(*(c.cast("double") for c in (lower, F.char_length(text) - inside, *others)))


def word_counts(words: Column, vocabulary: list[str]) -> Column:
    """Count of each vocabulary word, then of all other words, as doubles."""
    hits = F.filter(words, lambda x: x.isin(vocabulary))
    return bound(hits, lambda c: F.concat(
        F.transform(F.array(*map(F.lit, vocabulary)), lambda v: (F.size(c) - F.size(F.array_remove(c, v))).cast("double")),
        F.array((F.size(words) - F.size(c)).cast("double"))))


def references(docs: DataFrame, good: DataFrame | None = None, common: int = COMMON_WORDS, lang: str = "lang", doc_id: str = "doc_id",
               text: str = "text", candidates: int = CANDIDATES) -> tuple[list[str], list[tuple[str, list, list]]]:
    """(vocabulary, [(language, character histogram, word histogram)]) fitted on all
    ``docs`` whose id is in ``good`` (None: on all of them).

    Texts are not shuffled to meet the ids of ``good``: each is reduced to its counts and to its words among the
    ``candidates`` most frequent of all texts of each language first.  If the last common word found
    is more frequent in good texts than any other word is in all, none is missed; a language where
    that does not hold is counted by a join of its texts."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")
    own = own.select("doc_id", "lang", "t", words_of(F.col("t")).alias("w"))

    def chosen(x: DataFrame) -> DataFrame:
        # one way to join at every size: ids grow with the texts
        return x if good is None else x.join(good.select(F.col(doc_id).alias("doc_id")).hint("merge"), "doc_id", "left_semi")

    def counted(x: DataFrame) -> DataFrame:
        # outer: a plain explode adds a filter that splits the text again
        return x.select("lang", F.explode_outer("w").alias("word")).where("word IS NOT NULL").groupBy("lang", "word").count()

    def among(words: set) -> Column:
        return F.filter("w", lambda x: x.isin(sorted(words))).alias("w")

    def by_lang(rows) -> dict[str, dict]:
        out: dict[str, dict] = {}
        for r in rows:
            out.setdefault(r["lang"], {})[r["word"]] = r["count"]
        return out

    def frequent(x: DataFrame, n: int) -> dict[str, dict]:
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), F.desc("word")))
        return by_lang(counted(x).withColumn("place", place).where(F.col("place") <= n).collect())

    def first(v: dict, n: int) -> list:
        return sorted(((c, w) for w, c in v.items()), reverse=True)[:n]

    size = common if good is None else candidates
    tops = frequent(own, size + 1)
    listed = {w for v in tops.values() for _, w in first(v, size)}
    if not listed:
        return [], []
    met = C.cut(chosen(own.select("doc_id", "lang", char_counts(F.col("t"), F.col("w")).alias("c"), F.size("w").alias("n"), among(listed))).drop("doc_id"), "quality-counts")
    counts = by_lang(counted(met).collect())
    best = {k: first(v, common) for k, v in counts.items()}
    n_c = len(CHAR_COLUMNS)
    sums = met.groupBy("lang").agg(F.sum("n").alias("n"), *(F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(n_c))).collect()
    rest = [] if good is None else [r["lang"] for r in sums if r["n"] and len(tops[r["lang"]]) > size and (
        len(best.get(r["lang"], [])) < common or best[r["lang"]][-1][0] <= first(tops[r["lang"]], size + 1)[-1][0])]
    if rest:
        best |= {k: first(v, common) for k, v in frequent(chosen(own.where(F.col("lang").isin(rest))), common).items()}
    vocabulary = sorted({w for v in best.values() for _, w in v})
    if not vocabulary:
        return [], []
    if more := set(vocabulary) - listed:
        for k, v in by_lang(counted(chosen(own.select("doc_id", "lang", among(more)))).collect()).items():
            counts[k] = counts.get(k, {}) | v
    out = []
    for r in sorted(sums, key=lambda r: r["lang"]):
        c, v = [r[f"c{i}"] for i in range(n_c)], [float(counts.get(r["lang"], {}).get(w, 0)) for w in vocabulary]
        v.append(r["n"] - sum(v))
        if sum(c) and sum(v):
            out.append((r["lang"], [x / sum(c) for x in c], [x / sum(v) for x in v]))
    return vocabulary, out


def divergence(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon divergence in bits (0 to 1) of a histogram and a reference."""

    def half(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def part(p: Column, q: Column) -> Column:
        return (half(p, (p + q) / 2) + half(q, (p + q) / 2)) / 2

    return bound(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), lambda n: F.aggregate(
        F.zip_with(F.transform(counts, lambda x: x / F.greatest(n, F.lit(1.0))), F.array(*map(F.lit, reference)), part),
        F.lit(0.0), lambda a, x: a + x))


def judge(docs: DataFrame, fitted, text: str = "text", min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
          max_char: float = MAX_CHAR_DIVERGENCE, max_word: float = MAX_WORD_DIVERGENCE) -> DataFrame:
    """``docs`` plus the base counts, char_divergence, word_divergence (of the
    nearest language, null without references), nearest and kept."""
    vocabulary, refs = fitted
    out = base_counts(docs, text)
    if not refs:
        return out.withColumns({
            "char_divergence": F.lit(None).cast("double"), "word_divergence": F.lit(None).cast("double"),
            "nearest": F.lit(None).cast("string"), "kept": ~F.col("base_failed"),
        }).drop("_w", "_chars", *CHAR_COLUMNS)
    out = out.withColumns({"_c": F.array(*(F.col(c).cast("double") for c in CHAR_COLUMNS)),
                           "_v": word_counts(F.col("_w"), vocabulary)}).drop("_w", *CHAR_COLUMNS)
    long_c, long_w = F.col("_chars") >= min_chars, F.col("n_words") >= min_words
    options = F.array(*(F.struct(
        divergence(F.col("_c"), c).alias("c"), divergence(F.col("_v"), v).alias("w"), F.lit(lang).alias("lang")) for lang, c, v in refs))
    out = out.withColumn("_options", options)
    excess = F.transform("_options", lambda o: F.struct(
        (F.when(long_c, o["c"] / max_char).otherwise(0.0) + F.when(long_w, o["w"] / max_word).otherwise(0.0)).alias("e"),
        o["lang"].alias("lang"), o["c"].alias("c"), o["w"].alias("w"),
        ((~long_c | (o["c"] <= max_char)) & (~long_w | (o["w"] <= max_word))).alias("ok")))
    out = out.withColumn("_options", excess)
    nearest = F.array_min("_options")
    return out.withColumns({
        "char_divergence": nearest["c"], "word_divergence": nearest["w"], "nearest": nearest["lang"],
        "kept": ~F.col("base_failed") & F.exists("_options", lambda o: o["ok"]),
    }).drop("_options", "_c", "_v", "_chars")


CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = judge(docs.select("doc_id", "text"), references(docs, labels.where("quality = 1")))
    return out.select(*CONTRACT, "nearest", "char_divergence", "word_divergence")
