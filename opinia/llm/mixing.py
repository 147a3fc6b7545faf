"""Mixing sources to target weights (operator 3), DataFrame functions only.

1. Soft membership: a naive Bayes classifier, trained on a bounded sample of
   labelled rows (``sample`` per domain, the ``vocabulary`` most widespread
   words), gives each document a posterior over the domains.  Its log
   likelihood is scaled to ``EFFECTIVE`` words, so long texts stay soft.
2. Rates: document i gets a rate r_i >= 0, so that the expected domain totals
   S_d = sum r_i n_i p_id meet the targets T_d = weight_d * sum n_i.  Projected
   gradient on sum (S_d - T_d)^2 / G_d, G_d = sum n_i p_id^2, starting from
   r = 1, in the metric of the document lengths (a document's rate does not
   depend on its length).  Each step is one aggregate over all documents that
   returns one total per domain; the step size follows from the K x K Gram matrix.
   Totals that miss the targets after the last step (domains that the classifier
   does not tell apart, targets out of reach) are reported as a warning.

Defined results: null and empty texts have no tokens and the prior's posterior;
with no labelled rows, no tokens or no positive target every rate is 1;
domains that are not among the targets have target 0; repeated rows get equal
rates; extra columns stay, clashing ones are replaced.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinia.llm import common as C
from opinia.llm.licenses import GAP, WORD

SAMPLE = 2000  # labelled rows per domain that the classifier is trained on
VOCABULARY = 3000  # words the classifier knows
MAX_DOMAINS = 200
EFFECTIVE = 20.0
SMOOTH = 0.5
TOLERANCE, MAX_STEPS, WRITE_EVERY = 1e-7, 300, 8


def words_of(text: Column) -> Column:
    return F.split(F.lower(text), GAP)


def fit(labelled: DataFrame, domain: str, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE,
        vocabulary: int = VOCABULARY) -> tuple[list[str], list[float], list[tuple[str, list[float]]]]:
    """(domains, log priors, [(word, log probability in each domain)])."""
    own = labelled.select(F.col(doc_id).alias("id"), F.col(domain).cast("string").alias("d"), C.text_or_empty(text).alias("t"))
    own = own.where("d IS NOT NULL")
    prior = {r[0]: r[1] for r in own.groupBy("d").count().limit(MAX_DOMAINS + 1).collect()}
    if len(prior) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    domains = sorted(prior)
    if not domains:
        return [], [], []
    picked = C.sample_per_class(own, "d", "id", sample)
    words = C.cut(picked.select("d", F.explode(words_of(F.col("t"))).alias("w")).where("w != ''")
                  .groupBy("w", "d").agg(F.count("*").alias("n")), "mixing-words")
    top = words.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(vocabulary)
    counts: dict[str, dict[str, int]] = {}
    for r in words.join(F.broadcast(top.select("w")), "w").collect():  # at most vocabulary * domains rows
        counts.setdefault(r.w, {})[r.d] = r.n
    total = {d: sum(c.get(d, 0) for c in counts.values()) for d in domains}
    size = SMOOTH * len(counts)
    model = [(w, [math.log((c.get(d, 0) + SMOOTH) / (total[d] + size)) for d in domains]) for w, c in sorted(counts.items())]
    all_rows = sum(prior.values())
    return domains, [math.log(prior[d] / all_rows) for d in domains], model


def posteriors(docs: DataFrame, fitted, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, n_tokens and p_0 .. p_k-1, one row per row of ``docs``.  The words are
    exploded and summed up again within their task (partial aggregation), so one
    narrow row per document is shuffled."""
    domains, prior, model = fitted
    k = len(domains)
    table = docs.sparkSession.createDataFrame([(w, *ps) for w, ps in model], ", ".join(["word string", *(f"l_{i} double" for i in range(k))]))
    rows = docs.select(*keep, C.text_or_empty(text).alias("_t"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("n_tokens", F.regexp_count("_t", F.lit(WORD)).cast("long"))
    rows = rows.select(*keep, "_row", "n_tokens", F.explode(words_of(F.col("_t"))).alias("word"))
    summed = rows.join(F.broadcast(table), "word", "left").groupBy("_row", *keep, "n_tokens").agg(  # vocabulary rows at most
        F.count("l_0").alias("_hits"), *(F.coalesce(F.sum(f"l_{i}"), F.lit(0.0)).alias(f"_s{i}") for i in range(k)))
    scale = F.least(F.lit(1.0), F.lit(EFFECTIVE) / F.greatest(F.col("_hits"), F.lit(1)))
    logs = [F.lit(prior[i]) + F.col(f"_s{i}") * scale for i in range(k)]
    out = summed.select(*keep, "n_tokens", *(x.alias(f"_l{i}") for i, x in enumerate(logs)))
    high = F.greatest(*(F.col(f"_l{i}") for i in range(k))) if k > 1 else F.col("_l0")
    out = out.select(*keep, "n_tokens", *(F.exp(F.col(f"_l{i}") - high).alias(f"_e{i}") for i in range(k)))
    total = sum((F.col(f"_e{i}") for i in range(1, k)), F.col("_e0"))
    return out.select(*keep, "n_tokens", *((F.col(f"_e{i}") / total).alias(f"p_{i}") for i in range(k)))


def solve(table: DataFrame, weights: list[float], tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> tuple[DataFrame, list[float]]:
    """``table`` (n_tokens, p_0 ..) plus rate, and the totals' last distance from the
    targets as shares of all tokens."""
    k = len(weights)
    n = F.col("n_tokens")
    grams = [F.sum(n * F.col(f"p_{i}") * F.col(f"p_{j}")) for i in range(k) for j in range(i, k)]
    first = table.agg(F.sum(n).alias("n"), *(g.alias(f"g{x}") for x, g in enumerate(grams))).first()
    tokens = first["n"] or 0
    if not tokens or sum(weights) <= 0:
        return table.withColumn("rate", F.lit(1.0)), []
    gram, x = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = first[f"g{x}"]
            x += 1
    diagonal = np.maximum(np.diag(gram), 1e-12)
    step = 1.0 / np.linalg.eigvalsh(gram / np.sqrt(np.outer(diagonal, diagonal)))[-1]
    target = np.array(weights) / sum(weights) * tokens
    names = table.columns
    now, off = table.withColumn("rate", F.lit(1.0)), []
    for turn in range(max_steps + 1):
        got = now.agg(*(F.sum(F.col("rate") * n * F.col(f"p_{i}")).alias(f"t{i}") for i in range(k))).first()
        rest = np.array([got[f"t{i}"] for i in range(k)]) - target
        off = (rest / tokens).tolist()
        if np.abs(off).max() < tolerance or turn == max_steps:
            break
        move = (step * rest / diagonal).tolist()
        down = sum((F.lit(m) * F.col(f"p_{i}") for i, m in enumerate(move[1:], 1)), F.lit(move[0]) * F.col("p_0"))
        now = now.select(*names, F.greatest(F.lit(0.0), F.col("rate") - down).alias("rate"))
        if turn % WRITE_EVERY == WRITE_EVERY - 1:
            now = C.cut(now, "mixing-rates")
    return now, off


def rates(docs: DataFrame, fitted, targets: dict[str, float] | None = None, keep: list[str] | None = None,
          text: str = "text") -> DataFrame:
    """``keep`` columns plus n_tokens, domain (the likeliest), p (posterior of each domain,
    in alphabetical order) and rate, one row per row of ``docs``.  Without ``targets``
    all domains weigh the same."""
    fresh = ("n_tokens", "domain", "p", "rate")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*fresh, text)]
    own = {c: f"_keep{i}" for i, c in enumerate(keep)}
    back = [F.col(v).alias(c) for c, v in own.items()]
    docs = docs.select(*(F.col(c).alias(v) for c, v in own.items()), F.col(text).alias("_text"))
    domains, text, keep = fitted[0], "_text", list(own.values())
    if not domains:
        n = F.regexp_count(C.text_or_empty(text), F.lit(WORD)).cast("long")
        return docs.select(*back, n.alias("n_tokens"), F.lit(None).cast("string").alias("domain"),
                           F.array().cast("array<double>").alias("p"), F.lit(1.0).alias("rate"))
    weights = [float((targets or {}).get(d, 0.0)) if targets is not None else 1.0 for d in domains]
    table = C.cut(posteriors(docs, fitted, keep, text), "mixing-posteriors")
    solved, off = solve(table, weights)
    missed = {d: o for d, o in zip(domains, off) if abs(o) >= TOLERANCE}
    if missed:
        named = ", ".join(f"{d} {o:+.2g}" for d, o in missed.items())
        warnings.warn(f"mixing rates miss their targets after {MAX_STEPS} steps, as shares of all tokens: {named}", stacklevel=2)
    p = F.array(*(F.col(f"p_{i}") for i in range(len(domains))))
    best = F.array_position(p, F.array_max(p)).cast("int")
    return solved.select(*back, "n_tokens", F.element_at(F.array(*map(F.lit, domains)), best).alias("domain"), p.alias("p"), "rate")


def copies(rate: Column, *ids: str) -> Column:
    """The rate rounded to a whole number of copies, up or down by a hash of the ids, right
    on average."""
    u = F.pmod(F.xxhash64(F.lit("mix"), *ids), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("int")


def mix(docs: DataFrame, fitted, targets: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` plus rate and copies; documents of rate 0 go."""
    fresh = ["rate", "copies"]
    docs = docs.drop(*fresh)
    keyed = docs.withColumns({"_i": F.xxhash64(doc_id), "_h": F.xxhash64(text)})
    found = rates(keyed, fitted, targets, ["_i", "_h"], text).select("_i", "_h", "rate").dropDuplicates(["_i", "_h"])
    out = keyed.join(found, ["_i", "_h"]).where("rate > 0")
    return out.withColumn("copies", copies(F.col("rate"), doc_id, "_h")).select(*docs.columns, *fresh)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = rates(docs, fit(docs, "lang"), None, ["doc_id"])
    return out.withColumn("copies", copies(F.col("rate"), "doc_id"))
