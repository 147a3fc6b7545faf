"""License scans (operator 1), DataFrame functions only.

Exact set-similarity join of text blocks with license notices.  A block is a line, or a run of
two to ``RUN_LINES`` consecutive lines of at most ``RUN_CHARS`` characters together: a
notice that is wrapped is found where it is whole.  A
block matches a template if it holds at least ``threshold`` of the template's
distinct tokens.  Template tokens are ordered by their global frequency over
all blocks, rarest first; a match must share one of the rarest
``n - need + 1`` tokens of the template (prefix filter), have at least
``need`` template-vocabulary tokens (length filter) and have enough tokens
left behind the shared one on both sides (positional filter).  Candidates are
verified by intersection.  Tokens outside all templates cannot take part in
an overlap, so blocks are cut down to the template vocabulary first.

Three plain phrases are counted besides (``PHRASES``); their labels stay.

Defined results: null or empty texts have 0 words and no labels; an empty table gives no rows; texts
of any length are read whole; repeated rows
each get a row with equal values; templates without tokens are skipped; extra
columns are ignored.  The template table is a parameter held as literals
(``MAX_TEMPLATES``); it does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinia.llm import common as C

# Phrases of the base count and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Short notices; a block that holds most of a notice's words carries its label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "copyright all rights reserved"),
)
MAX_TEMPLATES = 1000
THRESHOLD = 0.8
RUN_LINES, RUN_CHARS = 4, 400  # four lines of a hundred columns hold the longest notice

SEP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # with A-Z as words: the text need not be lower-cased to find them
GAP = f"[{SEP}]+"
LETTER = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]"  # all that is no separator; the regex engine is much faster than with [^...]
WORD = LETTER + "++"


def phrase_pattern(phrase: str) -> str:
    """The phrase's words in a row; (?i) folds A-Z only."""
    return f"(?<!{LETTER})" + GAP.join(f"(?i:{w})" for w in phrase.split()) + f"(?!{LETTER})"


def words_in(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def base_scan(docs: DataFrame, text: str = "text", phrases=PHRASES) -> DataFrame:
    """``docs`` plus n_words, n_base, first_word, last_word, base_list."""
    t = C.text_or_empty(text)
    out = docs.withColumn("_t", t)

    def places(phrase: str) -> Column:
        """The regex runs only on texts that hold all of the phrase's words."""
        low = F.lower("_t")
        holds = F.lit(True)
        for w in sorted(set(phrase.split()), key=lambda w: (-len(w), w)):
            holds = holds & low.contains(w)
        return F.when(holds, F.regexp_count("_t", F.lit(phrase_pattern(phrase)))).otherwise(0)

    counts = [places(p) for p, _ in phrases]
    out = out.withColumns({f"_c{i}": c for i, c in enumerate(counts)})
    firsts, lasts, labels = [], [], []
    for i, (p, label) in enumerate(phrases):
        has, pat = F.col(f"_c{i}") > 0, phrase_pattern(p)
        before = F.regexp_extract("_t", f"(?s)^(.*?){pat}", 1)
        upto = F.regexp_extract("_t", f"(?s)^(.*){pat}", 1)
        firsts.append(F.when(has, words_in(before).cast("long")))
        lasts.append(F.when(has, words_in(upto).cast("long")))
        labels.append(F.when(has, F.lit(label)))
    one = len(phrases) == 1
    out = out.withColumns({
        "n_words": words_in(F.col("_t")).cast("long"),
        "n_base": sum((F.col(f"_c{i}") for i in range(len(phrases))), F.lit(0)).cast("long"),
        "first_word": firsts[0] if one else F.least(*firsts),
        "last_word": lasts[0] if one else F.greatest(*lasts),
        "base_list": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    })
    return out.drop("_t", *(f"_c{i}" for i in range(len(phrases))))


def token_sets(templates, threshold: float) -> list[tuple[int, str, set, int]]:
    """(number, label, distinct tokens, tokens needed) of each usable template."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"{len(templates)} templates: the template table is a parameter of at most {MAX_TEMPLATES}")
    sets = [(i, label, set(t.lower().split())) for i, (label, t) in enumerate(templates)]
    return [(i, label, s, need(len(s), threshold)) for i, label, s in sets if s]


def need(n: int, threshold: float) -> int:
    """Smallest overlap o with o / n >= threshold."""
    return next(o for o in range(1, n + 1) if o / n >= threshold)


def line_tokens(docs: DataFrame, keys: list[str], text: str, vocabulary: list[str]) -> DataFrame:
    """``keys`` and ``_l``: per line of the text its vocabulary tokens and its length."""
    known = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    x = docs.select(*keys, F.split(C.text_or_empty(text), "\n").alias("_lines"))
    return x.select(*keys, F.transform("_lines", lambda t: F.struct(
        F.array_intersect(known, F.split(F.lower(t), GAP)).alias("own"), F.length(t).alias("size"))).alias("_l"))


def blocks_of(lines: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``keys``, block, own: the vocabulary tokens of the lines and of the short runs of lines that have at least
    ``least`` of them; block numbers tell first line and number of lines.  A run's tokens are those of its lines, so
    no text is split again."""
    def total(i: Column, j: int, of) -> Column:
        return sum((of(F.get("_l", i + k)) for k in range(1, j)), of(F.get("_l", i)))

    def runs(j: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size("_l") - j), lambda i: (total(i, j, lambda e: F.size(e["own"])) >= least) & (
            F.lit(True) if j == 1 else total(i, j, lambda e: e["size"]) <= RUN_CHARS))
        found = F.transform(starts, lambda i: F.struct((i.cast("long") * (RUN_LINES + 1) + j).alias("block"), F.array_distinct(
            F.concat(*(F.get("_l", i + k)["own"] for k in range(j)))).alias("own")))
        return F.when(F.size("_l") >= j, found).otherwise(F.array().cast("array<struct<block:bigint,own:array<string>>>"))

    # below the explode, so that no row of a block carries the whole text
    x = lines.select(*keys, F.concat(*(runs(j) for j in range(1, RUN_LINES + 1))).alias("_blocks"))
    # explode_outer: for explode, Spark adds a filter on the array's size, pushes it below the projections and so
    # computes the lines' tokens again for each element
    return x.select(*keys, F.explode_outer("_blocks").alias("_b")).select(*keys, "_b.*").where(F.size("own") >= least)


def matches(docs: DataFrame, keys: list[str], text: str = "text", templates=TEMPLATES,
            threshold: float = THRESHOLD) -> DataFrame:
    """Every (row of ``keys``, block number, template) whose containment meets the
    threshold: columns keys, block, template, label, containment."""
    spark = docs.sparkSession
    sets = token_sets(templates, threshold)
    vocabulary = sorted(set().union(*(s for _, _, s, _ in sets))) if sets else []
    lines = line_tokens(docs, keys, text, vocabulary)

    # global order, rarest first: how many lines hold each token of the vocabulary (one small row per token)
    held = F.flatten(F.transform("_l", lambda e: e["own"]))
    counted = {r[0]: r[1] for r in lines.select(F.explode_outer(held).alias("w")).where("w IS NOT NULL").groupBy("w").count().collect()}
    order = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    index, whole = [], []
    for i, label, s, o in sets:
        own = sorted(s, key=rank.__getitem__)
        whole.append((i, label, own, len(own), o))
        index += [(w, i, at, len(own), o) for at, w in enumerate(own[:len(own) - o + 1])]
    index_df = spark.createDataFrame(index, "token string, template int, tpos int, tsize int, need int")
    whole_df = spark.createDataFrame(whole, "template int, label string, ttokens array<string>, tsize int, need int")

    # array_intersect keeps the order of its first argument: the block's tokens come out in the global order
    ordered = F.array_intersect(F.array(*map(F.lit, order)) if order else F.array().cast("array<string>"), "own")
    least = min((o for *_, o in sets), default=1)
    cut = blocks_of(lines, keys, least).select(*keys, "block", ordered.alias("own"))
    probes = cut.select(*keys, "block", "own", F.posexplode("own").alias("pos", "token"))
    room = F.least(F.size("own") - F.col("pos"), F.col("tsize") - F.col("tpos"))
    found = (
        probes.join(F.broadcast(index_df), "token")  # template tokens only: at most MAX_TEMPLATES notices
        .where((F.size("own") >= F.col("need")) & (room >= F.col("need")))
        .groupBy(*keys, "block", "template").agg(F.first("own").alias("own"))
    )
    shared = F.size(F.array_intersect("own", "ttokens"))
    return (
        found.join(F.broadcast(whole_df), "template").where(shared >= F.col("need"))
        .select(*keys, "block", "template", "label", (shared / F.col("tsize")).alias("containment"))
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES,
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (the best containment; 1 where a phrase stands)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    keyed = own.withColumn("_h", F.xxhash64("_text"))
    base = base_scan(keyed, "_text", phrases).drop("_text")
    best = (
        matches(keyed, ["doc_id", "_h"], "_text", templates, threshold)
        .groupBy("doc_id", "_h").agg(F.max("containment").alias("best"), F.collect_set("label").alias("more"))
        .withColumnsRenamed({"doc_id": "_id", "_h": "_k"})
    )
    joined = base.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k")), "left")
    every = F.array_sort(F.array_union("base_list", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_list", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    rows = ",\n  ".join(f"({i}, '{label}', {sorted(s)}, {o})" for i, label, s, o in token_sets(TEMPLATES, THRESHOLD))
    sep = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    places = "\n  UNION ALL ".join(
        f"SELECT rid, p - 1 AS p, '{label}' AS label FROM (SELECT rid, w, unnest(generate_series(1, len(w))) AS p FROM d) "
        f"WHERE w[p:p + {len(ph.split()) - 1}] = {ph.split()}" for ph, label in PHRASES)
    return f"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS rid,
  regexp_extract_all({low.format("coalesce(text, '')")}, '{sep}') AS w FROM documents),
places AS ({places}),
base AS (SELECT rid, count(*) AS n, min(p) AS f, max(p) AS l, list(DISTINCT label) AS labels FROM places GROUP BY rid),
t(i, label, s, need) AS (VALUES {rows}),
ls AS (SELECT rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM d),
runs AS (SELECT rid, ls[i:i + j - 1] AS r FROM (
    SELECT rid, ls, j, unnest(generate_series(1, len(ls) - j + 1)) AS i FROM ls, (SELECT unnest({list(range(2, RUN_LINES + 1))}) AS j) WHERE len(ls) >= j)
  WHERE list_sum(list_transform(ls[i:i + j - 1], lambda x: length(x))) <= {RUN_CHARS}),
lines AS (SELECT rid, list_distinct(regexp_extract_all(lower(line), '{sep}')) AS s
  FROM (SELECT rid, unnest(ls) AS line FROM ls UNION ALL SELECT rid, array_to_string(r, ' ') FROM runs)),
m AS (SELECT rid, t.label, len(list_intersect(lines.s, t.s)) / len(t.s) AS c, need, len(list_intersect(lines.s, t.s)) AS o
  FROM lines, t),
more AS (SELECT rid, max(c) AS best, list(DISTINCT label) AS labels FROM m WHERE o >= need GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word,
  CAST(l AS BIGINT) AS last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CAST(CASE WHEN n > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)
"""


SQL = _sql()
