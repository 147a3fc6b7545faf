"""Operators that judge each document by itself: licenses, quality, language, language
model, web pages, decontamination."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from opinia.llm import catalogue, decontaminate, html_samples, html_text, language, licenses, quality, suffix_tree
from opinia.llm import common as C
from tools.oracle_check import rows_of

from .conftest import LONG, SF, lower, words


def test_oracles(spark, duck):
    for name, sql in catalogue.ORACLES.items():
        df = catalogue.QUERIES[name](spark, SF)
        res = duck.execute(sql)
        assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in res.description], res.fetchall()), name


def test_word_hashes():
    texts = ["Ab c1-é", "", "x", "AB  C1 É é"]
    h, off = C.word_hashes(pa.array(texts), C.ALNUM)
    assert off.tolist() == [0, 3, 3, 4, 8]
    assert h[0] == h[4] and h[1] == h[5] and h[2] == h[7] and h[6] != h[7]
    assert len(set(h.tolist())) == 5


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the\nfollowing conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License",
    "mpl-2": "This Source Code Form is subject to the terms of the\nMozilla Public License, v. 2.0.",
}


def test_notices_wrapped_over_lines(spark):
    """Hard-wrapped notices among other lines; a run of too many characters or lines is no block."""
    rows = [(name, f"# A file\n{text}\n\nint main") for name, text in WRAPPED.items()]
    rows += [(f"{name} bare", text) for name, text in WRAPPED.items()]
    rows += [("far", WRAPPED["mit"].replace("\n", "\n" + "x" * 500 + "\n")), ("spread", WRAPPED["mit"].replace(" ", "\n")), ("none", "a\nb\n\n\nc")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name in WRAPPED:
        assert name in got[name][0].split(",") and got[name][1] >= 0.8 and got[f"{name} bare"] == got[name]
    assert got["far"] == got["spread"] == got["none"] == ("", 0.0)


def test_licenses_edges(spark, edges, empty):
    out = licenses.scan(edges).collect()
    assert len(out) == edges.count()
    assert {(r.n_words, r.labels, r.score) for r in out if r.doc_id in (2, 3, 4, 6, 8)} == {(0, "", 0.0)}
    assert licenses.scan(empty).count() == 0
    docs = spark.createDataFrame([
        (1, "Use it under the MIT\n license. under THE mit-license\nLicensed under the Apache License, Version 2.0."),
        (2, "this work is licensed under the gnu general public license"), (3, "emit license"), (4, "cc-by-nc"), (5, "ccc by nc cc by nc")],
        "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 2, 13, "apache-2,mit")
    assert got[2].n_base == 0 and got[2].labels == "gpl-3,lgpl" and 0.8 <= got[2].score < 1  # found by the method alone
    assert got[3].labels == "" and got[4].base_labels == "cc-by-nc" and (got[5].n_base, got[5].first_word) == (1, 3)


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    times, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts_and_divergence(spark, edges, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fitted = quality.references(docs.where("doc_id % 2 = 0"))
    hand = spark.createDataFrame([(-1, "a b c d e a b c d e x y a b c d e", "en"), (-2, "x\ny\nx\n\n\nx", "en")], "doc_id long, text string, lang string")
    every = docs.select("doc_id", "text", "lang").union(hand).union(edges.select("doc_id", "text", "lang"))
    rows = quality.judge(every, fitted).collect()
    assert len(rows) == every.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(r.text)
        assert not (r.base_failed and r.kept)
    vocabulary, refs = fitted
    for r in [r for r in rows if r.text and r.nearest][:40]:  # the nearest language's divergence, by numpy
        _, chars, common = next(x for x in refs if x[0] == r.nearest)
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        times = Counter(w)
        v = np.array([times[x] for x in vocabulary] + [len(w) - sum(times[x] for x in vocabulary)], float)
        p, q = v / max(1, v.sum()), np.array(common)
        m = (p + q) / 2
        half = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        assert abs((half(p) + half(q)) / 2 - r.word_divergence) < 1e-9
    assert quality.judge(empty, fitted).count() == 0
    assert quality.references(empty) == ([], [])
    assert all(r.kept != r.base_failed for r in quality.judge(edges, ([], [])).collect())


def test_quality_references_count_every_good_text(spark):
    n = 3200
    docs = spark.createDataFrame([(i, "common" + (" rare" if i % 4 == 0 else ""), "en") for i in range(n)] + [(n, None, "en"), (n + 1, "lost", None)],
                                 "doc_id long, text string, lang string")
    vocabulary, [(lang, chars, words)] = quality.references(docs)
    assert (vocabulary, lang) == (["common", "rare"], "en")
    assert words == [0.8, 0.2, 0.0]  # of 3,200 and 800 words
    letters, spaces = 6 * n + 4 * n // 4, n // 4
    assert chars[:2] == [letters / (letters + spaces), spaces / (letters + spaces)]


def test_quality_references_find_common_words_of_good_texts(spark):
    """By candidates, and by a join where the words of all texts hide those of good ones."""
    rows = [(i, " ".join(f"w{j:02d}" for j in range(i % 40 + 1)) + (" hidden" if i % 3 == 0 else " loud noisy"), "en" if i % 2 else "de") for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, "solo", "fr"), (None, "w00", "en"), (3, "w00 again", "en")], "doc_id long, text string, lang string")
    ids = spark.createDataFrame([(i,) for i in range(0, 400, 3)] * 2 + [(None,)], "doc_id long")
    want = quality.references(docs.join(ids, "doc_id", "left_semi"), common=4)
    assert "hidden" in want[0] and [r[0] for r in want[1]] == ["de", "en"]
    for candidates in (4, 8, 64):
        assert quality.references(docs, ids, common=4, candidates=candidates) == want


def test_quality_keeps_good_texts(spark):
    rows = quality.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.4


def greedy_phrases(text, train):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in train and text[at:at + size] in train:
            size += 1
        n, at = n + 1, at + size
    return n


def test_cross_parsing_is_greedy_longest_match():
    rng = random.Random(3)
    train = "".join(rng.choice("abc") for _ in range(300))
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 90))) for _ in range(50)]
    table = language.code_table(list("abcd"))
    codes, _, _ = language.symbols_of([train], table)
    sam = language.suffix_automaton(codes, language.FIRST + 4)
    codes, off, _ = language.symbols_of(texts, table)
    got = language.phrase_counts(codes, off, [sam])[:, 0]
    assert got.tolist() == [greedy_phrases(t, train) for t in texts]


def test_language(spark, edges, empty):
    rows = language.query(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    model = language.fit(edges)
    out = language.predict(edges, model).collect()
    assert len(out) == edges.count()
    assert {r.lang_pred for r in out if r.doc_id in (2, 3, 4, 6, 8)} == {"und"}
    assert next(r for r in out if r.doc_id == 5).n_symbols == len(re.sub(r"[^a-z]+", " ", LONG))
    nothing = language.fit(empty)
    assert {(r.lang_pred, r.score) for r in language.predict(edges, nothing).collect()} == {("und", 0.0)}
    assert language.predict(empty, model).count() == 0


def test_language_learns_long_texts_and_large_alphabets(spark, monkeypatch):
    rng = random.Random(9)
    script = {name: [chr(c) for c in range(lo, lo + 2500)] for name, lo in (("one", 0x4E00), ("two", 0x5A00), ("ko", 0xAC00))}
    pairs = {name: [a + rng.choice(chars) for a in chars] for name, chars in script.items()}
    make = lambda name, n: "".join(rng.choice(pairs[name]) for _ in range(n))
    english = "the quick brown fox jumps over a lazy dog and goes on to the next field "
    train = [(i, make(name, 3000), name) for i, name in enumerate(["one", "two", "ko"] * 5)]
    train += [(100 + i, english, "en") for i in range(5)] + [(200, "ein langes buch mit vielen wörtern das nie endet " * 2000, "de")]
    held = [(1, make("one", 60), "one"), (2, make("two", 60), "two"), (3, make("ko", 60), "ko"), (4, english[4:50], "en"),
            (5, "viele wörter in einem buch das endet", "de")]
    for cells in (1 << 25, 1):  # sparse for the large alphabets, for all
        monkeypatch.setattr(language, "DENSE_CELLS", cells)
        model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
        assert model["langs"] == ["de", "en", "ko", "one", "two"]
        got = language.predict(spark.createDataFrame(held, "doc_id long, text string, lang string"), model).collect()
        assert all(r.lang_pred == r.lang for r in got), got


def test_suffix_tree_base_is_exact(spark, edges, empty, monkeypatch):
    monkeypatch.setattr(suffix_tree, "FREQUENT", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(edges.where("doc_id IS NOT NULL").select("doc_id", "text"))
    model = suffix_tree.fit(docs.where("doc_id % 10 != 0"), frequent=300)
    rows = suffix_tree.score(docs, model).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    tokens = {x: re.findall(r"[^\x20\x09-\x0D]+", lower(x[1])) + [None] for x in texts}
    count = Counter(w for x in texts if x[0] % 10 != 0 for w in tokens[x])
    total, distinct = sum(count.values()), len(count)
    want = Counter()
    for x in texts:
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens[x])
        want[x[0], len(tokens[x]), sum(count[w] > 0 for w in tokens[x]), total, round(base, 4)] += 1
    assert want == Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)
    assert np.allclose((10.0 ** model["logp"].astype(float)).sum(axis=1), 1, atol=1e-4)
    assert suffix_tree.score(empty, model).count() == 0
    blank = suffix_tree.score(edges.where("doc_id = 2"), suffix_tree.fit(empty)).collect()
    assert (blank[0].n_tokens, blank[0].n_known, blank[0].train_tokens) == (1, 0, 0)


def test_suffix_tree_learns_contexts(spark):
    rng = random.Random(1)
    follow = {"a": "b", "b": "c", "c": "a"}
    texts = []
    for i in range(300):
        w, out = rng.choice("abc"), []
        for _ in range(30):
            out.append(w)
            w = follow[w] if rng.random() < 0.9 else rng.choice("abc")
        texts.append((i, " ".join(out)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = suffix_tree.score(docs, suffix_tree.fit(docs)).collect()
    assert all(r.score > r.base_score for r in rows)


def brute_tree(train, depth):
    """(log10 p of a word behind a history) by the model's definition."""
    read = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None]
    count = Counter(w for t in train for w in read(t))
    mass = sum(count.values()) + 0.1 * (len(count) + 1)
    cells = [{} for _ in range(depth + 1)]
    for t in train:
        w = [None, *read(t)]
        for i in range(1, len(w)):
            for k in range(1, min(depth, i) + 1):
                cells[k].setdefault(tuple(w[i - k:i]), Counter())[w[i]] += 1
    kept = {}

    def p(history, w):
        for k in range(min(depth, len(history)), 0, -1):
            ctx = tuple(history[-k:])
            if ctx in kept:
                c = kept[ctx]
                return (c[w] + suffix_tree.ALPHA * p(history[-k + 1:] if k > 1 else (), w)) / (c.total() + suffix_tree.ALPHA)
        return (count[w] + 0.1) / mass

    for k in range(1, depth + 1):
        for ctx, c in cells[k].items():
            n, free = c.total(), max(len(c) - 1, 1)
            if n >= suffix_tree.MIN_COUNT:
                kl = sum(x / n * math.log(x / n / p(ctx[1:], w)) for w, x in c.items())
                if 2 * n * kl >= free + 3 * math.sqrt(2 * free):
                    kept[ctx] = c
    return kept, lambda t: sum(math.log10(p([None, *read(t)][max(0, i - depth):i], w)) for i, w in enumerate([None, *read(t)]) if i)


def test_suffix_tree_keeps_every_context(spark):
    """Over 500 words, over 2,000 contexts of two words, and longer ones."""
    rng = random.Random(7)
    names = [f"v{i}" for i in range(900)]
    texts = []
    for i in range(3600):
        lead = names[i % 900]
        texts.append(" ".join(f"{lead} {lead}x{j} {lead}y{(i // 900 + j) % 2} {rng.choice('abc')}" for j in (0, 1, 0, 1, 0, 1)))
    texts = texts * 18 + ["", "v1 v2 unseen", names[0]]
    kept, want = brute_tree(texts, 3)
    assert len({w for c in kept for w in c}) > 2000 and sum(len(c) == 2 for c in kept) > 2000 and any(len(c) == 3 for c in kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    probe = [i for i in range(0, len(texts), 997)] + list(range(len(texts) - 3, len(texts)))
    some = docs.where(F.col("doc_id").isin(probe))
    for entries in (2_000_000, 100):  # all broadcast, most joined
        got = {r.doc_id: r.score for r in suffix_tree.score(some, suffix_tree.fit(docs, depth=3, frequent=300, entries=entries)).collect()}
        assert all(abs(got[i] - want(texts[i])) < 1e-6 for i in probe)

def _share_right(tree, pages):
    blocks = [b for p in pages for b in html_text.blocks_of(p)]
    return sum(html_text.decide(tree, f) == ("§" in t) for t, f in blocks) / len(blocks)


def test_html_tree_on_held_out_pages(spark):
    """Flat pages, where only words and links tell, and marked ones, none of them in the training table."""
    tree = html_text.train(spark)

    def used(t):
        return {html_text.FEATURES[t[0]]} | used(t[2]) | used(t[3]) if isinstance(t, tuple) else set()

    assert used(tree) & {"words_before", "words_behind", "words_before_2", "words_behind_2"}
    assert "links" in used(tree) and used(tree) & {"links_before", "links_behind", "links_before_2", "links_behind_2"}
    assert _share_right(tree, [html_samples.flat_page(k) for k in range(200, 400)]) > 0.98
    assert _share_right(tree, [html_samples.marked_page(k) for k in range(500, 700)]) > 0.98
    assert sum(html_text.decide(tree, f) == bool(y) for f, y in html_text.labelled_table()) > 0.99 * len(html_text.labelled_table())


def test_html_pages_that_names_alone_would_break(spark):
    tree = html_text.train(spark)
    text = lambda page: "\n".join(t for t, f in html_text.blocks_of(page) if html_text.decide(tree, f))
    long = html_samples.LONG
    links = "".join("<li><a href=/x>More stories about the coast</a></li>" for _ in range(5))
    assert text(f"<ul><li><a href=/a>Home</a></li><li><a href=/b>Shop</a></li></ul><h1>Late news</h1>"
                f"<p>The ferry left at noon with forty people on board.</p><p>{long}</p><div>Terms</div>") == (
        f"Late news\nThe ferry left at noon with forty people on board.\n{long}")
    assert text(f"<p>{long}</p><p>{long}</p><ul>{links}</ul>") == f"{long}\n{long}"
    assert text(f"<p>{long}</p><div><a href=/x>All the news about the coast</a> <a href=/y>and about all of its many islands, bays and ports</a></div>") == long
    assert text(f"<article><div class='social-policy'><p>{long}</p><p>Short.</p></div></article>") == f"{long}\nShort."
    assert text(f"<main><section id='search-and-rescue'><h2>Rescue</h2><p>{long}</p></section></main>") == f"Rescue\n{long}"
    assert text(f"<article><p>{long}</p><p aria-hidden='true'>Seen by readers.</p><div class='comment-list'><p>{long}</p></div></article>") == (
        f"{long}\nSeen by readers.")
    assert text(f"<article><p>{long}</p><p hidden>Not seen.</p><div class='site-footer ad-box'><p>{long}</p></div></article>") == long


def test_html_extraction(spark):
    tree = html_text.train(spark)
    text = lambda page: "\n".join(t for t, f in html_text.blocks_of(page) if html_text.decide(tree, f))
    assert text(None) == "" and text("") == "" and text("<p") == ""
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a href=x>Menu</a></nav>
      <!-- <p>no</p> --><article><h1>Caf&eacute; &amp; bar</h1><p>One &lt;b&gt;
      two.<br>Three<p>Ok.</p><aside><p>Side note of many words that goes on and on and on for long.</p></aside>
      <div class="comments"><p>A reader says a lot of things here, on and on and on and on.</p></div><p>Last&nbsp; one"""
    assert text(page) == "Café & bar\nOne <b> two. Three\nOk.\nLast one"
    docs = {"\n".join(x for x in (" ".join(y.split()) for y in (r.text or "").split("\n")) if x)
            for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()}
    rows = html_text.query(spark, SF).collect()
    assert all(r.text.partition("\n")[2] in docs and r.n_chars == len(r.text) for r in rows)
    odd = spark.createDataFrame([(1, None, "x", 5), (1, None, "x", 5), (None, "<p>" + LONG, "y", 6), (2, "<div " * 500, "z", 7)],
                                "page_id long, html string, text string, n_chars int")
    got = html_text.extract(odd, tree).collect()
    assert [r.text for r in got if r.page_id == 1] == ["", ""] and next(r for r in got if r.page_id is None).n_chars == len(LONG)
    assert html_text.extract(odd.where("false"), tree).count() == 0


def test_html_silent_elements_end_where_they_end():
    text = lambda page: [t for t, _ in html_text.blocks_of(page)]
    assert text('<p>One</p><svg class="icon"/><p>Two</p><math/><p>Three</p><svg title="a>b" /><p>Four') == ["One", "Two", "Three", "Four"]
    for name in ("svg-icon", "select-box", "template-x", "title-bar"):
        assert text(f"<p>One</p><{name}>Own</{name}><p>Two</p>") == ["One", "Own", "Two"]
    assert text("<p>One</p><svg><path d=''/><text>no</text></svg><script src='x'/>no</script><p>Two<style\n>no</style>") == ["One", "Two"]


def test_decontamination_edges_and_blocks(spark, edges, empty):
    rng = random.Random(5)
    item = lambda n: " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(n))
    items = [("q1", item(30)), ("q2", item(20)), ("q3", "Two Words!"), ("q4", None), ("q5", ""), ("q1", item(15)), (None, item(14))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [f"{item(9)} {items[0][1].upper()} - {item(5)}", items[1][1][:60], "x two-words, y", f"z {items[1][1]}.{items[0][1]}", None, "", items[5][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()
    many = decontaminate.decontaminate(docs, bench, block_words=20).orderBy("doc_id").collect()
    assert one == many
    for r in one:
        w, hit, ids = words(r.text), set(), set()
        for name, t in items:
            if name is None or not words(t):
                continue
            size = min(13, len(words(t)))
            wins = {tuple(words(t)[i:i + size]) for i in range(len(words(t)) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in wins:
                    hit.update(range(i, i + size))
                    ids.add(name)
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(ids))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
        for s, e, i, j in zip(r.char_starts, r.char_ends, r.hit_starts, r.hit_ends, strict=True):
            assert words(r.text[s:e]) == w[i:j]
    out = decontaminate.decontaminate(edges, bench).collect()
    assert len(out) == edges.count() and {r.n_words for r in out if r.doc_id in (2, 3, 4, 6, 8)} == {0}
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(docs, bench.where("false")).collect()} == {0}
