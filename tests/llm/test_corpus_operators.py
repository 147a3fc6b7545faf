"""Operators that compare documents: line dedup, mixing, toxicity, n-gram join, pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opinia.llm import chosen_path, line_dedup, mixing, toxicity

from .conftest import SF, words


def near_texts(seed, n, groups, size, line=True):
    """Texts of random words with groups of near copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    heads = [[rng.choice(vocabulary) for _ in range(size)] for _ in range(groups)]
    out = []
    for i in range(n):
        w = list(rng.choice(heads)) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((i, " ".join(w) if not line else "\n".join(" ".join(w[k:k + 20]) for k in range(0, len(w), 20))))
    return out


def brute_lines(rows, threshold=0.8):
    seen, removed = [], defaultdict(list)
    for key, line, s in sorted(((d, k, frozenset(words(x))) for d, t in rows for k, x in enumerate((t or "").split("\n"))), key=lambda r: r[:2]):
        if len(s) < line_dedup.MIN_TOKENS:
            continue
        if any(len(s & o) / len(s | o) >= threshold for o in seen):
            removed[key].append(line)
        seen.append(s)
    return removed


@pytest.mark.parametrize("small", [False, True])
def test_line_dedup_is_exact(spark, monkeypatch, small):
    if small:  # several rounds, tiles and windows
        monkeypatch.setattr(line_dedup, "FIRST_TRIES", 1)
        monkeypatch.setattr(line_dedup, "TILE", 3)
        monkeypatch.setattr(line_dedup, "WINDOW_LINES", 50)
        monkeypatch.setattr(line_dedup, "SLOTS", 1 << 6)
    rows = near_texts(1, 120, 8, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_lines(rows)
    got = {r.doc_id: r.removed_lines for r in line_dedup.summary(docs).collect()}
    assert got == {d: ",".join(map(str, want[d])) for d, _ in rows}
    assert sum(map(len, want.values())) > 100


def test_line_dedup_short_lines(spark):
    """Lines of one to four words, and of a script without spaces, by brute force over all lines."""
    rng = random.Random(8)
    pool = ["Menu", "All rights reserved.", "Read more", "one two three four", "one two three four five", "two three four", "我们在这里", "...", ""]
    rows = [(i, "\n".join(rng.choice([*pool, f"own {i}"]) for _ in range(6))) for i in range(60)]
    seen, want = [], defaultdict(list)
    for d, t in rows:
        for k, x in enumerate(t.split("\n")):
            s = frozenset(words(x))
            if s and any(len(s & o) / len(s | o) >= 0.8 for o in seen):
                want[d].append(k)
            if s:
                seen.append(s)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.removed_lines for r in line_dedup.summary(docs).collect()}
    assert got == {d: ",".join(map(str, want[d])) for d, _ in rows} and sum(map(len, want.values())) > 150


def test_line_dedup_edges(edges, empty):
    out = line_dedup.dedup(edges).collect()
    assert len(out) == edges.count()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert by[None][0].text == "A first line with seven words here.\nnull id"  # null ids come first
    assert [r.text for r in by[1]] == ["second short"] * 2  # equal rows get equal decisions
    assert by[2][0].text is None and by[3][0].text == "" and by[3][0].n_lines == 0
    assert by[7][0].removed == "r" and {r.n_removed for r in by[7]} == {0, 1}
    assert line_dedup.dedup(empty).count() == 0


def brute_groups(rows, threshold=0.8):
    sets = defaultdict(list)
    for d, t in rows:
        w = words(t)
        sets[frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None].append(d)
    keys = [s for s in sets if s]
    parent, links = list(range(len(keys))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for j in range(i):
            if len(a & keys[j]) / len(a | keys[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    group = defaultdict(list)
    for i, a in enumerate(keys):
        group[find(i)] += sets[a]
    return {d: (min(group[find(i)]), min(sets[a]), links[i], len(sets[a])) for i, a in enumerate(keys) for d in sets[a]}


@pytest.mark.parametrize("small", [False, True])
def test_chosen_path_join(spark, monkeypatch, small):
    if small:  # deep splitting and tiles
        monkeypatch.setattr(chosen_path, "LIMIT", 3)
        monkeypatch.setattr(chosen_path, "TILE", 4)
    rows = near_texts(2, 150, 12, 150, line=False) + [(1000, "one two"), (1001, "One, two"), (1002, None), (1003, ""), (1004, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    got = {r.doc_id: (r.class_id, r.set_id, r.n_links, r.n_copies) for r in chosen_path.join(docs).collect()}
    assert {d: got[d] for d in want} == want
    assert all(got[d] == (d, d, 0, 1) for d in (1002, 1003, 1004))


def test_chosen_path_recall_on_thousands_of_pairs(spark, monkeypatch):
    """Links of 400 documents' clusters of near copies, small buckets and tiled ones, against all pairs."""
    import random

    rnd = random.Random(10)
    rows = []
    for c in range(60):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([40, 90, 200]))]
        for _ in range(rnd.choice([2, 5, 20, 45])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(4000)}"
            rows.append((len(rows), " ".join(w)))
    sets = [frozenset(tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)) for _, t in rows]
    different = list(dict.fromkeys(sets))
    want = {s: sum(1 for o in different if o is not s and len(s & o) >= 0.8 * len(s | o)) for s in different}
    assert sum(want.values()) // 2 > 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit, tile in ((64, 1024), (8, 16)):
        monkeypatch.setattr(chosen_path, "LIMIT", limit)
        monkeypatch.setattr(chosen_path, "TILE", tile)
        got = {r.doc_id: r.n_links for r in chosen_path.join(docs).collect()}
        assert all(got[i] <= want[s] for i, s in enumerate(sets))
        assert sum(got[i] for i in range(len(rows))) >= 0.99 * sum(want[s] for s in sets)


def test_chosen_path_carries_only_what_a_level_compares(spark, monkeypatch):
    """A path of one set carries no sketch, and a deeper level takes no set along that has no member there."""
    classes = spark.createDataFrame([([11, 12, 13], 1, 1, 5, b"x"), ([12, 14], 2, 2, 5, b"y"), ([], 3, 3, 5, b"z")],
                                    "paths array<long>, a long, b long, n int, sketch binary")
    got = chosen_path.first_members(classes, spark.createDataFrame([(12, 2)], "path long, m long")).collect()
    assert sorted((r.path, r.a, r.b, r.n, bytes(r.sketch)) for r in got) == [(12, 1, 1, 5, b"x"), (12, 2, 2, 5, b"y")]

    levels, real = [], chosen_path.with_sets

    def with_sets(members, sets):
        levels.append((members.select("a").distinct().count(), sets.count()))
        return real(members, sets)

    monkeypatch.setattr(chosen_path, "with_sets", with_sets)
    monkeypatch.setattr(chosen_path, "LIMIT", 3)
    texts = [" ".join([f"c{g}w{i}" for i in range(40)] + [f"d{g}n{k}w{i}" for i in range(40)]) for g in range(6) for k in range(3 + 3 * g)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert chosen_path.join(docs).count() == docs.count()
    assert len(levels) > 1 and all(members == sets for members, sets in levels), levels


def test_chosen_path_edges(edges, empty):
    out = chosen_path.join(edges).collect()
    assert len(out) == edges.count() and {r.path for r in out} == {"p", None}
    assert sum(r.keep for r in out if r.doc_id == 1) == 2  # equal rows are one document
    assert chosen_path.join(empty).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(200, 200 + i) for i in range(1, 20)]
    node = lambda c: F.struct(F.col(c).alias("a"), F.lit(0).cast("long").alias("b"))
    df = spark.createDataFrame(pairs, "x long, y long").select(node("x").alias("u"), node("y").alias("v"))
    got = {r.u.a: r.root.a for r in chosen_path.components(df).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in pairs:
        x, y = sorted((find(x), find(y)))
        parent[y] = x
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_mixing_meets_targets(spark, edges, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fitted = mixing.fit(docs, "lang")
    targets = {"en": 1.0, "de": 2.0, "fr": 1.0, "es": 1.0}
    rows = mixing.rates(docs, fitted, targets).collect()
    p, n, rate = np.array([r.p for r in rows]), np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    assert len(rows) == docs.count() and (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    want = np.array([targets[d] for d in fitted[0]]) / 5
    assert np.abs((rate * n) @ p / n.sum() - want).max() < 1e-6
    assert np.mean([r.domain == r.lang for r in rows]) > 0.95
    # the same descent by numpy
    gram = (p * n[:, None]).T @ p
    d = np.diag(gram)
    step = 1 / np.linalg.eigvalsh(gram / np.sqrt(np.outer(d, d)))[-1]
    r = np.ones(len(n))
    for _ in range(300):
        rest = (r * n) @ p - want * n.sum()
        if np.abs(rest / n.sum()).max() < mixing.TOLERANCE:
            break
        r = np.maximum(0, r - p @ (step * rest / d))
    assert np.allclose(r, rate, atol=1e-6)
    out = mixing.rates(edges, mixing.fit(edges, "lang")).collect()
    assert len(out) == edges.count() and {x.n_tokens for x in out if x.doc_id in (2, 3, 4, 6, 8)} == {0}
    assert {x.rate for x in mixing.rates(edges, mixing.fit(empty, "lang")).collect()} == {1.0}
    assert mixing.rates(empty, fitted).count() == 0
    assert mixing.mix(edges, mixing.fit(edges, "lang")).count() == sum(x.rate > 0 for x in out)
    half = spark.range(2000).select(mixing.copies(F.lit(1.5), "id").alias("c")).agg(F.avg("c")).first()[0]
    assert abs(half - 1.5) < 0.05


def test_mixing_reports_missed_targets(spark):
    import warnings

    same = spark.createDataFrame([(i, "the same few words", "ab"[i % 2]) for i in range(20)], "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="miss their targets"):
        mixing.rates(same, mixing.fit(same, "lang"), {"a": 3.0, "b": 1.0})
    apart = spark.createDataFrame([(i, ["one two three", "vier funf sechs"][i % 2] * 9, "ab"[i % 2]) for i in range(20)], "doc_id long, text string, lang string")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        mixing.rates(apart, mixing.fit(apart, "lang"), {"a": 3.0, "b": 1.0})


def test_toxicity_index_is_exact():
    rng = random.Random(6)
    vectors = []
    for _ in range(400):
        v = {t: rng.random() + 0.1 for t in rng.sample(range(30), rng.randint(1, 5))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()})
    vectors += vectors[:50]  # ties
    pair = lambda v: (np.array(list(v), np.int64), np.array(list(v.values())))
    index = toxicity.Index([pair(v) for v in vectors], 30, block=8)
    for q in vectors[:60]:
        cos = [round(sum(x * v.get(t, 0) for t, x in q.items()), 9) for v in vectors]
        want = sorted((i for i, c in enumerate(cos) if c > 0), key=lambda i: (-cos[i], i))[:15]
        got = index.top(*pair(q), 15)
        assert [i for i, _ in got] == want and np.allclose([c for _, c in got], [min(1, cos[i]) for i in want])
    assert index.top(*pair({}), 5) == []
    assert toxicity.isotonic([0, 1, 2, 3], [0.1, 0.5, 0.3, 0.9], [1, 1, 1, 1]) == [0.1, 0.4, 0.4, 0.9]


def brute_toxicity(docs, labels, k=toxicity.K):
    """Scores and neighbours in plain Python: all features, all cosines, leave-one-out votes, calibration."""
    def features(t):
        c = Counter()
        for w, n in Counter(words(t)).items():
            c[w] += n
            if len(w) > toxicity.PREFIX:
                c[w[:toxicity.PREFIX] + "*"] += n
        return c

    bags = {d: features(t) for d, t in docs.items()}
    df = Counter(f for b in bags.values() for f in b)
    ex = sorted((d for d in labels), key=str)
    n_pos = sum(labels.values())
    n_neg, every = len(ex) - n_pos, len(ex)
    weight = {}
    for f in {f for d in ex for f in bags[d]}:
        pos, neg = (sum(labels[d] == y and f in bags[d] for d in ex) for y in (1, 0))
        z = 0.0
        if pos * n_neg > neg * n_pos:
            cells = ((pos, (pos + neg) * n_pos / every), (neg, (pos + neg) * n_neg / every), (n_pos - pos, (every - pos - neg) * n_pos / every),
                     (n_neg - neg, (every - pos - neg) * n_neg / every))
            z = math.sqrt(max(0.0, 2 * sum(a * math.log(a / b) for a, b in cells if a)))
        weight[f] = math.log((len(docs) + 1) / (df[f] + 1)) * (1 + toxicity.STRENGTH * max(z - toxicity.LEAST_Z, 0) ** 2)

    def unit(b):
        v = {f: (1 + math.log(n)) * weight[f] for f, n in b.items() if f in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / norm for f, x in v.items()} if norm else {}

    held = {d: unit(bags[d]) for d in ex}

    def near(v, skip=None):
        cos = [(round(sum(x * held[e].get(f, 0) for f, x in v.items()), 9), i) for i, e in enumerate(ex) if e != skip]
        return sorted(((c, i) for c, i in cos if c > 0), key=lambda r: (-r[0], r[1]))[:k]

    def vote(found):
        yes, total = toxicity.PRIOR_MASS * n_pos / every, toxicity.PRIOR_MASS
        for c, i in found:
            c = min(c, 1.0)
            w = c * c / (1 - c + 0.05)
            yes, total = yes + w * labels[ex[i]], total + w
        return yes / total

    bins = {}
    for d in ex:
        if bags[d]:
            b = bins.setdefault(min(toxicity.BINS - 1, int(vote(near(held[d], d)) * toxicity.BINS)), [0, 0])
            b[0], b[1] = b[0] + labels[d], b[1] + 1
    at = [(b + 0.5) / toxicity.BINS for b in sorted(bins)]
    to = toxicity.isotonic(at, [(bins[b][0] + 0.5 * a) / (bins[b][1] + 0.5) for b, a in zip(sorted(bins), at, strict=True)], [bins[b][1] for b in sorted(bins)])
    out = {}
    for d, b in bags.items():
        found = near(unit(b))
        out[d] = (float(np.interp(vote(found), at, to)) if found else None, [str(ex[i]) for _, i in found])
    return out


def test_toxicity_equals_brute_force_from_end_to_end(spark):
    rng = random.Random(77)
    common = [f"word{i}" for i in range(120)]
    insults = ["idiot", "moronic", "moron", "scumbag"]
    docs, labels = {}, {}
    for d in range(260):
        w = [rng.choice(common) for _ in range(rng.randint(0, 40))]
        toxic = d % 4 == 0
        w += [rng.choice(insults) for _ in range(2)] if toxic and w else []
        rng.shuffle(w)
        docs[d] = " ".join(w) if d % 50 else None
        if d < 150:
            labels[d] = int(toxic)
    docs[500], docs[501] = "words nobody labelled", "idiot"
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    want = brute_toxicity(docs, labels)
    blank = [d for d in labels if not words(docs[d])]
    for r in toxicity.fit_and_score(table, marks).collect():
        score, found = want[r.doc_id]
        assert r.neighbours == found and r.predicted == (r.score >= 0.7)
        assert r.score == pytest.approx(score if found else np.mean([labels[d] for d in blank]), abs=1e-6), r.doc_id
        assert bool(found) == bool(set(words(docs[r.doc_id])) & {x for d in labels for x in words(docs[d])})


def test_toxicity(spark, edges, empty):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    insults = {"idiot", "scum", "stupid", "clown", "loser", "moron", "trash", "disgusting", "worthless", "pathetic"}
    bad = [r for r in rows if r.held_out and sum(w in insults for w in words(r.text)) >= 3]
    assert bad and np.mean([r.predicted for r in bad]) > 0.8 and all(r.neighbours for r in bad if r.predicted)
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (None, 1), (5, None), (99, 1)], "doc_id long, toxic int")
    out = toxicity.fit_and_score(edges, labels).collect()
    assert len(out) == edges.count() and {r.ids for r in out} == {"i", None}
    assert {r.score for r in toxicity.fit_and_score(edges, labels.where("false")).collect()} == {0.0}
    assert toxicity.fit_and_score(empty, labels).count() == 0


def test_pipeline(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.cut(stage(spark, docs, SF), "test-stage")
        seen.append((name, before.collect(), docs.collect()))
        assert docs.columns[:len(columns)] == columns
    (_, start, clean), (_, _, lines), (_, pre, single), (_, _, pure), (_, last, mixed) = seen
    ids = lambda rows: {r.doc_id for r in rows}
    assert ids(clean) <= ids(start)
    removed = brute_lines([(r.doc_id, r.text) for r in clean])
    texts = {r.doc_id: r.text for r in clean}
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in removed[d]) for d, t in texts.items()}
    assert {r.doc_id: r.text for r in lines} == {d: t for d, t in want.items() if not removed[d] or t.split()}
    groups = brute_groups([(r.doc_id, r.text) for r in pre])
    assert ids(single) == {r.doc_id for r in pre if groups.get(r.doc_id, (r.doc_id,))[0] == r.doc_id}
    assert ids(pure) <= ids(single) and ids(mixed) == ids(last) and all(r.rate > 0 for r in mixed)
    assert corpus_pipeline.run(spark, SF).count() == len(mixed)


def test_pipeline_stages_on_edges(spark, edges, empty):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns and empty tables."""
    columns = edges.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edges, SF).collect()
        assert out and set(columns) <= set(out[0].asDict()) | {"score"}, name
        kept = {(r.doc_id, r.text) for r in out}
        if name != "line dedup":
            assert kept <= {(r.doc_id, r.text) for r in edges.collect()}, name
        assert (9, "no extras at all") in kept, name
        none = stage(spark, empty, SF)
        assert none.count() == 0 and none.columns[:5] == columns[:5], name
