"""Operators 11 to 13 against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from opinia.llm import collocations, common, piecewise, runs

from .conftest import SF, lower

SPACE = b" \t\n\r\x0b\x0c"


# --- 13: periodic runs ---------------------------------------------------------------------------------------------


def brute_runs(w, exponent=4, least=6):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((i, n, q) for (i, n), q in found.items())


def plant(w, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_result(text, doc_id):
    w = plant((text or "").encode().split(), doc_id)
    found = brute_runs(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(said.encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest())


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 5)])
def test_catchers_find_the_runs_of_brute_force(exponent, least):
    rnd = random.Random(exponent)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            n, k = rnd.choice([0, 1, 3, 7, 20, 60, 150]), rnd.choice([1, 2, 3, 8])
            w = [rnd.randrange(k) for _ in range(n)]
            for _ in range(rnd.randint(0, 3) if n > 6 else 0):
                a, p = rnd.randrange(n), rnd.randint(1, max(1, n // 4))
                for i in range(a, a + rnd.randint(1, n - a)):
                    w[i] = w[a + (i - a) % p]
            texts.append(w)
        keys = common.mix64(np.array(sum(texts, []), np.uint64) + np.uint64(1))
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        got = [tuple(r) for r in runs.find(keys, bounds, exponent, least).tolist()]
        want = [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t, exponent, least)]
        assert got == sorted(want, key=lambda r: (r[0], r[1], r[3]))


def test_one_long_repeated_word_is_one_run():
    got = runs.find(np.ones(300_000, np.uint64), np.array([0, 300_000]))
    assert got.tolist() == [[0, 0, 300_000, 1]]


def test_runs_of_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in docs}
    got = runs.query(spark, SF).collect()
    assert len(got) == len(docs)
    planted = 0
    for r in got:
        if len((texts[r.doc_id] or "").split()) < 600:
            assert tuple(r)[1:] == brute_result(texts[r.doc_id], r.doc_id), r.doc_id
            planted += r.n_runs > 0
    assert planted > 3


def test_runs_on_edges(edges, empty):
    got = runs.detect(edges).collect()
    assert len(got) == edges.count() and {"lang", "score", "path"} <= set(got[0].asDict())
    for r in got:
        w = (r.text or "").encode().split()
        if len(w) < 1000:
            assert [tuple(x) for x in r.runs] == brute_runs(w)
    none = [r for r in got if not (r.text or "").split()]
    assert none and all(r.n_runs == 0 and r.start is None and r.collapsed == "" and
                        r.collapsed_sha256 == hashlib.sha256(b"").hexdigest() for r in none)
    assert runs.detect(empty).count() == 0


# --- 11: fingerprints ----------------------------------------------------------------------------------------------


def mix(x):
    m = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ x >> 31


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def plain_fingerprint(text):
    data = (text or "").encode()
    if not data:
        return "0:::"
    hashes, levels = [], []
    for i in range(len(data)):
        window = (bytes(7) + data)[i + 1:i + 8]
        h = mix(int.from_bytes(window, "little"))
        top = np.float32(h >> 32)
        levels.append(min(max(158 - (int(top.view(np.uint32)) >> 23), 0), 32))
        hashes.append(h)

    def chunks(k):
        ends = [i + 1 for i in range(len(data) - 1) if levels[i] >= k] + [len(data)]
        return list(zip([0, *ends], ends, strict=False))

    k = next(k for k in range(40) if len(chunks(k)) <= piecewise.CHUNKS)
    out = [str(k)]
    for at in range(k, k + 3):
        symbols = [mix((sum(hashes[a:b]) + b - a) % (1 << 64)) >> 52 for a, b in chunks(at)]
        out.append("".join(LETTERS[x >> 6] + LETTERS[x & 63] for x in symbols))
    return ":".join(out)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    return row[-1]


def plain_likeness(one, other):
    (k, *a), (m, *b) = one.split(":"), other.split(":")
    best = float(a == b)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if int(k) + i == int(m) + j and x and y:
                u, v = [x[t:t + 2] for t in range(0, len(x), 2)], [y[t:t + 2] for t in range(0, len(y), 2)]
                best = max(best, 1 - plain_distance(u, v) / (len(u) + len(v)))
    return best


def test_fingerprints_and_likeness_equal_brute_force():
    rnd = random.Random(11)
    words = ["alpha", "béta", "gamma", "dél", "日本語", "epsilon", "x", "of"]
    texts = ["", None, "a", "日", "aaaa" * 400, "short text", " ".join(rnd.choice(words) for _ in range(700))]
    texts += ["".join(chr(rnd.randint(97, 122)) for _ in range(rnd.randint(1, 900))) for _ in range(6)]
    signs = [piecewise.fingerprint(t) for t in texts]
    assert signs == [plain_fingerprint(t) for t in texts]
    assert all(len(s.split(":")[1]) <= 2 * piecewise.CHUNKS for s in signs)
    signs += [piecewise.fingerprint(texts[6][:2500] + texts[9]), piecewise.fingerprint(texts[6][300:])]
    for a in signs:
        for b in signs:
            assert piecewise.likeness(a, b) == pytest.approx(plain_likeness(a, b))
            assert piecewise.likeness(a, b) == piecewise.likeness(b, a)
        assert piecewise.likeness(a, a) == 1.0


def test_fingerprint_query_follows_the_ids(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    got = {r.doc_id: r for r in piecewise.query(spark, SF).collect()}
    assert sorted(got) == ids
    alike = []
    for i, d in enumerate(ids):
        t, nxt, r = docs[d], docs[ids[(i + 1) % len(ids)]], got[d]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (piecewise.fingerprint(t), piecewise.fingerprint(edited))
        assert r.near_edited == piecewise.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == piecewise.likeness(r.fingerprint, got[ids[(i + 1) % len(ids)]].fingerprint)
        alike.append((r.near_edited, r.near_next))
    assert np.median([a for a, _ in alike]) > 0.4 and np.median([b for _, b in alike]) < 0.1


def test_fingerprints_on_edges(edges, empty, spark):
    got = piecewise.compare(edges).collect()
    assert len(got) == edges.count() and {"lang", "path", "score"} <= set(got[0].asDict())
    first = [r for r in got if r.doc_id == 1]
    assert len(first) == 2 and max(r.near_next for r in first) == 1.0  # a repeated row is its own next one
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r.text or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    last = next(r for r in got if r.doc_id == 9)
    null_id = next(r for r in got if r.doc_id is None)  # first in order
    assert last.near_next == piecewise.likeness(last.fingerprint, null_id.fingerprint)
    assert piecewise.compare(empty).count() == 0
    alone = piecewise.compare(spark.createDataFrame([(4, "one document")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0
    table = piecewise.fingerprint_table(edges).select("text", "fingerprint").collect()
    assert all(r.fingerprint == piecewise.fingerprint(r.text) for r in table)


# --- 12: phrase collocations ---------------------------------------------------------------------------------------


def pieces_of(text):
    out, piece, word = [], [], ""
    for c in lower(text) + "\n":
        if c in " \t.,;:!?\n\x0b\x0c\r":
            if word:
                piece.append(word)
            word = ""
            if c not in " \t":
                out.append(piece)
                piece = []
        else:
            word += c
    return [p for p in out if p]


def brute_collocations(rows, least, top):
    counts, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for p in pieces_of(text):
            total[lang or "und"] += len(p)
            for m in range(1, 5):
                counts.update((lang or "und", tuple(p[i:i + m])) for i in range(len(p) - m + 1))
    some = {k: v for k, v in counts.items() if len(k[1]) > 1 and v >= least}
    longer = collections.defaultdict(int)
    for (lang, w), v in some.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i:i + m]] = max(longer[lang, w[i:i + m]], v)
    out = collections.defaultdict(list)
    for (lang, w), a in some.items():
        if 100 * longer[lang, w] >= 80 * a:
            continue
        cuts = [(counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min((2000000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items()
                  for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def test_index_counts_all_phrases_of_cut_shards():
    rnd = random.Random(12)
    for _ in range(60):
        pieces = [[rnd.randrange(rnd.choice([2, 5, 9])) for _ in range(rnd.choice([1, 2, 5, 30]))] for _ in range(rnd.randint(1, 12))]
        flat = sum(pieces, [])
        want = collections.Counter(tuple(p[i:i + m]) for p in pieces for m in range(1, 5) for i in range(len(p) - m + 1))
        at = np.arange(len(flat))
        w = collocations.Words(common.mix64(np.array(flat, np.uint64) + np.uint64(1)), np.repeat(np.arange(len(pieces)), [len(p) for p in pieces]), at, at, at, at)
        got = collections.Counter()
        for part, sign in collocations.shards(w, 4, rnd.choice([6, 10, 1000])):
            index = collocations.ShardIndex(part.key, part.piece, 4)
            for p in index.enumerate(4):
                for first, n in zip(part.start[index.example(p)].tolist(), p.size.tolist(), strict=True):
                    got[tuple(flat[first:first + p.words])] += sign * n
        assert {k: v for k, v in got.items() if v} == want


def test_both_intervals_stay_in_step():
    rnd = random.Random(2)
    flat = [rnd.randrange(3) for _ in range(200)]
    index = collocations.ShardIndex(common.mix64(np.array(flat, np.uint64)), np.arange(200) // 17, 4)
    for p in index.enumerate(4):
        for lo, size, rev in zip(p.lo.tolist(), p.size.tolist(), p.rev.tolist(), strict=True):
            n = len(index.word)
            ahead = {(int(index.forward.order[i])) for i in range(lo, lo + size)}
            back = {n - int(index.reverse.order[i]) - p.words for i in range(rev, rev + size)}
            assert ahead == back


def test_collocations_equal_brute_force(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for least, top in ((30, 2000), (5, 40)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, min_count=least, top=top).collect())
        assert got and got == brute_collocations(rows, least, top)


def test_collocations_on_edges(edges, empty, monkeypatch):
    rows = [(r.lang, r.text) for r in edges.collect()]
    want = brute_collocations(rows, 2, 100)
    assert want and sorted(tuple(r) for r in collocations.collocations(edges, min_count=2, top=100).collect()) == want
    assert collocations.collocations(empty).count() == 0


def test_pieces_longer_than_a_shard_are_counted_once():
    words = [f"w{i % 7}" for i in range(5000)]
    import pyarrow as pa

    w = collocations._words(pa.array([" ".join(words)]), np.array([5], np.uint64), np.array([0]))
    got = collections.Counter()
    for part, sign in collocations.shards(w, 4, 1000):
        index = collocations.ShardIndex(part.key, part.piece, 4)
        for p in index.enumerate(4):
            for t, n in zip(collocations._phrase_texts(part, index.example(p), p.words).to_pylist(), p.size.tolist(), strict=True):
                got[t] += n * sign
    want = collections.Counter(" ".join(words[i:i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    assert {k: v for k, v in got.items() if v} == want
