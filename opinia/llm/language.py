"""Language identification by cross-parsing entropy (operator 5).

For each language a suffix automaton of labelled text is built.  A text is
cut, left to right, into the longest phrases that occur in that language's
text; the language that needs the fewest phrases, normalised by
log2(training symbols) / text symbols (bits per symbol), wins.

Symbols are lower-cased letters and one space for any run of other
characters.  Each language has its own alphabet, all letters of its training
text; other letters match nothing in it.  The automata are transition tables, dense
ones or, for large alphabets, sorted lists of the transitions, and all texts of a
batch are parsed at once, one symbol per step: texts are parsed in blocks of
``BLOCK`` symbols, side by side; a phrase ends at the end of its block.  Whole
texts are parsed, whatever their length.

Training: a bounded sample, ``symbols`` symbols per language from about
``sample`` labelled texts; a text longer than that many characters gives ``PIECES``
evenly spaced pieces that are as long in sum.

Defined results: null texts and texts without a letter, and every text when
nothing was learned, get ``und`` with score 0; ties go to the first language
in alphabetical order; letters never seen in training match nothing; repeated
rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinia.llm import common as C

SYMBOLS = 40_000  # training symbols per language
SAMPLE = 120  # labelled texts per language that they are taken from
BLOCK = 1024
SLICE = 4 << 20  # bytes of text parsed side by side
PIECES = 10  # of a long text for training
DENSE_CELLS = 1 << 25  # larger transition tables are kept sparse
UNKNOWN, SPACE, BREAK, FIRST = 1, 2, 3, 4  # symbol codes; 0 is any character that is no letter

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """True for the code points that are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def code_table(alphabet: list[str]) -> np.ndarray:
    table = letters().astype(np.int32) * UNKNOWN
    for i, ch in enumerate(alphabet):
        table[ord(ch)] = FIRST + i
    return table


def symbols_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts, offsets of the texts, whether each has a letter)."""
    data = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(d) // 4 for d in data])]).astype(np.int64)
    codes = table[np.frombuffer(b"".join(data), np.uint32)]
    gap = codes == 0
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    inner = bounds[:-1][bounds[:-1] < len(codes)]
    keep[inner] = ~gap[inner]  # no space in front of a text
    codes = np.where(gap, SPACE, codes).astype(np.int32)[keep]
    kept = np.concatenate([[0], np.cumsum(keep)])
    seen = np.concatenate([[0], np.cumsum(~gap)])
    return codes, kept[bounds], seen[bounds[1:]] > seen[bounds[:-1]]


class Sparse:
    """A transition table as the sorted cells that go on, and what each symbol reaches from the start."""

    def __init__(self, cells: np.ndarray, to: np.ndarray, start: np.ndarray):
        order = np.argsort(cells)
        self.cells, self.to, self.start = cells[order], to[order], start

    def step(self, row: np.ndarray, code: np.ndarray) -> np.ndarray:
        cell = row + code
        at = np.searchsorted(self.cells, cell)
        at[at == len(self.cells)] = 0
        return np.where(self.cells[at] == cell, self.to[at], ~self.start[code])


def suffix_automaton(s: np.ndarray, width: int) -> np.ndarray | Sparse:
    """Transitions of the suffix automaton of ``s``: flat, one row of ``width`` symbols
    per state, targets multiplied by ``width``.  A symbol that does not go on is coded
    as ~(row reached by that symbol from the start): a phrase ends and the next one
    begins with it.  Tables over ``DENSE_CELLS`` are sparse."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    dead = len(nxt)  # behind a symbol that the language does not have
    start = np.full(width, dead * width, np.int64)
    for c, to in nxt[0].items():
        start[c] = to * width
    if (dead + 1) * width > DENSE_CELLS:
        edges = np.array([(state * width + c, to * width) for state, out in enumerate(nxt) for c, to in out.items()], np.int64)
        return Sparse(edges[:, 0], edges[:, 1], start)
    start = start.astype(np.int32)
    table = np.tile(~start, (dead + 1, 1))
    for state, out in enumerate(nxt):
        for c, to in out.items():
            table[state, c] = to * width
    return table.reshape(-1)


def phrase_counts(codes: np.ndarray, offsets: np.ndarray, tables: list, own: list[np.ndarray] | None = None) -> np.ndarray:
    """Phrases of each text (rows) for each language (columns); own: each language's code of
    each code of ``codes``, if they differ."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    blocks = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(n), blocks)
    at = C.ranges(blocks) * BLOCK
    start = offsets[doc] + at
    size = np.minimum(BLOCK, sizes[doc] - at)
    order = np.argsort(-size, kind="stable")
    doc, start, size = doc[order], start[order], size[order]
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")  # blocks longer than k
    out = np.zeros((n, len(tables)), np.int64)
    for j, table in enumerate(tables):
        sparse = isinstance(table, Sparse)
        local = codes if own is None else own[j][codes]
        row = np.zeros(len(size), np.int64 if sparse else np.int32)  # every block begins at the start: its first symbol is found or opens a phrase
        count = np.ones(len(size), np.int64)
        for k, m in enumerate(active.tolist()):
            code = local[start[:m] + k]
            to = table.step(row[:m], code) if sparse else table[row[:m] + code]
            miss = to < 0
            if k:
                count[:m] += miss
            row[:m] = np.where(miss, ~to, to)
        out[:, j] = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
    return out


def fit(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", symbols: int = SYMBOLS,
        sample: int = SAMPLE) -> dict:
    """Automata of the labelled texts in ``docs`` (a bounded sample of them)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"))
    own = own.where("lang IS NOT NULL AND t IS NOT NULL")
    size = max(1, symbols // PIECES - 2)
    gap = (F.char_length("t") - size) / max(1, PIECES - 1)
    pieces = F.array(*(F.substring("t", (F.lit(i) * gap).cast("int") + 1, F.lit(size)) for i in range(PIECES)))
    picked = C.sample_per_class(own, "lang", "doc_id", sample)
    picked = picked.withColumn("t", F.explode(F.when(F.char_length("t") <= symbols, F.array("t")).otherwise(pieces)))
    by_lang: dict[str, list] = {}
    for r in picked.collect():
        by_lang.setdefault(r.lang, []).append((r.t, str(r.doc_id)))
    alphabet = sorted({ch for texts in by_lang.values() for t, _ in texts for ch in t.lower() if ch.isalpha()})
    table = code_table(alphabet)
    model: dict = {"alphabet": alphabet, "langs": [], "tables": [], "sizes": [], "own": []}
    for name in sorted(by_lang):
        codes, off, _ = symbols_of([t for t, _ in sorted(by_lang[name])], table)
        rng = np.random.default_rng(0)
        parts, have = [], 0
        for i in rng.permutation(len(off) - 1):
            part = codes[off[i]:off[i + 1]]
            if len(part) and have + len(part) < symbols:
                parts += [part, np.array([BREAK], np.int32)]
                have += len(part) + 1
        if parts:
            model["langs"].append(name)
            whole = np.concatenate(parts)
            known = np.unique(whole[whole >= FIRST])
            code = np.full(FIRST + len(alphabet), UNKNOWN, np.int32)
            code[:FIRST], code[known] = np.arange(FIRST), FIRST + np.arange(len(known))
            model["own"].append(code)
            model["tables"].append(suffix_automaton(code[whole], FIRST + len(known)))
            model["sizes"].append(have)
    return model


RESULT = "lang_pred string, score double, phrases array<long>, n_symbols long"


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` (all its columns but ``text``) plus lang_pred, score, phrases (one per
    learned language, in alphabetical order) and n_symbols.  score is
    second / (best + second) of the two lowest entropies: 0.5 for a tie, towards
    1 for a clear winner."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(RESULT)
    kept = [c for c in docs.columns if c not in (*added.names, text)]
    base = docs.select(*kept, F.col(text).alias("_text"))
    out = StructType(base.schema.fields[:-1] + added.fields)
    schema, held = to_arrow_schema(out), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        codes_of = code_table(m["alphabet"])
        bits = np.log2(np.array(m["sizes"] or [2], float) + 1)
        for b in batches:
            texts = C.strings(b.column(len(kept)))
            langs, scores, phrases, sizes = [], [], [], []
            for lo, hi in C.slices(texts, SLICE):
                codes, off, lettered = symbols_of(texts.slice(lo, hi - lo).to_pylist(), codes_of)
                n = np.diff(off)
                sizes += n.tolist()
                if not m["langs"]:
                    langs += ["und"] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    phrases += [[]] * (hi - lo)
                    continue
                found = phrase_counts(codes, off, m["tables"], m["own"])
                cost = found * bits / np.maximum(n, 1)[:, None]
                best = cost.argmin(axis=1)
                two = np.sort(cost, axis=1)[:, :2]
                conf = two[:, 1] / np.maximum(two.sum(axis=1), 1e-12) if cost.shape[1] > 1 else np.ones(len(cost))
                langs += [m["langs"][i] if x else "und" for i, x in zip(best.tolist(), lettered.tolist(), strict=True)]
                scores += np.where(lettered, conf, 0.0).tolist()
                phrases += found.tolist()
            cols = [b.column(i) for i in range(len(kept))]
            cols += [pa.array(v, schema.field(i - 4).type) for i, v in enumerate((langs, scores, phrases, sizes))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return base.mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = C.bucket("doc_id", 3)
    model = fit(docs.where(fold != 1))
    scored = predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
