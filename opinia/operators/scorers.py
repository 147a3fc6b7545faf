"""Deterministic stand-in text scorer (used where a real model would be
plugged into ``score_texts``): 3 + (#positive - #negative lexicon words),
clipped to 1-5.  Kept free of catalogue imports so Python workers load it
cheaply."""

from __future__ import annotations

import string


def lexicon_stars(lexicon_rows):
    """Build a batch scorer from ``(word, valence)`` rows."""
    table_ = {w: v for w, v in lexicon_rows if v != 0}
    punct = string.punctuation

    def score(texts):
        out = []
        for t in texts:
            n = 0
            for tok in (t or "").split():
                v = table_.get(tok.strip(punct).lower())
                if v is not None:
                    n += 1 if v > 0 else -1
            out.append(max(1, min(5, 3 + n)))
        return out

    return score


def stars_batches(lexicon_rows):
    """A ``mapInPandas`` function: ``(doc_id, text)`` -> ``(doc_id, stars)``."""

    def run(batches):
        scorer = lexicon_stars(lexicon_rows)
        for pdf in batches:
            out = pdf[["doc_id"]].copy()
            out["stars"] = [int(x) for x in scorer(pdf["text"].tolist())] if len(pdf) else []
            yield out

    return run
