"""Text expressions.  All of them are built-in Spark SQL functions, so they
stay inside whole-stage codegen; none needs a Python worker.

Regular expressions are written so that the JVM (java.util.regex) and
DuckDB (RE2) agree, which lets every operator be checked with SQL.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's definition of whitespace for ``str.split()`` and
# ASCII punctuation for ``str.strip(string.punctuation)``.
WHITESPACE_CLASS = r"\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}"
WHITESPACE_RUN = "[" + WHITESPACE_CLASS + "]+"
PUNCTUATION = string.punctuation  # !"#$%&'()*+,-./:;<=>?@[\]^_`{|}~
# Vectoriser token: two or more word characters (letters, digits, underscore).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
LETTER_OR_SPACE_NEGATED = "[^a-zA-Z" + WHITESPACE_CLASS + "]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_words(col) -> Column:
    """``str.split()``: whitespace runs, empty pieces removed."""
    # no lambda: an expression with one is computed again in each place that uses it
    return F.array_remove(F.split(_c(col), WHITESPACE_RUN), F.lit(""))


def letters_only(col) -> Column:
    """Delete everything but ASCII letters and whitespace, then lower."""
    return F.lower(F.regexp_replace(_c(col), LETTER_OR_SPACE_NEGATED, ""))


def clean_word(col) -> Column:
    """T5 (one word): strip ASCII punctuation at both ends, lower case."""
    return F.lower(F.btrim(_c(col), F.lit(PUNCTUATION)))


def clean_words(col) -> Column:
    """T5: array of cleaned, non-empty words of a text."""
    return F.filter(F.transform(split_words(col), clean_word), lambda w: w != F.lit(""))


def tokens(col) -> Column:
    """The vectoriser's tokens — lower case, runs of >= 2 word chars."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), 0)


def _gram_at(w: Column, n: int):
    # a one-argument lambda: Spark reads a second parameter as the index.  Single elements, not slices: a
    # slice copies the whole array first, which made n-grams quadratic in the text
    return lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])


def ngrams(words, lo: int = 1, hi: int = 1) -> Column:
    """All n-grams with lo <= n <= hi, space-joined, in order of n then
    position (the vectoriser's order)."""
    w = _c(words)
    empty = F.array().cast("array<string>")
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(w)
        else:
            grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), _gram_at(w, n))
            parts.append(F.when(F.size(w) >= n, grams).otherwise(empty))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def clean_output(col) -> Column:
    """Model-output clean-up: newline -> space, curly apostrophe -> ', trim."""
    c = F.replace(F.replace(_c(col), F.lit("\n"), F.lit(" ")), F.lit("’"), F.lit("'"))
    return strip_ws(c)


def word_count(col) -> Column:
    return F.size(split_words(col))


def char_count(col, ch: str) -> Column:
    c = _c(col)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def upper_count(col) -> Column:
    return F.length(F.regexp_replace(_c(col), r"[^\p{Lu}]", ""))


def review_stat_columns(col, polarity: Column | None = None, full: bool = True) -> dict[str, Column]:
    """T4: the review statistics as named columns.  ``full=False`` gives the
    five-column scoring variant.  Denominators are ``max(1, .)``."""
    c = _c(col)
    words = word_count(c).cast("bigint")
    excl = char_count(c, "!").cast("bigint")
    ques = char_count(c, "?").cast("bigint")
    upper = upper_count(c).cast("bigint")
    pol = polarity if polarity is not None else F.lit(0.0)
    out = {
        "review_length": words,
        "num_exclam": excl,
        "num_question": ques,
        "num_upper": upper,
        "polarity": pol.cast("double"),
    }
    if full:
        chars = F.length(c).cast("bigint")
        out.update(
            {
                "char_length": chars,
                "prop_upper": upper / F.greatest(F.lit(1), chars),
                "prop_exclam": excl / F.greatest(F.lit(1), words),
                "prop_question": ques / F.greatest(F.lit(1), words),
            }
        )
    return out


def strip_ws(col) -> Column:
    """``str.strip()``: remove leading/trailing whitespace (Python's set;
    Spark's ``trim`` removes spaces only)."""
    return F.regexp_replace(_c(col), "^" + WHITESPACE_RUN + "|" + WHITESPACE_RUN + "$", "")


def py_str_literal(col) -> Column:
    """Render a string as a single-quoted Python literal (escapes ``\\``,
    ``'``, newline, carriage return and tab) — used to build nested fixtures."""
    c = _c(col)
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit("'"), c, F.lit("'"))
