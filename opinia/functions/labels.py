"""Label and score expressions (P5-P7, L3-L7, N7).  Pure column arithmetic.

Rounding is half-even everywhere (``bround``), as the reference's Python
``round`` is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Free-text labels read as the negative class.
NEGATIVE_LABEL_TEXTS = ("0", "negative", "neg")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def binary_label(col) -> Column:
    """P5: ``'0','negative','neg'`` (trimmed, case-sensitive) -> 0, else 1.
    A numeric column is compared numerically (0.0 counts as 0)."""
    s = F.trim(_c(col).cast("string"))
    as_num = s.try_cast("double")
    return (
        F.when(s.isin(*NEGATIVE_LABEL_TEXTS) | (as_num == 0.0), F.lit(0))
        .otherwise(F.lit(1))
        .cast("int")
    )


def is_neutral_rating(col) -> Column:
    """The neutral rating 3 (as text ``'3'`` or the number 3)."""
    s = F.trim(_c(col).cast("string"))
    return (s == "3") | (s.try_cast("double") == 3.0)


def rating_to_binary(col) -> Column:
    """Rating <= 2 -> 0, else 1 (neutral rows are filtered separately)."""
    return F.when(F.trim(_c(col).cast("string")).try_cast("double") <= 2, 0).otherwise(1).cast("int")


def shift_label(col, by: int) -> Column:
    """1-5 <-> 0-4."""
    return (_c(col).cast("int") + F.lit(by)).cast("int")


def polarity_label(col, legacy: bool = False) -> Column:
    """L3: rescale polarity x in [-1,1] to 4x+5 (1-9) and name its sign.

    ``legacy=True`` tests the sign of the *rescaled* value, as the reference
    does (so every non-null label is ``positive``); the default tests the raw
    polarity.  Null polarity (blank review) gives null.
    """
    x = _c(col)
    v = x * 4 + 5 if legacy else x
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(v > 0, "positive")
        .when(v < 0, "negative")
        .otherwise("neutral")
    )


def rescale_polarity(col) -> Column:
    """L3: 4x + 5."""
    return _c(col) * 4 + 5


def scale_rating(col) -> Column:
    """L4: star rating -> 1-9: clip(round_half_even(r * 2.25), 1, 9)."""
    return F.greatest(F.lit(1.0), F.least(F.lit(9.0), F.bround(_c(col).cast("double") * 2.25, 0)))


def confidence_to_score(label, score) -> Column:
    """Label + confidence -> 1-9: round_half_even(5 +/- 4*score)."""
    s = _c(score).cast("double")
    return (
        F.when(_c(label) == "POSITIVE", F.bround(5 + 4 * s, 0))
        .otherwise(F.bround(5 - 4 * s, 0))
        .cast("int")
    )


def final_score(sentiment, stars) -> Column:
    """Negative -> stars (1-5), otherwise stars + 4 (5-9)."""
    s = _c(stars).cast("int")
    return F.when(F.lower(_c(sentiment)) == "negative", s).otherwise(s + 4).cast("int")


def sentiment_name(col) -> Column:
    """Prediction 1 -> 'Positive', another one -> 'Negative', none -> null."""
    return F.when(_c(col) == 1, "Positive").when(_c(col).isNotNull(), "Negative")


def overall_rating(scores_map) -> Column:
    """round_half_even(review_scores_rating / 10, 1); null if absent or not
    a number (the map's other values do not matter)."""
    return F.bround(_c(scores_map).getItem("review_scores_rating").try_cast("double") / 10.0, 1)
