"""Columns holding Python literals (lists of dicts, dicts) read as typed
nested data with ``from_json``.

Python literals are close to JSON with single quotes.  The differences that
matter are repaired by regex before parsing:

* ``None`` / ``True`` / ``False`` outside quoted strings -> ``null/true/false``
  (the text is cut into quoted strings and the rest, so strings stay as they are);
* ``\\xNN`` escapes -> ``\\u00NN``;
* ``\\U........`` escapes -> the character.

Malformed input parses to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_OPTIONS = {
    "allowSingleQuotes": "true",
    "allowBackslashEscapingAnyCharacter": "true",
    "allowUnquotedControlChars": "true",
    "mode": "PERMISSIVE",
}

REVIEW_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("_id", T.StringType()),
            T.StructField("date", T.StringType()),
            T.StructField("comments", T.StringType()),
        ]
    )
)
# values as text: one that is no number does not spoil the others
SCORES_SCHEMA = T.MapType(T.StringType(), T.StringType())
SCORE_LIST_SCHEMA = T.ArrayType(T.StringType())
ADDRESS_SCHEMA = T.StructType(
    [
        T.StructField("country", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField(
            "location",
            T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))]),
        ),
    ]
)


# a quoted string, a name, a run of other characters
PIECES = r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|\w++|[^'"\w]++|['"]"""


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_json_text(col) -> Column:
    """Repair the Python-only tokens so a JSON reader accepts the text."""
    s = _c(col)
    names = F.create_map(*map(F.lit, ("None", "null", "True", "true", "False", "false")))
    pieces = F.regexp_extract_all(s, F.lit(PIECES), F.lit(0))
    s = F.when(s.rlike("None|True|False"), F.array_join(
        F.transform(pieces, lambda p: F.coalesce(F.element_at(names, p), p)), "")).otherwise(s)
    s = F.regexp_replace(s, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    escapes = F.array_distinct(F.regexp_extract_all(s, F.lit(r"\\U[0-9a-fA-F]{8}"), F.lit(0)))
    return F.when(s.contains("\\U"), F.aggregate(escapes, s, lambda a, e: F.replace(
        a, e, F.decode(F.unhex(F.substring(e, 3, 8)), "UTF-32")))).otherwise(s)


def parse_literal(col, schema: T.DataType, require: str | None = None) -> Column:
    """Parse a literal column into ``schema``; malformed or shape-mismatched
    input gives null.  ``require='list'`` demands a leading ``[`` (a dict is
    otherwise read as a one-element list), ``'dict'`` a leading ``{``."""
    s = _c(col)
    parsed = F.from_json(to_json_text(s), schema, JSON_OPTIONS)
    t = F.ltrim(s)
    if require == "list" or (require is None and isinstance(schema, T.ArrayType)):
        return F.when(t.startswith("["), parsed)
    if require == "dict" or (require is None and isinstance(schema, (T.StructType, T.MapType))):
        return F.when(t.startswith("{"), parsed)
    return parsed


def is_bracketed(col) -> Column:
    """The reference's list test: starts with ``[`` and ends with ``]``."""
    s = _c(col)
    return s.startswith("[") & s.endswith("]")
