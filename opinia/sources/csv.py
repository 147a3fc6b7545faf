"""Tolerant CSV reading and writing.

* The header is read as one line (``spark.read.text().limit(1)``) to learn
  column names and, if asked, the separator (S2).
* Rows are parsed PERMISSIVE with one extra sentinel column ``_extra``:
  short rows come back null-padded (as the reference's reader pads them),
  rows with too many fields carry the surplus in ``_extra`` and are dropped.
* The whole file is checked for invalid UTF-8; if there is any, it is read byte
  by byte as windows-1252, or as iso-8859-1 if it holds bytes that
  windows-1252 does not define, with ``;`` (S1).
* Files are split among tasks.  If some line has an odd number of quotes (a field with a
  line break), the records are first put together by ``records.read_records``, which also
  works split by split; only files in an encoding that does not hold ASCII as it is are then
  read by one task each (``multiLine``).
* Fields may be arbitrarily large (S4: ``maxCharsPerColumn=-1``).
"""

from __future__ import annotations

import csv as _csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinia.sources.records import lines_of, read_records

SNIFF_SEPARATORS = (",", ";", "\t", "|")
SINGLE_BYTE = "iso-8859-1"
SPLITTABLE = {"utf-8": None, "utf8": None, SINGLE_BYTE: "ISO-8859-1"}  # and the charset that decodes their lines
# The characters of windows-1252 for the bytes 0x80-0x9F ("" where it has none).
C1_BYTES = [chr(i) for i in range(0x80, 0xA0)]
C1_CHARACTERS = ["€", "", "‚", "ƒ", "„", "…", "†", "‡", "ˆ", "‰", "Š", "‹", "Œ", "", "Ž", "",
                 "", "‘", "’", "“", "”", "•", "–", "—", "˜", "™", "š", "›", "œ", "", "ž", "Ÿ"]
UNDEFINED = "[" + "".join(b for b, c in zip(C1_BYTES, C1_CHARACTERS, strict=True) if not c) + "]"


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Raw lines as one string column ``value``.  The text source is UTF-8
    only, so other encodings go through the CSV reader with a separator and
    quote that never occur."""
    if encoding.upper().replace("-", "") == "UTF8":
        return spark.read.text(path)
    return (spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "\u0000")
            .option("header", "false").csv(path).select(F.col("_c0").alias("value")))


def header_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str | None:
    rows = _lines(spark, path, encoding).limit(1).collect()
    return rows[0].value if rows else None


def sniff_separator(header: str) -> str:
    """The candidate separator that occurs most often in the header."""
    counts = {s: header.count(s) for s in SNIFF_SEPARATORS}
    return max(SNIFF_SEPARATORS, key=lambda s: (counts[s], -SNIFF_SEPARATORS.index(s)))


def _columns(header: str, sep: str) -> list[str]:
    return next(_csv.reader(io.StringIO(header), delimiter=sep, quotechar='"'))


def _to_windows_1252(col) -> Column:
    """Text read byte by byte (iso-8859-1) as windows-1252."""
    pairs = [(b, c) for b, c in zip(C1_BYTES, C1_CHARACTERS, strict=True) if c]
    return F.translate(col, "".join(b for b, _ in pairs), "".join(c for _, c in pairs))


def _inspect(spark: SparkSession, path: str, encoding: str) -> tuple[bool, bool, bool]:
    """One pass over all lines: (invalid UTF-8, bytes that windows-1252 lacks, a
    line with an odd number of quotes)."""
    line = F.col("value")
    utf8 = encoding.upper().replace("-", "") == "UTF8"
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    row = _lines(spark, path, encoding).agg(
        F.coalesce(F.bool_or(~F.is_valid_utf8(line)) if utf8 else F.lit(False), F.lit(False)),
        F.coalesce(F.bool_or(line.rlike(UNDEFINED)), F.lit(False)),
        F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)),
    ).first()
    return tuple(row)


def read_reviews(spark: SparkSession, path: str, sep: str | None = ",", schema: T.StructType | None = None,
                 required: list[str] | None = None, encoding: str | None = None,
                 fallback_sep: str = ";") -> DataFrame:
    """Read a review CSV.  ``sep=None`` sniffs the separator.
    Columns are strings unless ``schema`` is given.  Raises on an empty file
    or a missing required column."""
    enc, cp1252 = encoding or "UTF-8", False
    bad, undefined, broken = _inspect(spark, path, enc)
    if encoding is None and bad:
        enc = SINGLE_BYTE
        _, undefined, broken = _inspect(spark, path, enc)
        cp1252 = not undefined
        sep = fallback_sep if sep is not None else None
    records = None
    if broken and enc.lower() in SPLITTABLE:
        # the separator, which the records depend on, is looked for in the first line
        first = header_line(spark, path, enc) or ""
        charset = SPLITTABLE[enc.lower()]
        crlf = (lines_of(spark, path, charset).limit(1).first() or ("", 0, ""))[2].endswith("\r")
        sep = sniff_separator(first) if sep is None else sep
        records = read_records(spark, path, sep, charset, crlf)
        header = (records.where("first").select("value").limit(1).first() or [None])[0]
    else:
        header = header_line(spark, path, enc)
    if header is None or not header.strip():
        raise ValueError(f"{path}: empty file")
    if sep is None:
        sep = sniff_separator(header)
    if cp1252:
        header = spark.range(1).select(_to_windows_1252(F.lit(header))).first()[0]
    names = _columns(header, sep)
    fields = list(schema.fields) if schema is not None else [T.StructField(n, T.StringType()) for n in names]
    full = T.StructType(fields + [T.StructField("_extra", T.StringType())])
    rules = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    if records is not None:
        df = records.where("NOT first").select(F.from_csv("value", full.toDDL(), rules).alias("_r"))
        df = df.select("_r.*")
    else:
        df = (
            spark.read.options(**rules).option("header", "true").option("multiLine", str(broken).lower())
            .option("encoding", enc).option("enforceSchema", "true").schema(full).csv(path)
        )
    df = df.where(F.col("_extra").isNull()).drop("_extra")
    if cp1252:
        df = df.withColumns({f.name: _to_windows_1252(F.col(f"`{f.name}`")) for f in fields if isinstance(f.dataType, T.StringType)})
    if required:
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise ValueError(f"{path}: missing required columns {missing}")
    return df


def write_reviews(df: DataFrame, path: str, sep: str = ",", quoting: str = "minimal",
                  mode: str = "overwrite") -> None:
    """Sharded CSV output with a header.  ``quoting``: ``minimal``,
    ``all`` or ``nonnumeric`` (string columns always quoted, numbers bare)."""
    w = df.write.mode(mode).option("header", "true").option("sep", sep).option("escape", '"')
    if quoting == "all":
        w.option("quoteAll", "true").csv(path)
        return
    if quoting == "minimal":
        w.csv(path)
        return
    if quoting != "nonnumeric":
        raise ValueError(quoting)
    numeric = (T.NumericType, T.BooleanType)
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, numeric):
            cols.append(c.cast("string").alias(f.name))
        else:
            cols.append(
                F.when(c.isNull(), F.lit(None))
                .otherwise(F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"')))
                .alias(f.name)
            )
    quoted_header = [f'"{f.name}"' if not isinstance(f.dataType, numeric) else f.name for f in df.schema.fields]
    out = df.select(*cols).toDF(*quoted_header)
    (out.write.mode(mode).option("header", "true").option("sep", sep).option("quote", "")
     .option("emptyValue", "").csv(path))
