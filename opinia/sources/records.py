"""Records of delimited files whose quoted fields may hold line breaks, read by many tasks.

A line of such a file starts a record or lies inside a quoted field; which of the two depends on all text
before it.  Two passes over the lines of each file split settle it without reading a
file in one task:

1. each split says where it ends (in a quoted field or not) for both ways it could start, and whether
   a record starts in it: one row per split;
2. from those rows, in file order, each split's true start follows by composition.  Now each split
   puts its lines together to records.  Only the piece of a record before its first start and the one that it
   leaves open are put together with the neighbours' by an aggregate: at most two rows per split.

The quoting rules are those of Spark's own parser, which then parses the records one by one: a quote opens
a field only at its start, two quotes inside stand for one, and text between a closing quote and the next
separator belongs to the field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE = '"'


def _patterns(sep: str) -> tuple[re.Pattern, re.Pattern]:
    """Lines that end outside of quoted fields if they start a record, or inside one."""
    s = re.escape(sep)
    inside = '[^"]*+(?:""[^"]*+)*+'
    after = f'"[^{s}]*+'  # the closing quote and what follows it
    field = f'(?:"{inside}{after}|[^"{s}][^{s}]*+|)'
    return re.compile(f"{field}(?:{s}{field})*+", re.DOTALL), re.compile(f"{inside}{after}(?:{s}{field})*+", re.DOTALL)


class Machine:
    """Whether a line ends inside a quoted field, by how it starts."""

    def __init__(self, sep: str):
        self.outside, self.inside = _patterns(sep)

    def open_after(self, line: str, inside: bool) -> bool:
        if QUOTE not in line:
            return inside
        return (self.inside if inside else self.outside).fullmatch(line) is None


def lines_of(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """``(file, at, value)``: lines in order within a split; ``at`` is the split's start.  ``encoding`` (one
    that holds ASCII as it is) decodes lines that are not UTF-8."""
    raw = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding is None else F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), value.alias("value"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """((file, at), lines) of each split of a task, one after the other."""
    state = {"key": None, "batch": None, "row": 0}

    def refill() -> bool:
        while state["batch"] is None or state["row"] >= len(state["batch"][2]):
            b = next(batches, None)
            if b is None:
                return False
            state["batch"], state["row"] = [c.to_pylist() for c in b.columns], 0
        return True

    def lines(key) -> Iterator[str]:
        while refill():
            f, at, v = state["batch"]
            i = state["row"]
            if (f[i], at[i]) != key:
                return
            state["row"] += 1
            yield v[i]

    while refill():
        f, at, _ = state["batch"]
        key = f[state["row"]], at[state["row"]]
        own = lines(key)
        yield key, own
        for _ in own:  # what the reader left
            pass


def _ends(sep: str):
    """First pass: (file, at, open0, open1, starts1) per split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, rows = Machine(sep), []
        for (file, at), lines in _splits(iter(batches)):
            out, into, starts = False, True, False  # states of the two readings; a record starts in the second one
            for line in lines:
                starts |= not into
                if QUOTE in line:
                    out, into = machine.open_after(line, out), machine.open_after(line, into)
            rows.append((file, at, out, into, starts))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                         names=["file", "at", "open0", "open1", "starts1"])

    return run


def _starts(splits: list[tuple]) -> dict[tuple[str, int], int]:
    """{split: start of the split whose record it continues} of the splits that start inside a quoted field."""
    out, file, inside, owner = {}, None, False, 0
    for f, at, open0, open1, starts1 in sorted(splits):
        if f != file:
            file, inside = f, False
        if inside:
            out[f, at] = owner
        if not inside or starts1:
            owner = at
        inside = open1 if inside else open0
    return out


def _records(sep: str, held, crlf: bool):
    """Second pass: (file, owner, at, first, whole, value): records, and pieces of those that cross splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, rows = Machine(sep), []

        def flush():
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                              names=["file", "owner", "at", "first", "whole", "value"])

        for (file, at), lines in _splits(iter(batches)):
            owner = held.value.get((file, at))
            inside, piece, fresh, first = owner is not None, [], owner is None, at == 0
            for line in lines:
                inside = machine.open_after(line, inside)
                piece.append(line[:-1] if crlf and line.endswith("\r") else line)
                if inside:
                    continue
                value = "\n".join(piece)
                if not fresh:
                    rows.append((file, owner, at, False, False, value))
                elif value:  # blank lines are no records
                    rows.append((file, at, at, first, True, value))
                    first = False
                piece, fresh = [], True
                if len(rows) >= 10_000:
                    yield flush()
            if piece:
                rows.append((file, at if fresh else owner, at, first and fresh, False, "\n".join(piece)))
        yield flush()

    return run


def read_records(spark: SparkSession, path: str, sep: str, encoding: str | None = None, crlf: bool = False) -> DataFrame:
    """``(first, value)``: one row per record of the files at ``path``; ``first`` marks each file's first one.  Line
    breaks inside records are ``\\n``; ``crlf`` takes the carriage return off each line's end.  A field
    that its file leaves open holds the rest of the file, without the file's last line break.  Blank lines are
    no records."""
    lines = lines_of(spark, path, encoding)
    ends = lines.mapInArrow(_ends(sep), "file string, at long, open0 boolean, open1 boolean, starts1 boolean")
    inside = _starts([tuple(r) for r in ends.collect()])  # one row per split of the files
    held = spark.sparkContext.broadcast(inside)
    found = lines.mapInArrow(_records(sep, held, crlf), "file string, owner long, at long, first boolean, whole boolean, value string")
    whole = found.where("whole").select("first", "value")
    if not inside:  # no record crosses splits; a field that the end of its file leaves open is one piece
        return found.select("first", "value")
    joined = found.where("NOT whole").groupBy("file", "owner").agg(
        F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    return whole.unionByName(joined.select("first", F.array_join(F.col("p.value"), "\n").alias("value")))
