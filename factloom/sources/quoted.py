"""Records of delimited files by exact quote rules, in parallel: a quote-state scan.

A quote may open and close anywhere in a field, and within quotes newlines and delimiters are text, so a line can't be
read without the quotes of all lines before it. But a stretch of text only does one of two things to the state: it
keeps it or turns it over. Each split of a file is folded to that bit (a pass that counts quotes), the bits are put
together in the order of splits, and each split is then read from its true state. A record that lies over several
splits comes in fragments, which are joined by the split that it begins in. No file is one task, whatever its quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint, small_side

#: Most characters of a record: beyond that a quote wasn't closed.
LONGEST = 1 << 28
#: What a row of a split is: a record, or what a record has at the beginning, in the middle or at the end of it.
_RECORD, _HEAD, _THROUGH, _TAIL = range(4)


class UnclosedQuote(ValueError):
    """A record that doesn't end."""


def fields(record: str, delimiter: str) -> list[str]:
    """The fields of one record. Quotes toggle anywhere; two within quotes are one."""
    if '"' not in record:
        return record.split(delimiter)
    out, cell = [], []
    # quoted text up to its quote or the end, plain text, a delimiter
    for quoted, plain, cut in re.findall(rf'"((?:[^"]|"")*)(?:"|\Z)|([^"{re.escape(delimiter)}]+)|({re.escape(delimiter)})', record):
        if cut:
            out.append("".join(cell))
            cell = []
        else:
            cell.append(plain or quoted.replace('""', '"'))
    return [*out, "".join(cell)]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): the lines of files in the order of each split; lines end in LF, CR LF or CR."""
    rows = spark.read.text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _inside(lines: DataFrame) -> set[tuple[str, int]]:
    """The splits that begin within quotes; a row for each split is folded, and these come to the driver."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    turns = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("turns"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = turns.withColumn("state", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
    return {(r["file"], r["start"]) for r in state.where("state = 1").collect()}


_ROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("kind", pa.int32()), ("cells", pa.list_(pa.string())), ("raw", pa.string())])
_SCHEMA = "file string, start long, seq long, kind int, cells array<string>, raw string"


class _Split:
    """The reading of one split: seq counts its records that aren't blank."""

    def __init__(self, key: tuple[str, int], inside: bool, delimiter: str) -> None:
        self.key, self.delimiter = key, delimiter
        self.open, self.begun = inside, not inside
        self.held: list[str] = []
        self.seq = 0

    def take(self, line: str) -> tuple | None:
        if line.count('"') % 2:
            self.open = not self.open
        self.held.append(line)
        if self.open:
            return None
        record, self.held = "\n".join(self.held), []
        if not self.begun:
            self.begun = True
            return (*self.key, -1, _HEAD, None, record)
        cells = fields(record, self.delimiter)
        if not any(c.strip() for c in cells):
            return None
        self.seq += 1
        return (*self.key, self.seq - 1, _RECORD, cells, None)

    def end(self) -> tuple | None:
        if not self.held:
            return None
        return (*self.key, self.seq, _TAIL if self.begun else _THROUGH, None, "\n".join(self.held))


def records(spark: SparkSession, path: str, delimiter: str, header: bool = True) -> tuple[list[str] | None, DataFrame]:
    """The cells of the first file's first record (None without a header), and (row_id, cells) of all other records that
    aren't blank, numbered in the order of files by name and of their text. Each file has a header, or none has."""
    lines = _lines(spark, path)
    inside = _inside(lines)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for b in batches:
            out = []
            for file, start, line in zip(*(b.column(c).to_pylist() for c in ("file", "start", "line")), strict=True):
                if split is None or split.key != (file, start):
                    out.append(split and split.end())
                    split = _Split((file, start), (file, start) in inside, delimiter)
                    line = line.removeprefix("﻿") if start == 0 else line
                out.append(split.take(line))
            if out := [x for x in out if x]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ROW, strict=True)], schema=_ROW)
        if split and (last := split.end()):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(last, _ROW, strict=True)], schema=_ROW)

    rows = checkpoint(lines.mapInArrow(scan, _SCHEMA))
    whole = rows.where(F.col("kind") == _RECORD).select("file", "start", "seq", "cells")
    parts = rows.where(F.col("kind") != _RECORD)
    if not parts.isEmpty():
        whole = whole.unionByName(_joined(parts, delimiter))
    whole = checkpoint(whole)
    names = None
    if header:
        first = whole.groupBy("file").agg(F.min(F.struct("start", "seq")).alias("at"))
        first = small_side(first.select(F.col("file").alias("of"), F.col("at.start").alias("at_start"), F.col("at.seq").alias("at_seq")))
        same = (F.col("file") == F.col("of")) & (F.col("start") == F.col("at_start")) & (F.col("seq") == F.col("at_seq"))
        top = whole.join(first, same).orderBy("file").select("cells").first()
        names = top["cells"] if top else None
        whole = whole.join(first, same, "left_anti")
    # a row for each split; within one seq has no gaps
    counts = whole.groupBy(F.col("file").alias("of"), F.col("start").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("least"))
    order = Window.orderBy("of", "at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("of", "at", (F.coalesce(F.sum("n").over(order), F.lit(0)) - F.col("least")).alias("offset"))
    whole = whole.join(small_side(offsets), (F.col("file") == F.col("of")) & (F.col("start") == F.col("at")))
    return names, whole.select((F.col("seq") + F.col("offset")).alias("row_id"), "cells")


def _joined(parts: DataFrame, delimiter: str) -> DataFrame:
    """The records that come in fragments, each at the place where it begins; some rows for each split."""
    begins = (F.col("kind") == _TAIL).cast("int")
    # the end of one record comes before the beginning of the next in the same split
    number = F.sum(begins).over(Window.partitionBy("file").orderBy("start", begins).rowsBetween(Window.unboundedPreceding, 0))
    groups = parts.select("file", "start", "seq", "kind", "raw", number.alias("number")).groupBy("file", "number").agg(
        F.max(F.when(F.col("kind") == _TAIL, F.col("start"))).alias("at"),
        F.max(F.when(F.col("kind") == _TAIL, F.col("seq"))).alias("seq"),
        F.sum(F.length("raw")).alias("size"),
        F.array_sort(F.collect_list(F.when(F.length("raw") <= LONGEST, F.struct("start", begins.alias("b"), "raw")))).alias("raws"),
    )
    groups = checkpoint(groups)
    if not groups.where(F.col("size") > LONGEST).isEmpty():
        raise UnclosedQuote(f"a quote isn't closed within {LONGEST} characters")

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        cells = [fields(t, delimiter) for t in texts.to_pylist()]
        return pa.array([c if any(x.strip() for x in c) else None for c in cells], pa.list_(pa.string()))

    cells = groups.select("file", F.col("at").alias("start"), "seq", cut(F.array_join("raws.raw", "\n")).alias("cells"))
    return cells.where("cells IS NOT NULL")
