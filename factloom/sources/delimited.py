"""Delimited text as typed tables.

Small texts are split here with all their quirks (a quote may open anywhere in a field); files are read in
parallel by the same rules, with the delimiter found from the first lines. Either way cells come as strings with
row_id, their kinds are voted in one aggregation, and a projection types them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import coerced, kind_of, votes
from ..operators.series import ordinals
from . import quoted

DELIMITERS = (",", ";", "\t", "|")


class InputError(ValueError):
    """Input that can't be analysed, in words for the user."""


@dataclass
class Table:
    """A typed table: df has row_id and the columns of kinds, in their order."""

    df: DataFrame
    kinds: dict[str, str]
    name: str = "uploaded data"
    notes: list[str] = field(default_factory=list)

    def of_kind(self, kind: str) -> list[str]:
        return [c for c, k in self.kinds.items() if k == kind]


def sniff(lines: list[str]) -> str:
    """The delimiter that the first lines have most, and most evenly, outside quotes."""
    best, found = 0, ","
    for d in DELIMITERS:
        counts = [sum(part.count(d) for part in line.split('"')[::2]) for line in lines[:5] if line.strip()]
        if not counts or min(counts) == 0:
            continue
        score = 2 * min(counts) + 2 * (len(set(counts)) == 1)
        if score > best:
            best, found = score, d
    return found


def records(text: str, delimiter: str) -> list[list[str]]:
    """Rows of fields. Quotes toggle anywhere; two within quotes are one."""
    rows, row, cell, quoted, i = [], [], [], False, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                cell.append(c)
                i += 1
            else:
                quoted = not quoted
        elif quoted or c not in (delimiter, "\n"):
            cell.append(c)
        else:
            row.append("".join(cell))
            cell = []
            if c == "\n":
                rows.append(row)
                row = []
        i += 1
    if cell or row:
        rows.append([*row, "".join(cell)])
    return rows


def unique_names(names: list[str]) -> list[str]:
    """Blank names get a number, repeated ones a suffix (in any case, as Spark doesn't tell cases apart)."""
    out, seen = [], set()
    for i, name in enumerate(names):
        name = name.strip() or f"column_{i + 1}"
        new, k = name, 1
        while new.lower() in seen:
            k += 1
            new = f"{name}_{k}"
        seen.add(new.lower())
        out.append(new)
    return out


def from_text(
    spark: SparkSession,
    text: str,
    name: str = "uploaded data",
    max_bytes: int | None = None,
    max_rows: int | None = None,
    max_columns: int | None = None,
) -> Table:
    """A text's table. Without caps nothing is cut; a cap that applies leaves a note."""
    if max_bytes is not None and len(text.encode("utf-8", "replace")) > max_bytes:
        raise InputError(f"the text has more than {max_bytes} bytes")
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").strip()
    if not text:
        raise InputError("the text is empty")
    rows = records(text, sniff(text.split("\n")))
    notes = []
    names = unique_names(rows[0])
    if [n.strip() for n in rows[0] if n.strip()] != [n for n, h in zip(names, rows[0], strict=True) if h.strip()]:
        notes.append("Repeated column names were numbered.")
    if max_columns is not None and len(names) > max_columns:
        notes.append(f"Only the first {max_columns} of {len(names)} columns were analysed.")
        names = names[:max_columns]
    body = [r for r in rows[1:] if any(c.strip() for c in r)]
    if not body:
        raise InputError("the text has no rows of data")
    if max_rows is not None and len(body) > max_rows:
        notes.append(f"Only the first {max_rows} of {len(body)} rows were analysed.")
        body = body[:max_rows]
    cells = [(i, *((r[k] if k < len(r) else None) for k in range(len(names)))) for i, r in enumerate(body)]
    schema = ", ".join(["row_id long", *(f"`{n.replace('`', '``')}` string" for n in names)])
    return typed(spark.createDataFrame(cells, schema), name, notes)


def from_path(
    spark: SparkSession, path: str, name: str | None = None, max_rows: int | None = None, max_columns: int | None = None, names: list[str] | None = None
) -> Table:
    """The table of a file or of a folder of files, by the same rules as a text, read in parallel (see quoted.py).

    Without caps nothing is cut; a cap that applies leaves a note. names are those of files that have no header.
    """
    head = [r[0] for r in spark.read.text(path).limit(5).collect()]
    if not head:
        raise InputError("the file is empty")
    delimiter = sniff([head[0].removeprefix("\ufeff"), *head[1:]])
    try:
        own, rows = quoted.records(spark, path, delimiter, header=names is None)
    except quoted.UnclosedQuote as e:
        raise InputError(str(e)) from e
    if names is None and own is None:
        raise InputError("the file is empty")
    names, notes = unique_names(own if names is None else names), []
    if own and [n.strip() for n in own if n.strip()] != [n for n, h in zip(names, own, strict=True) if h.strip()]:
        notes.append("Repeated column names were numbered.")
    if max_columns is not None and len(names) > max_columns:
        notes.append(f"Only the first {max_columns} of {len(names)} columns were analysed.")
        names = names[:max_columns]
    if max_rows is not None and (n := rows.count()) > max_rows:
        notes.append(f"Only the first {max_rows} of {n} rows were analysed.")
        rows = rows.where(F.col("row_id") < max_rows)
    return typed(rows.select("row_id", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]), name or path, notes)


def typed(raw: DataFrame, name: str, notes: list[str]) -> Table:
    """Vote and apply the kinds of string columns."""
    names = [c for c in raw.columns if c != "row_id"]
    # one row for each cell, so that the parsers are compiled once and not for each column
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").alias("x")) for i, c in enumerate(names)]))
    got = {r["i"]: r for r in raw.select(cell.alias("c")).select("c.i", "c.x").groupBy("i").agg(*votes(F.col("x"))).collect()}
    if names and not got:
        raise InputError("there are no rows of data")
    kinds = {c: kind_of(*(got[i][v] for v in ("filled", "numbers", "dates", "booleans"))) for i, c in enumerate(names)}
    return Table(raw.select("row_id", *[coerced(F.col(f"`{c}`"), k).alias(c) for c, k in kinds.items()]), kinds, name, notes)


def from_frame(df: DataFrame, row_id: str | None = None, name: str = "table") -> Table:
    """A typed DataFrame's table: numbers become doubles, dates and timestamps days.

    Without a row_id rows are numbered in the order of all their columns, so that facts and digests don't depend on
    partitions; equal rows stand for each other.
    """
    kinds, columns = {}, []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if f.name == row_id or f.name == "row_id":
            continue
        if t in ("byte", "short", "integer", "long", "float", "double") or t.startswith("decimal"):
            kinds[f.name], c = "number", c.cast("double")
        elif t in ("date", "timestamp", "timestamp_ntz"):
            kinds[f.name], c = "date", c.cast("date")
        elif t in ("string", "boolean"):
            kinds[f.name] = t
        else:
            continue  # nested values take no part
        columns.append(c.alias(f.name))
    row_id = row_id or ("row_id" if "row_id" in df.columns else None)
    if row_id:
        return Table(df.select(F.col(f"`{row_id}`").cast("long").alias("row_id"), *columns), kinds, name)
    rows = ordinals(df.select(*columns), [], [f"`{c}`" for c in kinds], "row_id")
    return Table(rows.select("row_id", *[F.col(f"`{c}`") for c in kinds]), kinds, name)
