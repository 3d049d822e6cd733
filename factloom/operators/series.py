"""Ordered series in long form, with ordinals and prefix sums that need no single task.

A series is rows (metric, i, v, row_id, at, label): i counts from 0 in the order of the axis. Rows are
sorted by range over all tasks; each task numbers its own, and the tasks' counts, a row for each
metric and partition, are summed up to offsets and joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..session import SMALL, checkpoint, small_side

#: Rows of a block of ordinals in which prefix sums are taken.
BLOCK = 65_536
#: Bits of a row's place in its partition in what monotonically_increasing_id() gives.
_PLACES = 33


def long_form(df: DataFrame, metrics: list[str], at: Column | None, row_id: Column, label: Column | None = None) -> DataFrame:
    """(metric, v, row_id, at, label) for each finite value of the metrics."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("v")) for m in metrics])
    at = at if at is not None else row_id
    label = label if label is not None else F.concat(F.lit("row "), row_id + 1)
    rows = df.select(row_id.cast("long").alias("row_id"), at.alias("at"), label.alias("label"), F.explode(pairs).alias("p"))
    return rows.select("p.metric", "p.v", "row_id", "at", "label").where(finite(F.col("v")))


def ordinals(rows: DataFrame, by: list[str], order: list[str], name: str = "i", groups: int | None = None) -> DataFrame:
    """Add name: the place from 0 within by in the given order (nulls last).

    Rows move once, to their range. Equal rows share a range, so the order should tell rows apart. groups is the
    number of groups, if it is known (one without by).
    """
    sort = [F.col(c).asc_nulls_last() for c in (*by, *order)]
    spread = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return _numbered(spread, by, name, groups if by else 1)


def _numbered(rows: DataFrame, by: list[str], name: str, groups: int | None) -> DataFrame:
    """Number rows that lie in order, those of each group of by together."""
    # the partition in the upper bits, the row's place in it in the lower ones; written down once, as what a
    # partition holds must not change between the two uses
    rows = checkpoint(rows.withColumn("_place", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_place", _PLACES))
    at = F.col("_place").bitwiseAND(F.lit((1 << _PLACES) - 1))
    counts = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    # a row for each group and partition
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    offsets = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_at_part"), offset.alias("_offset"))
    known = groups is not None and groups * rows.rdd.getNumPartitions() <= SMALL
    offsets = F.broadcast(offsets) if known else small_side(offsets)
    same = F.col("_part") == F.col("_at_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = rows.join(offsets, same).withColumn(name, at + F.col("_offset"))
    return out.drop("_place", "_part", "_at_part", "_offset", *[f"_by_{c}" for c in by])


def series(df: DataFrame, metrics: list[str], at: Column | None, row_id: Column, label: Column | None = None) -> DataFrame:
    return ordinals(long_form(df, metrics, at, row_id, label), ["metric"], ["at", "row_id"], groups=len(metrics))


@dataclass
class Together:
    """Series that lie in rows with a value and an ordinal of each metric (columns by metric), in order, written down."""

    rows: DataFrame
    values: dict[str, str]
    places: dict[str, str]

    def long(self, label: Column | None = None) -> DataFrame:
        """The rows of series(), made wherever they are read; label, over at and row_id, if none was written down."""
        pairs = [F.struct(F.lit(m).alias("metric"), F.col(self.places[m]).alias("i"), F.col(v).alias("v")) for m, v in self.values.items()]
        label = label if label is not None else F.col("label")
        return self.rows.select(F.explode(F.array(*pairs)).alias("p"), "row_id", "at", label.alias("label")).select("p.*", "row_id", "at", "label").where("v IS NOT NULL")


def together(df: DataFrame, metrics: list[str], at: Column | None, row_id: Column, label: Column | None = None, whole: set[str] = frozenset()) -> Together:
    """series() of metrics, of which rows are sorted once and not once for each metric. whole are the metrics that have
    a finite value in every row; of the others the values are counted."""
    values = {m: f"v{k}" for k, m in enumerate(metrics)}
    cells = [F.when(finite(x), x).alias(v) for v, x in ((v, F.col(f"`{m}`").cast("double")) for m, v in values.items())]
    at = at if at is not None else row_id
    rows = df.select(row_id.cast("long").alias("row_id"), at.alias("at"), *([label.alias("label")] if label is not None else []), *cells)
    rows = ordinals(rows, [], ["at", "row_id"])
    gaps = {m: k for k, m in enumerate(metrics) if m not in whole}
    if gaps:
        rows = rows.withColumns({f"has{k}": F.col(values[m]).isNotNull().cast("long") for m, k in gaps.items()})
        rows = prefix_sums(rows, [], {f"i{k}": f"has{k}" for k in gaps.values()}).drop(*[f"has{k}" for k in gaps.values()])
        # in order again: blocks lie by hash
        rows = rows.repartitionByRange("i").sortWithinPartitions("i")
    return Together(checkpoint(rows), values, {m: f"i{gaps[m]}" if m in gaps else "i" for m in metrics})


def prefix_sums(rows: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    """Add for each (name, column) the sum of the column over all smaller ordinals i."""
    blocks = rows.withColumn("_block", F.floor(F.col("i") / BLOCK))
    inside = Window.partitionBy(*by, "_block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"_in_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in values.items()})
    # one row stands for BLOCK rows
    sums = blocks.groupBy(*by, "_block").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in values.items()])
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *by, "_block", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in values]
    )
    out = blocks.join(sums, [*by, "_block"])
    out = out.withColumns({n: F.col(f"_in_{n}") + F.col(f"_before_{n}") for n in values})
    return out.drop("_block", *[f"{p}{n}" for n in values for p in ("_in_", "_before_")])


def previous(rows: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """Add for each (name, column) the column of the row with the ordinal before, in blocks of ordinals."""
    blocks = rows.withColumn("_block", F.floor(F.col("i") / BLOCK))
    inside = Window.partitionBy(*by, "_block").orderBy("i")
    blocks = blocks.withColumns({f"_lag_{n}": F.lag(c).over(inside) for n, c in columns.items()})
    # one row stands for BLOCK rows; it follows the partitioning of the blocks
    last = F.max_by(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), "i").alias("_last")
    lasts = blocks.groupBy(*by, "_block").agg(last).withColumn("_block", F.col("_block") + 1)
    out = blocks.join(lasts, [*by, "_block"], "left")
    begins = F.col("i") % BLOCK == 0
    out = out.withColumns({n: F.when(begins, F.col(f"_last.{n}")).otherwise(F.col(f"_lag_{n}")) for n in columns})
    return out.drop("_block", "_last", *[f"_lag_{n}" for n in columns])


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles by linear interpolation between order statistics: (by, n, the names of at).

    Rows are counted by value before they are dealt out by range, so a value that very many rows have is one
    row. The ranges' counts say which of them hold an order statistic, and only these are ordered.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    some = rows.where(finite(F.col(value))).groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).alias("_v"))
    counts = some.agg(F.count(F.lit(1)).alias("_count")).repartitionByRange(*keys, "_v")
    counts = checkpoint(counts.withColumn("_part", F.spark_partition_id()))
    # a row for each group and partition
    every = Window.partitionBy(*keys)
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(*keys, "_part").agg(F.sum("_count").alias("_n"))
    parts = parts.withColumns({"n": F.sum("_n").over(every), "_off": F.coalesce(F.sum("_n").over(before), F.lit(0))})
    ranks = {name: (F.col("n") - 1) * q for name, q in at.items()}

    def holds(rank: Column, first: str, count: str) -> Column:
        return (F.col(first) <= rank) & (rank < F.col(first) + F.col(count))

    wanted = F.lit(False)
    for p in ranks.values():
        wanted = wanted | holds(F.floor(p), "_off", "_n") | holds(F.ceil(p), "_off", "_n")
    parts = parts.where(wanted).select("n", "_off", F.col("_part").alias("_at_part"), *[F.col(k).alias(f"{k}p") for k in keys])
    same = F.col("_part") == F.col("_at_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}p"))
    running = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    found = counts.join(small_side(parts), same).withColumn("_first", F.col("_off") + F.coalesce(F.sum("_count").over(running), F.lit(0)))
    cells = []
    for name, p in ranks.items():
        low, high = (F.max(F.when(holds(i, "_first", "_count"), F.col("_v"))) for i in (F.floor(p), F.ceil(p)))
        cells.append((low + (high - low) * F.max(p - F.floor(p))).alias(name))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *cells).select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", *at)
