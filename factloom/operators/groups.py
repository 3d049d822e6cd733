"""Categories, correlations and what charts show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..session import SMALL, checkpoint, small_side
from .series import ordinals

#: Most row ids that a fact keeps (fixed value).
PROVENANCE = 200
#: Gates: |r| and pairs of a correlation; groups and share of a concentration (fixed values).
CORRELATED, CORRELATED_PAIRS, MANY_GROUPS, CONCENTRATED = 0.55, 6, 4, 55.0


def correlations(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(a, b, r, n) for each pair of metrics over rows where both are finite, in one aggregation.

    r is 0 with fewer than three rows or a constant metric.
    """
    cells = []
    for j, b in enumerate(metrics):
        for a in metrics[:j]:
            x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
            ok = finite(x) & finite(y)
            x, y = F.when(ok, x), F.when(ok, y)
            r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
            n = F.count(x)
            r = F.when(n >= 3, F.coalesce(r, F.lit(0.0))).otherwise(0.0)
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r"), n.alias("n")))
    return df.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def group_sums(df: DataFrame, category: str, value: Column, row_id: Column) -> DataFrame:
    """(key, sum, count, first_seen, rank, total, share) of the groups with a name, by falling sum."""
    rows = df.select(F.col(f"`{category}`").cast("string").alias("key"), value.cast("double").alias("v"), row_id.alias("row_id"))
    rows = rows.where((F.col("key") != "") & finite(F.col("v")))
    sums = rows.groupBy("key").agg(F.sum("v").alias("sum"), F.count(F.lit(1)).alias("count"), F.min("row_id").alias("first_seen"))
    sums = checkpoint(sums)
    if sums.count() <= SMALL:
        sums = sums.withColumn("rank", F.row_number().over(Window.orderBy(F.col("sum").desc(), "first_seen")))
    else:
        down = sums.withColumn("_down", -F.col("sum"))
        sums = ordinals(down, [], ["_down", "first_seen", "key"], "rank").withColumn("rank", F.col("rank") + 1).drop("_down")
    total = sums.agg(F.sum("sum").alias("total"))  # one row
    sums = sums.crossJoin(F.broadcast(total))
    return sums.withColumn("share", F.coalesce(F.try_divide("sum", "total") * 100.0, F.lit(0.0)))


def leader(groups: DataFrame) -> DataFrame:
    """(leader, sum, share, runner_up, lead_ratio, groups, passes_gate) of ranked groups."""
    first, second = F.col("rank") == 1, F.col("rank") == 2
    out = groups.agg(
        F.max(F.when(first, F.col("key"))).alias("leader"), F.max(F.when(first, F.col("sum"))).alias("sum"),
        F.max(F.when(first, F.col("share"))).alias("share"), F.max(F.when(second, F.col("sum"))).alias("runner_up"),
        F.count(F.lit(1)).alias("groups"), F.max("total").alias("total"),
    )
    out = out.withColumn("lead_ratio", F.try_divide("sum", "runner_up"))
    return out.withColumn("passes_gate", (F.col("groups") >= 2) & (F.col("total") != 0)).drop("total")


def concentration(groups: DataFrame, top: int = 3) -> DataFrame:
    """(top_n, top_share, groups, passes_gate): the share of the largest groups."""
    out = groups.agg(
        F.sum(F.when(F.col("rank") <= top, F.col("sum"))).alias("top_sum"), F.max("total").alias("total"), F.count(F.lit(1)).alias("groups")
    )
    out = out.withColumn("top_share", F.coalesce(F.try_divide("top_sum", "total") * 100.0, F.lit(0.0)))
    gate = (F.col("groups") > MANY_GROUPS) & (F.col("top_share") > CONCENTRATED)
    return out.select(F.lit(top).alias("top_n"), "top_share", "groups", gate.alias("passes_gate"))


def provenance(df: DataFrame, by: list[str], row_id: str, most: int = PROVENANCE) -> DataFrame:
    """(by, row_id, place) of the first rows of each group; the cut is pushed below the shuffle."""
    order = Window.partitionBy(*by).orderBy(row_id)
    return df.select(*by, row_id).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def top_and_other(groups: DataFrame, top: int) -> DataFrame:
    """(label, sum, place): the largest groups and one row for the rest, as bar and donut charts show them."""
    is_top = F.col("rank") <= top
    out = groups.groupBy(F.when(is_top, F.col("rank")).otherwise(top + 1).alias("place")).agg(
        F.sum("sum").alias("sum"), F.max(F.when(is_top, F.col("key"))).alias("key"), F.count(F.lit(1)).alias("_n")
    )
    label = F.coalesce("key", F.concat(F.lit("Other ("), F.col("_n").cast("string"), F.lit(")")))
    return out.select(label.alias("label"), "sum", "place")


def thinned_line(series: DataFrame, by: list[str] | None = None, most: int = 120) -> DataFrame:
    """(by, bucket, size, v, label, row_id): at most so many means of neighbouring points of each series."""
    by = by or []
    n = series.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))  # a row for each series
    both = series.join(small_side(n), by) if by else series.crossJoin(F.broadcast(n))
    both = both.withColumn("size", F.ceil(F.col("n") / most))
    return (
        both.groupBy(*by, F.floor(F.col("i") / F.col("size")).alias("bucket"))
        .agg(F.max("size").alias("size"), F.avg("v").alias("v"), F.min_by("label", "i").alias("label"), F.min_by("row_id", "i").alias("row_id"))
    )


def thinned_pairs(df: DataFrame, x: str, y: str, order: list[str], most: int = 200) -> DataFrame:
    """(k, x, y): every (n / most)-th pair in the order, all pairs if there are no more."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *order)
    rows = ordinals(rows.where(finite(F.col("x")) & finite(F.col("y"))), [], order)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    both = rows.crossJoin(F.broadcast(n))  # one row
    # place k holds the pair floor(k * n / most), so i is taken where some k falls on it
    k = F.ceil(F.col("i") * most / F.col("n"))
    taken = F.when(F.col("n") <= most, F.col("i")).otherwise(
        F.when((k < most) & (F.floor(k * F.col("n") / most) == F.col("i")), k)
    )
    return both.withColumn("k", taken.cast("long")).where("k IS NOT NULL").select("k", "x", "y")


def ticks(low: Column, high: Column, about: int = 5) -> Column:
    """Round axis ticks that cover low to high (low < high), as an array; display.nice_ticks() for columns."""
    unit = lambda x: F.pow(F.lit(10.0), F.floor(F.log10(x)))
    size = high - low
    span = unit(size) * F.when(size / unit(size) <= 1, 1).when(size / unit(size) <= 2, 2).when(size / unit(size) <= 5, 5).otherwise(10)
    rough = span / (about - 1)
    step = unit(rough) * F.when(rough / unit(rough) < 1.5, 1).when(rough / unit(rough) < 3, 2).when(rough / unit(rough) < 7, 5).otherwise(10)
    return F.transform(F.sequence(F.floor(low / step), F.ceil(high / step)), lambda i: i * step)
