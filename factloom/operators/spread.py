"""Descriptives, outliers, volatility and seasonality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .series import quantiles

#: Modified z-scores from which on a value is an outlier, its factor, and the fewest values (fixed values).
OUTLIER, NORMAL, OUTLIER_POINTS = 3.5, 0.6745, 8
#: Coefficient of variation from which on a series is volatile (fixed value).
VOLATILE = 0.45
#: Seasons: fewest points, fewest values of a bucket, fewest buckets, least spread in per cent (fixed values).
SEASON_POINTS, BUCKET_VALUES, BUCKETS, SEASON_SPREAD = 20, 2, 4, 15.0


def describe(rows: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """(by, n, min, max, sum, mean, median, stdev, q1, q3); quartiles from order statistics."""
    v = F.col(value)
    sums = rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.avg(v).alias("mean"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"),
    )
    middle = quantiles(rows, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    return sums.join(middle, by) if by else sums.crossJoin(F.broadcast(middle))


def outliers(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (with v) that lie far from their median: with median, mad and score, the modified z-score."""
    rows = rows.withColumn("v", F.col("v").cast("double"))
    median = quantiles(rows, by, "v", {"median": 0.5})
    median = small_side(median)  # a row for each group
    both = rows.join(median, by) if by else rows.crossJoin(median)
    off = both.withColumn("off", F.abs(F.col("v") - F.col("median")))
    mad = quantiles(off, by, "off", {"mad": 0.5}).drop("n")
    mad = small_side(mad)
    scored = off.join(mad, by) if by else off.crossJoin(mad)
    score = F.try_divide(F.lit(NORMAL) * F.col("off"), "mad")
    return scored.withColumn("score", score).where((F.col("n") >= OUTLIER_POINTS) & (F.col("score") > OUTLIER)).drop("off")


def volatility(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean, stdev, cv, passes_gate)"""
    out = rows.groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("stdev"))
    out = out.withColumn("cv", F.coalesce(F.try_divide("stdev", F.abs(F.col("mean"))), F.lit(0.0)))
    return out.withColumn("passes_gate", (F.col("n") >= 8) & (F.col("mean") != 0) & (F.col("cv") > VOLATILE))


def weekday(day: Column) -> Column:
    """0 for Sunday."""
    return F.dayofweek(day) - 1


def month(day: Column) -> Column:
    """0 for January."""
    return F.month(day) - 1


def seasons(rows: DataFrame, by: list[str], bucket: Column) -> DataFrame:
    """Means of calendar buckets that have values enough: (by, bucket, n, mean)."""
    means = rows.withColumn("bucket", bucket).groupBy(*by, "bucket").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    return means.where(F.col("n") >= BUCKET_VALUES)


def season_range(means: DataFrame, by: list[str]) -> DataFrame:
    """(by, buckets, best, best_mean, worst, worst_mean, spread_pct); the first bucket of equal ones."""
    out = means.groupBy(*by).agg(
        F.count(F.lit(1)).alias("buckets"),
        F.max_by("bucket", F.struct("mean", -F.col("bucket"))).alias("best"),
        F.max("mean").alias("best_mean"),
        F.min_by("bucket", F.struct("mean", "bucket")).alias("worst"),
        F.min("mean").alias("worst_mean"),
    )
    spread = F.try_divide(F.col("best_mean") - F.col("worst_mean"), F.abs(F.col("worst_mean"))) * 100.0
    return out.withColumn("spread_pct", spread)
