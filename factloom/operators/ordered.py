"""Trend, changepoint, streak and peak of series (metric, i, v): each by aggregation over ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent_change
from .series import prefix_sums, previous

#: Fewest points of each fact, and fewest moves of a streak (fixed values).
TREND_POINTS, CHANGE_POINTS, CHANGE_EDGE, STREAK_POINTS, STREAK_MOVES = 5, 10, 3, 5, 3
#: A split is a fact from this many pooled deviations between the means on (fixed value).
CHANGE_STRENGTH = 0.8


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def trend_sums() -> dict[str, Column]:
    """The aggregates of a trend over rows (i, v)."""
    x, y = F.col("i").cast("double"), F.col("v")
    return {
        "n": F.count(F.lit(1)), "mx": F.avg(x), "mean": F.avg(y), "vx": F.var_pop(x), "vy": F.var_pop(y), "c": F.covar_pop(x, y),
        "first": F.min_by("v", "i"), "last": F.max_by("v", "i"),
    }


def trend_of(sums: DataFrame) -> DataFrame:
    """Add slope, intercept, r2, se, t, df and change_pct to rows of trend_sums()."""
    n = F.col("n")
    slope = _or_zero(F.try_divide("c", "vx"))
    r2 = F.greatest(F.lit(0.0), _or_zero(F.try_divide(F.col("c") * F.col("c"), F.col("vx") * F.col("vy"))))
    rest = F.greatest(F.lit(0.0), F.col("vy") - _or_zero(F.try_divide(F.col("c") * F.col("c"), F.col("vx"))))
    se = F.sqrt(_or_zero(F.try_divide(rest * n / F.greatest(F.lit(1), n - 2), F.col("vx") * n)))
    return (
        sums.withColumns({"slope": slope, "r2": r2, "se": se})
        .withColumns({"intercept": F.col("mean") - F.col("slope") * F.col("mx"), "t": F.try_divide("slope", "se"), "df": n - 2})
        .withColumn("change_pct", percent_change(F.col("first"), F.col("last")))
    )


def trend(series: DataFrame, by: list[str]) -> DataFrame:
    """Least squares of v on i: (by, n, slope, intercept, r2, mean, first, last, change_pct, se, t, df).

    r2 and slope are 0 where v or i is constant; t is null where the fit is exact.
    """
    sums = trend_of(series.groupBy(*by).agg(*[c.alias(k) for k, c in trend_sums().items()]))
    return sums.select(*by, "n", "slope", "intercept", "r2", "mean", "first", "last", "change_pct", "se", "t", "df")


def gain_of(i: Column, n: Column, left: Column, total: Column) -> Column:
    """How much of the variance a split at i explains, left being the sum before it; null near the ends."""
    m, a, b = total / n, left / i, (total - left) / (n - i)
    inside = (n >= CHANGE_POINTS) & i.between(CHANGE_EDGE, n - CHANGE_EDGE)
    return F.when(inside, i * (a - m) ** 2 + (n - i) * (b - m) ** 2)


def sides_sums(split: Column) -> dict[str, Column]:
    """Number, mean and variance of v on either side of a split."""
    v = F.col("v")
    low, high = F.when(F.col("i") < split, v), F.when(F.col("i") >= split, v)
    return {f"{p}{k}": f(x) for k, x in ((1, low), (2, high)) for p, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))}


def strength_of(sides: DataFrame) -> DataFrame:
    """Add before, after and strength to rows of sides_sums() with n."""
    sse = F.col("v1") * (F.col("n1") - 1) + F.col("v2") * (F.col("n2") - 1)
    pooled = F.sqrt(sse / (F.col("n") - 2))
    return sides.withColumns(
        {"before": F.col("m1"), "after": F.col("m2"), "strength": F.try_divide(F.abs(F.col("m1") - F.col("m2")), pooled)}
    )


def changepoint(series: DataFrame, by: list[str], compat: bool = False) -> DataFrame:
    """The split into two levels that explains most: (by, n, split, before, after, strength, and of each
    side n, mean and variance: n1, m1, v1, n2, m2, v2).

    compat leaves the first two values out of the left sums of the search, as the reference engine does;
    the means at the split that is found are right either way.
    """
    sums = prefix_sums(series.select(*by, "i", "v"), by, {"left": "v"})
    if compat:
        lost = series.where("i < 2").groupBy(*by).agg(F.sum("v").alias("lost"))
        sums = sums.join(lost, by, "left") if by else sums.crossJoin(F.broadcast(lost))
        sums = sums.withColumn("left", F.col("left") - F.col("lost"))
    totals = series.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    both = sums.join(totals, by) if by else sums.crossJoin(F.broadcast(totals))
    i = F.col("i")
    gain = gain_of(i, F.col("n"), F.col("left"), F.col("total"))
    best = both.where(gain.isNotNull()).groupBy(*by).agg(F.max_by("i", F.struct(gain, -i)).alias("split"), F.max("n").alias("n"))
    cut = series.join(best, by) if by else series.crossJoin(F.broadcast(best))
    sides = cut.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("split").alias("split"), *[c.alias(k) for k, c in sides_sums(F.col("split")).items()]
    )
    return strength_of(sides).select(*by, "n", "split", "before", "after", "strength", "n1", "m1", "v1", "n2", "m2", "v2")


def welch(sides: DataFrame) -> DataFrame:
    """Add t and df of Welch's test to rows with n1, m1, v1, n2, m2, v2; null where it says nothing."""
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    ok = (F.col("n1") >= 3) & (F.col("n2") >= 3)
    t = F.when(ok, F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(a + b)))
    df = F.when(ok, F.try_divide((a + b) ** 2, a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1)))
    return sides.withColumns({"welch_t": t, "welch_df": df})


def streak(series: DataFrame, by: list[str]) -> DataFrame:
    """The longest run of moves in one direction: (by, start, moves, sign, change_pct), the first of equals.

    Each value meets the one before in its block of ordinals, so series need no task of their own.
    """
    moves = previous(series.select(*by, "i", "v"), by, {"was": "v"}).withColumn("sign", F.signum(F.col("v") - F.col("was")))
    moves = previous(moves, by, {"sign_was": "sign"})
    turn = F.when(F.col("sign").eqNullSafe(F.col("sign_was")), 0).otherwise(1)
    runs = prefix_sums(moves.withColumn("turn", turn), by, {"turns": "turn"})
    runs = runs.withColumn("run", F.col("turns") + F.col("turn")).where("sign <> 0")
    runs = runs.groupBy(*by, "run").agg(
        F.count(F.lit(1)).alias("moves"), F.min("i").alias("at"), F.max("sign").alias("sign"),
        F.min_by("was", "i").alias("first"), F.max_by("v", "i").alias("last"),
    )
    best = runs.groupBy(*by).agg(F.max_by(F.struct("at", "moves", "sign", "first", "last"), F.struct("moves", -F.col("at"))).alias("b"))
    points = series.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    best = best.join(points, by) if by else best.crossJoin(F.broadcast(points))
    return best.where((F.col("n") >= STREAK_POINTS) & (F.col("b.moves") >= STREAK_MOVES)).select(
        *by,
        (F.col("b.at") - 1).alias("start"),
        F.col("b.moves").alias("moves"),
        F.col("b.sign").cast("int").alias("sign"),
        percent_change(F.col("b.first"), F.col("b.last")).alias("change_pct"),
    )


def peak(series: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, max, min, sum, at, row_id): the largest value, and the first place that has it."""
    top = F.struct("v", -F.col("i"))
    return series.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max("v").alias("max"), F.min("v").alias("min"), F.sum("v").alias("sum"),
        F.max_by("i", top).alias("at"), F.max_by("row_id", top).alias("row_id"),
    )
