"""States of days that merge: facts of a whole table from what was kept of its days.

A day's state has the number of its pairs (x, y), their means and the sums of squared and mixed deviations from these.
States merge by pairwise update, which takes differences of means only: raw squares would cancel for values that are
large against their spread. For the same reason y is taken from a pivot, the day's least value, and only differences of
pivots enter a merge. In a trend x counts the points, from 0 in each day, and a merge moves it on. Beside these
a day keeps a sketch of quantiles and one of distinct values, which merge within their error bounds; where the exact
number decides, it is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.inference import correlation_two_sided, critical, two_sided
from ..functions.numbers import finite
from ..operators import ordered, series, spread
from ..session import small_side

#: Points of a sketch of quantiles (a rank is off by some 1.33 % at 200, less with more), and the bits of a distinct sketch.
POINTS, DISTINCT_BITS = 400, 14
_NUMBERS = ("mx", "pivot", "my", "xx", "yy", "xy", "first", "last", "low", "high")


def states(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The state of each group: by, n, mx, pivot, my (from the pivot), xx, yy, xy, first and last (y by x), low and high
    (of y); rows where x or y isn't finite don't count."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = rows.where(finite(a) & finite(b)).withColumns({"_x": a, "_v": b})
    pivots = rows.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.min("_v").alias("pivot"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    rows = rows.join(small_side(pivots), same).withColumn("_y", F.col("_v") - F.col("pivot"))
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        n.alias("n"), F.avg("_x").alias("mx"), F.first("pivot").alias("pivot"), F.avg("_y").alias("my"), (F.var_pop("_x") * n).alias("xx"), (F.var_pop("_y") * n).alias("yy"),
        (F.covar_pop("_x", "_y") * n).alias("xy"), F.min_by("_v", "_x").alias("first"), F.max_by("_v", "_x").alias("last"), F.min("_v").alias("low"), F.max("_v").alias("high"),
    )


def day_states(rows: DataFrame, by: list[str], ts: str, order: str, value: str) -> DataFrame:
    """The states of each group's days for a trend: x is a point's place in its day. For foreachBatch or a backfill."""
    rows = rows.where(finite(F.col(value).cast("double"))).withColumn("day", F.to_date(ts))
    return states(series.ordinals(rows, [*by, "day"], [ts, order], "_i"), [*by, "day"], "_i", value)


def _pair(a: Column, b: Column, moved: bool) -> Column:
    n = a["n"] + b["n"]
    bx = b["mx"] + (a["n"] if moved else F.lit(0.0))
    dx, dy, f = bx - a["mx"], b["pivot"] - a["pivot"] + b["my"] - a["my"], a["n"] * b["n"] / n
    both = F.struct(
        n.alias("n"), (a["mx"] + dx * b["n"] / n).alias("mx"), a["pivot"].alias("pivot"), (a["my"] + dy * b["n"] / n).alias("my"), (a["xx"] + b["xx"] + dx * dx * f).alias("xx"),
        (a["yy"] + b["yy"] + dy * dy * f).alias("yy"), (a["xy"] + b["xy"] + dx * dy * f).alias("xy"), a["first"].alias("first"), b["last"].alias("last"),
        F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"),
    )
    return F.when(a["n"] == 0, F.struct(b["n"].cast("double").alias("n"), *[b[c].alias(c) for c in _NUMBERS])).otherwise(both)


def merged(days: DataFrame, by: list[str], order: str = "day", moved: bool = False) -> DataFrame:
    """One state for each group, from its states in order; moved: x counts on from one to the next (a trend)."""
    state = F.struct("n", *_NUMBERS)
    one = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), state.alias("s"))))
    none = F.struct(F.lit(0.0).alias("n"), *[F.lit(None if c in ("first", "last", "low", "high") else 0.0).cast("double").alias(c) for c in _NUMBERS])
    rows = days.groupBy(*by).agg(one.alias("_s"))
    # a group has a state for each day
    rows = rows.select(*by, F.aggregate("_s", none, lambda a, d: _pair(a, d["s"], moved)).alias("s"))
    return rows.select(*by, F.col("s.n").cast("long").alias("n"), *[F.col(f"s.{c}").alias(c) for c in _NUMBERS])


def trends(state: DataFrame, by: list[str]) -> DataFrame:
    """ordered.trend() of merged states, with p (two-sided) and the interval of the slope (low95, high95)."""
    n = F.col("n")
    sums = state.select(*by, "n", "mx", (F.col("pivot") + F.col("my")).alias("mean"), (F.col("xx") / n).alias("vx"), (F.col("yy") / n).alias("vy"), (F.col("xy") / n).alias("c"), "first", "last")
    out = ordered.trend_of(sums)
    reach = critical(F.col("df")) * F.col("se")
    out = out.withColumns({"p": two_sided(F.col("t"), F.col("df")), "low95": F.col("slope") - reach, "high95": F.col("slope") + reach})
    return out.select(*by, "n", "slope", "intercept", "r2", "mean", "first", "last", "change_pct", "se", "t", "df", "p", "low95", "high95")


def correlations(state: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, r, p) of merged states; r is 0 with fewer than three pairs or a constant side."""
    r = F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy")))
    out = state.select(*by, "n", F.when(F.col("n") >= 3, F.coalesce(r, F.lit(0.0))).otherwise(0.0).alias("r"))
    return out.withColumn("p", correlation_two_sided(F.col("r"), F.col("n")))


def volatilities(state: DataFrame, by: list[str]) -> DataFrame:
    """spread.volatility() of merged states."""
    sd = F.coalesce(F.sqrt(F.try_divide("yy", F.col("n") - 1)), F.lit(0.0))
    out = state.select(*by, "n", (F.col("pivot") + F.col("my")).alias("mean"), sd.alias("stdev"))
    out = out.withColumn("cv", F.coalesce(F.try_divide("stdev", F.abs(F.col("mean"))), F.lit(0.0)))
    return out.withColumn("passes_gate", (F.col("n") >= 8) & (F.col("mean") != 0) & (F.col("cv") > spread.VOLATILE))


# ---- sketches -------------------------------------------------------------------------


def day_sketches(rows: DataFrame, by: list[str], value: str, text: str | None = None) -> DataFrame:
    """(by, n, quantiles, distinct): a group's sketches of its values and of the distinct texts (null without text)."""
    v = F.when(finite(F.col(value).cast("double")), F.col(value).cast("double"))
    some = F.hll_sketch_agg(F.nullif(F.col(text).cast("string"), F.lit("")), F.lit(DISTINCT_BITS)) if text else F.lit(None).cast("binary")
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.kll_sketch_agg_double(v, F.lit(POINTS)).alias("quantiles"), some.alias("distinct"))


def merged_sketches(days: DataFrame, by: list[str]) -> DataFrame:
    return days.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def medians(sketches: DataFrame, by: list[str], steps: int = 400) -> DataFrame:
    """(by, n, q1, median, q3, mad) from sketches; mad is the median of the distances of evenly spaced quantiles."""
    at = lambda q: F.kll_sketch_get_quantile_double("quantiles", q)
    out = sketches.select(*by, "n", *[at(F.lit(q)).alias(c) for c, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))], at(F.array(*[F.lit((i + 0.5) / steps) for i in range(steps)])).alias("_all"))
    off = F.array_sort(F.transform("_all", lambda x: F.abs(x - F.col("median"))))
    return out.select(*by, "n", "q1", "median", "q3", F.element_at(off, steps // 2).alias("mad"))


def distinct_counts(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.select(*by, F.hll_sketch_estimate("distinct").alias("distinct"))


def distinct_or_exact(sketches: DataFrame, rows: DataFrame, text: str, gates: list[float]) -> int:
    """The distinct texts of a whole table from its sketch, counted exactly where the estimate is near a gate."""
    (estimate,) = (r["distinct"] for r in distinct_counts(merged_sketches(sketches, []), []).collect())
    off = 5 * 1.04 / 2 ** (DISTINCT_BITS / 2)
    if estimate > 100 and all(abs(estimate - g) > off * estimate for g in gates):
        return estimate
    return rows.agg(F.count_distinct(F.nullif(F.col(text).cast("string"), F.lit("")))).first()[0]
