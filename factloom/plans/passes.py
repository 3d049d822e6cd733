"""The passes over a table that a ledger is made from: few, each for all measures, pairs and categories at once.

What comes back is some rows for each measure, pair or group. Whatever a later pass needs of an earlier one (a
split, a median) goes into it as literals, so nothing of that size is written down or joined.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..operators import groups, ordered, runs, series, spread
from ..session import checkpoint

#: Most values of a bracket that one task puts in order.
SORTED = 1_000_000
#: Row ids below which the first rows of a group are looked for at first.
EARLY = 100_000


def _of(values: dict[str, float | int | None], kind: str = "double") -> Column:
    """The value of a row's metric, null for others."""
    out = F.lit(None).cast(kind)
    for m, x in values.items():
        if x is not None:
            out = F.when(F.col("metric") == m, F.lit(x).cast(kind)).otherwise(out)
    return out


def _rows(df: DataFrame) -> dict[str, dict]:
    return {r["metric"]: r.asDict(recursive=True) for r in df.collect()}


def sums(long: DataFrame, more: dict[str, Column]) -> dict[str, dict]:
    """First pass, one aggregation: size, spread and trend of each measure, and whatever else is asked for (columns over
    metric, i, v, row_id, at, label). What is asked for here is of fixed width, so that rows are summed up unsorted."""
    v = F.col("v")
    cells = ordered.trend_sums() | {
        "min": F.min(v), "max": F.max(v), "sum": F.sum(v), "stdev": F.coalesce(F.stddev_samp(v), F.lit(0.0)),
    }
    clash = set(cells) & set(more)
    if clash:
        raise ValueError(f"these names are taken: {', '.join(sorted(clash))}")
    return _rows(ordered.trend_of(long.groupBy("metric").agg(*[c.alias(k) for k, c in (cells | more).items()])))


def streaks(of: series.Together, about: dict[str, dict]) -> tuple[dict[str, list], dict[str, dict], dict[str, tuple]]:
    """Second pass, in order where the rows lie: the stretches of each measure, of which a task gives a row; its longest
    run of moves one way; and the cells of its median. The place of its peak is put into about."""
    metrics = list(about)
    parts, cells = runs.stretches(of, metrics)
    found = {}
    for m in metrics:
        about[m]["at"] = runs.peak(parts[m])
        best = runs.longest(parts[m])
        if best and about[m]["n"] >= ordered.STREAK_POINTS and best.moves >= ordered.STREAK_MOVES:
            pct = (best.b - best.a) / abs(best.a) * 100 if best.a else 0.0
            found[m] = {"start": best.at - 1, "moves": best.moves, "sign": best.sign, "change_pct": pct}
    return parts, found, cells


def medians(rows: DataFrame, v: Column, cells: dict[str, tuple[float, float, int]], counts: dict[str, int]) -> dict[str, float]:
    """The exact median of v for each metric, of which the cells are known that it lies in: what lies below is counted,
    and only what lies in the cells is put in order, equal values as one. Where these are too many, series are put in order
    by ranges."""
    low, high = (_of({m: b[k] for m, b in cells.items()}) for k in (0, 1))
    at = rows.where(v <= high).select("metric", F.when(v >= low, v).alias("v"), (v < low).alias("below"))
    at = at.groupBy("metric", "below", "v").agg(F.count(F.lit(1)).alias("k"))
    if max(n for _, _, n in cells.values()) > SORTED:
        at = checkpoint(at)
        if at.count() > SORTED:
            found = series.quantiles(rows.select("metric", v.alias("v")), ["metric"], "v", {"median": 0.5})
            return {r["metric"]: r["median"] for r in found.collect()}
    order = Window.partitionBy("metric").orderBy(F.col("below").desc(), "v").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("to", F.sum("k").over(order)).where("NOT below")
    rank = _of({m: (n - 1) / 2 for m, n in counts.items()})
    holds = lambda r: F.max(F.when((r >= F.col("to") - F.col("k")) & (r < F.col("to")), F.col("v")))
    found = at.groupBy("metric").agg(holds(F.floor(rank)).alias("a"), holds(F.ceil(rank)).alias("b"))
    out = {}
    for r in found.collect():
        n = counts[r["metric"]]
        out[r["metric"]] = r["a"] + (r["b"] - r["a"]) * ((n - 1) / 2 % 1)
    return out


def levels(of: series.Together, long: DataFrame, about: dict[str, dict], parts: dict[str, list], cells: dict[str, tuple]) -> tuple[dict[str, dict], dict[str, float], dict[str, float]]:
    """Changes with their test, medians, and median absolute deviations."""
    v = F.col("v")
    counts = {m: a["n"] for m, a in about.items()}
    median = medians(long, v, cells, counts)
    splits, cells = runs.splits(of, list(about), parts, {m: a["sum"] for m, a in about.items()}, median)
    split, n = _of(splits, "long"), _of(counts, "long")
    sides = ordered.sides_sums(split) | {"split": F.max(split), "n": F.max(n)}
    got = _rows(ordered.welch(ordered.strength_of(long.groupBy("metric").agg(*[c.alias(k) for k, c in sides.items()]))))
    mad = medians(long, F.abs(v - _of(median)), cells, counts)
    return {m: g for m, g in got.items() if g["split"] is not None}, median, mad


def seasons_and_outliers(long: DataFrame, about: dict[str, dict], median: dict[str, float], mad: dict[str, float], dated: bool) -> tuple[dict, dict]:
    """For each measure its outliers (count, top), and its sums by weekday and by month: {unit: {bucket: (n, sum)}}."""
    v, i = F.col("v"), F.col("i")
    score = F.try_divide(F.lit(spread.NORMAL) * F.abs(v - _of(median)), _of({m: x for m, x in mad.items() if about[m]["n"] >= spread.OUTLIER_POINTS}))
    far = score > spread.OUTLIER
    at = (lambda f: f(F.col("at")) if dated else F.lit(None).cast("int"))
    # of fixed width, so that it is counted in place without a sort; where the top lies is looked up after
    cut = long.groupBy("metric", at(spread.weekday).alias("weekday"), at(spread.month).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("sum"), F.sum(far.cast("long")).alias("count"), F.max(F.when(far, score)).alias("score")
    )
    tops: dict[str, dict] = {}
    buckets: dict[str, dict[str, dict[int, tuple[int, float]]]] = {}
    for r in cut.collect():  # at most 84 rows for each measure
        m = r["metric"]
        if r["count"]:
            had = tops.setdefault(m, {"count": 0, "score": 0.0})
            tops[m] = {"count": had["count"] + r["count"], "score": max(had["score"], r["score"])}
        for unit in ("weekday", "month"):
            if r[unit] is not None:
                own = buckets.setdefault(m, {}).setdefault(unit, {})
                n, s = own.get(r[unit], (0, 0.0))
                own[r[unit]] = (n + r["n"], s + r["sum"])
    if tops:
        top = F.min(F.struct("i", "v", "row_id", "label"))
        for r in long.where(score == _of({m: t["score"] for m, t in tops.items()})).groupBy("metric").agg(top.alias("top")).collect():
            t = tops[r["metric"]]
            t["top"] = r["top"].asDict() | {"score": t["score"], "median": median[r["metric"]]}
    return tops, buckets


def _any(marks: set[tuple[str, int]]) -> Column:
    """Whether a row is one of some points (metric, i)."""
    out = F.lit(False)
    for m in sorted({m for m, _ in marks}):
        out = out | ((F.col("metric") == m) & F.col("i").isin(sorted(i for x, i in marks if x == m)))
    return out


def marked(long: DataFrame, marks: set[tuple[str, int]]) -> tuple[dict[str, list[int]], dict[tuple[str, int], tuple]]:
    """The row ids of the first points of each series, and (label, row_id, v) of some hundred points."""
    first, labels = {}, {}
    for r in long.where((F.col("i") < groups.PROVENANCE) | _any(marks)).select("metric", "i", "row_id", "label", "v").collect():
        labels[r["metric"], r["i"]] = (r["label"], r["row_id"], r["v"])
        if r["i"] < groups.PROVENANCE:
            first.setdefault(r["metric"], []).append((r["i"], r["row_id"]))
    return {m: [x for _, x in sorted(rows)] for m, rows in first.items()}, labels


def buckets(about: dict[str, dict], most: int) -> dict[str, int]:
    """How many neighbouring points of each series a chart shows as one."""
    return {m: -(-a["n"] // most) for m, a in about.items()}


def points(long: DataFrame, sizes: dict[str, int], labels: dict[tuple[str, int], tuple]) -> dict[str, list[dict]]:
    """The means of neighbouring points of each series, as charts show them, with the label of the first of them."""
    rows = long.groupBy("metric", F.floor(F.col("i") / _of(sizes, "long")).alias("bucket")).agg(F.avg("v").alias("v"))
    out: dict[str, list[dict]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["metric"], r["bucket"])):
        size = sizes[r["metric"]]
        out.setdefault(r["metric"], []).append({"label": labels[r["metric"], r["bucket"] * size][0], "value": r["v"], "size": size})
    return out


# ---- pairs ----------------------------------------------------------------------------


def pairs(df: DataFrame, metrics: list[str]) -> tuple[dict[tuple[str, str], dict], bool]:
    """r, n and the line through all points of each pair, in one aggregation; and whether row ids count the rows from 0."""
    cells = [F.count(F.lit(1)).alias("rows"), F.min("row_id").alias("low"), F.max("row_id").alias("high")]
    both = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    for k, (a, b) in enumerate(both):
        x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
        ok = finite(x) & finite(y)
        x, y = F.when(ok, x), F.when(ok, y)
        of = {"n": F.count(x), "c": F.covar_pop(x, y), "vx": F.var_pop(x), "vy": F.var_pop(y), "mx": F.avg(x), "my": F.avg(y)}
        cells += [c.alias(f"{name}{k}") for name, c in of.items()]
    got = df.agg(*cells).first()
    out = {}
    for k, pair in enumerate(both):
        x = {name: got[f"{name}{k}"] for name in ("n", "c", "vx", "vy", "mx", "my")}
        wide = (x["vx"] or 0.0) * (x["vy"] or 0.0)
        slope = x["c"] / x["vx"] if x["vx"] else 0.0
        out[pair] = {
            "n": x["n"], "r": x["c"] / wide**0.5 if x["n"] >= 3 and wide > 0 else 0.0, "slope": slope,
            "intercept": x["my"] - slope * x["mx"] if x["n"] else 0.0, "whole": x["n"] == got["rows"],
        }
    return out, got["rows"] > 0 and got["low"] == 0 and got["high"] == got["rows"] - 1


def thinned(df: DataFrame, found: dict[tuple[str, str], dict], counted: bool, most: int) -> dict[tuple[str, str], dict]:
    """For each pair the row ids of its first points, and evenly thinned points (x, y), by row id.

    All pairs share one order of the rows; where row ids count them there is nothing to sort, and a pair that every row
    has is numbered as the rows are.
    """
    columns = list(dict.fromkeys(c for pair in found for c in pair))
    rows = df.select("row_id", *[F.col(f"`{c}`").cast("double").alias(f"m{k}") for k, c in enumerate(columns)])
    rows = rows.withColumn("i", F.col("row_id")) if counted else series.ordinals(rows, [], ["row_id"])
    at = {c: F.col(f"m{k}") for k, c in enumerate(columns)}
    gaps = {p: k for k, (p, x) in enumerate(found.items()) if not x["whole"]}
    flags = {f"ok{k}": (finite(at[p[0]]) & finite(at[p[1]])).cast("long") for p, k in gaps.items()}
    if flags:
        rows = series.prefix_sums(rows.withColumns(flags), [], {f"rank{k}": f"ok{k}" for k in gaps.values()})
    cells = []
    for k, (p, x) in enumerate(found.items()):
        i, n = F.col(f"rank{k}") if p in gaps else F.col("i"), x["n"]
        ok = F.col(f"ok{k}") == 1 if p in gaps else F.lit(True)
        # place j holds the point floor(j * n / most), so i is taken where some j falls on it
        j = F.ceil(i * most / n)
        taken = F.lit(True) if n <= most else (j < most) & (F.floor(j * n / most) == i)
        first = i < groups.PROVENANCE
        row = F.struct(F.lit(k).alias("pair"), i.alias("i"), at[p[0]].alias("x"), at[p[1]].alias("y"), taken.alias("taken"), first.alias("first"))
        cells.append(F.when(ok & (taken | first), row))
    some = F.filter(F.array(*cells), lambda c: c.isNotNull())
    got = rows.select("row_id", some.alias("some")).where(F.size("some") > 0).select("row_id", F.inline("some")).collect()
    out = {p: {"rows": [], "points": []} for p in found}
    names = list(found)
    for r in sorted(got, key=lambda r: (r["pair"], r["i"])):
        own = out[names[r["pair"]]]
        if r["first"]:
            own["rows"].append(r["row_id"])
        if r["taken"]:
            own["points"].append([r["x"], r["y"]])
    return out


# ---- categories -----------------------------------------------------------------------


def categories(df: DataFrame, names: list[str], metrics: list[str]) -> dict[tuple[str, str], list[dict]]:
    """The groups (key, sum, share) of each category and metric by falling sum, from one aggregation over grouping sets."""
    keys = {c: f"c{k}" for k, c in enumerate(names)}
    rows = df.select("row_id", *[F.col(f"`{c}`").cast("string").alias(k) for c, k in keys.items()], *[F.col(f"`{m}`").cast("double").alias(f"m{j}") for j, m in enumerate(metrics)])
    cells = []
    for j in range(len(metrics)):
        v = F.when(finite(F.col(f"m{j}")), F.col(f"m{j}"))
        cells += [F.sum(v).alias(f"s{j}"), F.count(v).alias(f"n{j}"), F.min(F.when(v.isNotNull(), F.col("row_id"))).alias(f"f{j}")]
    cut = rows.groupingSets([[F.col(k)] for k in keys.values()], *[F.col(k) for k in keys.values()])
    got = cut.agg(F.grouping_id().alias("set"), *cells).collect()  # categories have few groups
    out: dict[tuple[str, str], list[dict]] = {}
    last = len(names) - 1
    for k, c in enumerate(names):
        # the bits of the set stand for the columns that are rolled up, the first one in the highest
        own = [r for r in got if r["set"] == (1 << len(names)) - 1 - (1 << (last - k)) and r[keys[c]]]
        for j, m in enumerate(metrics):
            some = sorted((r for r in own if r[f"n{j}"]), key=lambda r: (-r[f"s{j}"], r[f"f{j}"]))  # noqa: B023
            total = sum(r[f"s{j}"] for r in some)
            out[c, m] = [{"key": r[keys[c]], "sum": r[f"s{j}"], "total": total, "share": r[f"s{j}"] / total * 100 if total else 0.0} for r in some]
    return out


def first_rows(df: DataFrame, wanted: list[tuple[str, str, list[str]]]) -> list[list[int]]:
    """The first row ids that have one of some keys of a category and a number in a metric, for each (category, metric,
    keys); the cut is made before rows are moved."""
    if not wanted:
        return []
    hits = [F.when(F.col(f"`{c}`").isin(keys) & finite(F.col(f"`{m}`").cast("double")), F.lit(k)) for k, (c, m, keys) in enumerate(wanted)]
    rows = df.select("row_id", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("fact"))
    # the first rows are mostly among those of small ids; only where these are too few all rows are ranked
    got = groups.provenance(rows.where(F.col("row_id") < EARLY), ["fact"], "row_id").collect()
    if Counter(r["fact"] for r in got) != dict.fromkeys(range(len(wanted)), groups.PROVENANCE):
        got = groups.provenance(rows, ["fact"], "row_id").collect()
    of = {k: sorted(r["row_id"] for r in own) for k, own in groupby(sorted(got, key=lambda r: r["fact"]), key=lambda r: r["fact"])}
    return [of.get(k, []) for k in range(len(wanted))]
