"""The fact ledger: what can be said about a table, ranked.

Statistics are Spark aggregations over the whole table; what comes back is a few rows for each of at
most eight measures, and only from these the facts are put into words, on the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import display as show
from ..functions.inference import correlation_p, t_critical, t_two_sided
from ..functions.numbers import finite
from ..operators import groups, ordered, series, spread
from ..session import checkpoint
from ..sources.delimited import InputError, Table
from . import charts, passes

#: How many measures get series facts, correlations and category facts, and category columns (fixed values).
SERIES_MEASURES, PAIR_MEASURES, CATEGORY_MEASURES, CATEGORIES = 6, 8, 2, 2
#: Shares of rows that make a column an axis, and the bounds of categories (fixed values).
DATE_AXIS, LABEL_AXIS, LEAST_GROUPS, MOST_GROUPS, GROUP_SHARE = 0.7, 0.9, 2, 40, 0.8
#: What a question that names a column adds (fixed value).
BOOST = 18
_ID_LIKE = re.compile(r"(^|_)(id|uuid|index|row|#)$", re.I)

SCHEMA = (
    "id string, seq int, kind string, headline string, statement string, importance int, columns array<string>, "
    "values map<string,double>, evidence string, source_rows array<bigint>, "
    "confidence struct<level:string,note:string,ci95:array<double>,p_value:double>, "
    "period struct<from:string,to:string>, category string, chart string"
)


@dataclass
class Fact:
    kind: str
    headline: str
    statement: str
    importance: float
    columns: list[str]
    values: dict[str, float]
    evidence: str = ""
    source_rows: list[int] = field(default_factory=list)
    confidence: dict | None = None
    period: dict | None = None
    category: str | None = None
    chart: str | None = None
    id: str = ""
    seq: int = 0


@dataclass
class Axis:
    kind: str  # date, label or index
    column: str | None = None
    unit: str = "day"
    days: int = 0

    def at(self) -> Column | None:
        return F.col(f"`{self.column}`") if self.kind == "date" else None

    def label(self, at: str | None = None) -> Column:
        """A row's name, made of the axis' column or, if it is given, of the column that holds at()."""
        fallback = F.concat(F.lit("row "), (F.col("row_id") + 1).cast("string"))
        if self.kind == "index":
            return F.concat(F.lit("#"), (F.col("row_id") + 1).cast("string"))
        c = F.col(f"`{at or self.column}`")
        if self.kind == "date":
            c = F.date_format(c, {"year": "yyyy", "month": "MMM yyyy", "day": "MMM d, yyyy"}[self.unit])
        return F.coalesce(c, fallback)


def is_id_like(name: str) -> bool:
    return bool(_ID_LIKE.search(name))


def asked(question: str | None, column: str) -> bool:
    """Whether a question names a column, or a longer word of its name."""
    q, name = (question or "").lower(), column.lower()
    return bool(q) and ((len(name) >= 3 and name in q) or any(len(t) >= 4 and t in q for t in re.split(r"[\s_\-/]+", name)))


def profile(table: Table) -> dict:
    """Everything that the plan is made from, in one aggregation."""
    cells = [F.count(F.lit(1)).alias("rows")]
    for i, (c, kind) in enumerate(table.kinds.items()):
        x = F.col(f"`{c}`")
        if kind == "number":
            x = F.when(finite(x), x)
            cells += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
        elif kind == "date":
            cells += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        elif kind == "string":
            # only small counts matter, and whether nearly all values differ
            cells.append(F.approx_count_distinct(F.nullif(x, F.lit("")), 0.02).alias(f"d{i}"))
    got = table.df.agg(*cells).first().asDict()
    out = {"rows": got["rows"], "columns": {}}
    for i, (c, kind) in enumerate(table.kinds.items()):
        out["columns"][c] = {"kind": kind} | {k: got.get(f"{k}{i}") for k in ("n", "m", "s", "lo", "hi", "d")}
    # near the bounds the estimate is not good enough
    near = lambda d: d <= 2 * MOST_GROUPS or abs(d - LABEL_AXIS * got["rows"]) <= 0.1 * got["rows"] or abs(d - GROUP_SHARE * got["rows"]) <= 0.1 * got["rows"]
    close = [c for c, p in out["columns"].items() if p["d"] is not None and near(p["d"])]
    if close:
        exact = table.df.agg(*[F.count_distinct(F.nullif(F.col(f"`{c}`"), F.lit(""))).alias(f"d{i}") for i, c in enumerate(close)]).first()
        for i, c in enumerate(close):
            out["columns"][c]["d"] = exact[i]
    return out


def axis_of(p: dict) -> Axis:
    columns, rows = p["columns"], max(1, p["rows"])
    dated = next((c for c, x in columns.items() if x["kind"] == "date"), None)
    if dated and columns[dated]["n"] >= DATE_AXIS * rows:
        days = (columns[dated]["hi"] - columns[dated]["lo"]).days
        return Axis("date", dated, show.granularity(days), days)
    named = next((c for c, x in columns.items() if x["kind"] == "string" and x["d"] >= LABEL_AXIS * rows), None)
    return Axis("label", named) if named else Axis("index")


def measures_of(p: dict, question: str | None) -> list[str]:
    """Measures by completeness, variation and whether the question names them."""

    def score(c: str) -> float:
        x = p["columns"][c]
        cv = abs((x["s"] or 0.0) / x["m"]) if x["m"] else 0.0
        return (x["n"] or 0) / max(1, p["rows"]) + min(cv, 2.0) + 10.0 * asked(question, c)

    return sorted((c for c, x in p["columns"].items() if x["kind"] == "number" and not is_id_like(c)), key=lambda c: -score(c))


def _clamped(x: float, high: float) -> float:
    return max(0.0, min(high, x))


def _level(p: float, high: bool) -> str:
    return "high" if p < 0.01 and high else "medium" if p < 0.05 else "low"


@dataclass
class Emitter:
    """What a user adds to a ledger: aggregates over the rows (metric, i, v, row_id, at, label) of the series, which go
    into the one aggregation that all series facts come from, and the facts that are made of a measure's values."""

    aggregates: dict[str, Column]
    facts: Callable[[str, dict], list[Fact]]


def _series_facts(table: Table, axis: Axis, metrics: list[str], emitters: Sequence[Emitter] = (), whole: set[str] = frozenset()) -> list[Fact]:
    # only labels that are cells are written down
    label = axis.label() if axis.kind == "label" else None
    both = series.together(table.df, metrics, axis.at(), F.col("row_id"), label, whole)
    long = both.long(None if axis.kind == "label" else axis.label("at"))
    about = passes.sums(long, {k: c for e in emitters for k, c in e.aggregates.items()})
    about = {m: a for m, a in about.items() if a["n"] >= 3}
    if not about:
        return []
    metrics = [m for m in metrics if m in about]
    long = long.where(F.col("metric").isin(metrics))
    parts, streaks, cells = passes.streaks(both, about)
    changes, median, mad = passes.levels(both, long, about, parts, cells)
    tops, buckets = passes.seasons_and_outliers(long, about, median, mad, axis.kind == "date")
    # provenance: the first rows of each series and the labels at its ends and breaks, and of the points of charts
    sizes = passes.buckets(about, charts.LINE_POINTS)
    marks = {(m, i) for m in metrics for i in (*_marks(about[m], changes.get(m), streaks.get(m)), *range(0, about[m]["n"], sizes[m]))}
    first, labels = passes.marked(long, marks)
    season = _seasons(axis, about, buckets)
    points = passes.points(long, sizes, labels)
    facts = []
    for m in metrics:
        d, own = about[m], first[m]
        n = d["n"]
        span = {"from": labels[m, 0][0], "to": labels[m, n - 1][0]}
        if n >= ordered.TREND_POINTS:
            facts.append(_trend(m, d, own, span))
            facts[-1].chart = charts.line(points[m], d["slope"], d["intercept"])
        c = changes.get(m)
        if c and c["strength"] is not None and c["strength"] >= ordered.CHANGE_STRENGTH:
            where, _, value = labels[m, c["split"]]
            facts.append(_change(m, c, own, span, where))
            facts[-1].chart = charts.line(points[m], mark=(c["split"], value, where))
        if m in tops:
            top = tops[m]["top"]
            facts.append(_outlier(m, tops[m]))
            facts[-1].chart = charts.line(points[m], mark=(top["i"], top["v"], top["label"]))
        s = streaks.get(m)
        if s and s["moves"] >= 4:
            facts.append(_streak(m, s, own, labels))
        cv = d["stdev"] / abs(d["mean"]) if d["mean"] else 0.0
        if n >= 8 and d["mean"] and cv > spread.VOLATILE:
            facts.append(
                Fact("volatility", f"{m} varies widely", f"{m} ranges from {show.number(d['min'])} to {show.number(d['max'])} around a mean of {show.number(d['mean'])}.",
                     _clamped(28 + 18 * cv, 62), [m], {"min": d["min"], "max": d["max"], "mean": show.half_up(d["mean"], 2), "cv": show.half_up(cv, 2)}, "Standard deviation against the mean.")
            )
        facts.append(
            Fact("extreme", f"{m} peaked at {show.number(d['max'])}", f"{m} was highest at {labels[m, d['at']][0]} with {show.number(d['max'])}; the lowest value is {show.number(d['min'])}.",
                 20, [m], {"max": d["max"], "min": d["min"], "sum": show.half_up(d["sum"], 2)}, "Largest value of the series.", [labels[m, d["at"]][1]])
        )
        if m in season:
            facts.append(_season(m, season[m], axis))
        for e in emitters:
            facts += e.facts(m, {k: d[k] for k in e.aggregates} | {"n": n})
    return facts


def _marks(d: dict, change: dict | None, run: dict | None) -> set[int]:
    out = {0, d["n"] - 1, d["at"]}
    if change:
        out.add(change["split"])
    if run:
        # a run's rows, as many as a fact keeps
        out.update(range(run["start"], run["start"] + min(run["moves"], groups.PROVENANCE) + 1))
        out.add(run["start"] + run["moves"])
    return out


def _trend(m: str, t: dict, rows: list[int], span: dict) -> Fact:
    pct, r2 = t["change_pct"], t["r2"]
    way = "up" if pct > 3 else "down" if pct < -3 else "flat"
    p = t_two_sided(t["t"], t["df"]) if t["t"] is not None else (0.0 if t["slope"] else 1.0)
    crit = t_critical(t["df"])
    ci = [show.half_up(t["slope"] + s * crit * t["se"], 4) for s in (-1, 1)]
    steady = "steadily " if r2 >= 0.55 else ""
    said = {
        "up": f"{m} rose {steady}from {show.number(t['first'])} to {show.number(t['last'])} ({show.percent(pct)}).",
        "down": f"{m} fell {steady}from {show.number(t['first'])} to {show.number(t['last'])} ({show.percent(pct)}).",
        "flat": f"{m} held near {show.number(t['mean'])} over {t['n']} points.",
    }[way]
    values = {"first": t["first"], "last": t["last"], "changePct": show.half_up(pct, 2), "r2": show.half_up(r2, 2), "points": t["n"], "mean": show.half_up(t["mean"], 2)}
    note = f"Slope of a line over {t['n']} points, p {show.chance(p)}."
    importance = 24 if way == "flat" else _clamped(48 + min(30, abs(pct) / 4) + 18 * r2, 96)
    confidence = {"level": _level(p, t["n"] >= 8), "note": note, "ci95": ci, "p_value": show.half_up(p, 3)}
    return Fact("trend", f"{m} {'is flat' if way == 'flat' else 'went ' + way}", said, importance, [m], {k: float(v) for k, v in values.items()}, "Least squares on the order of points.", rows, confidence, span)


def _change(m: str, c: dict, rows: list[int], span: dict, where: str) -> Fact:
    s, a, b = c["strength"], c["before"], c["after"]
    pct = (b - a) / abs(a) * 100 if a else 0.0
    p = t_two_sided(c["welch_t"], c["welch_df"]) if c["welch_t"] is not None else None
    level = "low" if p is None else "high" if p < 0.01 and s >= 1.5 else "medium" if p < 0.05 else "low"
    confidence = {"level": level, "note": "Welch's test of the two levels; the split was searched for.", "ci95": None, "p_value": None if p is None else show.half_up(p, 3)}
    way = "rose" if b > a else "fell"
    values = {"before": show.half_up(a, 2), "after": show.half_up(b, 2), "shiftPct": show.half_up(pct, 2), "effectSize": show.half_up(s, 2)}
    return Fact("changepoint", f"{m} changed level", f"From {where} on the level of {m} {way} from {show.number(a)} to {show.number(b)}.", _clamped(46 + 9 * s, 90), [m], values, "Split that explains most of the variance.", rows, confidence, span)


def _outlier(m: str, o: dict) -> Fact:
    t = o["top"]
    values = {"value": t["v"], "median": show.half_up(t["median"], 2), "zScore": show.half_up(t["score"], 2), "anomalies": float(o["count"])}
    confidence = {"level": "high" if t["score"] >= 5 else "medium", "note": "Modified z-score against the median deviation.", "ci95": None, "p_value": None}
    return Fact("outlier", f"{m} has an outlier", f"At {t['label']} {m} was {show.number(t['v'])}, far from its median of {show.number(t['median'])}.", _clamped(40 + 4 * t["score"], 82), [m], values, "Median absolute deviation.", [t["row_id"]], confidence)


def _streak(m: str, s: dict, rows: list[int], labels: dict) -> Fact:
    way = "rises" if s["sign"] > 0 else "falls"
    a, b = s["start"], s["start"] + s["moves"]
    run = [labels[m, i][1] for i in range(a, min(b, a + groups.PROVENANCE - 1) + 1)]
    values = {"length": float(s["moves"]), "changePct": show.half_up(s["change_pct"], 2)}
    period = {"from": labels[m, a][0], "to": labels[m, b][0]}
    return Fact("streak", f"{s['moves']} {way} in a row", f"{m} had {s['moves']} {way} in a row ({show.percent(s['change_pct'])}).", _clamped(24 + 3 * s["moves"], 58), [m], values, "Longest run of moves one way.", run[: groups.PROVENANCE], None, period)


def _seasons(axis: Axis, about: dict[str, dict], buckets: dict) -> dict[str, dict]:
    """For each measure with a seasonal pattern its range over weekdays, or else months."""
    out = {}
    for unit in ("weekday", "month"):
        for m, of in buckets.items():
            n = about[m]["n"]
            fits = (axis.days / n <= 3 and axis.days >= 56) if unit == "weekday" else (axis.days / n >= 20 and axis.days >= 700)
            means = {b: s / k for b, (k, s) in sorted(of.get(unit, {}).items()) if k >= spread.BUCKET_VALUES}
            if m in out or n < spread.SEASON_POINTS or not fits or len(means) < spread.BUCKETS:
                continue
            best, worst = max(means, key=means.get), min(means, key=means.get)  # the first of equal ones
            if not means[worst]:
                continue
            pct = (means[best] - means[worst]) / abs(means[worst]) * 100
            if pct >= spread.SEASON_SPREAD:
                out[m] = {"best": best, "best_mean": means[best], "worst": worst, "worst_mean": means[worst], "spread_pct": pct, "unit": unit, "means": means}
    return out


def _season(m: str, s: dict, axis: Axis) -> Fact:
    days = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
    name = lambda i: days[i] if s["unit"] == "weekday" else show.MONTHS[i]
    values = {"best": show.half_up(s["best_mean"], 2), "worst": show.half_up(s["worst_mean"], 2), "spreadPct": show.half_up(s["spread_pct"], 2)}
    return Fact("seasonal", f"{m} follows the {s['unit']}", f"{m} is highest on average in {name(s['best'])} ({show.number(s['best_mean'])}) and lowest in {name(s['worst'])} ({show.number(s['worst_mean'])}).", _clamped(30 + 0.35 * s["spread_pct"], 72), [m], values, f"Means by {s['unit']}.", chart=charts.bars([name(b) for b in sorted(s["means"])], [s["means"][b] for b in sorted(s["means"])]))


def _pair_facts(table: Table, metrics: list[str]) -> list[Fact]:
    if len(metrics) < 2:
        return []
    facts = []
    found, counted = passes.pairs(table.df, metrics)
    found = {p: x for p, x in found.items() if abs(x["r"]) >= groups.CORRELATED and x["n"] >= groups.CORRELATED_PAIRS}
    shown = passes.thinned(table.df, found, counted, charts.SCATTER_POINTS) if found else {}
    for (a, b), x in found.items():
        r, n = x["r"], x["n"]
        p = correlation_p(r, n)
        word = "tightly" if abs(r) >= 0.85 else "closely" if abs(r) >= 0.7 else "loosely"
        how = "together" if r > 0 else "in opposite directions"
        confidence = {"level": _level(p, n >= 10), "note": f"Pearson's r over {n} pairs, p {show.chance(p)}.", "ci95": None, "p_value": show.half_up(p, 3)}
        facts.append(
            Fact("correlation", f"{a} and {b} move {how}", f"{a} and {b} move {word} {how} (r = {show.fixed(show.half_up(r, 2), 2)}).", _clamped(34 + 44 * abs(r), 86), [a, b],
                 {"r": show.half_up(r, 2), "n": float(n)}, "Pearson correlation.", shown[a, b]["rows"], confidence, chart=charts.scatter(shown[a, b]["points"], x["slope"], x["intercept"]))
        )
    return facts


def _category_facts(table: Table, categories: list[str], metrics: list[str]) -> list[Fact]:
    if not categories:
        return []
    found, facts, wanted = passes.categories(table.df, categories, metrics), [], []
    for (c, m), got in found.items():
        total = got[0]["total"] if got else 0
        if len(got) < 2 or not total:
            continue
        top, second = got[0], got[1]
        lead = top["sum"] / second["sum"] if second["sum"] else 0.0
        more = f", {show.number(lead)} times the runner-up {second['key']}" if lead > 1.15 else ""
        values = {"leader": show.half_up(top["sum"], 2), "share": show.half_up(top["share"], 2), "runnerUp": show.half_up(second["sum"], 2), "groups": float(len(got)), "leadRatio": show.half_up(lead, 2)}
        facts.append(
            Fact("category_leader", f"{top['key']} leads {m}", f"{top['key']} has {show.fixed(top['share'], 1)}% of {m} by {c}{more}.", _clamped(38 + 0.4 * top["share"], 84), [c, m], values, f"Sums by {c}.", category=top["key"], chart=charts.parts("bar", [(r["key"], r["sum"]) for r in got], charts.BARS))
        )
        wanted.append((c, m, [top["key"]]))
        share = sum(r["sum"] for r in got[:3]) / total * 100
        if len(got) > groups.MANY_GROUPS and share > groups.CONCENTRATED:
            facts.append(
                Fact("concentration", f"{m} is concentrated", f"The top 3 of {len(got)} values of {c} have {show.fixed(share, 1)}% of {m}.", _clamped(34 + 0.42 * share, 80), [c, m],
                     {"topShare": show.half_up(share, 2), "topN": 3.0, "groups": float(len(got))}, f"Shares by {c}.", chart=charts.parts("donut", [(r["key"], r["sum"]) for r in got], charts.SLICES))
            )
            wanted.append((c, m, [r["key"] for r in got[:3]]))
    for f, rows in zip(facts, passes.first_rows(table.df, wanted), strict=True):
        f.source_rows = rows
    return facts


def facts_of(table: Table, question: str | None = None, emitters: Sequence[Emitter] = ()) -> list[Fact]:
    """The ranked facts of a table; ids number them in the order in which they were found.

    emitters add facts of their own about each measure without another pass over the table.
    """
    p = profile(table)
    if not p["rows"]:
        raise InputError("the table has no rows")
    axis, metrics = axis_of(p), measures_of(p, question)
    span = ""
    if axis.kind == "date":
        x = p["columns"][axis.column]
        span = f", from {show.date(x['lo'], axis.unit)} to {show.date(x['hi'], axis.unit)}"
    facts = [
        Fact("overview", "What was analysed", f"{p['rows']} rows and {len(p['columns'])} columns{span}.", 10, [], {"rows": float(p["rows"]), "columns": float(len(p["columns"]))}, "Counts.")
    ]
    if metrics:
        categories = [
            c for c, x in p["columns"].items()
            if x["kind"] == "string" and LEAST_GROUPS <= x["d"] <= MOST_GROUPS and x["d"] < GROUP_SHARE * p["rows"]
        ][:CATEGORIES]
        # what facts are made of is written down once: the table is read and parsed for this and for its profile only
        own = dict.fromkeys([*([axis.column] if axis.column else []), *metrics[:PAIR_MEASURES], *categories])
        table = replace(table, df=checkpoint(table.df.select("row_id", *[F.col(f"`{c}`") for c in own])))
        facts += _series_facts(table, axis, metrics[:SERIES_MEASURES], emitters, {c for c in metrics if p["columns"][c]["n"] == p["rows"]})
        facts += _pair_facts(table, metrics[:PAIR_MEASURES])
        facts += _category_facts(table, categories, metrics[:CATEGORY_MEASURES])
    for i, f in enumerate(facts):
        f.seq, f.id = i + 1, f"F{i + 1}"
        if f.kind != "overview":
            more = BOOST if any(asked(question, c) for c in f.columns) else 0
            f.importance = _clamped(math.floor(f.importance + 0.5) + more, 100)
        f.importance = int(f.importance)
    return sorted(facts, key=lambda f: (-f.importance, f.seq))


def to_frame(spark: SparkSession, facts: list[Fact]) -> DataFrame:
    names = StructType.fromDDL(SCHEMA).names
    return spark.createDataFrame([tuple(asdict(f)[n] for n in names) for f in facts], SCHEMA)


def analyze(table: Table, question: str | None = None) -> DataFrame:
    """The ledger as a DataFrame."""
    return to_frame(table.df.sparkSession, facts_of(table, question))


def without_charts(ledger: DataFrame) -> DataFrame:
    return ledger.drop("chart")


