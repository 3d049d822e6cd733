"""Queries on profiles, series and their statistics, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.inference import critical, two_sided
from ..functions.numbers import half_up
from ..operators import groups, ordered, series, spread
from ..streaming import moments

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: half_up(F.col(c), digits) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def r(x: str, digits: int = 2) -> str:
    k = 10**digits
    return f"floor(({x}) * {float(k)} + 0.5) / {float(k)}"


# ---- profiles -------------------------------------------------------------------------

_DESCRIBED = ("min", "max", "sum", "mean", "median", "stdev", "q1", "q3")


def _describe_sql(v: str) -> str:
    return f"""count({v}) AS n, {r(f'min({v})')} AS "min", {r(f'max({v})')} AS "max", {r(f'sum({v})')} AS "sum",
      {r(f'avg({v})')} AS mean, {r(f'quantile_cont({v}, 0.5)')} AS median, {r(f'coalesce(stddev_samp({v}), 0)')} AS stdev,
      {r(f'quantile_cont({v}, 0.25)')} AS q1, {r(f'quantile_cont({v}, 0.75)')} AS q3"""


@query(f"SELECT {_describe_sql('o_totalprice')} FROM orders")
def describe_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("v"))
    return rounded(spread.describe(rows, []), 2, *_DESCRIBED)


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, {_describe_sql(m)} FROM lineitem" for m in MEASURES))
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.long_form(load(spark, sf_dir, "lineitem"), MEASURES, None, F.lit(0))
    return rounded(spread.describe(rows.select("metric", "v"), ["metric"]), 2, *_DESCRIBED)


_CATEGORIES = (("customer", "c_mktsegment"), ("customer", "c_name"), ("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderpriority"))


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT nullif({c}, '')) AS groups, count(*) AS "rows",
        count(DISTINCT nullif({c}, '')) BETWEEN 2 AND 40 AND count(DISTINCT nullif({c}, '')) < 0.8 * count(*) AS is_category FROM {t}"""
        for t, c in _CATEGORIES
    )
)
def distinct_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, c in _CATEGORIES:
        d = F.count_distinct(F.nullif(F.col(c), F.lit("")))
        one = load(spark, sf_dir, t).agg(F.lit(c).alias("column"), d.alias("groups"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    g = F.col("groups")
    return out.withColumn("is_category", g.between(2, 40) & (g < F.col("rows") * 0.8))


@query(
    f"""SELECT metric, {r('complete + least(coalesce(abs(stdev / nullif(mean, 0)), 0), 2)', 6)} AS score,
      CAST(row_number() OVER (ORDER BY {r('complete + least(coalesce(abs(stdev / nullif(mean, 0)), 0), 2)', 6)} DESC, metric) AS BIGINT) AS place
    FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, count({m}) / count(*) AS complete, avg({m}) AS mean, coalesce(stddev_samp({m}), 0) AS stdev FROM lineitem"
        for m in MEASURES
    )
    + ")"
)
def rank_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    df = load(spark, sf_dir, "lineitem")
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in MEASURES])).alias("p"))
    about = rows.select("p.*").groupBy("metric").agg(
        (F.count("v") / F.count(F.lit(1))).alias("complete"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("stdev")
    )
    score = F.col("complete") + F.least(F.coalesce(F.abs(F.try_divide("stdev", "mean")), F.lit(0.0)), F.lit(2.0))
    # one row for each measure
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), "metric")).cast("long")
    return about.select("metric", half_up(score, 6).alias("score")).withColumn("place", place)


@query(
    """SELECT CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS BIGINT) AS days,
      CASE WHEN date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) > 900 THEN 'year'
           WHEN date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) > 120 THEN 'month' ELSE 'day' END AS unit,
      count(o_orderdate) >= 0.7 * count(*) AS is_axis FROM orders"""
)
def axis_span_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    out = load(spark, sf_dir, "orders").agg(
        F.date_diff(F.max(d), F.min(d)).cast("long").alias("days"), (F.count(d) >= F.count(F.lit(1)) * 0.7).alias("is_axis")
    )
    return out.withColumn("unit", F.when(F.col("days") > 900, "year").when(F.col("days") > 120, "month").otherwise("day"))


# ---- series ---------------------------------------------------------------------------


def monthly(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    """Orders by month as a series."""
    df = load(spark, sf_dir, "orders")
    if by:
        df = df.join(load(spark, sf_dir, "customer"), df["o_custkey"] == F.col("c_custkey"))
    rows = df.groupBy(*(by or []), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("at")).agg(F.sum("o_totalprice").alias("v"))
    return series.ordinals(rows.withColumn("row_id", F.unix_date("at").cast("long")), by or [], ["at"])


def daily(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    """Mean event values by day as a series."""
    rows = load(spark, sf_dir, "events").groupBy(*(by or []), F.col("ts").cast("date").alias("at")).agg(F.avg("value").alias("v"))
    return series.ordinals(rows.withColumn("row_id", F.unix_date("at").cast("long")), by or [], ["at"])


_MONTHLY = """s AS (SELECT row_number() OVER (ORDER BY d) - 1 AS i, d, v FROM (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1))"""
_DAILY = """s AS (SELECT row_number() OVER (ORDER BY d) - 1 AS i, d, v FROM (
  SELECT CAST(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY 1))"""
_DAILY_BY = """s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY d) - 1 AS i, d, v FROM (
  SELECT event_type, CAST(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY 1, 2))"""
_BY_SEGMENT = """s AS (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY d) - 1 AS i, d, v FROM (
  SELECT c_mktsegment, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, sum(o_totalprice) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))"""


@query(f'WITH {_MONTHLY} SELECT CAST(i AS BIGINT) AS i, d AS "at", {r("v")} AS v FROM s')
def series_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(longs(monthly(spark, sf_dir), "i").select("i", "at", "v"), 2, "v")


_PCT = "CASE WHEN {a} = 0 THEN 0 ELSE ({b} - {a}) / abs({a}) * 100 END"
_LINE = f"""line AS (SELECT count(*) AS n, coalesce(covar_pop(v, i) / nullif(var_pop(i), 0), 0) AS slope, avg(v) AS mean, avg(i) AS mx,
  greatest(0, coalesce(covar_pop(v, i) ** 2 / nullif(var_pop(i) * var_pop(v), 0), 0)) AS r2,
  greatest(0, var_pop(v) - coalesce(covar_pop(v, i) ** 2 / nullif(var_pop(i), 0), 0)) AS rest, var_pop(i) AS vx,
  arg_min(v, i) AS a, arg_max(v, i) AS b FROM s),
tested AS (SELECT *, sqrt(rest * n / greatest(1, n - 2) / nullif(vx * n, 0)) AS se FROM line)"""


@query(
    f"""WITH {_MONTHLY}, {_LINE} SELECT n, {r('slope')} AS slope, {r('mean - slope * mx')} AS intercept, {r('r2', 6)} AS r2,
      {r('mean')} AS mean, {r('a')} AS "first", {r('b')} AS "last", {r(_PCT.format(a='a', b='b'))} AS change_pct,
      CASE WHEN {_PCT.format(a='a', b='b')} > 3 THEN 'up' WHEN {_PCT.format(a='a', b='b')} < -3 THEN 'down' ELSE 'flat' END AS direction,
      n >= 5 AS passes_gate FROM line"""
)
def trend_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ordered.trend(monthly(spark, sf_dir), [])
    t = t.withColumn("direction", F.when(F.col("change_pct") > 3, "up").when(F.col("change_pct") < -3, "down").otherwise("flat"))
    t = t.select("n", "slope", "intercept", "r2", "mean", "first", "last", "change_pct", "direction", (F.col("n") >= 5).alias("passes_gate"))
    return rounded(rounded(t, 2, "slope", "intercept", "mean", "first", "last", "change_pct"), 6, "r2")


_CRIT = "(1.959963985 + (1.959963985 ** 3 + 1.959963985) / (4 * (n - 2)) + (5 * 1.959963985 ** 5 + 16 * 1.959963985 ** 3 + 3 * 1.959963985) / (96 * (n - 2) ** 2))"


@query(
    f"""WITH {_MONTHLY}, {_LINE} SELECT n - 2 AS df, {r('se', 4)} AS se, {r('slope / nullif(se, 0)', 6)} AS t,
      {r(f'slope - {_CRIT} * se')} AS low, {r(f'slope + {_CRIT} * se')} AS high FROM tested"""
)
def trend_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ordered.trend(monthly(spark, sf_dir), []).withColumn("c", critical(F.col("df")))
    t = t.select("df", "se", "t", (F.col("slope") - F.col("c") * F.col("se")).alias("low"), (F.col("slope") + F.col("c") * F.col("se")).alias("high"))
    return rounded(rounded(rounded(t, 4, "se"), 6, "t"), 2, "low", "high")


_SIMPSON = """(1 - 2 * (SELECT sum((CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
    * (1 + (t * k / 2000.0) ** 2 / df) ** (-(df + 1) / 2.0)) * (t / 2000.0) / 3
    * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) FROM range(2001) g(k)))"""


@query(
    f"""WITH {_MONTHLY}, {_LINE}, x AS (SELECT CAST(n - 2 AS DOUBLE) AS df, abs(slope / nullif(se, 0)) AS t FROM tested)
    SELECT {r(_SIMPSON, 5)} AS p FROM x"""
)
def trend_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ordered.trend(monthly(spark, sf_dir), [])
    return t.select(half_up(two_sided(F.col("t"), F.col("df")), 5).alias("p"))


@query(
    f"""WITH s AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
    line AS (SELECT user_id, count(*) AS n, covar_pop(v, i) AS c, var_pop(i) AS vx, var_pop(v) AS vy FROM s GROUP BY 1),
    tested AS (SELECT user_id, n, CAST(n - 2 AS DOUBLE) AS df, abs(c / vx / sqrt(greatest(0, vy - c * c / vx) / (n - 2) / vx)) AS t FROM line WHERE n >= 5)
    SELECT user_id, n, {r('t', 6)} AS t, {r(_SIMPSON, 7)} AS p FROM tested"""
)
def user_trend_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend of each user's values, tested: p-values of as many series as there are users."""
    rows = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("v"))
    t = ordered.trend(series.ordinals(rows, ["user_id"], ["ts", "event_id"]), ["user_id"]).where(F.col("n") >= ordered.TREND_POINTS)
    return t.select("user_id", "n", half_up(F.abs("t"), 6).alias("t"), half_up(two_sided(F.col("t"), F.col("df")), 7).alias("p"))


def _change_sql(series_sql: str, by: str) -> str:
    comma, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    same = f"AND s.{by} = best.{by}" if by else ""
    return f"""WITH {series_sql}, w AS (SELECT *, sum(v) OVER ({part} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
      sum(v) OVER ({part}) AS total, count(*) OVER ({part}) AS n FROM s),
    g AS (SELECT *, i * (l / i - total / n) ** 2 + (n - i) * ((total - l) / (n - i) - total / n) ** 2 AS gain FROM w WHERE n >= 10 AND i BETWEEN 3 AND n - 3),
    best AS (SELECT {comma}i AS split, n FROM g QUALIFY row_number() OVER ({part} ORDER BY gain DESC, i) = 1),
    sides AS (SELECT {f's.{by}, ' if by else ''}max(best.n) AS n, max(split) AS split,
      count(*) FILTER (i < split) AS n1, avg(v) FILTER (i < split) AS m1, var_samp(v) FILTER (i < split) AS v1,
      count(*) FILTER (i >= split) AS n2, avg(v) FILTER (i >= split) AS m2, var_samp(v) FILTER (i >= split) AS v2
      FROM s, best WHERE true {same} {f'GROUP BY s.{by}' if by else ''}),
    strong AS (SELECT *, abs(m1 - m2) / nullif(sqrt((v1 * (n1 - 1) + v2 * (n2 - 1)) / (n - 2)), 0) AS strength FROM sides)"""


def _change_row(by: str) -> str:
    return f"""SELECT {f'{by}, ' if by else ''}CAST(n AS BIGINT) AS n, CAST(split AS BIGINT) AS split, {r('m1', 4)} AS "before", {r('m2', 4)} AS "after",
      {r('strength', 6)} AS strength, coalesce(strength >= 0.8, false) AS passes_gate FROM strong"""


def _change(rows: DataFrame, by: list[str]) -> DataFrame:
    c = ordered.changepoint(rows, by).withColumn("passes_gate", F.coalesce(F.col("strength") >= ordered.CHANGE_STRENGTH, F.lit(False)))
    return rounded(rounded(longs(c.select(*by, "n", "split", "before", "after", "strength", "passes_gate"), "n", "split"), 4, "before", "after"), 6, "strength")


@query(f"{_change_sql(_DAILY, '')} {_change_row('')}")
def changepoint_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _change(daily(spark, sf_dir), [])


@query(f"{_change_sql(_DAILY_BY, 'event_type')} {_change_row('event_type')}")
def changepoint_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _change(daily(spark, sf_dir, ["event_type"]), ["event_type"])


@query(
    f"""{_change_sql(_DAILY, '')} SELECT CAST(split AS BIGINT) AS split, {r('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)', 6)} AS welch_t,
      {r('(v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))', 4)} AS welch_df FROM strong"""
)
def welch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered.welch(ordered.changepoint(daily(spark, sf_dir), []))
    return rounded(rounded(longs(w.select("split", "welch_t", "welch_df"), "split"), 6, "welch_t"), 4, "welch_df")


@query(
    f"""WITH m AS (SELECT median(value) AS med FROM events), d AS (SELECT median(abs(value - med)) AS mad FROM events, m)
    SELECT event_id, {r('value', 4)} AS v, {r('med', 4)} AS median, {r('0.6745 * abs(value - med) / mad', 4)} AS score
    FROM events, m, d WHERE 0.6745 * abs(value - med) / nullif(mad, 0) > 3.5"""
)
def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_id", F.col("value").alias("v"))
    return rounded(spread.outliers(rows, []).select("event_id", "v", "median", "score"), 4, "v", "median", "score")


def _streak_sql(series_sql: str, by: str) -> str:
    part, comma = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f"""WITH {series_sql}, m AS (SELECT *, lag(v) OVER ({part} ORDER BY i) AS was FROM s),
    d AS (SELECT *, CAST(sign(v - was) AS INTEGER) AS sg FROM m),
    t AS (SELECT *, CASE WHEN sg IS NOT DISTINCT FROM lag(sg) OVER ({part} ORDER BY i) THEN 0 ELSE 1 END AS turn FROM d),
    u AS (SELECT *, sum(turn) OVER ({part} ORDER BY i) AS run FROM t),
    x AS (SELECT {comma}run, count(*) AS moves, min(i) - 1 AS start, max(sg) AS "sign", arg_min(was, i) AS a, arg_max(v, i) AS b
      FROM u WHERE sg <> 0 GROUP BY {comma}run)
    SELECT {comma}CAST(start AS BIGINT) AS start, CAST(moves AS BIGINT) AS moves, "sign", {r(_PCT.format(a='a', b='b'))} AS change_pct
    FROM x QUALIFY row_number() OVER ({part} ORDER BY moves DESC, start) = 1 AND moves >= 3"""


@query(_streak_sql(_MONTHLY, ""))
def longest_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(longs(ordered.streak(monthly(spark, sf_dir), []), "start", "moves"), 2, "change_pct")


@query(_streak_sql(_BY_SEGMENT, "c_mktsegment"))
def streak_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["c_mktsegment"]
    return rounded(longs(ordered.streak(monthly(spark, sf_dir, by), by), "start", "moves"), 2, "change_pct")


@query(
    f"""SELECT event_type, count(value) AS n, {r('avg(value)', 4)} AS mean, {r('stddev_samp(value)', 4)} AS stdev,
      {r('stddev_samp(value) / nullif(abs(avg(value)), 0)', 6)} AS cv,
      count(value) >= 8 AND avg(value) <> 0 AND stddev_samp(value) / nullif(abs(avg(value)), 0) > 0.45 AS passes_gate FROM events GROUP BY 1"""
)
def volatility_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_type", F.col("value").alias("v"))
    return rounded(rounded(spread.volatility(rows, ["event_type"]), 4, "mean", "stdev"), 6, "cv")


@query(
    f"""WITH {_MONTHLY} SELECT count(*) AS n, {r('max(v)')} AS "max", {r('min(v)')} AS "min", {r('sum(v)')} AS "sum",
      (SELECT CAST(i AS BIGINT) FROM s ORDER BY v DESC, i LIMIT 1) AS i FROM s"""
)
def extreme_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ordered.peak(monthly(spark, sf_dir), []).select("n", "max", "min", "sum", F.col("at").cast("long").alias("i"))
    return rounded(p, 2, "max", "min", "sum")


def _season_sql(bucket: str) -> str:
    return f"""WITH b AS (SELECT {bucket} AS bucket, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1 HAVING count(*) >= 2)
    SELECT count(*) AS buckets, CAST(arg_max(bucket, mean) AS BIGINT) AS best, {r('max(mean)')} AS best_mean,
      CAST(arg_min(bucket, mean) AS BIGINT) AS worst, {r('min(mean)')} AS worst_mean,
      {r('(max(mean) - min(mean)) / abs(min(mean)) * 100', 4)} AS spread_pct, count(*) >= 4 AND (max(mean) - min(mean)) / abs(min(mean)) * 100 >= 15 AS passes_gate FROM b"""


def _season(spark: SparkSession, sf_dir: str, of) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("at"), F.col("o_totalprice").alias("v"))
    s = spread.season_range(spread.seasons(rows, [], of(F.col("at"))), [])
    s = s.withColumn("passes_gate", (F.col("buckets") >= spread.BUCKETS) & (F.col("spread_pct") >= spread.SEASON_SPREAD))
    return rounded(rounded(longs(s, "buckets", "best", "worst"), 2, "best_mean", "worst_mean"), 4, "spread_pct")


@query(_season_sql("dayofweek(o_orderdate)"))
def seasonal_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _season(spark, sf_dir, spread.weekday)


@query(_season_sql("month(o_orderdate) - 1"))
def seasonal_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _season(spark, sf_dir, spread.month)


@query(
    f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1),
    s AS (SELECT row_number() OVER (ORDER BY d) - 1 AS i, d, v, count(*) OVER () AS n FROM d)
    SELECT CAST(floor(i / ceil(n / 120)) AS BIGINT) AS bucket, {r('avg(v)')} AS v, min(d) AS "at" FROM s GROUP BY 1"""
)
def line_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("at")).agg(F.sum("o_totalprice").alias("v"))
    rows = series.ordinals(rows.withColumns({"label": F.col("at"), "row_id": F.unix_date("at").cast("long")}), [], ["at"])
    out = groups.thinned_line(rows, most=120)
    return rounded(out.select(F.col("bucket").cast("long").alias("bucket"), "v", F.col("label").alias("at")), 2, "v")


# ---- states of days -------------------------------------------------------------------


@query(
    f"""WITH e AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT event_type, count(*) AS n, {r('covar_pop(v, i) / var_pop(i)', 8)} AS slope, {r('covar_pop(v, i) ** 2 / var_pop(i) / var_pop(v)', 8)} AS r2,
      {r('avg(v)', 6)} AS mean, {r('arg_min(v, i)', 6)} AS "first", {r('arg_max(v, i)', 6)} AS "last" FROM e GROUP BY 1"""
)
def merged_day_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends of whole series from the merged states of their days."""
    days = moments.day_states(load(spark, sf_dir, "events"), ["event_type"], "ts", "event_id", "value")
    out = moments.trends(moments.merged(days, ["event_type"], moved=True), ["event_type"])
    out = out.select("event_type", "n", "slope", "r2", "mean", "first", "last")
    return rounded(rounded(out, 8, "slope", "r2"), 6, "mean", "first", "last")


@query(
    f"""SELECT l_returnflag, count(*) AS n, {r('corr(l_quantity, l_extendedprice)', 8)} AS r FROM lineitem GROUP BY 1"""
)
def merged_day_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations from the merged co-moments of days."""
    lines = load(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    days = moments.states(lines, ["l_returnflag", "day"], "l_quantity", "l_extendedprice")
    return rounded(moments.correlations(moments.merged(days, ["l_returnflag"]), ["l_returnflag"]).drop("p"), 8, "r")
