"""Queries on whole ledgers, scenes and verdicts, and the SQL that says the same."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..operators import ordered, series
from ..sources import delimited
from . import ledger, proof, story, verify
from .queries_series import _CRIT, _PCT, _SIMPSON, load, longs, r

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# ---- the SQL of a ledger --------------------------------------------------------------


@dataclass
class Source:
    """A table for the SQL: rows (row_id, at_day, measures, categories), and what the engine sees of its columns."""

    rows: str
    measures: tuple[str, ...]
    categories: tuple[str, ...] = ()
    asked: tuple[str, ...] = ()


def _fact(kind: str, columns: str, importance: str, block: str, values: dict[str, str]) -> str:
    """The SELECT list of a fact: block is its place among the facts as they are found."""
    pairs = ", ".join(f"{{'name': '{k}', 'value': CAST({v} AS DOUBLE)}}" for k, v in values.items())
    return f"'{kind}' AS kind, {columns} AS columns, CAST({importance} AS DOUBLE) AS score, {block} AS block, [{pairs}] AS vals"


def _clamp(x: str, high: float) -> str:
    return f"greatest(0, least({high}, {x}))"


def ledger_sql(s: Source) -> str:
    """CTEs up to facts (place, id, kind, columns, importance, vals), the ranked ledger of a table on a date axis."""
    names = {m: i for i, m in enumerate(s.measures)}
    long = " UNION ALL ".join(f"SELECT '{m}' AS metric, {i} AS at_column, {m} AS v, at_day, row_id FROM t" for m, i in names.items())
    asked = ", ".join(f"'{m}'" for m in s.asked) or "''"
    day = "date_diff('day', (SELECT min(at_day) FROM t), (SELECT max(at_day) FROM t))"
    pct = _PCT.format(a="a", b="b")
    season = lambda bucket: f"""SELECT metric, count(*) AS buckets, max(mean) AS best, min(mean) AS worst, (max(mean) - min(mean)) / abs(min(mean)) * 100 AS spread
      FROM (SELECT metric, {bucket} AS b, avg(v) AS mean FROM s GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1"""  # noqa: E731
    pairs = [(a, b) for i, a in enumerate(s.measures) for b in s.measures[i + 1 :]]
    found = [
        f"""SELECT {_fact('overview', "''", '10', '[0, 0, 0, 0]', {'rows': 'count(*)', 'columns': str(len(s.measures) + len(s.categories) + 1)})} FROM t""",
        f"""SELECT {_fact('trend', 'metric', f"CASE WHEN {pct} BETWEEN -3 AND 3 THEN 24 ELSE {_clamp(f'48 + least(30, abs({pct}) / 4) + 18 * r2', 96)} END",
            '[1, place, 1, 0]', {'first': 'a', 'last': 'b', 'changePct': r(pct), 'r2': r('r2'), 'points': 'n', 'mean': r('mean')})} FROM line JOIN m USING (metric) WHERE n >= 5""",
        f"""SELECT {_fact('changepoint', 'metric', _clamp('46 + 9 * strength', 90), '[1, place, 2, 0]',
            {'before': r('m1'), 'after': r('m2'), 'shiftPct': r('CASE WHEN m1 = 0 THEN 0 ELSE (m2 - m1) / abs(m1) * 100 END'), 'effectSize': r('strength')})}
          FROM strong JOIN m USING (metric) WHERE strength >= 0.8""",
        f"""SELECT {_fact('outlier', 'metric', _clamp('40 + 4 * score', 82), '[1, place, 3, 0]',
            {'value': 'v', 'median': r('med'), 'zScore': r('score'), 'anomalies': 'anomalies'})} FROM far JOIN m USING (metric) WHERE nth = 1""",
        f"""SELECT {_fact('streak', 'metric', _clamp('24 + 3 * moves', 58), '[1, place, 4, 0]', {'length': 'moves', 'changePct': r(pct)})}
          FROM runs JOIN m USING (metric) WHERE nth = 1 AND moves >= 4""",
        f"""SELECT {_fact('volatility', 'metric', _clamp('28 + 18 * sd / abs(mean)', 62), '[1, place, 5, 0]',
            {'min': 'low', 'max': 'high', 'mean': r('mean'), 'cv': r('sd / abs(mean)')})} FROM about JOIN m USING (metric) WHERE n >= 8 AND mean <> 0 AND sd / abs(mean) > 0.45""",
        f"""SELECT {_fact('extreme', 'metric', '20', '[1, place, 6, 0]', {'max': 'high', 'min': 'low', 'sum': r('total')})} FROM about JOIN m USING (metric) WHERE n >= 3""",
        f"""SELECT {_fact('seasonal', 'metric', _clamp('30 + 0.35 * spread', 72), '[1, place, 7, 0]',
            {'best': r('best'), 'worst': r('worst'), 'spreadPct': r('spread')})} FROM season JOIN m USING (metric)""",
    ]
    sort = lambda a, b: f"CASE WHEN x.place < y.place THEN '{a},{b}' ELSE '{b},{a}' END"
    for a, b in pairs:
        c = f"coalesce(covar_pop({a}, {b}) / nullif(sqrt(var_pop({a}) * var_pop({b})), 0), 0)"
        found.append(
            f"""SELECT {_fact('correlation', sort(a, b), _clamp('34 + 44 * abs(c)', 86), '[2, least(x.place, y.place), greatest(x.place, y.place), 0]', {'r': r('c'), 'n': 'n'})}
            FROM (SELECT {c} AS c, count(*) AS n FROM t), m x, m y WHERE x.metric = '{a}' AND y.metric = '{b}' AND abs(c) >= 0.55 AND n >= 6"""
        )
    for i, category in enumerate(s.categories):
        for name in s.measures:
            groups = f"""(SELECT *, row_number() OVER (ORDER BY s DESC) AS nth, sum(s) OVER () AS total, count(*) OVER () AS n
              FROM (SELECT {category} AS key, sum({name}) AS s FROM t GROUP BY 1))"""
            of = f"max(s) FILTER (nth = %d)"  # noqa: F541
            share = f"{of % 1} / max(total) * 100"
            top = "sum(s) FILTER (nth <= 3) / max(total) * 100"
            found.append(
                f"""SELECT {_fact('category_leader', f"'{category},{name}'", _clamp(f'38 + 0.4 * {share}', 84), f"[3, {i}, (SELECT place FROM m WHERE metric = '{name}'), 0]",
                {'leader': r(of % 1), 'share': r(share), 'runnerUp': r(of % 2), 'groups': 'max(n)', 'leadRatio': r(f'{of % 1} / {of % 2}')})}
                FROM {groups} HAVING max(n) >= 2 AND max(total) <> 0 AND (SELECT place FROM m WHERE metric = '{name}') <= 2"""
            )
            found.append(
                f"""SELECT {_fact('concentration', f"'{category},{name}'", _clamp(f'34 + 0.42 * {top}', 80), f"[3, {i}, (SELECT place FROM m WHERE metric = '{name}'), 1]",
                {'topShare': r(top), 'topN': '3', 'groups': 'max(n)'})}
                FROM {groups} HAVING max(n) > 4 AND {top} > 55 AND (SELECT place FROM m WHERE metric = '{name}') <= 2"""
            )
    boosted = " OR ".join(f"list_contains(string_split(columns, ','), '{c}')" for c in s.asked) or "false"
    return f"""WITH t AS ({s.rows}),
    s AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY at_day, row_id) - 1 AS i FROM ({long})),
    about AS (SELECT metric, any_value(at_column) AS at_column, count(*) AS n, min(v) AS low, max(v) AS high, sum(v) AS total, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd FROM s GROUP BY 1),
    m AS (SELECT metric, row_number() OVER (ORDER BY n / (SELECT count(*) FROM t) + least(coalesce(abs(sd / nullif(mean, 0)), 0), 2)
      + CASE WHEN metric IN ({asked}) THEN 10 ELSE 0 END DESC, at_column) AS place FROM about),
    line AS (SELECT metric, count(*) AS n, avg(v) AS mean, greatest(0, coalesce(covar_pop(v, i) ** 2 / nullif(var_pop(i) * var_pop(v), 0), 0)) AS r2,
      arg_min(v, i) AS a, arg_max(v, i) AS b FROM s GROUP BY 1),
    w AS (SELECT *, sum(v) OVER (PARTITION BY metric ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
      sum(v) OVER (PARTITION BY metric) AS total, count(*) OVER (PARTITION BY metric) AS n FROM s),
    g AS (SELECT *, i * (l / i - total / n) ** 2 + (n - i) * ((total - l) / (n - i) - total / n) ** 2 AS gain FROM w WHERE n >= 10 AND i BETWEEN 3 AND n - 3),
    best AS (SELECT metric, i AS split, n FROM g QUALIFY row_number() OVER (PARTITION BY metric ORDER BY gain DESC, i) = 1),
    sides AS (SELECT s.metric, max(n) AS n, avg(v) FILTER (i < split) AS m1, avg(v) FILTER (i >= split) AS m2, count(*) FILTER (i < split) AS n1,
      count(*) FILTER (i >= split) AS n2, var_samp(v) FILTER (i < split) AS v1, var_samp(v) FILTER (i >= split) AS v2 FROM s JOIN best ON s.metric = best.metric GROUP BY 1),
    strong AS (SELECT *, abs(m1 - m2) / nullif(sqrt((v1 * (n1 - 1) + v2 * (n2 - 1)) / (n - 2)), 0) AS strength FROM sides),
    med AS (SELECT metric, median(v) AS med, count(*) AS n FROM s GROUP BY 1),
    mad AS (SELECT metric, any_value(med) AS med, median(abs(v - med)) AS mad FROM s JOIN med USING (metric) WHERE n >= 8 GROUP BY 1),
    far AS (SELECT *, count(*) OVER (PARTITION BY metric) AS anomalies, row_number() OVER (PARTITION BY metric ORDER BY score DESC, i) AS nth
      FROM (SELECT metric, i, v, med, 0.6745 * abs(v - med) / nullif(mad, 0) AS score FROM s JOIN mad USING (metric)) WHERE score > 3.5),
    d AS (SELECT *, CAST(sign(v - was) AS INTEGER) AS sg FROM (SELECT *, lag(v) OVER (PARTITION BY metric ORDER BY i) AS was FROM s)),
    u AS (SELECT *, sum(turn) OVER (PARTITION BY metric ORDER BY i) AS run FROM
      (SELECT *, CASE WHEN sg IS NOT DISTINCT FROM lag(sg) OVER (PARTITION BY metric ORDER BY i) THEN 0 ELSE 1 END AS turn FROM d)),
    runs AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY moves DESC, start) AS nth FROM
      (SELECT metric, run, count(*) AS moves, min(i) AS start, arg_min(was, i) AS a, arg_max(v, i) AS b FROM u WHERE sg <> 0 GROUP BY 1, 2)),
    weekly AS ({season('dayofweek(at_day)')}), yearly AS ({season('month(at_day)')}),
    season AS (SELECT * EXCLUDE (n) FROM weekly JOIN (SELECT metric, n FROM about) USING (metric) WHERE n >= 20 AND {day} / n <= 3 AND {day} >= 56 AND buckets >= 4 AND spread >= 15
      UNION ALL SELECT * EXCLUDE (n) FROM yearly JOIN (SELECT metric, n FROM about) USING (metric) WHERE n >= 20 AND {day} / n >= 20 AND {day} >= 700 AND buckets >= 4 AND spread >= 15),
    found AS ({' UNION ALL '.join(found)}),
    numbered AS (SELECT *, row_number() OVER (ORDER BY block) AS seq,
      least(100, greatest(0, floor(score + 0.5) + CASE WHEN {boosted} THEN 18 ELSE 0 END)) AS importance FROM found),
    facts AS (SELECT row_number() OVER (ORDER BY importance DESC, seq) AS place, 'F' || seq AS id, kind, columns, CAST(importance AS INTEGER) AS importance, vals FROM numbered)"""


_VALUES = f"""SELECT place, id, kind, columns, importance, x.name AS name, {r('x.value')} AS value FROM (SELECT * EXCLUDE (vals), unnest(vals) AS x FROM facts)"""


def values_of(facts: DataFrame) -> DataFrame:
    """A ledger's facts in their order, a row for each value."""
    place = F.row_number().over(Window.orderBy(F.col("importance").desc(), "seq"))  # a ledger has some hundred rows at most
    rows = facts.withColumn("place", place.cast("long")).withColumn("columns", F.array_join("columns", ","))
    rows = rows.select("place", "id", "kind", "columns", "importance", F.explode("values").alias("name", "value"))
    return rows.withColumn("value", half_up(F.col("value"), 2))


# ---- ledgers --------------------------------------------------------------------------


def orders_table(spark: SparkSession, sf_dir: str) -> delimited.Table:
    """Monthly orders with a few measures, as the engine takes them."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    df = load(spark, sf_dir, "orders").groupBy(month.alias("month")).agg(
        F.sum("o_totalprice").alias("total_price"), F.avg("o_totalprice").alias("mean_price"), F.count(F.lit(1)).alias("order_count")
    )
    return delimited.from_frame(df.withColumn("row_id", F.unix_date("month")), "row_id", "orders")


_ORDERS = """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS at_day, epoch(date_trunc('month', o_orderdate)) AS row_id, sum(o_totalprice) AS total_price,
  avg(o_totalprice) AS mean_price, CAST(count(*) AS DOUBLE) AS order_count FROM orders GROUP BY 1, 2"""
_ORDER_MEASURES = ("total_price", "mean_price", "order_count")
_ASKED = ledger_sql(Source(_ORDERS, _ORDER_MEASURES, asked=("total_price", "mean_price")))


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger itself, with statements, evidence and charts."""
    return ledger.analyze(orders_table(spark, sf_dir), "how did total_price develop?")


@query(f"{_ASKED} {_VALUES}")
def fact_ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values_of(orders_ledger(spark, sf_dir))


def _shown(x: str) -> str:
    """A number of at least 1 as statements have it."""
    fixed = lambda v, k: rf"regexp_replace(printf('%.{k}f', {v}), '\.?0+$', '')"
    big = " ".join(f"WHEN abs({x}) >= {low} THEN concat({fixed(f'{x} / {unit}', k)}, '{name}')" for low, unit, k, name in ((1e9, 1e9, 2, "B"), (1e6, 1e6, 2, "M"), (1e4, 1e3, 1, "K")))
    return f"CASE {big} WHEN abs({x}) >= 100 THEN {fixed(x, 1)} ELSE {fixed(x, 2)} END"


@query(
    f"""{_ASKED}, x AS (SELECT metric, count(*) AS n, covar_pop(v, i) / var_pop(i) AS slope, avg(v) AS mean, var_pop(i) AS vx, covar_pop(v, i) ** 2 / var_pop(i) / var_pop(v) AS r2,
      greatest(0, var_pop(v) - covar_pop(v, i) ** 2 / var_pop(i)) AS rest, arg_min(v, i) AS a, arg_max(v, i) AS b, min(at_day) AS first_day, max(at_day) AS last_day FROM s GROUP BY 1),
    y AS (SELECT *, sqrt(rest / (n - 2) / vx) AS se, {_PCT.format(a='a', b='b')} AS pct FROM x),
    z AS (SELECT *, CAST(n - 2 AS DOUBLE) AS df, abs(slope / se) AS t FROM y), told AS (SELECT *, greatest(0, {_SIMPSON}) AS p FROM z)
    SELECT metric, CASE WHEN pct BETWEEN -3 AND 3 THEN concat(metric, ' held near ', {_shown('mean')}, ' over ', n, ' points.')
        ELSE concat(metric, CASE WHEN pct > 3 THEN ' rose ' ELSE ' fell ' END, CASE WHEN r2 >= 0.55 THEN 'steadily ' ELSE '' END, 'from ', {_shown('a')}, ' to ', {_shown('b')},
          ' (', CASE WHEN pct > 0 THEN '+' ELSE '' END, {_shown('pct')}, '%).') END AS statement,
      CASE WHEN p < 0.01 AND n >= 8 THEN 'high' WHEN p < 0.05 THEN 'medium' ELSE 'low' END AS level, {r(f'slope - {_CRIT} * se', 4)} AS low95, {r(f'slope + {_CRIT} * se', 4)} AS high95, {r('p', 3)} AS p_value,
      CASE WHEN last_day - first_day > 900 THEN strftime(first_day, '%Y') WHEN last_day - first_day > 120 THEN strftime(first_day, '%b %Y') ELSE strftime(first_day, '%b %-d, %Y') END AS begins,
      CASE WHEN last_day - first_day > 900 THEN strftime(last_day, '%Y') WHEN last_day - first_day > 120 THEN strftime(last_day, '%b %Y') ELSE strftime(last_day, '%b %-d, %Y') END AS ends, least(200, n) AS source_rows FROM told WHERE n >= 5"""
)
def trend_facts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ledger of monthly orders says of trends, in words, with confidence, period and provenance."""
    c = F.col("confidence")
    return orders_ledger(spark, sf_dir).where("kind = 'trend'").select(
        F.get("columns", F.lit(0)).alias("metric"), "statement", c["level"].alias("level"), F.get(c["ci95"], F.lit(0)).alias("low95"), F.get(c["ci95"], F.lit(1)).alias("high95"),
        c["p_value"].alias("p_value"), F.col("period.from").alias("begins"), F.col("period.to").alias("ends"), F.size("source_rows").cast("long").alias("source_rows"),
    )


_LINES = """SELECT CAST(l_shipdate AS DATE) AS at_day, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net_price,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS row_id FROM lineitem"""


@query(f"{ledger_sql(Source(_LINES, ('l_quantity', 'l_extendedprice', 'net_price'), ('l_returnflag', 'l_linestatus')))} {_VALUES}")
def fact_ledger_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a whole table: category columns, correlations and series over all its rows."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    df = series.ordinals(load(spark, sf_dir, "lineitem"), [], order, "row_id").select(
        "row_id", "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice",
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("net_price"),
    )
    return values_of(ledger.analyze(delimited.from_frame(df, "row_id", "lineitem")))


# ---- scenes and verdicts --------------------------------------------------------------

_ARC = "[" + ", ".join(f"'{k}'" for k in story.ARC) + "]"


@query(
    f"""WITH RECURSIVE {ledger_sql(Source(_ORDERS, _ORDER_MEASURES)).removeprefix('WITH ')},
    pool AS (SELECT *, string_split(columns, ',')[1] AS first, row_number() OVER (ORDER BY place) AS k FROM facts WHERE kind <> 'overview' AND importance >= 20),
    steps AS (SELECT 0 AS k, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS kinds, CAST([] AS VARCHAR[]) AS firsts
      UNION ALL SELECT pool.k, CASE WHEN fits THEN list_append(ids, id) ELSE ids END, CASE WHEN fits THEN list_append(kinds, kind) ELSE kinds END,
        CASE WHEN fits THEN list_append(firsts, first) ELSE firsts END
      FROM steps JOIN pool ON pool.k = steps.k + 1, LATERAL (SELECT len(ids) < 7 AND len(list_filter(kinds, lambda x: x = kind)) < 2 AND len(list_filter(firsts, lambda x: x = first)) < 3 AS fits)),
    done AS (SELECT ids FROM steps ORDER BY k DESC LIMIT 1),
    rest AS (SELECT id FROM pool, done WHERE NOT list_contains(ids, id) ORDER BY place LIMIT (SELECT greatest(0, 3 - len(ids)) FROM done))
    SELECT CAST(row_number() OVER (ORDER BY list_position({_ARC}, kind), importance DESC, place) AS BIGINT) AS scene, id, kind, columns, importance
    FROM pool WHERE id IN (SELECT unnest(ids) FROM done) OR id IN (SELECT id FROM rest)"""
)
def scene_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = story.select_scenes(ledger.facts_of(orders_table(spark, sf_dir)))
    rows = [(i + 1, f.id, f.kind, ",".join(f.columns), f.importance) for i, f in enumerate(scenes)]  # seven at most
    return spark.createDataFrame(rows, "scene long, id string, kind string, columns string, importance int")


_NATION_SERIES = """WITH RECURSIVE months AS (SELECT c_nationkey AS nation, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total_price, avg(o_totalprice) AS mean_price,
    CAST(count(*) AS DOUBLE) AS order_count, max(o_totalprice) AS top_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  s AS (SELECT nation, metric, pos, v, row_number() OVER (PARTITION BY nation, metric ORDER BY month) - 1 AS i FROM
    (SELECT nation, month, 'total_price' AS metric, 0 AS pos, total_price AS v FROM months UNION ALL SELECT nation, month, 'mean_price', 1, mean_price FROM months
     UNION ALL SELECT nation, month, 'order_count', 2, order_count FROM months UNION ALL SELECT nation, month, 'top_price', 3, top_price FROM months)),
  line AS (SELECT nation, metric, any_value(pos) AS pos, count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd, arg_min(v, i) AS a, arg_max(v, i) AS b,
    greatest(0, coalesce(covar_pop(v, i) ** 2 / nullif(var_pop(i) * var_pop(v), 0), 0)) AS r2 FROM s GROUP BY 1, 2)"""
_NATION_PCT = _PCT.format(a="a", b="b")


@query(
    f"""{_NATION_SERIES},
    scored AS (SELECT nation, 3 * pos + 1 AS seq, 'trend' AS kind, metric, CASE WHEN {_NATION_PCT} BETWEEN -3 AND 3 THEN 24 ELSE {_clamp(f'48 + least(30, abs({_NATION_PCT}) / 4) + 18 * r2', 96)} END AS score FROM line WHERE n >= 5
      UNION ALL SELECT nation, 3 * pos + 2, 'volatility', metric, {_clamp('28 + 18 * sd / abs(mean)', 62)} FROM line WHERE n >= 8 AND mean <> 0 AND sd / abs(mean) > 0.2
      UNION ALL SELECT nation, 3 * pos + 3, 'extreme', metric, 20 FROM line WHERE n >= 3),
    pool AS (SELECT nation, seq, kind, metric, CAST(floor(score + 0.5) AS BIGINT) AS importance, row_number() OVER (PARTITION BY nation ORDER BY floor(score + 0.5) DESC, seq) AS k FROM scored),
    steps AS (SELECT DISTINCT nation, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS seqs, CAST([] AS VARCHAR[]) AS kinds, CAST([] AS VARCHAR[]) AS firsts FROM pool
      UNION ALL SELECT pool.nation, pool.k, CASE WHEN fits THEN list_append(seqs, seq) ELSE seqs END, CASE WHEN fits THEN list_append(kinds, kind) ELSE kinds END,
        CASE WHEN fits THEN list_append(firsts, metric) ELSE firsts END
      FROM steps JOIN pool ON pool.nation = steps.nation AND pool.k = steps.k + 1,
      LATERAL (SELECT len(seqs) < 7 AND len(list_filter(kinds, lambda x: x = kind)) < 2 AND len(list_filter(firsts, lambda x: x = metric)) < 3 AS fits)),
    done AS (SELECT nation, arg_max(seqs, k) AS seqs FROM steps GROUP BY 1),
    taken AS (SELECT pool.* FROM pool JOIN done ON pool.nation = done.nation AND list_contains(seqs, seq))
    SELECT nation, CAST(row_number() OVER (PARTITION BY nation ORDER BY list_position({_ARC}, kind), importance DESC, seq) AS BIGINT) AS scene, CAST(seq AS BIGINT) AS seq, kind, metric, importance FROM taken"""
)
def nation_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes of every nation's ledger of monthly orders, all ledgers at once."""
    both = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    price, names = F.col("o_totalprice"), ["total_price", "mean_price", "order_count", "top_price"]
    months = both.groupBy(F.col("c_nationkey").alias("nation"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(
        F.sum(price).alias("total_price"), F.avg(price).alias("mean_price"), F.count(F.lit(1)).alias("order_count"), F.max(price).alias("top_price")
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for i, m in enumerate(names)]))
    long = series.ordinals(months.select("nation", "month", pairs.alias("p")).select("nation", "month", "p.*"), ["nation", "metric"], ["month"])
    line = long.groupBy("nation", "metric", "at").agg(*[c.alias(k) for k, c in ordered.trend_sums().items()], F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))
    line, pct = ordered.trend_of(line), F.col("change_pct")
    clamped = lambda x, high: F.greatest(F.lit(0.0), F.least(F.lit(float(high)), x))
    cv = F.try_divide("sd", F.abs(F.col("mean")))
    score = {
        "trend": F.when(F.col("n") >= 5, F.when(pct.between(-3, 3), 24.0).otherwise(clamped(48 + F.least(F.lit(30.0), F.abs(pct) / 4) + 18 * F.col("r2"), 96))),
        "volatility": F.when((F.col("n") >= 8) & (cv > 0.2), clamped(28 + 18 * cv, 62)),
        "extreme": F.when(F.col("n") >= 3, F.lit(20.0)),
    }
    facts = F.explode(F.array(*[F.struct((3 * F.col("at") + k + 1).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.floor(x + 0.5).alias("importance")) for k, (kind, x) in enumerate(score.items())]))
    ledgers = line.select("nation", F.array("metric").alias("columns"), facts.alias("f")).select("nation", "columns", "f.*").where("importance IS NOT NULL")
    out = story.scenes_of_ledgers(ledgers, ["nation"])
    return longs(out.select("nation", "scene", "seq", "kind", F.get("columns", F.lit(0)).alias("metric"), "importance"), "scene", "importance")


#: What is wrong with each case: another source, a broken proof or fact, a claim or text without support, no proof.
_CASES = (
    ("untouched", 0, 0, 0, 0), ("without proof", 0, 0, 0, 1), ("other source", 1, 0, 0, 0), ("other source and key", 1, 1, 0, 0), ("other key", 0, 1, 0, 0),
    ("changed fact", 0, 1, 0, 1), ("turned claim", 0, 0, 1, 1), ("wrong number", 0, 0, 1, 1), ("wrong word", 0, 0, 1, 1), ("signed wrong word", 0, 0, 1, 0), ("no facts", 0, 1, 0, 1),
)


@query(
    f"""SELECT name, CASE WHEN source = 1 THEN 'SOURCE_MISMATCH' WHEN broken = 1 THEN 'TAMPERED' WHEN unsupported = 1 THEN 'UNSUPPORTED_CLAIM'
      WHEN bare = 1 THEN 'LEGACY_UNVERIFIED' ELSE 'VERIFIED' END AS verdict FROM (VALUES {', '.join(map(str, _CASES))}) c(name, source, broken, unsupported, bare)"""
)
def forgery_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts on a story of all months, as it was made and forged in many ways."""
    rows = orders_table(spark, sf_dir).df.orderBy("month").collect()  # a row for each month
    lines = [f"{x['month']},{x['total_price']:.2f},{x['order_count']:.0f}" for x in rows]
    source = "\n".join(["month,total_price,order_count", *lines])
    signer, stranger = proof.new_signer(spark), proof.new_signer(spark)
    made = story.create(delimited.from_text(spark, source, "orders"), source, signer=signer)
    other = "\n".join(["month,total_price,order_count", *lines[:-1], lines[-1] + "0"])
    bare = {k: v for k, v in made.items() if k != "proof"}
    at = next(i for i, s in enumerate(made["scenes"]) if s["kind"] == "insight" and s["claim"]["direction"] in ("up", "down"))
    way = made["scenes"][at]["claim"]["direction"]
    against = "It plunged and slumped." if way == "up" else "It soared and surged."
    scene = lambda **more: {"scenes": [s | more if i == at else s for i, s in enumerate(made["scenes"])]}
    claim = made["scenes"][at]["claim"] | {"direction": "down" if way == "up" else "up"}
    worded = bare | scene(headline="So it went", body=against)
    cases = {
        "untouched": (source, made),
        "without proof": (source, bare),
        "other source": (other, made),
        "other source and key": (other, bare | {"proof": proof.sign(source, bare, stranger, "factloom")}),
        "other key": (source, bare | {"proof": proof.sign(source, bare, stranger, "factloom")}),
        "changed fact": (source, bare | {"facts": [f | {"values": {k: v + 1 for k, v in f["values"].items()}} for f in made["facts"]]}),
        "turned claim": (source, bare | scene(claim=claim)),
        "wrong number": (source, bare | scene(body="It came to 987654321.")),
        "wrong word": (source, worded),
        "signed wrong word": (source, worded | {"proof": proof.sign(source, worded, signer, "factloom")}),
        "no facts": (source, {k: v for k, v in bare.items() if k != "facts"}),
    }
    # all stories but that of the other source are held against facts that are computed from the source once more
    fresh = verify.recompute(spark, source, "orders")
    verdicts = [(name, verify.verify(spark, s, x, {signer.public_key}, fresh=fresh).verdict) for name, (s, x) in cases.items()]
    return spark.createDataFrame(verdicts, "name string, verdict string")


_MEASURES = """SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total_price, avg(o_totalprice) AS mean_price, min(o_totalprice) AS least_price,
  max(o_totalprice) AS top_price, count(*) AS order_count, count(DISTINCT o_custkey) AS buyers, avg(o_custkey) AS mean_key, max(o_orderkey) AS last_key,
  stddev_samp(o_totalprice) AS price_range, min(o_orderpriority) AS priority, min(o_custkey) AS first_key FROM orders GROUP BY 1"""


@query(
    f"""SELECT column_name AS named, CASE WHEN column_name = 'total_price' OR column_type NOT IN ('DOUBLE', 'BIGINT', 'INTEGER', 'HUGEINT') THEN 'VERIFIED'
      ELSE 'UNSUPPORTED_CLAIM' END AS verdict FROM (DESCRIBE {_MEASURES})"""
)
def metric_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts on a signed story whose scene about total_price is rewritten to name each column in turn."""
    price, key = F.col("o_totalprice"), F.col("o_custkey")
    months = load(spark, sf_dir, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(
        F.sum(price).alias("total_price"), F.avg(price).alias("mean_price"), F.min(price).alias("least_price"), F.max(price).alias("top_price"),
        F.count(F.lit(1)).alias("order_count"), F.count_distinct(key).alias("buyers"), F.avg(key).alias("mean_key"), F.max("o_orderkey").alias("last_key"),
        F.stddev_samp(price).alias("price_range"), F.min("o_orderpriority").alias("priority"), F.min(key).alias("first_key"),
    )
    rows = months.orderBy("month").collect()  # a row for each month
    source = "\n".join([",".join(months.columns), *(",".join(map(str, x)) for x in rows)])
    asked, signer = "total_price?", proof.new_signer(spark)
    table = delimited.from_text(spark, source, "orders")
    made = story.create(table, source, asked, signer=signer)
    fresh = verify.Recomputed([verify.fact_of(f) for f in made["facts"]], table.of_kind("number"))
    fact = next(f for f in fresh.facts if f.columns == ["total_price"])
    at = max(i for i, s in enumerate(made["scenes"]) if s["kind"] == "insight")
    out = []
    for c in table.kinds:
        scene = {"kind": "insight", "headline": "So it went", "body": f"Look at {c}.", "factIds": [fact.id], "claim": story.claim(fact)}
        bare = {k: v for k, v in made.items() if k != "proof"} | {"scenes": [*made["scenes"][:at], scene, *made["scenes"][at + 1 :]]}
        forged = bare | {"proof": proof.sign(source, bare, signer, "factloom")}
        out.append((c, verify.verify(spark, source, forged, {signer.public_key}, fresh=fresh).verdict))
    return spark.createDataFrame(out, "named string, verdict string")
