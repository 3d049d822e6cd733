"""Queries on groups, cells, texts, ledgers and events, and the SQL that says the same."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, prose
from ..operators import groups
from ..session import new_folder
from ..sources import delimited
from ..streaming import events as streams
from . import story, verify
from .queries_series import load, longs, r, rounded

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else text(v) if isinstance(v, str) else f"DATE '{v}'" if isinstance(v, dt.date) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, row)) + ')' for row in rows)}) t({columns})"


# ---- pairs and groups -----------------------------------------------------------------

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_net"]


def _pair_sql(table: str, names: list[str], aliases: dict[str, str]) -> str:
    of = lambda c: aliases.get(c, c)
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, {r(f'coalesce(covar_pop({of(a)}, {of(b)}) / nullif(sqrt(var_pop({of(a)}) * var_pop({of(b)})), 0), 0)', 6)} AS r,
        count(*) AS n FROM {table}"""
        for j, b in enumerate(names)
        for a in names[:j]
    )


@query(
    f"""SELECT *, abs(r) >= 0.55 AND n >= 6 AS passes_gate FROM ({_pair_sql('lineitem', _NUMBERS, {'l_net': '(l_extendedprice * (1 - l_discount))'})}
    UNION ALL {_pair_sql('part', ['p_partkey', 'p_size', 'p_retailprice'], {})})"""
)
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").withColumn("l_net", F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")))
    both = groups.correlations(lines, _NUMBERS).unionByName(groups.correlations(load(spark, sf_dir, "part"), ["p_partkey", "p_size", "p_retailprice"]))
    out = rounded(both, 6, "r")
    return out.withColumn("passes_gate", (F.abs(F.col("r")) >= groups.CORRELATED) & (F.col("n") >= groups.CORRELATED_PAIRS))


@query("SELECT 'o_totalprice' AS a, 'same' AS b, 0.0::DOUBLE AS r, count(*) AS n FROM orders UNION ALL SELECT 'o_totalprice', 'two', 0.0, 2 FROM (SELECT max(o_orderkey) FROM orders)")
def correlation_constant_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant column, and one of which all but two rows are null, correlate with nothing."""
    orders = load(spark, sf_dir, "orders")
    ends = orders.agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))  # one row
    df = orders.crossJoin(F.broadcast(ends)).select(
        "o_totalprice", (F.col("o_orderkey") * 0 + 7).cast("double").alias("same"), F.when(F.col("o_orderkey").isin(F.col("low"), F.col("high")), F.col("o_orderkey")).alias("two")
    )
    return groups.correlations(df, ["o_totalprice", "same", "two"]).where(F.col("a") == "o_totalprice")


def _revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))
    return load(spark, sf_dir, "lineitem").withColumn("revenue", price)


def _leader_sql(rows: str) -> str:
    return f"""WITH g AS (SELECT key, sum(v) AS s FROM ({rows}) GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY s DESC, key) AS place, sum(s) OVER () AS total FROM g)
    SELECT max(key) FILTER (place = 1) AS leader, {r('max(s) FILTER (place = 1)')} AS "sum", {r('max(s / total * 100) FILTER (place = 1)', 4)} AS share,
      {r('max(s) FILTER (place = 2)')} AS runner_up, count(*) AS groups, {r('max(s) FILTER (place = 1) / max(s) FILTER (place = 2)', 4)} AS lead_ratio,
      count(*) >= 2 AND max(total) <> 0 AS passes_gate FROM k"""


def _leader(df: DataFrame, key: str) -> DataFrame:
    out = groups.leader(groups.group_sums(df, key, F.col("revenue"), F.col("l_orderkey")))
    return rounded(rounded(out, 2, "sum", "runner_up"), 4, "share", "lead_ratio")


@query(_leader_sql("SELECT l_returnflag AS key, l_extendedprice * (1 - l_discount) AS v FROM lineitem"))
def category_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leader(_revenue(spark, sf_dir), "l_returnflag")


@query(
    _leader_sql(
        """SELECT n_name AS key, l_extendedprice * (1 - l_discount) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
    )
)
def category_join_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    nations = F.broadcast(load(spark, sf_dir, "nation"))  # 25 rows, fixed
    df = _revenue(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return _leader(df, "n_name")


_BRANDS = """g AS (SELECT p_brand AS key, sum(l_extendedprice * (1 - l_discount)) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY s DESC, key) AS place, sum(s) OVER () AS total, count(*) OVER () AS n FROM g)"""


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _revenue(spark, sf_dir).join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return groups.group_sums(df, "p_brand", F.col("revenue"), F.col("l_orderkey"))


@query(
    f"""WITH {_BRANDS} SELECT 3 AS top_n, {r('sum(s) FILTER (place <= 3) / max(total) * 100', 4)} AS top_share, count(*) AS groups,
      count(*) > 4 AND sum(s) FILTER (place <= 3) / max(total) * 100 > 55 AS passes_gate FROM k"""
)
def concentration_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(groups.concentration(_brands(spark, sf_dir)), 4, "top_share")


def _chart_sql(top: int) -> str:
    return f"""WITH {_BRANDS}, c AS (SELECT least(place, {top + 1}) AS p, CASE WHEN place <= {top} THEN key END AS key, s FROM k)
    SELECT coalesce(max(key), 'Other (' || count(*) || ')') AS label, {r('sum(s)')} AS "sum", CAST(p AS BIGINT) AS place FROM c GROUP BY p"""


@query(_chart_sql(8))
def bar_top8_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(longs(groups.top_and_other(_brands(spark, sf_dir), 8), "place"), 2, "sum")


@query(_chart_sql(5))
def donut_top5_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(longs(groups.top_and_other(_brands(spark, sf_dir), 5), "place"), 2, "sum")


@query(
    """WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n, p_size, p_retailprice FROM part)
    SELECT CAST(CASE WHEN n <= 200 THEN i ELSE ceil(i * 200 / n) END AS BIGINT) AS k, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM p
    WHERE n <= 200 OR (ceil(i * 200 / n) < 200 AND floor(ceil(i * 200 / n) * n / 200) = i)"""
)
def scatter_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.thinned_pairs(load(spark, sf_dir, "part"), "p_size", "p_retailprice", ["p_partkey"])


@query(
    """SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS BIGINT) AS place FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 200"""
)
def provenance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(groups.provenance(load(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey"), "place")


# ---- cells ----------------------------------------------------------------------------

_NUMBER_CASES = [
    ("$1,234.50", 1234.5), ("45%", 45.0), ("(200)", -200.0), ("€3.5", 3.5), ("abc", None), ("", None), ("1_000", 1000.0),
    ("1 2 3", 123.0), ("-$5", None), ("$-5", -5.0), ("(-5)", 5.0), ("1e3", 1000.0), ("1e400", None), ("Infinity", None),
    ("5f", None), ("1 234", 1234.0), (".5", 0.5), ("5.", 5.0), ("--5", None), ("($1,000)", -1000.0), (None, None),
]
_D = dt.date
_DATE_CASES = [
    ("2024-03-15", _D(2024, 3, 15)), ("2024-03", _D(2024, 3, 1)), ("2024-Q2", _D(2024, 4, 1)), ("Q2 2024", _D(2024, 4, 1)),
    ("3/15/2024", _D(2024, 3, 15)), ("15/3/2024", _D(2024, 3, 15)), ("Jan 2024", _D(2024, 1, 1)), ("January 5, 2024", _D(2024, 1, 5)),
    ("5 Jan 2024", _D(2024, 1, 5)), ("not a date", None), ("2024-02-31", _D(2024, 3, 2)), ("2024-13-01", None), ("1899", None),
    ("1900", _D(1900, 1, 1)), ("2021.5", None), ("2024-01-05T23:59:59Z", _D(2024, 1, 5)), ("13/13/2024", None), (None, None),
]
_NULL_CASES = ["", "  ", "null", "NULL", "NA", "n/a", "N/A", "none", "0", "nan", "-", None]


#: Numbers as they are written, by the order's key: the text in Spark and in SQL (of k and q), and its value.
_NUMBER_FORMS = [
    ("concat('$', k, ',', lpad(q, 3, '0'), '.5')", "k * 1000 + q + 0.5"), ("concat(q, '%')", "q"), ("concat('(', q, ')')", "-q"), ("concat('€', q, '.25')", "q + 0.25"),
    ("concat('abc', q)", "NULL"), ("concat(k, '_', '000')", "k * 1000"), ("concat('-$', q)", "NULL"), ("concat('$-', q)", "-q"), ("concat('(-', q, ')')", "q"),
    ("concat(q, 'e3')", "q * 1000"), ("concat(q, 'e400')", "NULL"), ("concat(' ', q, 'f')", "NULL"), ("concat(k, ' ', lpad(q, 3, '0'))", "k * 1000 + q"),
    ("concat('($', k, ',', lpad(q, 3, '0'), ')')", "-(k * 1000 + q)"), ("concat('.', q, '5')", "CAST(concat('0.', q, '5') AS DOUBLE)"), ("concat('--', q)", "NULL"), ("''", "NULL"),
]
_QUARTER = "CAST(floor((m + 2) / 3) AS INTEGER)"
#: Dates as they are written (of y, m, d, the date t and its month's short name b).
_DATE_FORMS = [
    ("concat(y, '-', lpad(m, 2, '0'), '-', lpad(d, 2, '0'))", "t"), ("concat(y, '-', lpad(m, 2, '0'))", "make_date(y, m, 1)"), (f"concat(y, '-Q', {_QUARTER})", f"make_date(y, {_QUARTER} * 3 - 2, 1)"),
    (f"concat('Q', {_QUARTER}, ' ', y)", f"make_date(y, {_QUARTER} * 3 - 2, 1)"), ("concat(m, '/', d, '/', y)", "t"), ("concat(d, '/', m, '/', y)", "CASE WHEN d > 12 THEN t ELSE make_date(y, d, m) END"),
    ("concat(b, ' ', y)", "make_date(y, m, 1)"), ("concat(b, ' ', d, ', ', y)", "t"), ("concat(d, ' ', b, ' ', y)", "t"), ("concat(y, '-', lpad(m, 2, '0'), '-31')", "make_date(y, m, 1) + 30"),
    ("concat(y, '-', lpad(m, 2, '0'), '-', lpad(d, 2, '0'), 'T23:59:59Z')", "t"), ("concat(y, '-13-', d)", "NULL"), ("concat('on ', d, '.', m, '.', y)", "NULL"), ("concat(y)", "make_date(y, 1, 1)"), ("concat(y, '.5')", "NULL"),
]
#: Texts that stand for nothing, and others.
_NULL_FORMS = ["''", "'  '", "'NuLL'", "' na '", "'n/A'", "c_mktsegment", "'none'", "'0'", "concat('NA', c_custkey)", "NULL"]


def _by_form(key: str, forms: list[str]) -> str:
    return f"CASE {key} % {len(forms)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(forms)) + " END"


def _strings(sql: str) -> str:
    """The same text with its numbers cast, as SQL's lpad wants."""
    for name in ("q", "m", "d"):
        sql = sql.replace(f"lpad({name},", f"lpad(CAST({name} AS VARCHAR),")
    return sql


_ORDER_NUMBERS = "SELECT o_orderkey AS k, o_custkey % 999 + 1 AS q FROM orders"


@query(f"SELECT k, {_by_form('k', [_strings(x) for x, _ in _NUMBER_FORMS])} AS x, CAST({_by_form('k', [v for _, v in _NUMBER_FORMS])} AS DOUBLE) AS v FROM ({_ORDER_NUMBERS})")
def parse_number_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 999 + 1).alias("q"))
    x = F.expr(_by_form("k", [x for x, _ in _NUMBER_FORMS]))
    return rows.select("k", x.alias("x")).withColumn("v", parse.parse_number(F.col("x")))


@query(
    f"""SELECT k, {_by_form('k', [_strings(x) for x, _ in _DATE_FORMS])} AS x, CAST({_by_form('k', [v for _, v in _DATE_FORMS])} AS DATE) AS v
    FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS t, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, strftime(o_orderdate, '%b') AS b FROM orders)"""
)
def parse_date_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    rows = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.year(at).alias("y"), F.month(at).alias("m"), F.day(at).alias("d"), F.date_format(at, "MMM").alias("b")
    )
    x = F.expr(_by_form("k", [x for x, _ in _DATE_FORMS]))
    return rows.select("k", x.alias("x")).withColumn("v", parse.parse_date(F.col("x")))


@query(
    f"""SELECT c_custkey AS k, x, coalesce(lower(trim(x)) IN ('', 'null', 'na', 'n/a'), true) AS is_null
    FROM (SELECT c_custkey, {_by_form('c_custkey', _NULL_FORMS)} AS x FROM customer)"""
)
def null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr(_by_form("c_custkey", _NULL_FORMS)).alias("x"))
    return rows.withColumn("is_null", parse.is_null_token(F.col("x")))


_VOTED = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query(
    """SELECT *, CASE WHEN filled = 0 THEN 'string' WHEN dates >= 0.9 * filled AND numbers < 0.9 * filled THEN 'date' WHEN numbers >= 0.9 * filled THEN 'number'
      WHEN booleans >= 0.95 * filled THEN 'boolean' WHEN dates >= 0.9 * filled THEN 'date' ELSE 'string' END AS kind FROM ("""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS filled, count(*) FILTER (regexp_full_match(CAST({c} AS VARCHAR), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')) AS numbers,
        count(*) FILTER (regexp_full_match(CAST({c} AS VARCHAR), '[0-9]{{4}}') AND try_cast(CAST({c} AS VARCHAR) AS INTEGER) BETWEEN 1900 AND 2100) AS dates,
        count(*) FILTER (lower(CAST({c} AS VARCHAR)) IN ('true', 'yes', 'y', '1', 'false', 'no', 'n', '0')) AS booleans FROM customer"""
        for c in _VOTED
    )
    + ")"
)
def type_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "customer")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("x")) for c in _VOTED])).alias("p"))
    out = cells.select("p.*").groupBy("column").agg(*parse.votes(F.col("x")))
    return out.withColumn("kind", parse.kind(*[F.col(c) for c in ("filled", "numbers", "dates", "booleans")]))


# ---- texts ----------------------------------------------------------------------------


@query(
    r"""SELECT doc_id, list_transform(regexp_extract_all(text, '-?\d[\d,]*(?:\.\d+)?'), lambda x: abs(try_cast(replace(x, ',', '') AS DOUBLE))) AS numbers
    FROM documents"""
)
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", prose.numbers_in(F.col("text")).alias("numbers"))


_SENTENCE = "'event ' || event_id || ' of ' || event_type || CASE WHEN event_id % 3 = 0 THEN ' rose' WHEN event_id % 3 = 1 THEN ' fell' ELSE ' stayed' END || ' at ' || (event_id % 97) || '.' || (event_id % 9)"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    way = F.when(i % 3 == 0, " rose").when(i % 3 == 1, " fell").otherwise(" stayed")
    words = F.concat(F.lit("event "), i.cast("string"), F.lit(" of "), "event_type", way, F.lit(" at "), (i % 97).cast("string"), F.lit("."), (i % 9).cast("string"))
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("text_id"), words.alias("text"), "event_type")


_ALLOWED = (0.0, 1.0, 2.0, 3.0, 41.5, 250.0, 1999.0, 7000.0)


@query(
    rf"""WITH t AS (SELECT event_id AS text_id, {_SENTENCE} AS text FROM events),
    n AS (SELECT DISTINCT text_id, unnest(list_transform(regexp_extract_all(text, '-?\d[\d,]*(?:\.\d+)?'), lambda x: abs(try_cast(replace(x, ',', '') AS DOUBLE)))) AS number FROM t),
    a(x) AS (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in _ALLOWED)})
    SELECT text_id, count(*) AS checked, count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE abs(number - x) <= 0.05 OR abs(number - x) / nullif(abs(x), 0) <= 0.015)) AS verified
    FROM n GROUP BY 1"""
)
def number_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([(None, x) for x in _ALLOWED], "text_id long, number double")
    return story.audit_texts(_sentences(spark, sf_dir), allowed).where("checked > 0")


#: Words that look like some of the lexicons but say nothing.
_NEUTRAL = "stayed enterprise fallow lossless upwards grows-not gainful risky shrinkwrap"
_WORDS = " ".join((prose.UP_WORDS, _NEUTRAL.replace("grows-not ", ""), prose.DOWN_WORDS)).split()


@query(
    f"""WITH w AS (SELECT event_id, list_extract({_WORDS}, event_id % {len(_WORDS)} + 1) AS a, CASE WHEN event_id % 3 = 0 THEN list_extract({_WORDS}, event_id * 7 % {len(_WORDS)} + 1) ELSE '' END AS b FROM events),
    d AS (SELECT event_id, list_contains({prose.UP_WORDS.split()}, a) OR list_contains({prose.UP_WORDS.split()}, b) AS up,
      list_contains({prose.DOWN_WORDS.split()}, a) OR list_contains({prose.DOWN_WORDS.split()}, b) AS down FROM w)
    SELECT event_id AS text_id, CASE WHEN up AND down THEN 'both' WHEN up THEN 'up' WHEN down THEN 'down' END AS direction FROM d"""
)
def direction_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the lexicons, in any case, alone and with another one, in a sentence."""
    i, words = F.col("event_id"), F.array(*map(F.lit, _WORDS))
    word = lambda k: F.element_at(words, (k % len(_WORDS) + 1).cast("int"))
    one = F.when(i % 2 == 0, F.upper(word(i))).otherwise(word(i))
    text = F.concat(F.lit("it "), one, F.lit(", then "), F.when(i % 3 == 0, word(i * 7)).otherwise(""), F.lit("."))
    return load(spark, sf_dir, "events").select(i.alias("text_id"), prose.direction_of(text).alias("direction"))


@query(
    rf"""SELECT event_id AS text_id, regexp_matches({_SENTENCE}, '(?i)(^|\W)event(\W|$)') AS event, regexp_matches({_SENTENCE}, '(?i)(^|\W)click(\W|$)') AS click FROM events"""
)
def metric_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _sentences(spark, sf_dir).select("text_id", prose.mentions(t, "EVENT").alias("event"), prose.mentions(t, "click").alias("click"))


@query("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.octet_length(t).cast("long").alias("bytes"))


# ---- ledgers and stories --------------------------------------------------------------


@query(
    """WITH f AS (SELECT event_type AS id, avg(value) AS mean FROM events GROUP BY 1),
    c AS (SELECT id, CASE WHEN mean > (SELECT avg(mean) FROM f) THEN 'up' ELSE 'down' END AS direction FROM f)
    SELECT id, said, CASE WHEN said = 'operation' THEN 'operation' WHEN said = 'metric' THEN 'metric' WHEN said = 'direction' THEN 'direction'
      WHEN said = 'period' THEN 'period' END AS difference FROM c, (VALUES ('same'), ('operation'), ('metric'), ('direction'), ('period')) v(said)"""
)
def claim_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on event types, each said right and wrong in one field, against what the events give."""
    means = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("id")).agg(F.avg("value").alias("mean"))
    all_means = F.broadcast(means.agg(F.avg("mean").alias("all")))  # one row
    way = F.when(F.col("mean") > F.col("all"), "up").otherwise("down")
    claim = F.struct(F.lit("ols_trend").alias("operation"), F.col("id").alias("metric"), way.alias("direction"), F.struct(F.lit("a").alias("from"), F.lit("b").alias("to")).alias("period"))
    meant = means.crossJoin(all_means).select("id", claim.alias("claim"))
    kinds = F.explode(F.array(*[F.lit(x) for x in ("same", "operation", "metric", "direction", "period")])).alias("said")
    c = F.col("claim")
    other = F.when(c["direction"] == "up", "down").otherwise("up")
    wrong = {"operation": F.lit("mean_shift"), "metric": F.lit("other"), "direction": other, "period": F.struct(F.lit("a").alias("from"), F.lit(None).cast("string").alias("to"))}
    fields = [F.when(F.col("said") == k, wrong[k]).otherwise(c[k]).alias(k) for k in ("operation", "metric", "direction", "period")]
    said = meant.select("id", "claim", kinds).withColumn("stated", F.struct(*fields))
    return said.select("id", "said", verify.claim_difference(F.col("stated"), F.col("claim"), ["operation", "metric", "direction", "period"]).alias("difference"))


@query(
    """WITH f AS (SELECT event_type AS id, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1),
    c AS (SELECT id, n, CASE WHEN id = 'click' THEN users + 1 ELSE users END AS users FROM f WHERE id <> 'view' UNION ALL SELECT 'ghost', 1, 1)
    SELECT coalesce(c.id, f.id) AS id, CASE WHEN c.id IS NULL THEN 'left out' WHEN f.id IS NULL THEN 'no fact with this id' WHEN c.n <> f.n THEN 'values.n'
      WHEN c.users <> f.users THEN 'values.users' END AS difference FROM c FULL JOIN f ON c.id = f.id"""
)
def fact_diff_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("id")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_distinct("user_id").cast("double").alias("users")
    )
    as_facts = lambda df: df.select(
        "id", F.lit("count").alias("kind"), F.lit("").alias("statement"), F.lit("").alias("headline"), F.array("id").alias("columns"),
        F.create_map(F.lit("n"), "n", F.lit("users"), "users").alias("values"),
    )
    ghost = spark.createDataFrame([("ghost", 1.0, 1.0)], "id string, n double, users double")
    claimed = facts.where("id <> 'view'").withColumn("users", F.when(F.col("id") == "click", F.col("users") + 1).otherwise(F.col("users")))
    return verify.compare_ledgers(as_facts(claimed.unionByName(ghost)), as_facts(facts), strict=True)


_NICE = "CASE WHEN {x} / {u} <= {a} THEN 1 WHEN {x} / {u} <= {b} THEN 2 WHEN {x} / {u} <= {c} THEN 5 ELSE 10 END * {u}"
_UNIT = "pow(10.0, floor(log10({x})))"


@query(
    f"""WITH b AS (SELECT p_brand AS key, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1 HAVING max(p_retailprice) > min(p_retailprice)),
    s AS (SELECT *, {_NICE.format(x='(high - low)', u=_UNIT.format(x='(high - low)'), a='1', b='2', c='5')} AS span FROM b),
    t AS (SELECT *, CASE WHEN span / 4 / {_UNIT.format(x='(span / 4)')} < 1.5 THEN 1 WHEN span / 4 / {_UNIT.format(x='(span / 4)')} < 3 THEN 2
      WHEN span / 4 / {_UNIT.format(x='(span / 4)')} < 7 THEN 5 ELSE 10 END * {_UNIT.format(x='(span / 4)')} AS step FROM s)
    SELECT key, {r('floor(low / step) * step', 6)} AS "first", {r('ceil(high / step) * step', 6)} AS "last", CAST(ceil(high / step) - floor(low / step) + 1 AS BIGINT) AS n FROM t"""
)
def nice_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis ticks of each brand's prices."""
    x = F.col("p_retailprice")
    ranges = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg(F.min(x).alias("low"), F.max(x).alias("high")).where("high > low")
    ticks = ranges.select("key", groups.ticks(F.col("low"), F.col("high")).alias("t"))
    out = ticks.select("key", F.get("t", F.lit(0)).alias("first"), F.element_at("t", -1).alias("last"), F.size("t").cast("long").alias("n"))
    return rounded(out, 6, "first", "last")


# ---- events ---------------------------------------------------------------------------


@query(
    """SELECT event_id, user_id, CAST(row_number() OVER w AS BIGINT) AS hit, CAST(greatest(0, 3 - row_number() OVER w) AS BIGINT) AS remaining, row_number() OVER w <= 3 AS allowed
    FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)"""
)
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.admitted(load(spark, sf_dir, "events"), quota=3)
    return longs(out.select("event_id", "user_id", "hit", "remaining", "allowed"), "hit", "remaining")


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS hits, count(*) > 25 AS over_quota FROM events GROUP BY 1, 2")
def daily_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.daily_hits(load(spark, sf_dir, "events"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT user_id, event_type, k, event_id, ts, ts AS last, true AS kept FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.event_type, e.k, e.event_id, e.ts, CASE WHEN e.ts > w.last + INTERVAL 10 MINUTE THEN e.ts ELSE w.last END, e.ts > w.last + INTERVAL 10 MINUTE
      FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.k = w.k + 1)
    SELECT event_id, user_id, event_type FROM w WHERE kept"""
)
def replay_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.first_seen(load(spark, sf_dir, "events"), ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query(f"SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n, {r('sum(value)', 4)} AS \"sum\" FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.tumbling(load(spark, sf_dir, "events"))
    return rounded(out.withColumn("start", F.unix_micros(F.col("start").cast("timestamp"))), 4, "sum")


@query(
    f"""WITH x AS (SELECT unnest(range(4)) AS k, ts, value FROM events)
    SELECT epoch_us(time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE) AS start, count(*) AS n, {r('sum(value)', 4)} AS "sum" FROM x GROUP BY 1"""
)
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.sliding(load(spark, sf_dir, "events"))
    return rounded(out.withColumn("start", F.unix_micros(F.col("start").cast("timestamp"))), 4, "sum")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.sessions(load(spark, sf_dir, "events"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.withColumns({"start": micros("start"), "end": micros("end")})


# ---- files ----------------------------------------------------------------------------


@query(
    """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, CAST(c_custkey AS DOUBLE) AS key,
      concat(c_mktsegment, ', "', c_name, '"', chr(10), chr(10), 'nation ', c_nationkey) AS note, concat('of ', c_mktsegment, ',; "', c_custkey) AS mixed FROM customer"""
)
def quoted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as text with quotes, newlines and delimiters within fields, and read by exact rules in parallel."""
    rows = load(spark, sf_dir, "customer").orderBy("c_custkey")
    note = F.concat(F.lit('"'), "c_mktsegment", F.lit(', ""'), "c_name", F.lit('""\n\nnation '), F.col("c_nationkey").cast("string"), F.lit('"'))
    # quotes that open within a field
    mixed = F.concat(F.lit("of "), "c_mktsegment", F.lit('",;" """'), F.col("c_custkey").cast("string"), F.lit('"'))
    folder = new_folder(spark)
    rows.select(F.concat_ws(",", F.col("c_custkey").cast("string"), note, mixed).alias("value")).write.text(folder)
    return delimited.from_path(spark, folder, names=["key", "note", "mixed"]).df
