import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import display, inference, parse, prose
from factloom.functions.numbers import clamp, finite, half_up, percent_change
from factloom.plans import story
from factloom.plans.queries_tables import _DATE_CASES, _NUMBER_CASES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_numbers(spark):
    df = spark.createDataFrame([(a,) for a, _ in _NUMBER_CASES], "x string")
    assert [r[0] for r in df.select(parse.parse_number(F.col("x"))).collect()] == [b for _, b in _NUMBER_CASES]


def test_dates(spark):
    df = spark.createDataFrame([(a,) for a, _ in _DATE_CASES], "x string")
    assert [r[0] for r in df.select(parse.parse_date(F.col("x"))).collect()] == [b for _, b in _DATE_CASES]


@pytest.mark.parametrize(("t", "want"), [
    ("Jan  2024", "2024-01-01"), ("Jan\t2024", "2024-01-01"), ("Jan 45, 2024", "2024-02-14"), ("45 Jan 2024", "2024-02-14"),
    ("Marvelous 2024", "2024-03-01"), ("Januaryyyyyy 2024", None), ("Sept. 5, 2024", "2024-09-05"), ("5 Sept. 2024", "2024-09-05"),
    ("5 Jan, 2024", None), ("Jan 5 , 2024", None), ("Jan5 2024", None), ("Foo 2024", None), ("2024 Q1", "2024-01-01"), ("2024Q4", "2024-10-01"),
    ("2024  Q1", None), ("q3-2024", "2024-07-01"), ("Q3  2024", None), ("Q5 2024", None), ("2024-Q0", None), ("1-2-2024", "2024-01-02"),
    ("1/2-2024", "2024-01-02"), ("1/32/2024", None), ("31/12/2024", "2024-12-31"), ("1.2.2024", None), ("2024-1", "2024-01-01"),
    ("2024-1-2 noon", "2024-01-02"), ("2024-01-05Tuesday", "2024-01-05"), ("2024-01-05x", None), ("2024-1-123", None), ("2024-01 5", "2024-01-01"),
    ("24-01-05", None), ("2101", None), ("+2024", None), ("2024.0", None), ("20240105", None), ("", None), (" ", None), ("Q", None), ("-", None),
    ("Jan 2024 ", "2024-01-01"), ("May", None),
])
def test_dates_by_their_forms(spark, t, want):
    got = one(spark, parse.parse_date(F.lit(t)))
    assert (got and str(got)) == want


def test_booleans_and_null_tokens(spark):
    df = spark.createDataFrame([("Yes",), ("0",), ("x",), (" n/A ",)], "x string")
    assert [r[0] for r in df.select(parse.parse_boolean(F.col("x"))).collect()] == [True, False, None, None]
    assert [r[0] for r in df.select(parse.is_null_token(F.col("x"))).collect()] == [False, False, False, True]


@pytest.mark.parametrize(
    ("votes", "kind"),
    [((0, 0, 0, 0), "string"), ((10, 9, 0, 0), "number"), ((10, 9, 9, 0), "number"), ((10, 0, 9, 0), "date"), ((20, 0, 0, 19), "boolean"), ((10, 8, 8, 8), "string")],
)
def test_kinds(votes, kind):
    assert parse.kind_of(*votes) == kind


def test_rounding(spark):
    values = [-2.5, 2.5, 1.005, -0.5]
    got = [one(spark, half_up(F.lit(v), 0)) for v in values]
    assert got == [-2.0, 3.0, 1.0, 0.0]
    assert one(spark, half_up(F.lit(1.005), 2)) == display.half_up(1.005, 2) == 1.0
    assert one(spark, clamp(F.lit(7.0), 0, 5)) == 5
    assert one(spark, percent_change(F.lit(0.0), F.lit(5.0))) == 0
    assert [one(spark, finite(F.lit(x))) for x in (1.0, float("nan"), float("inf"))] == [True, False, False]


def test_display():
    shown = {1234567: "1.23M", 0.03456: "0.0346", 42: "42", 0: "0", 12345: "12.3K", 2.5e9: "2.5B", 120.04: "120", 1e-10: "0.0000000001"}
    assert {k: display.number(k) for k in shown} == shown
    assert display.number(math.inf) == "—" and display.percent(12.4) == "+12.4%"
    assert display.date(dt.date(2024, 3, 5), "day") == "Mar 5, 2024" and display.granularity(901) == "year"
    assert display.canonical_json({"b": 1.0, "a": [None, {"y": 2, "x": None}]}) == '{"a":[null,{"y":2}],"b":1}'
    assert display.shortened("abcdef", 4) == "abc…"


def test_inference():
    assert inference.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-5)
    assert inference.t_two_sided(0, 5) == 1 and inference.t_two_sided(math.nan, 5) == 1 and inference.t_two_sided(3, 0) == 1
    assert inference.t_critical(3) == pytest.approx(3.064, abs=1e-3) and inference.t_critical(10) == pytest.approx(2.225, abs=1e-3)
    assert inference.correlation_p(0.9, 20) < 0.001 < 0.05 < inference.correlation_p(0.3, 5)


@pytest.mark.parametrize("word", f"{prose.UP_WORDS} {prose.DOWN_WORDS}".split())
def test_each_word_has_its_direction(word):
    text = f"it {word.upper()}."
    assert bool(re.search(prose.UP, text)) == (word in prose.UP_WORDS.split())
    assert bool(re.search(prose.DOWN, text)) == (word in prose.DOWN_WORDS.split())


def test_words_without_a_direction_and_signs():
    assert not re.search(prose.UP, "up, higher and arisen") and not re.search(prose.DOWN, "down, lower and falls_x")
    assert all(re.search(prose.TOGETHER, t) for t in ("positively", "in lockstep", "In  tandem")) and not re.search(prose.TOGETHER, "together")
    assert all(re.search(prose.AGAINST, t) for t in ("inversely", "negatively", "opposite", "anti-correlated", "anticorrelation"))


def test_forms_of_numbers(spark):
    assert sorted(set(one(spark, prose.forms_of(F.lit(950.0))))) == [950.0]
    assert set(one(spark, prose.forms_of(F.lit(-1_234_567.0)))) == {1234567.0, 1234.6, 1234.57, 1.2, 1.23} == story._forms(-1_234_567.0)


def test_prose(spark):
    assert one(spark, prose.numbers_in(F.lit("from -1,234.5 to 7 in 2024"))) == [1234.5, 7.0, 2024.0]
    assert [one(spark, prose.direction_of(F.lit(t))) for t in ("it rose", "it fell", "it rose and fell", "it stayed")] == ["up", "down", "both", None]
    assert [one(spark, prose.mentions(F.lit(t), "mrr")) for t in ("the MRR.", "mrrx", "x mrr")] == [True, False, True]
    assert one(spark, prose.mentions(F.lit("a b"), "a")) is False


def test_many_p_values_at_once(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.uniform(0.01, 40, 400), [0.5, 1.0, 2.0, 1000.0, 1e6]))
    assert np.allclose(inference.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-12)
    t = np.concatenate((rng.normal(0, 3, 500), [0.0, 1e-9, 50.0, np.inf, np.nan]))
    df = np.concatenate((rng.integers(1, 3000, 500), [5, 5, 5, 5, 5])).astype(float)
    want = [inference.t_two_sided(a, b) for a, b in zip(t.tolist(), df.tolist(), strict=True)]
    assert np.abs(inference.t_two_sided_all(t, df) - want).max() < 1e-10
    rows = [(float(a), float(b), 0.1 * (k % 20 - 10), k) for k, (a, b) in enumerate(zip(t[:40], df[:40], strict=True))] + [(None, None, 1.0, 2)]
    frame = spark.createDataFrame(rows, "t double, df double, r double, n long")
    got = frame.select(inference.two_sided(F.col("t"), F.col("df")).alias("p"), inference.critical(F.col("df")).alias("c"), inference.correlation_two_sided(F.col("r"), F.col("n")).alias("q")).collect()
    for row, (a, b, r, n) in zip(got, rows, strict=True):
        assert row["p"] == pytest.approx(inference.t_two_sided(a, b), abs=1e-10)
        assert row["q"] == pytest.approx(inference.correlation_p(r, n), abs=1e-10)
        assert row["c"] == pytest.approx(inference.t_critical(b) if b else 1.959963985)
