import datetime as dt
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from factloom.operators import groups, ordered, series, spread
from factloom.streaming import moments

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    """Thirty days, of which some groups miss some, near 1e9."""
    rng, start = random.Random(2), dt.datetime(2024, 5, 1)
    rows = []
    for i in range(3000):
        at = start + dt.timedelta(seconds=rng.randrange(30 * 86_400))
        k = rng.choice("aab")
        if k == "b" and at.day % 5 == 0:
            continue
        rows.append((k, at, i, 1e9 + at.day * 0.25 + rng.gauss(0, 1), rng.gauss(0, 1) if i % 7 else None))
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, event_id long, value double, other double").repartition(5).cache()


def by_key(df):
    return {r["k"]: r.asDict() for r in df.collect()}


def test_trends_of_merged_days_are_those_of_the_table(events):
    days = moments.day_states(events, ["k"], "ts", "event_id", "value")
    got = by_key(moments.trends(moments.merged(days, ["k"], moved=True), ["k"]))
    whole = series.ordinals(events.withColumn("v", F.col("value")), ["k"], ["ts", "event_id"])
    want = by_key(ordered.trend(whole, ["k"]))
    assert set(got) == {"a", "b"}
    for k, w in want.items():
        assert (got[k]["n"], got[k]["first"], got[k]["last"], got[k]["df"]) == (w["n"], w["first"], w["last"], w["df"])
        # against exact arithmetic: the whole table's doubles near 1e9 are good for fewer digits
        ys = [Fraction(r["v"]) for r in whole.where(F.col("k") == k).orderBy("i").collect()]
        n, mx, my = len(ys), Fraction(len(ys) - 1, 2), sum(ys) / len(ys)
        xx, xy, yy = sum((i - mx) ** 2 for i in range(n)), sum((i - mx) * (y - my) for i, y in enumerate(ys)), sum((y - my) ** 2 for y in ys)
        slope, r2 = xy / xx, xy * xy / xx / yy
        se = float((yy - xy * xy / xx) / (n - 2) / xx) ** 0.5
        for name, x in (("slope", slope), ("r2", r2), ("mean", my), ("se", se), ("t", float(slope) / se)):
            assert got[k][name] == pytest.approx(float(x), rel=1e-9), name
            assert w[name] == pytest.approx(float(x), rel=1e-5), name
        assert got[k]["low95"] < got[k]["slope"] < got[k]["high95"] and 0 <= got[k]["p"] <= 1


def test_correlation_and_volatility_of_merged_days(events):
    days = moments.states(events.withColumn("day", F.to_date("ts")), ["k", "day"], "other", "value")
    state = moments.merged(days, ["k"])
    got = by_key(moments.correlations(state, ["k"]))
    for k in "ab":
        (want,) = groups.correlations(events.where(F.col("k") == k), ["other", "value"]).collect()
        assert (got[k]["n"], got[k]["r"]) == (want["n"], pytest.approx(want["r"], rel=1e-6))
    both = events.where("other IS NOT NULL")
    want, got = by_key(spread.volatility(both.withColumn("v", F.col("value")), ["k"])), by_key(moments.volatilities(state, ["k"]))
    for k, w in want.items():
        assert (got[k]["n"], got[k]["passes_gate"]) == (w["n"], w["passes_gate"])
        assert (got[k]["mean"], got[k]["stdev"]) == (pytest.approx(w["mean"], rel=1e-12), pytest.approx(w["stdev"], rel=1e-7))


def test_states_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0, 5.0), ("a", dt.date(2024, 1, 2), None, 5.0)], "k string, day date, x double, y double")
    (one,) = moments.merged(moments.states(df, ["k", "day"], "x", "y"), ["k"]).collect()
    assert (one["n"], one["pivot"] + one["my"], one["yy"]) == (1, 5.0, 0.0)
    (r,) = moments.correlations(moments.merged(moments.states(df, ["k", "day"], "x", "y"), ["k"]), ["k"]).collect()
    assert (r["r"], r["p"]) == (0.0, 1.0)
    assert moments.merged(moments.states(df.limit(0), ["k", "day"], "x", "y"), ["k"]).count() == 0


def test_sketches_of_merged_days(spark, events):
    rows = events.withColumn("day", F.to_date("ts")).withColumn("code", F.concat(F.lit("c"), F.col("event_id") % 500))
    days = moments.day_sketches(rows, ["k", "day"], "value", "code")
    whole = moments.merged_sketches(days, ["k"])
    got = by_key(moments.medians(whole, ["k"]))
    for k in "ab":
        values = sorted(r["value"] for r in rows.where(F.col("k") == k).collect())
        n = len(values)
        assert got[k]["n"] == n
        for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            rank = sum(v <= got[k][name] for v in values) / n
            assert abs(rank - q) < 0.02
        off = sorted(abs(v - got[k]["median"]) for v in values)
        assert abs(sum(v <= got[k]["mad"] for v in off) / n - 0.5) < 0.04
    counts = {r["k"]: r["distinct"] for r in moments.distinct_counts(whole, ["k"]).collect()}
    want = {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.count_distinct("code").alias("n")).collect()}
    assert all(abs(counts[k] - want[k]) <= 0.04 * want[k] for k in want)
    # near a gate the exact number decides
    exact = rows.select("code").distinct().count()
    assert moments.distinct_or_exact(days, rows, "code", [exact + 1.0]) == exact
    assert abs(moments.distinct_or_exact(days, rows, "code", [1e6]) - exact) <= 0.04 * exact
