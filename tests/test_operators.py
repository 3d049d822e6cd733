import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import display
from factloom.operators import groups, ordered, series, spread
from factloom.streaming import events


def as_series(spark, values, partitions=5):
    rows = [("m", float(v), i) for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "metric string, v double, row_id long").repartition(partitions)
    return series.ordinals(df.withColumn("at", F.col("row_id")).withColumn("label", F.col("row_id").cast("string")), ["metric"], ["at", "row_id"])


def test_ordinals_and_prefix_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 7)
    values = [random.Random(2).randint(-50, 50) for _ in range(200)]
    rows = series.prefix_sums(as_series(spark, values), ["metric"], {"before": "v"}).orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(200)) and [r["v"] for r in rows] == values
    assert [r["before"] for r in rows] == [sum(values[:i]) for i in range(200)]


def test_quantiles_of_groups(spark):
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 10), ("c", 101)) for v in random.Random(n).sample(range(1000), n)]
    got = {r["g"]: r for r in series.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"q1": 0.25, "median": 0.5}).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g)
        for name, q in (("q1", 0.25), ("median", 0.5)):
            p = (len(v) - 1) * q
            lo, hi = v[int(p)], v[min(int(p) + 1, len(v) - 1)]
            assert got[g][name] == pytest.approx(lo + (hi - lo) * (p - int(p)))


def test_quantiles_of_values_that_all_rows_have(spark):
    """A constant and a few values: no task sorts the rows of a value."""
    df = spark.range(0, 300_000, 1, 16).select(F.lit(5.0).alias("c"), (F.col("id") % 3).cast("double").alias("v"), F.lit(None).cast("string").alias("g"))
    (c,) = series.quantiles(df, [], "c", {"q1": 0.25, "median": 0.5}).collect()
    assert (c["n"], c["q1"], c["median"]) == (300_000, 5.0, 5.0)
    (v,) = series.quantiles(df, ["g"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75, "top": 1.0}).collect()
    assert (v["g"], v["n"], v["q1"], v["median"], v["q3"], v["top"]) == (None, 300_000, 0.0, 1.0, 2.0, 2.0)
    assert series.quantiles(df.limit(0), ["g"], "v", {"median": 0.5}).count() == 0


def test_ordinals_of_groups_without_a_name(spark):
    rows = [(g, i) for g in ("a", None, "b") for i in range(50)]
    random.Random(3).shuffle(rows)
    got = series.ordinals(spark.createDataFrame(rows, "g string, k long").repartition(4), ["g"], ["k"]).collect()
    assert len(got) == 150 and all(r["i"] == r["k"] for r in got)


def brute_change(v, compat=False):
    n, m = len(v), sum(v) / len(v)
    best = None
    for i in range(3, n - 2):
        left = sum(v[:i]) - (v[0] + v[1] if compat else 0)
        gain = i * (left / i - m) ** 2 + (n - i) * ((sum(v) - left) / (n - i) - m) ** 2
        if best is None or gain > best[0] + 1e-9:
            best = (gain, i)
    return best[1]


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_changepoint_is_the_best_split(spark, seed, compat):
    rng = random.Random(seed)
    v = [rng.gauss(0, 1) + (2 if i > 20 else 0) for i in range(40)]
    (got,) = ordered.changepoint(as_series(spark, v), ["metric"], compat).collect()
    assert got["split"] == brute_change(v, compat)


def test_known_changepoint_and_short_series(spark):
    v = [10, 11, 10, 12, 11, 10, 11, 50, 51, 52, 50, 51, 53]
    (got,) = ordered.changepoint(as_series(spark, v), ["metric"]).collect()
    assert got["split"] == 7 and got["strength"] > 0.8
    assert ordered.changepoint(as_series(spark, v[:9]), ["metric"]).count() == 0
    (flat,) = ordered.changepoint(as_series(spark, [5] * 12), ["metric"]).collect()
    assert flat["strength"] is None


def brute_streak(v):
    best, start, i = (0, 0), 0, 1
    while i < len(v):
        s, j = (v[i] > v[i - 1]) - (v[i] < v[i - 1]), i
        while j < len(v) and ((v[j] > v[j - 1]) - (v[j] < v[j - 1])) == s:
            j += 1
        if s and j - i > best[0]:
            best = (j - i, i - 1)
        i = j
    return best


@pytest.mark.parametrize("seed", range(5))
def test_streak_is_the_first_longest_run(spark, seed, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 5)
    rng = random.Random(seed)
    v = [rng.randint(0, 6) for _ in range(60)]
    moves, start = brute_streak(v)
    got = ordered.streak(as_series(spark, v), ["metric"]).collect()
    if moves >= 3:
        assert (got[0]["moves"], got[0]["start"]) == (moves, start)
    else:
        assert not got


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_previous_rows_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(series, "BLOCK", block)
    v = [float(i * i % 17) for i in range(40)]
    rows = series.previous(as_series(spark, v), ["metric"], {"was": "v"}).orderBy("i").collect()
    assert [r["was"] for r in rows] == [None, *v[:-1]]


def test_ranks_of_very_many_groups(spark, monkeypatch):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 50).cast("string").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    few = sorted(map(repr, groups.group_sums(df, "k", F.col("v"), F.col("id")).collect()))
    monkeypatch.setattr(groups, "SMALL", 10)
    assert sorted(map(repr, groups.group_sums(df, "k", F.col("v"), F.col("id")).select("key", "sum", "count", "first_seen", "rank", "total", "share").collect())) == few


def test_ticks_equal_those_of_charts(spark):
    ranges = [(0.0, 97.0), (-3.0, 12.5), (0.001, 0.0042), (1e6, 3.7e6), (5.0, 5.5), (-7.0, -1.0), (0.0, 1.0)]
    df = spark.createDataFrame(ranges, "a double, b double")
    for r in df.select("a", "b", groups.ticks(F.col("a"), F.col("b")).alias("t")).collect():
        assert r["t"] == pytest.approx(display.nice_ticks(r["a"], r["b"]))


def brute_first_seen(rows, seconds):
    last, kept = {}, []
    for key, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or (at - last[key]).total_seconds() > seconds:
            last[key] = at
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("together", [events.TOGETHER, 10])
def test_repeats_are_suppressed(spark, monkeypatch, together):
    monkeypatch.setattr(series, "BLOCK", 16)
    monkeypatch.setattr(events, "TOGETHER", together)
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), start + dt.timedelta(seconds=rng.randrange(0, 40_000)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, event_id long").repartition(5)
    got = events.first_seen(df, ["k"], seconds=300)
    assert got.columns == df.columns and sorted(r["event_id"] for r in got.collect()) == brute_first_seen(rows, 300)
    hits = {r["event_id"]: r["hit"] for r in events.admitted(df, "k", quota=3).collect()}
    for key in ("a", "b", None):
        own = sorted((at, i) for k, at, i in rows if k == key)
        assert [hits[i] for _, i in own] == list(range(1, len(own) + 1))


def test_trend(spark):
    (t,) = ordered.trend(as_series(spark, [1, 3, 5, 7, 9]), ["metric"]).collect()
    assert (t["slope"], t["r2"], t["first"], t["last"], t["change_pct"]) == pytest.approx((2, 1, 1, 9, 800))
    (c,) = ordered.trend(as_series(spark, [4, 4, 4, 4, 4]), ["metric"]).collect()
    assert (c["slope"], c["r2"], c["change_pct"]) == (0, 0, 0)


def test_outliers(spark):
    rows = spark.createDataFrame([(float(x),) for x in (10, 11, 12, 10, 11, 12, 10, 11, 99)], "v double")
    (o,) = spread.outliers(rows, []).collect()
    assert o["v"] == 99
    assert spread.outliers(spark.createDataFrame([(5.0,)] * 20, "v double"), []).count() == 0


def test_correlations_of_odd_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 7.0, None if i % 2 else float(-i)) for i in range(10)], "a double, b double, c double, d double")
    got = {(r["a"], r["b"]): (r["r"], r["n"]) for r in groups.correlations(df, ["a", "b", "c", "d"]).collect()}
    assert got["a", "b"] == pytest.approx((1, 10)) and got["a", "c"] == (0, 10) and got["a", "d"] == pytest.approx((-1, 5))


def test_groups(spark):
    rows = [("x", 10.0), ("y", 5.0), ("y", 4.0), ("", 99.0), (None, 9.0), ("z", float("nan")), ("z", 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k string, v double")
    ranked = groups.group_sums(df, "k", F.col("v"), F.col("id"))
    (lead,) = groups.leader(ranked).collect()
    assert (lead["leader"], lead["groups"], lead["share"]) == ("x", 3, 50.0)
    labels = [r["label"] for r in groups.top_and_other(ranked, 1).orderBy("place").collect()]
    assert labels == ["x", "Other (2)"]
