import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import ordered, runs, series
from factloom.plans import passes
from factloom.session import checkpoint


@pytest.mark.parametrize("seed", range(3))
def test_runs_splits_and_medians_where_rows_lie(spark, seed):
    """Against the operators that bring rows together by blocks, with gaps, ties and runs over the ends of tasks."""
    rng = random.Random(seed)
    slow = [float(i // 37 * (-1) ** (i // 150)) for i in range(600)]
    cells = [(i, rng.choice([None, float("nan"), rng.gauss(0, 1), -rng.gauss(0, 1) * 1e6, 0.0, -0.0]), slow[i], float(rng.randint(-2, 2))) for i in range(600)]
    df = spark.createDataFrame(cells, "row_id long, a double, b double, c double").repartition(7)
    metrics = ["a", "b", "c"]
    both = series.together(df, metrics, None, F.col("row_id"), whole={"b", "c"})
    long = both.long(F.lit("x"))
    plain = series.series(df, metrics, None, F.col("row_id"))
    of = lambda x: sorted((r["metric"], r["i"], r["v"], r["row_id"]) for r in x.collect())
    assert of(long) == of(plain)

    values = {m: np.array([v for k, _, v, _ in of(plain) if k == m]) for m in metrics}
    # over several tasks, the last time in no order
    dealt = both.rows.repartition(5, "row_id") if seed == 2 else both.rows.repartitionByRange(5, "i").sortWithinPartitions("i")
    both = series.Together(checkpoint(dealt), both.values, both.places)
    parts, cells_of = runs.stretches(both, metrics)
    assert both.rows.rdd.getNumPartitions() > 1 and {m: sum(r["n"] for r in parts[m]) for m in metrics} == {m: len(v) for m, v in values.items()}
    want = {r["metric"]: (r["start"], r["moves"], r["sign"]) for r in ordered.streak(plain, ["metric"]).collect()}
    got = {m: (x.at - 1, x.moves, x.sign) for m in metrics if (x := runs.longest(parts[m])) and x.moves >= ordered.STREAK_MOVES}
    assert got == want
    assert {m: runs.peak(parts[m]) for m in metrics} == {m: int(v.argmax()) for m, v in values.items()}
    median = {m: float(np.median(v)) for m, v in values.items()}
    splits, far = runs.splits(both, metrics, parts, {m: float(v.sum()) for m, v in values.items()}, median)
    assert splits == {r["metric"]: r["split"] for r in ordered.changepoint(plain, ["metric"]).collect()}
    for m, v in values.items():
        for x, (low, high, n) in ((v, cells_of[m]), (np.abs(v - median[m]), far[m])):
            middle = np.sort(x)[[(len(x) - 1) // 2, len(x) // 2]]
            assert low <= middle[0] and middle[1] <= high and n == len(x) - (x < low).sum() - (x > high).sum() or low < 0 < high


def test_cells_are_in_the_order_of_values():
    x = np.array(sorted([-1e300, -3.5, -1.0, -1e-300, 0.0, 1e-300, 1.0, 1.0 + 2**-13, 2.0, 1e300]))
    c = runs._cells(x)
    assert (np.diff(c) >= 0).all() and all(a <= v <= b for v, (a, b) in zip(x, map(runs.bounds, c.tolist()), strict=True))
    assert runs._cells(np.array([-0.0]))[0] == runs._cells(np.array([0.0]))[0]


def test_rows_of_many_measures_are_sorted_once_and_summed_up_unsorted(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 11), float(i)) for i in range(300)], "row_id long, x double, y double, z double")
    both = series.together(df, ["x", "y", "z"], None, F.col("row_id"), whole={"x", "y", "z"})
    long = both.long(F.concat(F.lit("#"), "row_id"))
    assert both.rows.count() == 300 and long.count() == 900
    for far in (False, True):
        about = {m: {"n": 300} for m in "xyz"}
        mad = dict.fromkeys("xyz", 0.01 if far else 1e9)
        tops, _ = passes.seasons_and_outliers(long, about, dict.fromkeys("xyz", 3.0), mad, False)
        assert {m: (t["top"]["i"], t["top"]["label"]) for m, t in tops.items()} == ({"x": (0, "#0"), "y": (10, "#10"), "z": (299, "#299")} if far else {})
    assert passes.points(long, passes.buckets(about, 100), {(m, i): (f"#{i}",) for m in "xyz" for i in range(300)})["z"][1] == {"label": "#3", "value": 4.0, "size": 3}


def test_first_rows_beyond_early_ids(spark):
    """Ids may begin anywhere: then all rows are ranked."""
    for start in (0, passes.EARLY - 50, 10**12):
        df = spark.range(start, start + 900).selectExpr("id AS row_id", "if(id % 3 = 0, 'a', 'b') AS c", "CAST(id AS DOUBLE) AS m")
        a = [i for i in range(start, start + 900) if i % 3 == 0]
        assert passes.first_rows(df, [("c", "m", ["a"]), ("c", "m", ["a", "b"])]) == [a[:200], list(range(start, start + 200))]


def test_medians_of_values_that_many_rows_have(spark, monkeypatch):
    """Equal values are one row to be put in order, however many they are; only many different ones take ranges."""
    x = [float(i % 5) for i in range(400)] + [1000.0 + i / 1000 for i in range(401)]
    rows = spark.createDataFrame([("x", v) for v in x], "metric string, v double")
    ranged, quantiles = [], series.quantiles
    monkeypatch.setattr(series, "quantiles", lambda *a: ranged.append(1) or quantiles(*a))
    for most, calls in ((1000, 0), (100, 0), (3, 1)):
        monkeypatch.setattr(passes, "SORTED", most)
        assert passes.medians(rows, F.col("v"), {"x": (0.0, 1000.005, 406)}, {"x": 801}) == {"x": float(np.median(x))}
        assert len(ranged) == calls
