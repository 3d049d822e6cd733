import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.streaming import decisions, events

SCHEMA = "k string, ts timestamp_ntz, event_id long, value double"


@pytest.fixture
def arrivals(spark, tmp_path):
    """Events in files, shuffled within the watermark, and the last one far ahead so that all others are decided on."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", decisions.PROVIDER)
    rng, start = random.Random(3), dt.datetime(2024, 1, 1, 22)
    rows = [(rng.choice(["a", "a", "b", None]), start + dt.timedelta(seconds=i * 40 + rng.random(), microseconds=i), i, float(i)) for i in range(240)]
    rows += [(k, t, i + 1000, v) for k, t, i, v in rng.sample(rows, 20)]  # equal times
    rows.sort(key=lambda r: r[1].timestamp() + rng.uniform(-250, 250))
    rows.append(("z", start + dt.timedelta(days=4), 5000, 0.0))
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]

    def put(k):
        folder = tmp_path / "in"
        spark.createDataFrame(parts[k], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        return str(folder)

    yield rows[:-1], len(parts), put
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, tmp_path, arrivals, form):
    """All that a stream says of events that arrive in turn, the query being started anew for every second part."""
    rows, n, put = arrivals
    for k in range(n):
        folder = put(k)
        if k % 2 and k < n - 1:
            continue
        stream = form(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(300)
    return spark.read.parquet(str(tmp_path / "out")), spark.createDataFrame(rows, SCHEMA)


def test_quotas_of_a_stream_equal_those_of_a_batch(spark, tmp_path, arrivals):
    got, rows = run(spark, tmp_path, arrivals, lambda s: decisions.admitted_stream(s, "k", quota=3))
    want = events.admitted(rows, "k", quota=3)
    key = lambda df: sorted((r["event_id"], str(r["k"]), r["ts"], r["value"], r["hit"], r["remaining"], r["allowed"]) for r in df.collect())
    assert key(got) == key(want)
    assert {r["d"] for r in rows.select(F.to_date("ts").alias("d")).distinct().collect()} == {dt.date(2024, 1, 1), dt.date(2024, 1, 2)}


def test_repeats_of_a_stream_equal_those_of_a_batch(spark, tmp_path, arrivals):
    got, rows = run(spark, tmp_path, arrivals, lambda s: decisions.first_seen_in_order(s, ["k"], seconds=300))
    want = events.first_seen(rows, ["k"], seconds=300)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect())
    assert 0 < got.count() < rows.count() and got.columns == rows.columns
