"""Event streams: quotas by client and day, suppression of repeats, and rollups.

Each has a streaming form with a watermark and, where it makes sense, a batch form with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import series

#: Hits of a client in a UTC day that are free (fixed value).
DAILY_QUOTA = 25
#: How long a key is remembered (fixed value).
REMEMBERED = "10 minutes"


#: Most events of a key that one task puts in order.
TOGETHER = 1_000_000


def _largest(rows: DataFrame, keys: list[str]) -> int:
    """The number of rows of the most frequent key."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def daily_hits(events: DataFrame, client: str = "user_id", ts: str = "ts", late: str | None = None) -> DataFrame:
    """(client, day, hits, over_quota): the hits of each client and UTC day; late sets a watermark."""
    if late:
        events = events.withWatermark(ts, late)
    day = F.window(ts, "1 day")
    hits = events.groupBy(client, day.alias("w")).agg(F.count(F.lit(1)).alias("hits"))
    return hits.select(client, F.col("w.start").cast("date").alias("day"), "hits", (F.col("hits") > DAILY_QUOTA).alias("over_quota"))


def admitted(events: DataFrame, client: str = "user_id", ts: str = "ts", order: str = "event_id", quota: int = DAILY_QUOTA) -> DataFrame:
    """events with hit (from 1 in its client's day), remaining and allowed. Batch only.

    Where no day of a client has more than TOGETHER events a window numbers them; else days lie over several tasks.
    """
    rows = events.withColumn("_day", F.to_date(ts))
    if _largest(rows, [client, "_day"]) <= TOGETHER:
        order_ = Window.partitionBy(client, "_day").orderBy(F.col(ts).asc_nulls_last(), F.col(order).asc_nulls_last())
        out = rows.withColumn("hit", F.row_number().over(order_).cast("long")).drop("_day")
    else:
        out = series.ordinals(rows, [client, "_day"], [ts, order], "hit").withColumn("hit", F.col("hit") + 1).drop("_day")
    return out.withColumns(
        {"remaining": F.greatest(F.lit(0), F.lit(quota) - F.col("hit")), "allowed": F.col("hit") <= quota}
    )


def first_seen_stream(events: DataFrame, keys: list[str], ts: str = "ts", remembered: str = REMEMBERED) -> DataFrame:
    """The first event of each key; repeats within the time are dropped. Streaming only."""
    return events.withWatermark(ts, remembered).dropDuplicatesWithinWatermark(keys)


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", order: str = "event_id", seconds: int = 600) -> DataFrame:
    """Events that come more than so many seconds after the last kept one of their key. Batch form.

    A key of up to TOGETHER events goes to one task. A gap of more than the time starts anew whatever was before, so
    where there are larger keys, keys are cut into stretches at their gaps. Gaps
    are found between rows with neighbouring ordinals; only a stretch, not a key, goes to one task, through which
    its rows stream while the last kept time is held.
    """
    # one column for all keys, in which nulls are equal
    rows = events.withColumns({"_key": F.struct(*keys), "_at": F.unix_micros(F.col(ts).cast("timestamp"))})
    if _largest(events, keys) <= TOGETHER:  # then a key is a stretch
        rows = rows.select(*events.columns, "_at", F.lit(0).cast("long").alias("_stretch"))
    else:
        rows = series.previous(series.ordinals(rows, ["_key"], ["_at", order]), ["_key"], {"_was": "_at"})
        gap = F.when(F.col("_at") - F.col("_was") > seconds * 1_000_000, 1).otherwise(0)
        rows = series.prefix_sums(rows.withColumn("_gap", gap), ["_key"], {"_gaps": "_gap"})
        rows = rows.withColumn("_stretch", F.col("_gaps") + F.col("_gap")).select(*events.columns, "_at", "_stretch")
    rows = rows.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "_at", order)
    columns = [*keys, "_stretch"]

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0
        for b in batches:
            kept = []
            for k, at in zip(b[columns].itertuples(index=False, name=None), b["_at"].tolist(), strict=True):
                fresh = k != key or at - last > seconds * 1_000_000
                if fresh:
                    key, last = k, at
                kept.append(fresh)
            yield b[kept]

    return rows.mapInPandas(keep, rows.schema).drop("_at", "_stretch")


def tumbling(events: DataFrame, width: str = "1 hour", ts: str = "ts", by: str = "event_type", late: str | None = None) -> DataFrame:
    """(start, by, n, sum) of fixed windows."""
    if late:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"))
    return out.select(F.col("w.start").alias("start"), by, "n", "sum")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", ts: str = "ts", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.window(ts, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"))
    return out.select(F.col("w.start").alias("start"), "n", "sum")


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", client: str = "user_id", late: str | None = None) -> DataFrame:
    """(client, start, end, n): stretches of events with no longer gap; end is the last event."""
    if late:
        events = events.withWatermark(ts, late)
    out = events.groupBy(client, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("end"))
    return out.select(client, F.col("w.start").alias("start"), "end", "n")


def day_cells() -> list[Column]:
    """What is kept of a day's values: their number, mean and sum of squared deviations."""
    n = F.count("value")
    return [n.alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * n).alias("m2")]


def daily_sums(events: DataFrame, late: str, ts: str = "ts", by: str = "event_type") -> DataFrame:
    """States from which a day's facts are made, and which merge over batches: (day, by, n, mean, m2)."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), by).agg(*day_cells())
    return out.select(F.col("w.start").cast("date").alias("day"), by, "n", "mean", "m2")


def write_sums(sums: DataFrame, epoch: int, path: str) -> None:
    """A batch's sums in a folder of its own: a batch that is repeated after a failure replaces itself.

    For foreachBatch: lambda df, epoch: write_sums(df, epoch, path).
    """
    sums.coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def totals(spark: SparkSession, path: str, by: str = "event_type") -> DataFrame:
    """(by, day, n, mean, stdev) over all batches so far; states merge by pairwise update."""

    def both(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        merged = F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))
        return F.when(n == a["n"], a).otherwise(merged)

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    states = spark.read.parquet(path).groupBy(by, "day").agg(F.array_sort(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), "mean", "m2"))).alias("s"))
    states = states.select(by, "day", F.aggregate("s", none, both).alias("s"))
    spread = F.coalesce(F.sqrt(F.try_divide("s.m2", F.col("s.n") - 1)), F.lit(0.0))
    return states.select(by, "day", F.col("s.n").cast("long").alias("n"), F.col("s.mean").alias("mean"), spread.alias("stdev"))
