"""Decisions on events as they arrive, equal to the batch forms in events.py: quotas and suppression of repeats.

Events come in any order within a watermark. A key's events wait in its state until the watermark has passed them, and
are decided on in the order of (time, order): by then all that came before is there. What a decision needs of the past
is one number and a time for each key, which timers clear once they can't matter any more. State lies in RocksDB with
the stream's checkpoint, so a restart goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import DAILY_QUOTA

#: The state store that timers and several states need, to be set as spark.sql.streaming.stateStore.providerClass.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
_DAY = 86_400_000_000


class _InOrder(StatefulProcessor):
    """Takes a key's events in the order of (time, order) once the watermark has passed them.

    A subclass decides: memory is (count, at) before an event, None at first. Times are in microseconds.
    """

    def decide(self, memory: tuple[int, int] | None, at: int) -> tuple[tuple[int, int], int | None]:
        """The memory after an event, and what is said of it (None: it goes)."""
        raise NotImplementedError

    def forgets(self, memory: tuple[int, int]) -> int:
        """From when on a memory doesn't matter any more."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq string, row string")
        self.memory = handle.getValueState("memory", "n long, at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for df in rows:
            new = list(zip(df["at"].tolist(), df["seq"].tolist(), df["row"].tolist(), strict=True))
            self.waiting.appendList(new)
            self._wake(min(x[0] for x in new))
        return iter(())

    def _wake(self, at: int) -> None:
        # the first millisecond that doesn't come before it
        self.handle.registerTimer(max(1, -(-at // 1000)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(x) for x in self.waiting.get()]
        ready = sorted((x for x in waiting if x[0] <= now), key=lambda x: (x[0], len(x[1]), x[1]))
        later = [x for x in waiting if x[0] > now]
        memory = tuple(self.memory.get()) if self.memory.exists() else None
        out = []
        for at, _, row in ready:
            memory, said = self.decide(memory, at)
            if said is not None:
                out.append((row, said))
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
            self.memory.update(memory)
            self._wake(self.forgets(memory))
        elif memory is not None and self.forgets(memory) <= now and not later:
            self.memory.clear()
        if later:
            self._wake(min(x[0] for x in later))
        if out:
            yield pd.DataFrame(out, columns=["row", "said"])

    def close(self) -> None:
        pass


class _Quota(_InOrder):
    """Counts a client's events of a UTC day; a memory is the count and the day's midnight."""

    def decide(self, memory, at):
        midnight = at - at % _DAY
        n = memory[0] + 1 if memory and memory[1] == midnight else 1
        return (n, midnight), n

    def forgets(self, memory):
        return memory[1] + _DAY


class _FirstSeen(_InOrder):
    """Keeps events that come more than so long after the last kept one; a memory is its time."""

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def decide(self, memory, at):
        if memory is None or at - memory[1] > self.micros:
            return (0, at), 1
        return memory, None

    def forgets(self, memory):
        # an event at just this distance is still a repeat
        return memory[1] + self.micros + 1


def _decided(events: DataFrame, keys: list[str], ts: str, order: str, late: str, processor: _InOrder) -> DataFrame:
    # session windows apart, watermarks want a timestamp; times without a zone are taken as the session's (UTC)
    marked = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    rows = marked.select(
        F.to_json(F.struct(*keys), _JSON).alias("key"), F.unix_micros("_ts").alias("at"), F.col(order).cast("string").alias("seq"),
        F.to_json(F.struct(*events.columns), _JSON).alias("row"), "_ts",
    )
    out = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType="row string, said long", outputMode="Append", timeMode="EventTime"
    )
    return out.select(F.from_json("row", events.schema, _JSON).alias("e"), "said").select("e.*", "said")


def admitted_stream(
    events: DataFrame, client: str = "user_id", ts: str = "ts", order: str = "event_id", quota: int = DAILY_QUOTA, late: str = "10 minutes"
) -> DataFrame:
    """events.admitted() for a stream: hit, remaining and allowed of each event, once nothing earlier can come.

    order is a column of whole numbers. Rows later than the watermark are dropped, as in all streams.
    """
    out = _decided(events, [client], ts, order, late, _Quota()).withColumnRenamed("said", "hit")
    return out.withColumns({"remaining": F.greatest(F.lit(0), F.lit(quota) - F.col("hit")), "allowed": F.col("hit") <= quota})


def first_seen_in_order(
    events: DataFrame, keys: list[str], ts: str = "ts", order: str = "event_id", seconds: int = 600, late: str = "10 minutes"
) -> DataFrame:
    """events.first_seen() for a stream: the time counts from the last kept event, not from the last one."""
    return _decided(events, keys, ts, order, late, _FirstSeen(seconds * 1_000_000)).drop("said")
