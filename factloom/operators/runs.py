"""Runs of moves one way, splits into two levels and cells of values, found where the rows of series lie.

Each task goes through its rows in order and sums them up in a stretch, a row for each task and metric: its sum, its
peak, its first, last and longest run. Stretches are put together in the order of their ordinals. Rows out of order
make more stretches, but no other result. On the way tasks count their values by cells of doubles that are neighbours,
from which medians are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .ordered import CHANGE_EDGE, CHANGE_POINTS
from .series import Together

#: Bits of a double that don't count for its cell: 4,096 cells lie between a number and its double.
CELL = 40


@dataclass
class Run:
    """at is the ordinal after the first move; a and b are the values before and after all moves."""

    at: int
    moves: int
    sign: int
    a: float
    b: float


class Runs:
    """Runs that come in order: neighbours one way become one."""

    def __init__(self) -> None:
        self.head = self.best = self.open = None

    def add(self, run: Run) -> None:
        o = self.open
        if o and o.sign == run.sign and o.at + o.moves == run.at:
            self.open = Run(o.at, o.moves + run.moves, o.sign, o.a, run.b)
        else:
            self.close()
            self.open = run

    def close(self) -> None:
        if self.open and self.head is None:
            self.head = self.open
        elif self.open:
            self.offer(self.open)
        self.open = None

    def offer(self, run: Run) -> None:
        """The longest one stays, the first of equals."""
        if run.sign and (self.best is None or (run.moves, -run.at) > (self.best.moves, -self.best.at)):
            self.best = run

    def feed(self, i: int, v: np.ndarray) -> None:
        """All runs of values of which the first has ordinal i."""
        sign = np.sign(v[1:] - v[:-1])
        if not len(sign):
            return
        begin = np.concatenate(([0], np.flatnonzero(sign[1:] != sign[:-1]) + 1))
        moves = np.diff(begin, append=len(sign))
        run = lambda k: Run(i + 1 + int(begin[k]), int(moves[k]), int(sign[begin[k]]), float(v[begin[k]]), float(v[begin[k] + moves[k]]))
        self.add(run(0))
        if len(begin) > 2:
            inner = np.where(sign[begin[1:-1]] != 0, moves[1:-1], 0)
            self.close()
            self.offer(run(1 + int(np.argmax(inner))))
        if len(begin) > 1:
            self.add(run(len(begin) - 1))


_RUN = "struct<at: bigint, moves: bigint, sign: bigint, a: double, b: double>"
_STRETCH = f"struct<i: bigint, n: bigint, total: double, first: double, last: double, high: double, at: bigint, runs: array<{_RUN}>>"
_L, _D = pa.int64(), pa.float64()
_RUN_ARROW = pa.struct([("at", _L), ("moves", _L), ("sign", _L), ("a", _D), ("b", _D)])
_STRETCH_ARROW = pa.struct([("i", _L), ("n", _L), ("total", _D), ("first", _D), ("last", _D), ("high", _D), ("at", _L), ("runs", pa.list_(_RUN_ARROW))])
#: A row is a count of a cell, or else a stretch or a split.
_CELLS, _CELLS_ARROW = "metric long, cell long, count long", [("metric", _L), ("cell", _L), ("count", _L)]


def _pieces(b: pa.RecordBatch, value: str, place: str) -> Iterator[tuple[int, np.ndarray]]:
    """The values of a metric in a batch with the ordinal of the first, cut where ordinals don't follow each other."""
    v, i = b.column(value), b.column(place)
    if v.null_count:
        i, v = i.filter(v.is_valid()), v.drop_null()
    i, v = i.to_numpy(), v.to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(i) != 1) + 1).tolist(), len(i)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield int(i[a]), v[a:z]


def _cells(v: np.ndarray) -> np.ndarray:
    """The number of each value's cell; cells are in the order of their values."""
    bits = (v + 0.0).view(np.int64)  # without a zero's sign
    return np.where(bits < 0, ~(bits & np.int64((1 << 63) - 1)), bits) >> CELL


def bounds(cell: int) -> tuple[float, float]:
    """The least and the greatest double of a cell."""
    ends = np.array([cell << CELL, (cell << CELL) + (1 << CELL) - 1], np.int64)
    back = np.where(ends < 0, ~ends | np.int64(-1 << 63), ends).view(np.float64)
    return float(back[0]), float(back[1])


class _Counts:
    """Values counted by metric and cell."""

    def __init__(self) -> None:
        self.of: dict[int, dict[int, int]] = {}

    def add(self, k: int, v: np.ndarray) -> None:
        own = self.of.setdefault(k, {})
        for c, n in zip(*(x.tolist() for x in np.unique(_cells(v), return_counts=True)), strict=True):
            own[c] = own.get(c, 0) + n

    def rows(self) -> list[dict]:
        return [{"metric": k, "cell": c, "count": n} for k, own in self.of.items() for c, n in own.items()]


def _run(of: Together, metrics: list[str], make, schema: str) -> DataFrame:
    columns = dict.fromkeys(x for m in metrics for x in (of.values[m], of.places[m]))
    return of.rows.select(*columns).mapInArrow(make, schema)


def _middle(counts: DataFrame, metrics: list[str]) -> dict[str, tuple[float, float, int]]:
    """(low, high, values from low to high) of the cells that the middle values of each metric lie in."""
    by = Window.partitionBy("metric").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = counts.groupBy("metric", "cell").agg(F.sum("count").alias("count")).withColumn("to", F.sum("count").over(by))
    n = F.max("to").over(Window.partitionBy("metric"))
    low, high = F.floor((n - 1) / 2), F.ceil((n - 1) / 2)
    some = cells.withColumns({"low": low, "high": high}).where("(to > low AND to - count <= low) OR (to > high AND to - count <= high)")
    out = {}
    for r in some.groupBy("metric").agg(F.min("cell").alias("a"), F.max("cell").alias("b"), F.sum("count").alias("n")).collect():
        out[metrics[r["metric"]]] = (bounds(r["a"])[0], bounds(r["b"])[1], r["n"])
    return out


def stretches(of: Together, metrics: list[str]) -> tuple[dict[str, list], dict[str, tuple[float, float, int]]]:
    """The stretches of each metric in the order of their ordinals, some for each task; and the cells of its median."""
    columns = [(of.values[m], of.places[m]) for m in metrics]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, dict] = {}
        counts, schema = _Counts(), pa.schema([*_CELLS_ARROW, ("stretch", _STRETCH_ARROW)])

        def done(k: int) -> dict:
            x = own.pop(k)
            r: Runs = x.pop("found")
            tail, r.open = r.open, None
            return {"metric": k, "stretch": x | {"runs": [vars(y) for y in (r.head, r.best, tail) if y]}}

        for b in batches:
            out = []
            for k, c in enumerate(columns):
                for i, v in _pieces(b, *c):
                    if k in own and own[k]["i"] + own[k]["n"] != i:
                        out.append(done(k))
                    top = int(np.argmax(v))
                    x = own.setdefault(k, {"i": i, "n": 0, "total": 0.0, "first": float(v[0]), "last": None, "high": -np.inf, "at": i, "found": Runs()})
                    x["found"].feed(i, v) if x["last"] is None else x["found"].feed(i - 1, np.concatenate(([x["last"]], v)))
                    if v[top] > x["high"]:
                        x["high"], x["at"] = float(v[top]), i + top
                    x["n"], x["total"], x["last"] = x["n"] + len(v), x["total"] + float(v.sum()), float(v[-1])
                    counts.add(k, v)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if rows := [done(k) for k in list(own)] + counts.rows():
            yield pa.RecordBatch.from_pylist(rows, schema)

    got = checkpoint(_run(of, metrics, make, f"{_CELLS}, stretch {_STRETCH}"))
    out: dict[str, list] = {m: [] for m in metrics}
    for r in sorted(got.where("stretch IS NOT NULL").collect(), key=lambda r: r["stretch"]["i"]):
        out[metrics[r["metric"]]].append(r["stretch"])
    return out, _middle(got.where("stretch IS NULL"), metrics)


def peak(parts: list) -> int:
    """The first ordinal that has the largest value of a series."""
    return max(((r["high"], -r["at"]) for r in parts))[1] * -1


def longest(parts: list) -> Run | None:
    """The longest run of a series, the first of equals, from its stretches."""
    found, last = Runs(), None
    for r in parts:
        if last is not None:
            found.add(Run(r["i"], 1, int(np.sign(r["first"] - last)), last, r["first"]))
        for x in r["runs"]:
            found.add(Run(**x.asDict()))
        last = r["last"]
    found.close()
    if found.head:
        found.offer(found.head)
    return found.best


def splits(
    of: Together, metrics: list[str], parts: dict[str, list], sums: dict[str, float], median: dict[str, float]
) -> tuple[dict[str, int], dict[str, tuple[float, float, int]]]:
    """The split of each series that explains most, the first of equals (see ordered.gain_of); and the cells of the
    median distance from the median."""
    columns = [(of.values[m], of.places[m]) for m in metrics]
    before: dict[tuple[int, int], float] = {}
    sizes = [sum(r["n"] for r in parts[m]) for m in metrics]
    for k, m in enumerate(metrics):
        left = 0.0
        for r in parts[m]:
            before[k, r["i"]] = left
            left += r["total"]
    totals, middles = [sums[m] for m in metrics], [median[m] for m in metrics]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, int]] = {}
        reached: dict[int, tuple[int, float]] = {}
        counts = _Counts()
        for b in batches:
            for k, c in enumerate(columns):
                n, total = sizes[k], totals[k]
                for i, v in _pieces(b, *c):
                    counts.add(k, np.abs(v - middles[k]))
                    at, left = reached.get(k, (None, 0.0))
                    lefts = (left if at == i else before[k, i]) + np.concatenate(([0.0], np.cumsum(v)))
                    reached[k] = (i + len(v), float(lefts[-1]))
                    a, z = max(i, CHANGE_EDGE), min(i + len(v) - 1, n - CHANGE_EDGE)
                    if n < CHANGE_POINTS or a > z:
                        continue
                    p, x = np.arange(a, z + 1), lefts[a - i : z + 1 - i]
                    gain = p * (x / p - total / n) ** 2 + (n - p) * ((total - x) / (n - p) - total / n) ** 2
                    j = int(np.argmax(gain))
                    best[k] = max(best.get(k, (-1.0, 0)), (float(gain[j]), -a - j))
        rows = [{"metric": k, "gain": g, "split": -i} for k, (g, i) in best.items()] + counts.rows()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*_CELLS_ARROW, ("gain", _D), ("split", _L)]))

    got = checkpoint(_run(of, metrics, make, f"{_CELLS}, gain double, split long"))
    found: dict[str, tuple[float, int]] = {}
    for r in got.where("split IS NOT NULL").collect():
        m = metrics[r["metric"]]
        found[m] = max(found.get(m, (-1.0, 0)), (r["gain"], -r["split"]))
    return {m: -i for m, (_, i) in found.items()}, _middle(got.where("split IS NULL"), metrics)
