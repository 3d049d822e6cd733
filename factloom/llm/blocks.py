"""Conversations of any length, cut into blocks, and shortest paths through all blocks of one.

Turns are numbered where they lie after a sort by range, and a block is a stretch of a conversation of a bounded size
(or one turn). For a conversation of several blocks each block says what it costs to come from each state before it to
each one behind it. These costs add up, from the last block on, to the costs behind each block, with which a block
knows where it is left for every state that it is entered in. A block's few numbers stream through one task for each
conversation, one block after the other; nothing of that comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import series
from .common import checkpoint

#: Bytes of a block, and what a turn counts besides its text.
BLOCK, TURN = 4 << 20, 256
NEVER = 1 << 40
Costs = tuple[int, ...]


def numbered(turns: DataFrame, role: Column, text: Column) -> DataFrame:
    """(g, i, turn, role, text, sha): g tells conversations apart, i is a turn's place in its own, by turn, role and
    SHA-256 of the text, nulls first."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("g"), F.col("turn").cast("long").alias("turn"),
        role.cast("string").alias("role"), text.cast("string").alias("text"),
    )
    rows = rows.withColumns({"sha": F.sha2("text", 256), "_row": F.monotonically_increasing_id()})
    has = {f"_has_{c}": F.col(c).isNotNull() for c in ("turn", "role", "sha")}
    order = [x for c in ("turn", "role", "sha") for x in (f"_has_{c}", c)]
    return series.ordinals(rows.withColumns(has), ["g"], [*order, "_row"]).drop("_row", *has)


def conv_id() -> Column:
    return F.when(F.col("g") != " ", F.col("g")).cast("long").alias("conv_id")


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(TURN)


def with_blocks(rows: DataFrame, size: str, most: int) -> DataFrame:
    """rows (g, i, size) with block."""
    rows = series.prefix_sums(rows, ["g"], {"_sum": size})
    return rows.withColumn("block", F.floor(F.col("_sum") / most)).drop("_sum")


def runs(batches: Iterator[pa.RecordBatch], by: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each stretch with the same values of by; rows come sorted."""
    key, held = None, []
    for b in batches:
        keys = zip(*(b.column(c).to_pylist() for c in by), strict=True)
        for k, row in zip(keys, zip(*(b.column(c).to_pylist() for c in columns), strict=True), strict=True):
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append(row)
    if held:
        yield key, held


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def plans(
    turns: DataFrame,
    code: str,
    codes: Callable[[list], bytes],
    crossing: Callable[[bytes], list[int]],
    exits: Callable[[bytes, Costs], list[int]],
    close: Costs,
) -> DataFrame:
    """(g, block, state, ahead, last) of the blocks of conversations that have several, written down: the state before a
    block, the costs behind it by the state there, and whether it is the last one.

    turns has g, block, i and the column code, which codes() turns to a byte for each turn. crossing() gives the costs
    from state to state (of four, row by row), exits() the state behind for each one before; close is what it costs to end.
    """
    several = turns.groupBy("g").agg(F.max("block").alias("most"), F.min("block").alias("least")).where("most > least").select("g")
    rows = checkpoint(turns.join(checkpoint(several), "g", "left_semi").select("g", "block", "i", code))
    numbers, n = pa.list_(pa.int64()), len(close)
    a_block = [("g", pa.string()), ("block", pa.int64())]

    def in_order(df: DataFrame, *columns: str) -> DataFrame:
        return df.select("g", "block", "i", code, *columns).repartition("g", "block").sortWithinPartitions("g", "block", "i")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, block), run in runs(batches, ["g", "block"], [code]):
            yield batch([(g, block, crossing(codes([x[0] for x in run])))], pa.schema([*a_block, ("m", numbers)]))

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, costs = None, close
        for b in batches:
            out = []
            for one, block, m in zip(*(b.column(c).to_pylist() for c in ("g", "block", "m")), strict=True):
                last = one != g
                g, costs = one, close if last else costs
                out.append((g, block, list(costs), last))
                costs = tuple(min(NEVER, *(m[n * q + e] + costs[e] for e in range(n))) for q in range(n))
            if out:
                yield batch(out, pa.schema([*a_block, ("ahead", numbers), ("last", pa.bool_())]))

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, block), run in runs(batches, ["g", "block"], [code, "ahead", "last"]):
            to = exits(codes([x[0] for x in run]), tuple(run[0][1]))
            yield batch([(g, block, to, *run[0][1:])], pa.schema([*a_block, ("m", numbers), ("ahead", numbers), ("last", pa.bool_())]))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, state = None, 0
        for b in batches:
            out = []
            for one, block, m, ahead, last in zip(*(b.column(c).to_pylist() for c in ("g", "block", "m", "ahead", "last")), strict=True):
                g, state = one, state if one == g else 0
                out.append((g, block, state, ahead, last))
                state = m[state]
            if out:
                yield batch(out, pa.schema([*a_block, ("state", pa.int32()), ("ahead", numbers), ("last", pa.bool_())]))

    costs = in_order(rows).mapInArrow(cross, "g string, block long, m array<long>")
    costs = costs.repartition("g").sortWithinPartitions("g", F.col("block").desc()).mapInArrow(behind, "g string, block long, ahead array<long>, last boolean")
    left = in_order(rows.join(checkpoint(costs), ["g", "block"]), "ahead", "last")
    left = left.mapInArrow(leave, "g string, block long, m array<long>, ahead array<long>, last boolean")
    left = left.repartition("g").sortWithinPartitions("g", "block")
    return checkpoint(left.mapInArrow(enter, "g string, block long, state int, ahead array<long>, last boolean"))


def planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (g, block, i), those of a block together and in order, with state, ahead and last (null for a conversation
    of one block)."""
    if plan.isEmpty():
        none = {"state": "int", "ahead": "array<long>", "last": "boolean"}
        rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in none.items()})
    else:
        rows = rows.join(plan, ["g", "block"], "left")
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "i")
