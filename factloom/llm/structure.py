"""Conversation structure repair: the cheapest edits that make a conversation legal, and their audit.

Turns are kept (K), get another role (R), are deleted (D), or an empty turn is inserted (I), so that the initials of
the roles are an optional s and then ua, once or more, or nothing at all. Places between turns and states of that
automaton are the nodes of a graph, edits its arcs. Their costs are small integers, so Dial's bucket queue settles
the nodes in the order of their distances to a legal end: a list for each distance, without a heap. From the start a
walk then takes, of the arcs that are tight (an arc's cost and the distance behind it make the distance before it),
the one whose letter comes first: that is the ASCII-least of all cheapest audits.

A conversation may be longer than a task can hold: it is cut into blocks, of which each knows the state that it is entered
in and the distances behind it (blocks.py), and walks on its own. Earlier turns with the same role and text are found
by an aggregation, neighbours by ordinals. The digest of a repaired text is the one thing that has to be made in order:
the blocks of a conversation stream through one task for it, which holds one at a time.

Defined results: turns are ordered by turn, nulls first, then by role and text; equal rows are turns of their own. Null
roles and texts are one space each. A role is known by its first character, and only by the letters s, u and a. Very
long texts are read whole; a block has one at least. Rows with a null conv_id form a conversation. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series
from . import blocks
from .common import checkpoint, slices, table

#: Costs of the edits, and of a truncated turn that stays (fixed values).
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Bytes of a block.
BLOCK = blocks.BLOCK
ROLES = {1: "system", 2: "user", 3: "assistant"}
BLANK, CUT = "[^\\x20\\x09-\\x0D]", "[.!?][\\x20\\x09-\\x0D]*\\z"
_NEVER = blocks.NEVER
#: States: 0 at the start, then the role of the last turn. The state after an inserted or re-roled turn, and after a
#: kept one of each role; what it costs to end.
_NEXT = (2, 2, 3, 2)
_KEPT = ({}, {0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3})
CLOSE = (0, 2 * INSERT, INSERT, 0)

# A turn is a number: its role (0 to 3, 0 for others), plus 4 if it is truncated, or 8 if it has to go.
_CUT, _GONE = 4, 8


def _arcs(turn: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, state before, state after) of what may be done with a turn."""
    out = [("D", DELETE, q, q) for q in range(4)]
    if turn < _GONE:
        more = TRUNCATED if turn & _CUT else 0
        out += [("K", KEEP + more, q, to) for q, to in _KEPT[turn & 3].items()]
        out += [("R", REROLE + more, q, _NEXT[q]) for q in range(4)]
    return out


_ARCS = [_arcs(t) for t in range(12)]
_INTO = [[[(q, cost) for _, cost, q, to in arcs if to == s] for s in range(4)] for arcs in _ARCS]
_OUT = [[sorted((x, cost, to) for x, cost, q, to in arcs if q == s) for s in range(4)] for arcs in _ARCS]
_INSERTED = [[q for q in range(4) if _NEXT[q] == s] for s in range(4)]


def distances(turns: bytes, ahead: tuple[int, ...]) -> list[int]:
    """The distance of each node (4 * place + state) to a legal end, where ahead has what follows the last turn.

    Turns may be inserted before each turn; what is inserted behind the last one is part of ahead.
    """
    n = 4 * len(turns)
    found = [_NEVER] * (n + 4)
    least = min(ahead)
    buckets: list[list[int]] = [[] for _ in range(1 + max((x - least for x in ahead if x < _NEVER), default=0))]
    for q, x in enumerate(ahead):
        if x < _NEVER:
            buckets[x - least].append(n + q)
    at = 0
    while at < len(buckets):
        # a bucket may grow while it is emptied: keeping a turn costs nothing
        bucket = buckets[at]
        while bucket:
            node = bucket.pop()
            if found[node] <= at:
                continue
            found[node] = at
            place, state = node >> 2, node & 3
            before = [(4 * (place - 1) + q, cost) for q, cost in _INTO[turns[place - 1]][state]] if place else []
            if node < n:
                before += [(4 * place + q, INSERT) for q in _INSERTED[state]]
            for other, cost in before:
                if found[other] > at + cost:
                    while len(buckets) <= at + cost:
                        buckets.append([])
                    buckets[at + cost].append(other)
        at += 1
    return [x + least if x < _NEVER else x for x in found]


def walk(turns: bytes, found: list[int], state: int) -> tuple[str, int]:
    """The ASCII-least tight way from a state through some turns: its letters, and the state that it ends in."""
    out, place = [], 0
    while place < len(turns):
        have, options = found[4 * place + state], _OUT[turns[place]][state]
        step = [(x, to, 1) for x, cost, to in options if cost + found[4 * place + 4 + to] == have]
        if INSERT + found[4 * place + _NEXT[state]] == have:
            step.append(("I", _NEXT[state], 0))
        letter, state, on = min(step)
        out.append(letter)
        place += on
    return "".join(out), state


@lru_cache(maxsize=1 << 14)
def _short(turns: bytes, state: int, ahead: tuple[int, ...]) -> tuple[str, int]:
    return walk(turns, distances(turns, ahead), state)


def edits(turns: bytes, state: int = 0, ahead: tuple[int, ...] = CLOSE, last: bool = True) -> str:
    """The letters of the cheapest edits from a state on; last adds the turns that are inserted behind the last one."""
    letters, end = _short(turns, state, ahead) if len(turns) <= 64 else walk(turns, distances(turns, ahead), state)
    return letters + "I" * (CLOSE[end] // INSERT if last else 0)


def cost_of(letters: str, turns: bytes) -> int:
    """What edits cost."""
    place, sum_ = 0, 0
    for x in letters:
        sum_ += {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[x]
        if x != "I":
            sum_ += TRUNCATED if x in "KR" and turns[place] & _CUT else 0
            place += 1
    return sum_


def applied(letters: str, turns: bytes, state: int = 0) -> Iterator[tuple[str, int, int | None]]:
    """(letter, role, place) of each edit: place is the turn that it is done to, None for an inserted one."""
    place = 0
    for x in letters:
        if x == "D":
            yield x, 0, place
        else:
            state = _KEPT[turns[place] & 3][state] if x == "K" else _NEXT[state]
            yield x, state, None if x == "I" else place
        place += x != "I"


# ---- on Spark -------------------------------------------------------------------------


def _ordered(turns: DataFrame) -> DataFrame:
    """(g, i, turn, role, text, sha) of each turn; nulls are one space."""
    return blocks.numbered(turns, F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" ")))


def _told(ordered: DataFrame) -> DataFrame:
    """(g, i, turn, t, fault, illegal, block) of each turn, written down; t is the number that stands for the turn."""
    rows = ordered.select(
        "g", "i", "turn", "role", "sha", F.substring("role", 1, 1).alias("_r"), blocks.size_of(F.col("text")).alias("_size"),
        (~F.col("text").rlike(BLANK)).alias("_blank"), (~F.col("text").rlike(CUT)).alias("_cut"),
    )
    rows = blocks.with_blocks(series.previous(rows, ["g"], {"_was": "_r"}), "_size", BLOCK)
    first = rows.groupBy(F.col("g").alias("_g"), F.col("role").alias("_role"), F.col("sha").alias("_s")).agg(F.min("i").alias("_first"))
    rows = rows.join(first, (F.col("g") == F.col("_g")) & (F.col("role") == F.col("_role")) & (F.col("sha") == F.col("_s")))
    fault = F.when(F.col("_blank"), "blank").when(F.col("i") > F.col("_first"), "duplicate").when(F.col("_cut"), "truncated")
    role = F.when(F.col("_r") == "s", 1).when(F.col("_r") == "u", 2).when(F.col("_r") == "a", 3).otherwise(0)
    more = F.when(fault.isin("blank", "duplicate"), _GONE).when(fault == "truncated", _CUT).otherwise(0)
    illegal = F.col("_was").isNotNull() & ~F.concat("_was", "_r").isin("su", "ua", "au")
    return checkpoint(rows.select("g", "i", "turn", (role + more).alias("t"), fault.alias("fault"), illegal.alias("illegal"), "block"))


def _crossing(turns: bytes) -> list[int]:
    ends = [distances(turns, tuple(0 if q == e else _NEVER for q in range(4)))[:4] for e in range(4)]
    return [ends[e][q] for q in range(4) for e in range(4)]


def _exits(turns: bytes, ahead: tuple[int, ...]) -> list[int]:
    found = distances(turns, ahead)
    return [walk(turns, found, q)[1] if found[q] < _NEVER else q for q in range(4)]


def _blocks(ordered: DataFrame, told: DataFrame) -> DataFrame:
    """All turns, those of a block together and in order, with what a block has to know."""
    rows = ordered.select("g", "i", "role", "text").join(told.select("g", "i", "t", "block"), ["g", "i"])
    return blocks.planned(rows, blocks.plans(told, "t", bytes, _crossing, _exits, CLOSE))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(g, block, is it the whole conversation, rows, turns, letters, state before) of each block."""
    some = (x for b in batches for x in slices(b))
    for (g, block), run in blocks.runs(some, ["g", "block"], ["i", "role", "text", "t", "state", "ahead", "last"]):
        turns = bytes(x[3] for x in run)
        state, ahead, last = run[0][4:]
        alone = state is None
        letters = edits(turns, 0 if alone else state, CLOSE if alone else tuple(ahead), alone or last)
        yield g, block, alone, run, turns, letters, 0 if alone else state


def _lines(run: list[tuple], turns: bytes, letters: str, state: int) -> list[str]:
    out = []
    for x, role, place in applied(letters, turns, state):
        if x != "D":
            out.append(f"{run[place][1] if x == 'K' else ROLES[role]}:{'' if place is None else run[place][2]}")
    return out


def repaired(turns: DataFrame) -> DataFrame:
    """A row for each edit: conv_id, block and place (their order), edit (K, R, D or I), role and text after it (null
    if it is gone), and i, the place of the turn that it is done to (null for an inserted one)."""
    schema = pa.schema([("g", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("i", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, block, _, run, codes, letters, state in _walked(batches):
            out = []
            for k, (x, role, place) in enumerate(applied(letters, codes, state)):
                name = None if x == "D" else run[place][1] if x == "K" else ROLES[role]
                text = None if x == "D" else "" if place is None else run[place][2]
                out.append((g, block, k, x, name, text, None if place is None else run[place][0]))
            yield blocks.batch(out, schema)

    ordered = _ordered(turns)
    rows = _blocks(ordered, _told(ordered)).mapInArrow(emit, "g string, block long, place long, edit string, role string, text string, i long")
    return rows.select(blocks.conv_id(), "block", "place", "edit", "role", "text", "i")


EMPTY = hashlib.sha256(b"").hexdigest()


def audited(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation."""
    ordered = _ordered(turns)
    told = _told(ordered)
    one = pa.schema([("g", pa.string()), ("block", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("digest", pa.string()), ("lines", pa.string())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for g, block, alone, run, codes, letters, state in _walked(batches):
            lines = _lines(run, codes, letters, state)
            text = "\n".join(lines)
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if alone else None
            # a block without lines doesn't add an empty one
            out.append((g, block, cost_of(letters, codes), letters, digest, None if alone or not lines else text))
            size += 0 if alone else len(text)
            if len(out) >= 1_000 or size > BLOCK:
                yield blocks.batch(out, one)
                out, size = [], 0
        if out:
            yield blocks.batch(out, one)

    made = checkpoint(_blocks(ordered, told).mapInArrow(emit, "g string, block long, cost long, audit string, digest string, lines string"))

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, sha, empty = None, hashlib.sha256(), True
        for b in batches:
            for one, lines in zip(b.column("g").to_pylist(), b.column("lines").to_pylist(), strict=True):
                if one != g:
                    if g is not None:
                        yield blocks.batch([(g, sha.hexdigest())], whole)
                    g, sha, empty = one, hashlib.sha256(), True
                if lines is not None:
                    sha.update((("" if empty else "\n") + lines).encode("utf-8", "surrogatepass"))
                    empty = False
        if g is not None:
            yield blocks.batch([(g, sha.hexdigest())], whole)

    whole = pa.schema([("g", pa.string()), ("digest", pa.string())])
    parts = made.where("digest IS NULL")
    out = made.where("digest IS NOT NULL").select("g", "cost", "audit", "digest")
    if not parts.isEmpty():
        digests = parts.select("g", "block", "lines").repartition("g").sortWithinPartitions("g", "block").mapInArrow(in_order, "g string, digest string")
        letters = parts.groupBy("g").agg(F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("a"))
        out = out.unionByName(letters.join(digests, "g").select("g", "cost", F.array_join("a.audit", "").alias("audit"), "digest"))
    count = lambda fault: F.sum(F.when(F.col("fault") == fault, 1).otherwise(0)).alias(fault)
    # distinct turns are counted in two steps, the first of which meets rows where they are
    turns_ = told.groupBy("g", "turn").agg(*[count(f) for f in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal").cast("long")).alias("illegal"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    stats = turns_.groupBy("g").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    out = stats.join(out, "g")
    return out.select(blocks.conv_id(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults: crc32 of `conv_id:turn` by 20 drops a row (0), empties its text (1), takes its
    [.!?] out (2), repeats it (3) or makes it the user's (4). Nulls are one space, but conv_id and turn stay null."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.encode(F.concat(say("conv_id"), F.lit(":"), say("turn")), "UTF-8")) % 20
    rows = turns.select("conv_id", "turn", say("role").alias("role"), say("text").alias("text"), k.alias("_k")).where("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def audits_of(original: DataFrame, rows: DataFrame) -> DataFrame:
    """audited(rows) for every conversation of original, also those that rows don't have."""
    found = audited(rows).withColumnRenamed("conv_id", "id")
    ids = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.fillna(0, list(numbers)).fillna({"audit": "", "repaired_sha256": EMPTY})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return audits_of(turns, damaged(turns))
