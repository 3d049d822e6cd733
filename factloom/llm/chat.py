"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns by turns, the user's
first and the assistant's last. The automaton of it has four states: start, after system, after user,
after assistant. Each turn is given a role: its own (free) or another (RELABEL), it may continue the
turn before (MERGE), and empty turns may be put in before it (INSERT each). A turn is thus a 4 x 4
matrix of least costs from state to state, and the cheapest repair of a conversation is a shortest
path through its turns, found by dynamic programming. Of equal repairs the one wins that, at the first
turn where they differ, doesn't merge, then has fewer insertions, then the role that comes first in ROLES.

Matrices combine by the (min, +) product, so a conversation of any length may lie over many tasks: it is cut into blocks,
every task multiplies the matrices of its block, and the blocks' few numbers give the state before and the costs behind
each (blocks.py). The choices are made inside the blocks. Nothing needs a conversation in one task or on the driver,
and the result doesn't depend on the blocks.

Rendering is by turn as well: each row carries the text that it adds to its conversation, and the
conversation is these in their order (conversations()).

Defined results: roles are compared in lower case without outer blanks; null and unknown roles fit
nothing and are relabelled at UNKNOWN. A null text is empty; a very long one is a block with what comes before it. Turns are ordered by (turn, role, hash of
the text), nulls first; repeated rows are turns of their own. Rows with a null conv_id form a conversation. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import checkpoint, slices, table

ROLES = ("system", "user", "assistant")
#: Costs: joining a turn to the one before, another role, a role for an unknown one, an empty turn.
MERGE, RELABEL, UNKNOWN, INSERT = 2, 5, 1, 4
#: What turns look like, and what stands between merged texts.
HEAD, TAIL, JOINT = "<|{role}|>\n", "<|end|>\n", "\n\n"
_NEVER = blocks.NEVER
#: The state after a role (1 to 3), and the roles that may follow a state; a state's own role merges.
_NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
#: Turns that are taken at once within a part.
_ROOM = 50_000


def _bridges() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty turns that lead from one state to another."""
    found = {(s, s): () for s in range(4)}
    for _ in range(3):
        for (a, b), path in list(found.items()):
            for r in _NEXT[b]:
                if len(path) + 1 < len(found.get((a, r), (0,) * 9)):
                    found[a, r] = (*path, r)
    return found


_BRIDGE = _bridges()


def _choices(role: int) -> dict[tuple[int, int], tuple[int, int, int, tuple[int, ...]]]:
    """For each pair of states (before, after) the cheapest (cost, kind, number of insertions, insertions);
    kind 0 keeps or relabels, 1 merges. role: 1 to 3, or 0 for an unknown one."""
    best: dict[tuple[int, int], tuple] = {}
    for a in range(4):
        for b in range(4):
            path = _BRIDGE.get((a, b))
            if path is None:
                continue
            for to in (1, 2, 3):
                cost = INSERT * len(path) + (0 if to == role else UNKNOWN if role == 0 else RELABEL)
                options = [(cost, 0)] if to in _NEXT[b] else []
                if to == b and not path:
                    options.append((cost + MERGE, 1))
                for c, kind in options:
                    one = (c, kind, len(path), path)
                    if one < best.get((a, to), (_NEVER,)):
                        best[a, to] = one
    return best


_CHOICE = [_choices(r) for r in range(4)]
#: For each role and state the choices (state after, choice).
_FROM = [[[(b, one) for (a, b), one in c.items() if a == s] for s in range(4)] for c in _CHOICE]
_MATRIX = np.full((4, 4, 4), _NEVER, np.int64)
for _r, _c in enumerate(_CHOICE):
    for (_a, _b), _one in _c.items():
        _MATRIX[_r, _a, _b] = _one[0]
#: What it costs to end in a state: after the user an empty assistant turn closes; an empty start needs nothing.
_CLOSE = np.array([_NEVER, 2 * INSERT, INSERT, 0], np.int64)


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The (min, +) product, of stacks of matrices too."""
    return np.minimum((x[..., :, :, None] + y[..., None, :, :]).min(axis=-2), _NEVER)


def product(roles: np.ndarray) -> np.ndarray:
    """The matrix of a run of turns."""
    out = np.where(np.eye(4, dtype=bool), 0, _NEVER).astype(np.int64)
    for a in range(0, len(roles), _ROOM):
        stack = _MATRIX[roles[a : a + _ROOM]]
        while len(stack) > 1:
            odd = stack[-1:] if len(stack) % 2 else stack[:0]
            stack = np.concatenate((_times(stack[0 : len(stack) - 1 : 2], stack[1::2]), odd))
        out = _times(out, stack[0])
    return out


def repair(roles: np.ndarray, first: int, ahead: np.ndarray) -> list[tuple[int, int, tuple[int, ...]]]:
    """(role, kind, insertions before) of each turn on the cheapest path from a state, where ahead has
    the costs that follow the last turn by its state."""
    if len(roles) <= 32:
        return _short(roles.tobytes(), first, tuple(ahead.tolist()))
    return _repair(roles, first, ahead)


@lru_cache(maxsize=1 << 16)
def _short(roles: bytes, first: int, ahead: tuple[int, ...]) -> list[tuple[int, int, tuple[int, ...]]]:
    return _repair(np.frombuffer(roles, np.int64), first, np.array(ahead, np.int64))


def _repair(roles: np.ndarray, first: int, ahead: np.ndarray) -> list[tuple[int, int, tuple[int, ...]]]:
    costs = np.empty((len(roles) + 1, 4), np.int64)  # from each state before turn i on
    costs[-1] = ahead
    for i in range(len(roles) - 1, -1, -1):
        costs[i] = np.minimum((_MATRIX[roles[i]] + costs[i + 1]).min(axis=1), _NEVER)
    out, s = [], first
    for i, r in enumerate(roles.tolist()):
        fits = [one[1:3] + (to, one[3]) for to, one in _FROM[r][s] if one[0] + costs[i + 1, to] == costs[i, s]]
        kind, _, s, path = min(fits)
        out.append((s, kind, path))
    return out


def _role(name: str | None) -> int:
    name = (name or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


# ---- on Spark -------------------------------------------------------------------------

def _codes(roles: list[str | None]) -> bytes:
    return bytes(map(_role, roles))


def _numbers(codes: bytes) -> np.ndarray:
    return np.frombuffer(codes, np.uint8).astype(np.int64)


def _crossing(codes: bytes) -> list[int]:
    return product(_numbers(codes)).ravel().tolist()


def _exits(codes: bytes, ahead: tuple[int, ...]) -> list[int]:
    roles, costs = _numbers(codes), np.array(ahead, np.int64)
    reach = np.minimum((product(roles) + costs).min(axis=1), _NEVER)
    # a state that leads nowhere stays
    return [repair(roles, s, costs)[-1][0] if reach[s] < _NEVER else s for s in range(4)]


def _sorted(turns: DataFrame, block: int) -> DataFrame:
    """All turns, those of a block together and in order."""
    rows = blocks.numbered(turns, F.col("role"), F.col("text")).withColumn("_size", blocks.size_of(F.col("text"))).drop("sha")
    rows = checkpoint(blocks.with_blocks(rows, "_size", block).drop("_size"))
    plan = blocks.plans(rows, "role", _codes, _crossing, _exits, tuple(_CLOSE.tolist()))
    return blocks.planned(rows, plan)


_OUT = "g string, turn long, role string, action string, inserted array<string>, rendered string, part long, place long"
_SCHEMA = pa.schema(list(zip(
    [c.split()[0] for c in _OUT.split(", ")], (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64()), strict=True
)))


def _empty(path: tuple[int, ...]) -> str:
    return "".join(HEAD.format(role=ROLES[r - 1]) + TAIL for r in path)


def render(
    roles: np.ndarray, texts: list[str | None], first: int, ahead: np.ndarray, begins: bool, ends: bool
) -> list[tuple[str, str, list[str], str]]:
    """(role, action, inserted, rendered) of each turn of a stretch of a conversation."""
    out, chosen = [], repair(roles, first, ahead)
    for i, (to, kind, path) in enumerate(chosen):
        acts = (["relabel"] if to != roles[i] else []) + (["merge"] if kind else [])
        before = "" if kind or (begins and i == 0) else TAIL
        text = before + _empty(path) + (JOINT if kind else HEAD.format(role=ROLES[to - 1])) + (texts[i] or "")
        if ends and i == len(chosen) - 1:
            text += TAIL + _empty(_BRIDGE[to, 3])
        out.append((ROLES[to - 1], " and ".join(acts) or "keep", [ROLES[r - 1] for r in path], text))
    return out


def formatted(turns: DataFrame, block: int = blocks.BLOCK) -> DataFrame:
    """One row for each row of turns: conv_id, turn, role (the repaired one), action (keep, merge, relabel,
    or relabel and merge), inserted (the roles of empty turns before it), rendered (the text that it adds to
    its conversation, for the last one with all that closes it), and the order (part, place)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        some = (x for b in batches for x in slices(b))
        for (g, part), run in blocks.runs(some, ["g", "block"], ["i", "turn", "role", "text", "state", "ahead", "last"]):
            i, turn, role, text, state, ahead, last = zip(*run, strict=True)
            alone = state[0] is None
            costs = _CLOSE if alone else np.array(ahead[0], np.int64)
            begins, ends = alone or i[0] == 0, alone or last[0]
            made = render(_numbers(_codes(list(role))), list(text), 0 if alone else state[0], costs, begins, ends)
            out += [(g, t, *one, part, k) for t, one, k in zip(turn, made, i, strict=True)]
            if len(out) >= 2_000:
                yield blocks.batch(out, _SCHEMA)
                out = []
        if out:
            yield blocks.batch(out, _SCHEMA)

    rows = _sorted(turns, block).mapInArrow(emit, _OUT)
    return rows.select(blocks.conv_id(), *[c for c in rows.columns if c != "g"])


def conversations(turns: DataFrame, block: int = blocks.BLOCK) -> DataFrame:
    """conv_id and the whole rendered text of each conversation (which one row has to hold)."""
    rows = formatted(turns, block).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "place", "rendered"))).alias("r"))
    return rows.select("conv_id", F.array_join("r.rendered", "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations")).drop("part", "place")
