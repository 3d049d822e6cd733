import itertools
import random

import numpy as np
import pytest

from factloom.llm import chat

LEGAL = {None: (0, 1), 0: (1,), 1: (2,), 2: (1,)}  # roles by number; None: the start


def cheapest(roles):
    """Least cost by trying every way, turn after turn: the last role reached, and what it cost."""
    reached = {None: 0}
    for r in roles:
        now = {}
        for state, cost in reached.items():
            fronts = {state: cost}
            for _ in range(4):  # empty turns
                for s, c in list(fronts.items()):
                    for x in LEGAL[s]:
                        fronts[x] = min(fronts.get(x, 1 << 30), c + chat.INSERT)
            for to in range(3):
                price = 0 if to == r else chat.UNKNOWN if r is None else chat.RELABEL
                for s, c in fronts.items():
                    if to in LEGAL[s]:
                        now[to] = min(now.get(to, 1 << 30), c + price)
                if state == to:
                    now[to] = min(now.get(to, 1 << 30), cost + price + chat.MERGE)
        reached = now
    return min(c + {0: 2, 1: 1, 2: 0}[s] * chat.INSERT for s, c in reached.items())


def price(roles, made):
    total = 0
    for r, (to, kind, path) in zip(roles, made, strict=True):
        total += chat.INSERT * len(path) + chat.MERGE * kind
        total += 0 if r == to - 1 else chat.UNKNOWN if r is None else chat.RELABEL
    return total + {1: 2, 2: 1, 3: 0}[made[-1][0]] * chat.INSERT


def numbers(roles):
    return np.array([0 if r is None else r + 1 for r in roles], np.int64)


def is_legal(made):
    turns = []
    for to, kind, path in made:
        turns += [r - 1 for r in path]
        if kind:
            assert turns and turns[-1] == to - 1
        else:
            turns.append(to - 1)
    state = None
    for t in turns:
        assert t in LEGAL[state]
        state = t


def test_every_short_sequence_is_repaired_at_least_cost():
    for n in range(1, 6):
        for roles in itertools.product((None, 0, 1, 2), repeat=n):
            made = chat.repair(numbers(roles), 0, chat._CLOSE)
            is_legal(made)
            assert price(roles, made) == cheapest(roles)
            assert int((chat.product(numbers(roles))[0] + chat._CLOSE).min()) == cheapest(roles)


def test_long_sequences():
    rng = random.Random(3)
    for n in (33, 200, 3000):
        roles = rng.choices((None, 0, 1, 2), k=n)
        made = chat._repair(numbers(roles), 0, chat._CLOSE)
        is_legal(made)
        assert price(roles, made) == cheapest(roles)


def whole(turns):
    """A conversation rendered on one machine."""
    roles = np.array([chat._role(r) for r, _ in turns], np.int64)
    return "".join(x[3] for x in chat.render(roles, [t for _, t in turns], 0, chat._CLOSE, True, True))


def test_rendering():
    assert whole([("system", "s"), ("user", "a"), ("USER ", "b"), ("assistant", "c"), ("user", "d")]) == (
        "<|system|>\ns<|end|>\n<|user|>\na\n\nb<|end|>\n<|assistant|>\nc<|end|>\n<|user|>\nd<|end|>\n<|assistant|>\n<|end|>\n"
    )


@pytest.mark.parametrize(("partitions", "block"), [("1", 1 << 22), ("7", 700), ("7", 90_000)])
def test_hot_conversation_over_many_blocks(spark, partitions, block):
    rng = random.Random(9)
    names = ["system", "user", "assistant", None, "tool"]
    rows = [(7, i, rng.choice(names), f"t{i}") for i in range(3000)]
    rows += [(c, i, rng.choice(names), None if i == 2 else "x") for c in range(40) for i in range(c % 9 + 1) if c != 7]
    rows += [(None, 0, "user", "q"), (None, None, "assistant", "first")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {r["conv_id"]: r["text"] for r in chat.conversations(df, block).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    by = {}
    for c, i, r, t in rows:
        by.setdefault(c, []).append((-1 if i is None else i, r, t))
    assert got == {c: whole([(r, t) for _, r, t in sorted(v, key=lambda x: x[0])]) for c, v in by.items()}


def test_very_long_texts(spark):
    turns = [("user", "long " * 300_000), ("assistant", None), ("assistant", "x" * 5_000_000), ("user", "bye")]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    (got,) = chat.conversations(df, 1 << 20).collect()
    assert got["text"] == whole(turns)
    assert len({r["part"] for r in chat.formatted(df, 1 << 20).collect()}) > 1


def test_repeated_rows_and_extra_columns(spark):
    rows = [(1, 0, "user", "a", "p")] * 300 + [(1, 1, "assistant", "b", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    (got,) = chat.conversations(df).collect()
    assert got["text"] == whole([("user", "a")] * 300 + [("assistant", "b")])
    assert chat.formatted(df).count() == 301
    assert chat.formatted(df.limit(0)).count() == 0


def test_whole_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = {r["conv_id"]: r["text"] for r in chat.conversations(turns).collect()}
    by = {}
    for r in turns.collect():
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert got == {c: whole([(r, t) for _, r, t in sorted(v, key=lambda x: x[0])]) for c, v in by.items()}
    assert chat.query(spark, "/root/testdata/sf0.001").count() == turns.count()
