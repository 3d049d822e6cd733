import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from factloom.llm import structure

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append(None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, lines) by trying all edits in the order of (cost, audit), without states or distances."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, place, initials, lines = heapq.heappop(heap)
        if place == len(rows) and LEGAL.fullmatch(initials):
            return cost, audit, "\n".join(lines)
        # what came before matters by its last two letters and its start only
        key = (place, initials[-1:], initials[:1] == "s" and len(initials) == 1, len(initials) == 0)
        if (key, audit) in seen or not re.fullmatch(r"s?((ua)*u?)", initials):
            continue
        if any(k == key for k, _ in seen):
            continue
        seen.add((key, audit))
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", place, initials + name[0], (*lines, f"{name}:")))
        if place < len(rows):
            _, role, text = rows[place]
            heapq.heappush(heap, (cost + 3, audit + "D", place + 1, initials, lines))
            if faults[place] not in ("blank", "duplicate"):
                more = 1 if faults[place] == "truncated" else 0
                heapq.heappush(heap, (cost + more, audit + "K", place + 1, initials + role[:1] if role[:1] in tuple("sua") else initials + "x", (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", place + 1, initials + name[0], (*lines, f"{name}:{text}")))
    raise AssertionError


def brute(turns):
    """The result for each conversation of rows (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((t, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults = faults_of(rows)
        have = [r[0] for r in rows if r[0] is not None]
        gaps = max(have) - min(have) + 1 - len(set(have)) if have else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, text = cheapest(rows, faults)
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def hurt(turns):
    out = []
    for c, t, role, text in turns:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def made(seed, n=60, most=7):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why? ", "open end", "  ", "", "a.b", "é", "Yes.\n", None, "fine?\x0b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ufo"]
    return [
        (None if c == 3 else c, None if rng.random() < 0.1 else t * rng.choice((1, 1, 1, 2)), rng.choice(roles), rng.choice(texts))
        for c in range(n)
        for t in range(rng.randint(1, most))
    ]


def result(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    turns = made(seed)
    rows = spark.createDataFrame(turns, SCHEMA).repartition(5)
    assert result(structure.audited(rows)) == brute(turns)


@pytest.mark.parametrize("block", [1, 600, 1500])
def test_blocks_change_nothing(spark, monkeypatch, block):
    turns = made(7, n=12, most=14)
    monkeypatch.setattr(structure, "BLOCK", block)
    rows = spark.createDataFrame(turns, SCHEMA).repartition(5)
    assert result(structure.audited(rows)) == brute(turns)


def test_dial_is_the_shortest_way():
    rng = random.Random(4)
    for _ in range(300):
        turns = bytes(rng.choice((0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11)) for _ in range(rng.randint(0, 6)))
        rows = [(i, {0: "tool", 1: "system", 2: "user", 3: "assistant"}[t & 3], f"{i}") for i, t in enumerate(turns)]
        faults = ["blank" if t & 8 else "truncated" if t & 4 else None for t in turns]
        cost, audit, _ = cheapest(rows, faults)
        letters = structure.edits(turns)
        assert (structure.cost_of(letters, turns), letters) == (cost, audit)
        assert structure.distances(turns, structure.CLOSE)[0] == cost


def test_repaired_turns(spark):
    turns = [(1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "user", ""), (2, 1, "user", "Ok."), (2, 2, "assistant", "Good.")]
    got = structure.repaired(spark.createDataFrame(turns, SCHEMA)).orderBy("conv_id", "block", "place").collect()
    want = brute(turns)
    for c in (1, 2):
        own = [r for r in got if r.conv_id == c]
        assert "".join(r.edit for r in own) == want[c][6]
        text = "\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == want[c][7]
        assert [r.i for r in own if r.edit != "I"] == list(range(sum(t[0] == c for t in turns)))
    assert [(r.role, r.text) for r in got if r.conv_id == 1 and r.edit == "D"] == [(None, None)]


def test_odd_rows(spark):
    rows = spark.createDataFrame(
        [(None, None, None, None, "x"), (None, None, None, None, "y"), (5, 1, "user", "long " * 200_000 + ".", "z")], SCHEMA + ", g string"
    )
    want = brute([(None, None, None, None)] * 2 + [(5, 1, "user", "long " * 200_000 + ".")])
    assert result(structure.audited(rows)) == want
    empty = structure.audits_of(rows.limit(0), structure.damaged(rows.limit(0)))
    assert empty.count() == 0
    # a conversation that lost all its rows
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(lost, 0, "user", "gone")], SCHEMA)
    assert result(structure.audits_of(rows, structure.damaged(rows))) == {lost: (0, 0, 0, 0, 0, 0, "", structure.EMPTY)}


def test_query_equals_brute_force(spark):
    turns = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: (0, 0, 0, 0, 0, 0, "", structure.EMPTY) for c, *_ in turns} | brute(hurt(turns))
    assert result(structure.query(spark, "/root/testdata/sf0.001")) == want
    odd = made(9)
    rows = spark.createDataFrame(odd, SCHEMA)
    want = {c: (0, 0, 0, 0, 0, 0, "", structure.EMPTY) for c, *_ in odd} | brute(hurt(odd))
    assert result(structure.audits_of(rows, structure.damaged(rows))) == want
