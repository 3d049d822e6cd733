import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import repeats

SCHEMA = "doc_id long, text string"


def brute(texts, length):
    """(bytes, removed, spans, kept) of each text, from all strings of length bytes."""
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, kept))
    return out


def made(seed, n=60, alphabet="ab"):
    """Texts with shared passages, copies, near copies and periods."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randint(6, 40)) for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            t = list(rng.choice(texts) or "")
            for _ in range(rng.randint(0, 2)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(alphabet)
            texts.append("".join(t))
        elif kind < 0.25:
            texts.append(word(rng.randint(1, 4)) * rng.randint(1, 20) + word(3))
        else:
            texts.append("".join(rng.choice([word(rng.randint(0, 12)), rng.choice(shared)]) for _ in range(rng.randint(0, 4))))
    return texts + ["", None, "é" * 15, "é" * 15]


def result(spark, texts, **kw):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = repeats.without_repeats(rows.repartition(3), **kw).orderBy("doc_id").collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got]


@pytest.mark.parametrize("seed, alphabet, crowd", [(1, "ab", 512), (2, "abcdefgh", 3), (3, "abc", 2), (4, "abcdefghijklmnop", 512)])
def test_equal_to_brute_force(spark, seed, alphabet, crowd):
    texts = made(seed, alphabet=alphabet)
    assert result(spark, texts, length=12, anchor=5, crowd=crowd) == brute(texts, 12)


def test_blocks_of_long_texts_change_nothing(monkeypatch):
    rng = random.Random(5)
    part = "".join(rng.choice("abcd") for _ in range(90))
    data = np.frombuffer((part + "x" + part[10:70] + "y" * 40).encode(), np.uint8)
    starts, ends = np.array([0]), np.array([len(data)])
    whole = covered_here(data, starts, ends)
    monkeypatch.setattr(repeats, "BLOCK", 7)
    assert (covered_here(data, starts, ends) == whole).all()
    n, text = Counter(), data.tobytes()
    n.update(text[i : i + 12] for i in range(len(text) - 11))
    want = np.zeros(len(text), bool)
    for i in range(len(text) - 11):
        if n[text[i : i + 12]] > 1:
            want[i : i + 12] = True
    assert (whole == want).all()


def covered_here(data, starts, ends):
    """What the items of one text cover, without Spark."""
    by, gone = defaultdict(list), np.zeros(len(data), bool)
    for key, ctx, a, before, size, stretch in zip(*(x.tolist() for x in repeats.items_of(data, starts, ends, 12, 5)), strict=True):
        by[key].append((ctx, a, before, size, stretch))
    for own in by.values():
        times = Counter()
        for ctx, *_, stretch in own:
            times[ctx] += 1 + (stretch > 0)
        one = {x[0]: x for x in own}
        text = data.tobytes()
        sides = [(text[a + b : a + s], text[a : a + b][::-1]) for _, a, b, s, _ in one.values()]
        got = dict(zip(one, repeats.scan(sides, 12), strict=True))
        for ctx, a, before, size, stretch in own:
            left, right = (before, size - before) if times[ctx] > 1 else got[ctx]
            gone[a + before - left : a + stretch + before + right] = left + right > 0
    return gone


def test_groups_have_all_occurrences(spark):
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("abcdefghijkl") for _ in range(k))
    long, short = word(30), word(15)
    texts = [word(9) + long + word(8), word(5) + long + word(4), long, word(6) + short + word(3) + short, short + word(9), long[:20] + word(9)]
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = defaultdict(set)
    for r in repeats.maximal_repeats(rows, length=12, anchor=5).collect():
        found[r.repeat_id].add((r.doc_id, r.start, r.length))
    told = set()
    for places in found.values():
        strings = {texts[d].encode()[s : s + n] for d, s, n in places}
        assert len(strings) == 1
        (one,) = strings
        # each place where it is
        assert {(d, s) for d, s, _ in places} == {(d, s) for d, t in enumerate(texts) for s in range(len(t)) if t.encode().startswith(one, s)}
        told.add(one.decode())
    # a long repeat comes in parts, one for each anchor, which hold all of its strings
    for one in (long, short):
        assert all(any(one[i : i + 12] in x for x in told) for i in range(len(one) - 11))


def test_neighbours_in_the_suffix_array_are_not_enough():
    # the partner of the first item by its left side stands two places off by its right side
    items = [(b"aaaab", b"xyz"), (b"aaaac", b"pq"), (b"aaaad", b"xyw")]
    groups = []
    assert repeats.scan(items, 6, groups) == [(2, 4), (0, 0), (2, 4)]
    assert [(b, a, sorted(m)) for b, a, m in groups] == [(2, 4, [0, 2])]


def test_odd_rows(spark):
    same = "the same text again and again, long enough"
    rows = spark.createDataFrame(
        [(1, same, "x", 1), (1, same, "y", 2), (None, same, "z", 3), (None, None, None, None), (2, "", "", 0), (3, "short", "", 5)],
        "doc_id long, text string, key string, start int",
    )
    got = repeats.without_repeats(rows, length=12, anchor=5).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(
        [(1, 42, 42, 1, b""), (1, 42, 42, 1, b""), (0, 42, 42, 1, b""), (0, 0, 0, 0, b""), (2, 0, 0, 0, b""), (3, 5, 0, 0, b"short")]
    )
    empty = repeats.without_repeats(rows.limit(0))
    assert empty.count() == 0 and repeats.maximal_repeats(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(rows, length=4, anchor=5)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: x for d, x in zip(docs, brute([d.text for d in docs], repeats.LENGTH), strict=True)}
    got = repeats.query(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {
        k: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for k, x in want.items()
    }
    assert sum(x[1] for x in want.values()) > 0


def test_a_very_long_text(spark):
    rng = random.Random(3)
    part = "".join(rng.choice("abcdefghij ") for _ in range(200_000))
    text = part * 6 + part[:5000]
    rows = spark.createDataFrame([(1, text + "!"), (2, "?" + part[1000:1500])], SCHEMA)
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in repeats.without_repeats(rows).collect()}
    assert got == {1: (len(text), b"!"), 2: (500, b"?")}


def brute_words(texts, n):
    """How many words of each text stand in strings of n words that stand anywhere else too."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    times = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        shared = set()
        for i in range(len(w) - n + 1):
            if times[tuple(w[i : i + n])] > 1:
                shared.update(range(i, i + n))
        out.append(len(shared))
    return out


@pytest.mark.parametrize("seed, crowd", [(1, 512), (2, 3), (3, 2)])
def test_passages_equal_brute_force(spark, seed, crowd):
    rng = random.Random(seed)
    # words of one to three letters, parted by all kinds of white space and by what is none (U+00A0)
    texts = ["".join(x + rng.choice([" ", "\n", "\t ", "\x0c", "\xa0"]) for x in re.findall("..?.?", t or "")) for t in made(seed, alphabet="abé")]
    texts += ["", None, " \n ", "one", " ".join("word" for _ in range(30))]
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    got = {r.doc_id: r.n_passage_words for r in repeats.passages(rows, words=5, anchor=2, crowd=crowd).collect()}
    assert got == dict(enumerate(brute_words(texts, 5))) and any(got.values())


def test_planted_passages_of_over_50_words_are_caught(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    planted = [prose(n) for n in (51, 52, 55, 59, 49)]
    # all too short for a string of LENGTH bytes
    assert max(len(p) for p in planted) < repeats.LENGTH
    texts = [f"{prose(rng.randint(0, 200))}\n{planted[i % 5]} {prose(rng.randint(0, 200))}" for i in range(30)] + [prose(300) for _ in range(30)]
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows = repeats.query(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows if r.has_passage} == {i for i in range(30) if i % 5 < 4}
    assert {r.doc_id: r.n_passage_words for r in rows} == dict(enumerate(brute_words(texts, 50)))
    # what is removed follows strings of 400 bytes, as before
    assert all(r.n_removed == r.n_spans == 0 and r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


def test_passages_of_the_query_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], brute_words([d.text for d in docs], repeats.WORDS), strict=True))
    got = repeats.query(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_passage_words for r in got} == want and any(want.values())
    assert all(r.has_passage == (r.n_passage_words > 0) for r in got)
