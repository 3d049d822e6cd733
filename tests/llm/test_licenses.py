import random
import re

import pytest

from factloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels, best = [], set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
                best = 1.0
    spans = []
    for notice, label in [*licenses.NOTICES, *licenses.license_texts()]:
        for start, end, has, size in brute_spans(words, notice.split()):
            best = max(best, has / size)
            if has / size >= licenses.LEAST:
                spans.append((start, end, 2 * has - size, label))
    stay = []
    for a, b, score, label in sorted(spans, key=lambda x: (-x[2], x[0], x[3])):
        if all(2 * (min(b, d) - max(a, c)) < min(b - a, d - c) for c, d, _ in stay):
            stay.append((a, b, label))
    own = {x for *_, x in stay}
    n = len(at)
    return (
        len(words), n, min(at, default=None), max(at, default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | own)), best,
    )


def brute_spans(words, p, k=4):
    """(start, end, words covered, size) of all chains of diagonals of a template."""
    where = {}
    for t in range(len(p) - k + 1):
        where.setdefault(tuple(p[t : t + k]), []).append(t)
    found = sorted((i - t, t, i) for i in range(len(words) - k + 1) for t in where.get(tuple(words[i : i + k]), ()))
    out, chain = [], []
    for m in [*found, None]:
        if chain and (m is None or m[0] - chain[-1][0] > max(licenses.REACH, len(p) // 4)):
            places = [i for _, _, i in chain]
            out.append((min(places), max(places) + k, brute_cover([(t, i) for _, t, i in chain], k), len(p)))
            chain = []
        chain.append(m)
    return out


def brute_cover(matches, k):
    matches = sorted(matches)
    best = []
    for j, (t, at) in enumerate(matches):
        best.append(max([k, *(best[i] + min(k, t - u) for i, (u, b) in enumerate(matches[:j]) if u < t and b < at)]))
    return max(best, default=0)


def test_covered_words():
    rng = random.Random(2)
    for k in (2, 4):
        for _ in range(300):
            some = [(rng.randrange(20), rng.randrange(25)) for _ in range(rng.randrange(0, 30))]
            assert licenses.covered(some, k) == brute_cover(set(some), k)


def rows_of(df):
    return sorted((repr(r["doc_id"]), tuple(r[c] for c in df.columns if c != "doc_id")) for r in df.collect())


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(licenses.query(spark, SF))
    want = sorted((repr(r["doc_id"]), brute(r["text"])) for r in docs.collect())
    assert len(got) == len(want)
    for (i, g), (j, w) in zip(got, want, strict=True):
        assert i == j and g[:-1] == w[:-1] and g[-1] == pytest.approx(w[-1])


def test_odd_rows(spark):
    texts = [
        None,
        "",
        " \n",
        "MIT License",
        "mit,\x00license MIT  License",
        "GNU General Public\nLicense cc by",
        "Licensed under the new Apache License, Version 2.0",
        "permission is granted free of charge to any person obtaining a copy of this software",
        "mit licenses",
        "É mit É license",
        "word " * 30000 + "cc by",
        "MIT License",
    ]
    rows = [(i if i != 2 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string")
    got = rows_of(licenses.scan(docs))
    want = sorted((repr(i), brute(t)) for i, t, _ in rows)
    assert [g[:-1] for _, g in got] == [w[:-1] for _, w in want]


def test_whole_license_texts(spark):
    """Each text in the midst of others, with words put in, left out, changed and moved."""
    rng = random.Random(6)
    rows, want = [], []
    several = [label for _, label in licenses.license_texts()]  # a whole text and a notice
    for text, label in licenses.license_texts():
        words = text.split()
        n = len(words)
        some = [rng.choice(("lorem", "ipsum", "dolor")) for _ in range(300)]
        long = words[: n // 2] + ["to", "you", "and", "yours"] + words[n // 2 :]
        changed = [("other" if i % 15 == 7 else w) for i, w in enumerate(words)]
        moved = words[n // 2 :] + words[: n // 2]
        for found, own in ((words, True), (long, True), (changed, n > 60), (moved, False), (words[: n // 2], False)):
            if own or (found is not changed and several.count(label) == 1):
                rows.append((len(rows), " ".join(some[:100] + found + some[100:]).upper()))
                want.append((label, own))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), (), licenses.license_texts()).collect()}
    for i, (label, own) in enumerate(want):
        assert (label in got[i]["labels"].split(",")) == own, (label, i, got[i])
    _, spans = licenses.spans(spark.createDataFrame(rows[:1], "doc_id long, text string"), (), licenses.license_texts()[:1])
    s = max(spans.where("NOT exact").collect(), key=lambda s: s["share"])
    assert (s["start"], s["end"], s["share"]) == (100, 100 + len(licenses.license_texts()[0][0].split()), 1.0)


def test_no_label_of_a_sister(spark):
    texts = licenses.license_texts()
    rows = [(i, "before it " + text.upper() + " and after it") for i, (text, _) in enumerate(texts)]
    # a modified whole text has its label, not that of the notice that it holds
    gpl = next(text for text, label in texts if label == "gpl-2.0").split()
    rows.append((len(rows), " ".join(w for i, w in enumerate(gpl) if i % 40 or i > 2500)))
    # two licenses one after the other have both
    rows.append((len(rows), f"{texts[0][0]} then {texts[-1][0]}"))
    got = {r["doc_id"]: set(r["labels"].split(",")) - set(r["base_labels"].split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [{label} for _, label in texts]
    assert got[len(texts)] == {"gpl-2.0"} and got[len(texts) + 1] == {texts[0][1], texts[-1][1]}


def test_the_best_of_overlapping_spans():
    spans = [(0, 100, 90, "a"), (2, 98, 96, "b"), (60, 160, 95, "c"), (98, 110, 12, "d"), (300, 310, 5, "e"), (300, 310, 5, "a")]
    assert licenses.best_spans(spans) == [False, True, True, False, False, True]


def test_words_put_in_at_one_place(spark):
    text = "permission is hereby granted, to you and yours, free of charge to any person obtaining a copy of this software"
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["labels"] == "mit-license" and r["score"] == 1.0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(docs).count() == 0
