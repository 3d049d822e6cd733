import re
from collections import Counter

import numpy as np
import pytest

from factloom.llm import quality

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


ODD = [
    None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x\x1cy z", "é é é é", "漢 字 # $ | <>", "l\nl\n \nl\r\nl\r", "a\x0bb\x0cc",
    "w " * 30000, "one two three\none two three\nfour", " lead\n lead", "\x00 \x00", "😀 b 😀 b 😀 b",
]


def test_statistics_of_odd_texts():
    stats, rates = quality.statistics(ODD)
    assert stats.tolist() == [brute(t) for t in ODD]
    assert np.isfinite(rates).all()
    assert quality.statistics([None])[0].tolist() == [[0] * 5]


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality.query(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        b = brute(texts[r["doc_id"]])
        assert [r[n] for n in names] == b
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r["base_failed"] and r["kept"])


def test_held_out_labels(spark):
    """The forest catches bad documents that pass the base rules, and leaves good ones alone."""
    rows = quality.query(spark, SF).where("NOT base_failed").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = [r for r in rows.collect()]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)


def brute_path(tree, row, usual, rows, margin):
    """The length of a row's path: splits until the sample's rows that take the same way are alone."""
    column, cut, left, right, path = tree
    low, high = rows.min(axis=0) - margin, rows.max(axis=0) + margin
    at, depth = 0, 0
    while left[at] != at:
        c = column[at]
        assert low[c] <= cut[at] <= high[c]
        if row[c] <= cut[at]:
            at, rows, high[c] = left[at], rows[rows[:, c] <= cut[at]], cut[at]
        else:
            at, rows, low[c] = right[at], rows[rows[:, c] > cut[at]], cut[at]
        depth += 1
    return depth + usual(len(rows))


def test_paths_against_brute_force():
    rng = np.random.default_rng(5)
    rows = rng.normal(0, 1, (60, 4))
    rows[:, 3] = 0  # a statistic that no good row has
    forest = quality.Forest(rows, trees=9, tree_rows=60)
    ask = np.vstack([rows[:10], rng.normal(0, 4, (30, 4))])
    want = [np.mean([brute_path(t, r, forest._usual, rows, forest.margin) for t in forest.trees]) for r in ask]
    assert forest.paths(ask) == pytest.approx(want)
    assert all(0 < s < 1 for s in forest.score(ask))


def test_paths_of_a_lone_point_are_short():
    rng = np.random.default_rng(0)
    rows = rng.normal(0, 1, (400, 3))
    score = quality.Forest(rows).score(np.vstack([rows, [[9, 0, 0]]]))
    assert score.argmax() == 400
    assert quality.Forest(np.zeros((1, 2))).score(np.zeros((3, 2))).shape == (3,)


def test_a_box_with_a_soft_edge():
    """What is beyond the good rows in one rate goes; an odd combination of usual rates stays."""
    rng = np.random.default_rng(2)
    level = rng.uniform(0.05, 1, 600)
    rates = np.column_stack([level, level * rng.uniform(0.95, 1.05, 600), rng.uniform(0.1, 0.3, 600)])
    bad = np.column_stack([rng.uniform(5, 9, 60), rng.uniform(0.1, 1, 60), rng.uniform(0.1, 0.3, 60)])
    model = quality.Model(np.vstack([rates, bad]), np.array([True] * 600 + [False] * 60))
    # the first two rates go together in all good rows
    ask = np.array([[0.1, 0.95, 0.2], [7.0, 0.5, 0.2], [0.5, 0.5, 3.0], [0.5, 0.5, 0.2]])
    assert model.passes(ask).tolist() == [True, False, False, True]


def test_the_forest_alone_gives_the_verdict(spark):
    """kept is what base rules and path lengths say, nothing else."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.judge(docs, labels).collect():
        rates = quality.statistics([texts[r["doc_id"]]])[1]
        scaled = np.log1p(rates / model.typical)[0]
        at = [path[walk(tree, scaled)] for tree in model.forest.trees for path in [tree[4]]]
        score = 2.0 ** (-np.mean(at) / model.forest._usual(model.forest.tree_rows))
        assert r["anomaly"] == pytest.approx(score)
        assert r["kept"] == (not r["base_failed"] and r["anomaly"] <= model.threshold)


def walk(tree, row):
    at = 0
    while tree[2][at] != at:
        at = tree[2][at] if row[tree[0][at]] <= tree[1][at] else tree[3][at]
    return at


def test_thresholds():
    good = np.array([True] * 6 + [False] * 2)
    assert quality.threshold(np.array([0.1, 0.2, 0.3, 0.3, 0.4, 0.5, 0.7, 0.9]), good, 0.0) == pytest.approx(0.6)
    assert quality.threshold(np.array([0.1]), np.array([True])) == np.inf


def test_odd_tables(spark):
    text = "word " * 20 + "the quick brown fox jumps over a lazy dog and runs far away from here to there with no one near it at all now or then ever again so it goes on"
    rows = [(1, text, "x"), (1, text, "y"), (None, text, "z"), (2, None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (99, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        assert quality.judge(df, labels).count() == 4
        assert quality.kept(df, labels).columns == df.columns
        assert quality.judge(df.limit(0), labels).count() == 0
