import random
import re
import zlib

import numpy as np
import pytest

from factloom.llm import toxicity
from factloom.llm.common import Memo, labelled_sample

SF = "/root/testdata/sf0.1"


def brute_segments(scores):
    """Maximal segments by their definition: the best segment, then the same left and right of it."""

    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (top is None or total > top[0] + 1e-12):
                    top = (total, i, j + 1)
        return top

    out, todo = [], [(0, len(scores))]
    while todo:
        a, b = todo.pop()
        if a < b and (m := best(a, b)):
            out.append((m[1], m[2], round(m[0], 6)))
            todo += [(a, m[1]), (m[2], b)]
    return sorted(out)


def test_segments_are_the_maximal_ones():
    rng = random.Random(0)
    for _ in range(300):
        scores = [rng.choice((-3, -2, -1.5, -1, 1.25, 2, 3.5)) + rng.random() * 0.01 for _ in range(rng.randrange(0, 25))]
        got = sorted((a, b, round(s, 6)) for a, b, s in toxicity.segments(np.array(scores, float)))
        assert got == brute_segments(scores)


def test_a_passage_scores_by_its_own_words_only():
    rude = ["vilest", "rotten", "foulmouth", "scumbag"]
    model = toxicity.Model({w + " ": 5.0 for w in rude})
    far = ["and"] * 200
    found, n = model.passages(" ".join(rude + far + rude), Memo())
    assert [(a, b) for a, b, _ in found] == [(0, 4), (204, 208)] and n == 208
    assert [s for _, _, s in found] == pytest.approx([4 * 4.4] * 2)
    # each word was there once, alone, before the dense passage
    found, n = model.passages(" ".join(x for w in rude for x in [w, *far]) + " " + " ".join(rude), Memo())
    assert found[-1][:2] == (n - 4, n) and found[-1][2] == pytest.approx(4 * 4.4)
    # repeats inside a passage don't add up, and don't take away from its best part
    found, _ = model.passages(" ".join(rude + ["and", "vilest"] * 40), Memo())
    assert found[0][:2] == (0, 84) and found[0][2] == pytest.approx(4 * 4.4)


def test_the_best_part_of_a_passage():
    rng = random.Random(3)
    for _ in range(300):
        value = {w: rng.choice((-3, -0.6, -0.1, 0.9, 2, 6)) + rng.random() * 0.01 for w in "abcdef"}
        words = rng.choices("abcdef", k=rng.randrange(1, 40))
        scores = np.array([value[w] for w in words])
        for a, b, s in toxicity.segments(scores):
            want = 0.0
            for i in range(a, b):
                part, seen = 0.0, set()
                for w in words[i:b]:
                    part += toxicity.BACKGROUND if w in seen and value[w] > 0 else value[w]
                    seen.add(w)
                    want = max(want, part)
            assert toxicity.once(words[a:b], scores[a:b], s) == pytest.approx(want)


def odds(counts, toxic, other):
    t, o = (np.array([c[i] for c in counts.values()]) for i in (0, 1))
    return toxicity.log_odds(list(counts), t, o, (toxic, other))


def test_priors_follow_the_word():
    counts = {"abcd": (30, 2), "abcde": (5, 0), "zzzz": (1, 30), "zzzz ": (1, 30), "abcdf": (0, 9)}
    s = odds(counts, 100, 900)
    assert s["abcde"] > s["abcd"] > 2 and s["zzzz"] < -1 and "zzzz " not in s and s["abcdf"] < s["abcd"] - 2
    model = toxicity.Model(s)
    assert model.word_score("abcdxyz") == pytest.approx(s["abcd"] + toxicity.BACKGROUND)
    assert model.word_score("zzzz") == pytest.approx(s["zzzz"] + toxicity.BACKGROUND)
    assert model.word_score("other") == toxicity.BACKGROUND
    assert all(np.isfinite(list(odds({"q" * n: (90, 0) for n in range(4, 17)}, 90, 10).values())))


def test_a_document_counts_once_for_all_beginnings_of_a_word():
    word = "réeuxelle"
    s = odds({k: (3, 0) for k in toxicity.beginnings(word)}, 100, 900)
    score = toxicity.Model(s).word_score(word) - toxicity.BACKGROUND
    # three toxic documents and one of the prior, whatever the word's length
    assert score == pytest.approx(np.log(3.1 / 0.9) - np.log(100 / 900), abs=0.01) and score < 4


def test_odds_against_brute_force(monkeypatch):
    """Counts made of documents, and shares by their definition on the documents themselves."""
    monkeypatch.setattr(toxicity, "TELLING", 0.0)
    rng = random.Random(7)
    words = ["abcd", "abcde", "abcdef", "abcxyz", "wxyz", "wxyzabcdefghijklmnop", "ab", "abcdé"]
    docs = [(set(rng.sample(words, rng.randrange(0, 4))), rng.random() < 0.3) for _ in range(200)]
    keys = sorted({k for w in words for k in toxicity.beginnings(w)})
    has = {k: [any(k in toxicity.beginnings(w) for w in own) for own, _ in docs] for k in keys}
    toxic = [y for _, y in docs]
    share = lambda which, prior: (sum(y for y, x in zip(toxic, which, strict=True) if x) + prior) / (sum(which) + 1)

    def prior_and_score(key):
        """From the documents that have the longest shorter key that counts, but not this one."""
        shorter = [k for k in keys if k != key and key.replace(" ", "").startswith(k) and " " not in k and sum(has[k]) >= 3]
        up = max(shorter, key=len, default=None)
        wide = has[up] if up else [True] * len(docs)
        above = prior_and_score(up)[0] if up else sum(toxic) / len(docs)
        prior = share([a and not b for a, b in zip(wide, has[key], strict=True)], above)
        p = share(has[key], prior)
        return prior, np.log(p / (1 - p)) - np.log(sum(toxic) / (len(docs) - sum(toxic)))

    count = lambda k, y: sum(x and (z == y) for x, z in zip(has[k], toxic, strict=True))
    got = odds({k: (count(k, True), count(k, False)) for k in keys}, sum(toxic), len(docs) - sum(toxic))
    assert set(got) == {k for k in keys if sum(has[k]) >= 3}
    for k, s in got.items():
        assert s == pytest.approx(prior_and_score(k)[1])


def test_held_out_accuracy(spark):
    got = toxicity.query(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    hits = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hits / sum(r["toxic"] for r in rows) > 0.88
    assert hits / sum(r["predicted"] for r in rows) > 0.99
    assert all((r["score"] >= 0.7) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in rows)


def test_ids_and_held_out_rows(spark):
    got = {r["doc_id"]: r["held_out"] for r in toxicity.query(spark, "/root/testdata/sf0.001").collect()}
    ids = [r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in ids}


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("aeioulnrst", k=rng.randrange(2, 7)))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randrange(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.sample(["vilest", "rotten", "foulmouth", "scumbag"], 3)
        docs.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def brute_score(model, text):
    """A text's score by definitions: the longest key of each word, maximal segments, parts without repeats, evidence."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())

    def word_score(w):
        keys = [w[:16] + " " + w[16:], *(w[:n] for n in range(min(len(w), 16), 3, -1))]
        return next((model.table[k] for k in keys if k in model.table), 0.0) + toxicity.BACKGROUND

    scores, evidence = [word_score(w) for w in words], 0.0
    for a, b, _ in brute_segments(scores):
        best = 0.0
        for i in range(a, b):
            part, seen = 0.0, set()
            for w, s in zip(words[i:b], scores[i:b], strict=True):
                part += toxicity.BACKGROUND if w in seen and s > 0 else s
                seen.add(w)
                best = max(best, part)
        x = (best - model.location - model.growth * np.log(max(len(words), 1))) / model.scale
        chance = -np.expm1(-np.exp(-x))
        evidence -= np.log(chance) if chance < toxicity.CHANCE else 0.0
    return 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * np.log1p(evidence))))


def test_scores_against_brute_force(spark, small):
    docs, labels = small
    model = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    assert len({round(s, 6) for s in got.values()}) > 20
    for i, text in texts.items():
        assert got[i] == pytest.approx(brute_score(model, text), abs=1e-9)


def test_passages_and_clean_documents(spark, small):
    docs, labels = small
    planted = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    found = toxicity.passages(docs, labels).collect()
    got = {r["doc_id"] for r in found}
    assert planted <= got and len(got - planted) <= 6
    assert {r["doc_id"] for r in found if r["end"] - r["start"] >= 3} >= planted
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(600) if i % 6}


def test_odd_rows(spark, small):
    docs, labels = small
    odd = spark.createDataFrame([(None, "scumbag", "x"), (900, None, "x"), (900, "", "x"), (901, "vilest " * 60000, "x"), (902, "SCUMBAG!! Rotten, vilest***", "x")], docs.schema)
    both = docs.unionByName(odd).unionByName(odd)
    rows = toxicity.score(both, labels).collect()
    assert len(rows) == 610
    assert {r["predicted"] for r in rows if r["doc_id"] == 900} == {0} and {r["predicted"] for r in rows if r["doc_id"] == 902} == {1}
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(odd.limit(0), labels).count() == 0 and toxicity.clean(odd, none).count() == 5


def test_the_sample_is_of_labels_that_documents_have(spark, small):
    docs, labels = small
    others = spark.range(10_000, 40_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    more = labels.unionByName(others)
    for column in ("toxic", "quality"):
        got = labelled_sample(more, column, 50, False, docs.unionByName(docs)).collect()
        assert len(got) == 50 and {r["doc_id"] for r in got} <= set(range(600))
    assert {r["doc_id"] for r in toxicity.clean(docs, more, 600).collect()} == {i for i in range(600) if i % 6}


def test_a_repeated_id_is_fitted_on_once(spark, small):
    docs, labels = small
    hot = docs.where(docs["doc_id"] == 1)
    assert zlib.crc32(b"1") % 3 != 1
    many = docs.unionByName(hot.crossJoin(spark.range(3000)).drop("id"))
    one, other = toxicity.fit(docs, labels), toxicity.fit(many, labels)
    assert one.table == other.table and one.curve == pytest.approx(other.curve)
