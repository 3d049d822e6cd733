"""Toxicity by maximum-scoring segments.

Every word and every beginning of a word (its first SHORT to LONG characters) is counted by the
labelled documents, toxic and other, that have it. Log-odds are smoothed by Dirichlet priors that
follow the word: the prior of a key is what documents with the next shorter key but without this
one say, so that each document counts once however many beginnings of a word it shows. Words that
were never seen take the odds of the longest beginning that was. Words that speak for toxic text
and words that speak against it both count, and each word costs BACKGROUND.

A text is then a sequence of scores with a negative mean, and its maximal scoring segments (Ruzzo
and Tompa), found in one scan over all its words, are its passages. A word that a passage repeats
tells nothing new, so a passage takes the score of its best part in which repeats cost BACKGROUND;
what other passages say doesn't matter to it. The best scores of clean documents follow an
extreme-value law whose location grows with the logarithm of the length. Held against it, each
passage has a chance to be that good in clean text; the passages' evidence is summed up, and a
logistic curve that is fitted to labelled rows turns it into the score.

The tables and curves come from at most LABELLED labelled rows outside the held-out part; all of
the corpus is scored by them, in one pass without a shuffle.

Defined results: a null or empty text has no passage and gets the score of no evidence. A very
long text is scanned whole: the law's location follows its length, and passages that repeat each
other add up. Of passages with equal scores neither goes before the other: both are found. Rows
with a null doc_id are scored like any other and repeated rows come out repeated. Without labels of
both kinds every score is 0. An empty table gives no rows. Other columns are ignored by score()
and carried by clean(), of whatever type they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, held_out, labelled_sample, passing, slices, table

#: Most labelled rows that the model comes from.
LABELLED = 12_000
#: A document is toxic from this score on.
TOXIC = 0.7
#: Strength of the prior in documents, score of a word that nothing is known of (in nats).
PRIOR, BACKGROUND = 1.0, -0.6
#: A key tells something if it has so many documents, and if it is so many nats away from what its
#: longest beginning that tells something says; other keys say what that beginning says.
FEWEST, TELLING = 3, 1.0
#: The shortest beginning of a word, and the longest.
SHORT, LONG = 4, 16
#: A passage is significant if clean text has one that good with a smaller chance.
CHANCE = 0.1
#: Bytes of what a task remembers of words.
WORD_BYTES = 32 << 20
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def beginnings(word: str) -> list[str]:
    """The word's beginnings from SHORT characters on, and the word itself, marked by a space."""
    return [word[:n] for n in range(SHORT, min(len(word), LONG) + 1)] + [word[:LONG] + " " + word[LONG:]]


# ---- the model ------------------------------------------------------------------------


def log_odds(keys: list[str], toxic: np.ndarray, other: np.ndarray, base: tuple[int, int]) -> dict[str, float]:
    """The scores of the keys that tell something, from the documents with each key (toxic, other).

    A key's share of toxic documents has a Dirichlet prior of PRIOR documents, centred at the share among
    the documents that have the next shorter key, or are any, but not this one. A key of the same documents
    as the next shorter one so gets the same share.
    """
    some = toxic + other >= FEWEST
    order = sorted(np.flatnonzero(some).tolist(), key=lambda i: len(keys[i]))
    nothing = math.log(base[0] / base[1])
    # of each key: toxic and other documents, what these say smoothed, what it is taken to say
    known: dict[str, tuple[int, int, float, float]] = {}
    told: dict[str, float] = {}
    for i in order:
        key, t, o = keys[i], int(toxic[i]), int(other[i])
        up = _shorter(key)
        while up and up not in known:
            up = up[:-1]
        ut, uo, prior, said = known.get(up, (*base, base[0] / sum(base), 0.0))
        prior = (ut - t + PRIOR * prior) / (ut - t + uo - o + PRIOR)
        share = min(max((t + PRIOR * prior) / (t + o + PRIOR), 1e-9), 1 - 1e-9)
        score = math.log(share / (1 - share)) - nothing
        if abs(score - said) >= TELLING:
            told[key] = said = score
        known[key] = (t, o, prior, said)
    return told


def _shorter(key: str) -> str:
    return key[: key.index(" ")] if " " in key else key[:-1] if len(key) > SHORT else ""


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one scan.

    Only runs that begin at positive scores are looked at one by one; sums come from numpy.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    at = np.flatnonzero(scores > 0)
    left: list[float] = []  # the sum before each candidate
    right: list[float] = []  # the sum at its end
    span: list[list[int]] = []
    back: list[int] = []  # for each candidate the last one before it with a smaller left sum, or -1
    for i in at.tolist():
        lo, hi, start = float(sums[i]), float(sums[i + 1]), i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                left.append(lo), right.append(hi), span.append([start, i + 1]), back.append(j)
                break
            lo, start = left[j], span[j][0]
            del left[j:], right[j:], span[j:], back[j:]
    return [(a, b, r - x) for (a, b), x, r in zip(span, left, right, strict=True)]


def once(words: list[str], scores: np.ndarray, total: float) -> float:
    """The score of the best part of a passage if a telling word that the part repeats costs BACKGROUND.

    total is the score of the whole passage, which is the answer if no telling word repeats.
    """
    up = scores > 0
    at = np.flatnonzero(up)
    gains = {words[i]: float(scores[i]) - BACKGROUND for i in at.tolist()}
    if len(gains) == len(at):
        return total
    cost = np.concatenate(([0.0], np.cumsum(np.where(up, BACKGROUND, scores))))
    before, after = -cost[at], cost[at + 1]
    parts = before.copy()  # for each first word of a part, its score without the cost up to its end
    last: dict[str, int] = {}
    most, best, low = sum(gains.values()), 0.0, 0
    for j, i in enumerate(at.tolist()):
        while before[low] + most + after[j] <= 0:  # too long a part to have a positive score
            low += 1
        parts[max(last.get(words[i], -1) + 1, low) : j + 1] += gains[words[i]]
        last[words[i]] = j
        best = max(best, float(parts[low : j + 1].max() + after[j]))
    return best


class Model:
    """Scores of words, the extreme-value law of clean text and the curve of the score."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.table = scores
        self.location, self.scale, self.growth = 0.0, 1.0, 1.0
        self.curve = (-20.0, 0.0)

    def word_score(self, word: str) -> float:
        for key in reversed(beginnings(word)):
            s = self.table.get(key)
            if s is not None:
                return s + BACKGROUND
        return BACKGROUND

    def passages(self, text: str | None, cache: Memo) -> tuple[list[tuple[int, int, float]], int]:
        words = words_of(text)
        for w in set(words):
            if not cache.knows(w):
                cache.add(w, self.word_score(w))
        scores = np.fromiter(map(cache.__getitem__, words), float, len(words))
        found = segments(scores)
        telling = [words[i] for i in np.flatnonzero(scores > 0).tolist()]
        if len(set(telling)) < len(telling):
            found = [(x, y, once(words[x:y], scores[x:y], s)) for x, y, s in found]
        return found, len(words)

    def _standard(self, best: float, n: int) -> float:
        return (best - self.location - self.growth * math.log(max(n, 1))) / self.scale

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        """The summed evidence: minus the logarithms of each significant passage's chance in clean text."""
        total = 0.0
        for _, _, s in found:
            if not self.significant(s, n):
                continue
            # a chance of exp(-exp(-x)) to stay below: its complement, without cancellation
            total += -math.log(max(-math.expm1(-math.exp(-min(self._standard(s, n), 600.0))), 1e-300))
        return total

    def significant(self, s: float, n: int, chance: float = CHANCE) -> bool:
        return -math.expm1(-math.exp(-self._standard(s, n))) < chance

    def calibrate(self, rows: list[tuple[list[tuple[int, int, float]], int]], toxic: np.ndarray) -> None:
        """Fit the extreme-value law to the best scores of clean rows, then the curve to all."""
        best = np.array([max((s for _, _, s in f), default=0.0) for f, _ in rows])
        size = np.log(np.maximum([n for _, n in rows], 1))
        clean, x = best[~toxic], size[~toxic]
        spread = float(np.var(x))
        self.growth = max(0.0, float(np.cov(x, clean, bias=True)[0, 1]) / spread) if spread else 0.0
        rest = clean - self.growth * x
        self.scale = max(float(rest.std()) * math.sqrt(6) / math.pi, 0.1)
        self.location = float(rest.mean()) - 0.5772156649015329 * self.scale
        e = np.log1p([self.evidence(f, n) for f, n in rows])
        self.curve = _logistic(e, toxic.astype(float))

    def score(self, evidence: float) -> float:
        z = self.curve[0] + self.curve[1] * math.log1p(evidence)
        return 1.0 / (1.0 + math.exp(-max(min(z, 500.0), -500.0)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


# ---- on Spark -------------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Model | None:
    """The model, from at most limit labelled rows outside the held-out part."""
    sample = labelled_sample(labels, "toxic", limit, True, docs)  # bounded by limit
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out(F.col("doc_id")))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")
    # one row of each id, whichever text has the smallest hash, so that there are at most limit rows
    text = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text")
    rows = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), text)
    rows = rows.select(fold, F.col("label").cast("int").alias("label"), "text").persist()
    try:
        sizes = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
        size = lambda folds, label: sum(sizes.get((f, label), 0) for f in folds)
        if not size((0, 1), 1) or not size((0, 1), 0):
            return None
        counts = _counts(rows)
        keys, tables = counts.column("key").to_pylist(), []
        number = {c: counts.column(c).to_numpy() for c in ("t0", "t1", "o0", "o1")}
        for folds in ((0,), (1,), (0, 1)):
            t, o = (sum(number[f"{x}{f}"] for f in folds) for x in "to")
            tables.append(Model(log_odds(keys, t, o, (max(1, size(folds, 1)), max(1, size(folds, 0))))))
        # each half is scored by what the other half says: own words would look too telling
        halves = rows.sparkSession.sparkContext.broadcast(tables[:2])

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            caches = [Memo(), Memo()]
            for b in batches:
                for cache in caches:
                    cache.tidy()
                got = [
                    halves.value[1 - f].passages(t, caches[f])
                    for f, t in zip(b.column("fold").to_pylist(), b.column("text").to_pylist(), strict=True)
                ]
                best = pa.array([[s for _, _, s in x] for x, _ in got], pa.list_(pa.float64()))
                arrays = [b.column("label"), best, pa.array([n for _, n in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["label", "found", "n"])

        got = rows.mapInArrow(found, "label int, found array<double>, n long").collect()  # at most limit rows
        model = tables[2]
        model.calibrate(
            [([(0, 0, s) for s in r["found"]], r["n"]) for r in got], np.array([r["label"] == 1 for r in got])
        )
        return model
    finally:
        rows.unpersist()


def _counts(rows: DataFrame) -> pa.Table:
    """For each key of FEWEST documents or more, the documents with it: by fold, toxic (t) and other (o)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            fold, label, key = [], [], []
            columns = (b.column(c).to_pylist() for c in ("fold", "label", "text"))
            for f, y, t in zip(*columns, strict=True):
                own = {k for w in set(words_of(t)) for k in beginnings(w)}
                key.extend(own)
                fold.extend([f] * len(own))
                label.extend([y] * len(own))
            arrays = [pa.array(fold, pa.int32()), pa.array(label, pa.int32()), pa.array(key, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["fold", "label", "key"])

    cells = [F.count_if(F.expr(f"fold = {f} AND label {is_} 1")).alias(f"{x}{f}") for f in (0, 1) for x, is_ in (("t", "="), ("o", "<>"))]
    counts = rows.mapInArrow(keys, "fold int, label int, key string").groupBy("key").agg(*cells)
    # the sample is bounded, and so are its keys
    return counts.where(f"t0 + t1 + o0 + o1 >= {FEWEST}").toArrow()


def _each(model: Model | None, texts: pa.Array, cache: Memo) -> Iterator[tuple[float, int]]:
    """The score and the number of significant passages of each text."""
    cache.tidy()
    for t in texts:
        if model is None:
            yield 0.0, 0
            continue
        found, n = model.passages(t.as_py(), cache)
        yield model.score(model.evidence(found, n)), sum(model.significant(s, n) for _, _, s in found)


def score(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted and passages, the significant ones, of each row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Memo(WORD_BYTES)
        for b in (x for whole in batches for x in slices(whole)):
            got = list(_each(model.value, b.column("text"), cache))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([s for s, _ in got], pa.float64()),
                    pa.array([int(s >= TOXIC) for s, _ in got], pa.int32()),
                    pa.array([k for _, k in got], pa.int32()),
                ],
                ["doc_id", "score", "predicted", "passages"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(scores, "doc_id long, score double, predicted int, passages int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "passages")


def passages(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, chance: float = 0.001) -> DataFrame:
    """The passages that clean text has with at most a small chance: doc_id, start and end in words,
    score and text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Memo()
        for b in (x for whole in batches for x in slices(whole)):
            cache.tidy()
            rows = []
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if model.value is None or not t:
                    continue
                found, n = model.value.passages(t, cache)
                words = words_of(t) if found else []
                rows += [(doc, x, y, s, " ".join(words[x:y])) for x, y, s in found if model.value.significant(s, n, chance)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "end", "score", "passage"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, "doc_id long, start long, end long, score double, passage string")


def clean(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """The documents that are not toxic, with all their columns: judged where they lie."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))
    caches: list[Memo] = []  # a task's own, as each task unpickles this function

    def staying(texts: pa.Array) -> pa.Array:
        cache = caches[0] if caches else caches.append(Memo(WORD_BYTES)) or caches[0]
        return pa.array([s < TOXIC for s, _ in _each(model.value, texts, cache)], pa.bool_())

    return passing(docs, staying)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
