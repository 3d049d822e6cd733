"""Quality rules, and an isolation forest on their statistics.

Every text gets the statistics of simple rules (words, symbols, repeated lines and windows). A few
of them reject a document outright. The others go as rates to an isolation forest: trees that
split a sample of good labelled rows at random values of random statistics until its rows stand
alone. A document whose statistics are unlike theirs is alone after few splits, so a short mean path
means an anomaly. Rates are put on a logarithmic scale on which a typical good row's is about 1, and
splits are drawn from the range of the sample widened by MARGIN of it on both sides: only so a row
beyond everything that the sample has is alone sooner than the sample's own outermost row. How short
a path is too short is read from labelled rows that the trees have not seen: the threshold lies above
all but CLEAN_LOSS of the good ones. With so wide a margin the verdict is in effect a box with a soft edge: what lies
beyond the good sample in some rate is found, an odd combination of rates that are each usual is not.

The forest and the threshold come from at most LABELLED labelled rows; all of the corpus is
judged by them, in one pass without a shuffle.

Defined results: a null or blank text has no words and fails the base rules. A very long text is
judged whole, as its rates don't grow with it. A row whose score equals the threshold stays. Rows
with a null doc_id are judged like any other and repeated rows come out repeated. Without labels of
both kinds nothing but the base rules rejects. An empty table gives no rows. Other columns are ignored
by judge() and carried by kept(), of whatever type they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, passing, slices, table

#: Most labelled rows that the forest and its threshold come from.
LABELLED = 8_000
#: Trees, rows of a tree's sample, seed, and the share of good rows that may be rejected.
TREES, TREE_ROWS, SEED, CLEAN_LOSS = 128, 512, 42, 0.004
#: How far beyond the sample splits may lie, and the share of good rows that a typical rate covers.
MARGIN, TYPICAL = 2.0, 0.99
#: Base rules: fewest words, and the most words in repeated windows of a hundred.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"

_STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_DIGITS = b"0123456789"
_MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum() and i not in SYMBOLS)


# ---- statistics -----------------------------------------------------------------------


def _repeated(words: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """For each document, its words in 3-word windows that are found twice or more in it."""
    if len(words) < 3:
        return np.zeros(docs, np.int64)
    n = int(words.max()) + 1
    pairs = pd.factorize(words[:-1] * n + words[1:])[0].astype(np.int64)
    windows = pd.factorize(pairs[:-1] * n + words[2:])[0].astype(np.int64)
    whole = doc[:-2] == doc[2:]
    where = np.flatnonzero(whole)
    own = pd.factorize(windows[where] * docs + doc[where])[0]
    again = where[np.bincount(own)[own] > 1] if len(own) else where
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[again + k] = True
    return np.bincount(doc[hit], minlength=docs)


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The rules' numbers of each text, (n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words), and its rates for the forest."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    split = [d.split() for d in data]
    n_words = np.array([len(w) for w in split], np.int64)
    doc = np.repeat(np.arange(len(data)), n_words)
    words = pd.factorize(np.array([w for some in split for w in some] or [b""], object))[0].astype(np.int64)
    repeated = _repeated(words[: len(doc)], doc, len(data))
    blank = b" \t\n\x0b\x0c\r"
    rest = [d.translate(None, blank) for d in data]
    size = lambda d, drop: len(d) - len(d.translate(None, drop))
    # every character but those of UTF-8 that continue one
    continued = bytes(range(0x80, 0xC0))
    chars = np.array([len(r) - size(r, continued) for r in rest], np.int64)
    lines, dup = np.array([_dup_lines(d) for d in data], np.int64).reshape(-1, 2).T
    symbols, upper, letters, digits, marks = (
        np.array([size(r, kind) for r in rest], np.int64) for kind in (SYMBOLS, _UPPER, _LETTERS, _DIGITS, _MARKS)
    )
    some = lambda a, b: a / np.maximum(b, 1)
    rates = np.column_stack(
        [
            some(chars, n_words),
            some(symbols, chars),
            some(dup, lines),
            some(repeated, n_words),
            some(upper, letters),
            some(digits, chars),
            some(marks, chars),
        ]
    )
    return np.column_stack([n_words, chars, symbols, dup, repeated]), rates


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < LEAST_WORDS) | (100 * stats[:, 4] > MOST_REPEATED * stats[:, 0])


# ---- forest ---------------------------------------------------------------------------


class Forest:
    """Isolation trees as flat arrays; a leaf points to itself."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, margin: float = MARGIN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.tree_rows, self.margin = min(tree_rows, len(rows)), margin
        self.depth = max(1, math.ceil(math.log2(max(2, self.tree_rows))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.tree_rows, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def _usual(n: int) -> float:
        """The mean path of n rows that are told apart at random."""
        return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        column, cut, left, right, path = [], [], [], [], []

        def node(rows: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray) -> int:
            """low and high bound what can come here, rows or not."""
            at = len(column)
            wide = np.flatnonzero(high > low)
            stop = depth >= self.depth or len(rows) < 2 or not len(wide)
            for x, v in ((column, 0), (cut, np.inf), (left, at), (right, at), (path, depth + self._usual(len(rows)))):
                x.append(v)
            if not stop:
                column[at] = c = int(rng.choice(wide))
                cut[at] = s = float(rng.uniform(low[c], high[c]))
                below, end, begin = rows[:, c] <= s, high.copy(), low.copy()
                end[c] = begin[c] = s
                left[at] = node(rows[below], depth + 1, low, end)
                right[at] = node(rows[~below], depth + 1, begin, high)
            return at

        node(rows, 0, rows.min(axis=0) - self.margin, rows.max(axis=0) + self.margin)
        return tuple(np.array(x) for x in (column, cut, left, right, path))

    def paths(self, rows: np.ndarray) -> np.ndarray:
        """The mean path of each row over all trees."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for column, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = np.where(rows[every, column[at]] <= cut[at], left[at], right[at])
            total += path[at]
        return total / len(self.trees)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; high for rows with short paths."""
        return 2.0 ** (-self.paths(rows) / max(self._usual(self.tree_rows), 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, clean_loss: float = CLEAN_LOSS) -> float:
    """The anomaly score above which rows are rejected, from labelled rows."""
    bad, fine = np.sort(scores[~good]), np.sort(scores[good])
    if not len(bad) or not len(fine):
        return math.inf
    least = fine[-1 - int(clean_loss * len(fine))]  # so many good rows may lie above
    above = bad[bad > least]
    # halfway to the first bad row, which leaves unseen good rows some room
    return float((least + above[0]) / 2) if len(above) else math.inf


class Model:
    """Scale, forest and threshold: half of the good rows grow the trees, all other rows set the threshold."""

    def __init__(self, rates: np.ndarray, good: np.ndarray) -> None:
        grows = np.zeros(len(good), bool)
        grows[np.flatnonzero(good)[::2]] = True
        grows |= not good.any()
        self.typical = np.maximum(np.quantile(rates[grows], TYPICAL, axis=0), 0.01)
        self.forest = Forest(self.scaled(rates[grows]))
        self.threshold = threshold(self.score(rates[~grows]), good[~grows])

    def scaled(self, rates: np.ndarray) -> np.ndarray:
        return np.log1p(rates / self.typical)

    def score(self, rates: np.ndarray) -> np.ndarray:
        return self.forest.score(self.scaled(rates))

    def passes(self, rates: np.ndarray) -> np.ndarray:
        return self.score(rates) <= self.threshold


# ---- on Spark -------------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Model | None:
    """The model, from at most limit labelled rows outside the held-out part."""
    sample = labelled_sample(labels, "quality", limit, True, docs)  # bounded by limit
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.where(~held_out(F.col("doc_id"))).join(F.broadcast(sample), "doc_id").select("label", "text")

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                stats, x = statistics(b.column("text").to_pylist())
                ok = ~base_failed(stats)
                label = np.array(b.column("label").to_pylist(), np.int64)[ok]
                yield pa.RecordBatch.from_pydict({"label": label, "x": list(x[ok])})

    # repeated ids may give more rows than labels, so the sample is cut once more
    got = found.mapInArrow(rates, "label long, x array<double>")
    got = got.orderBy(F.xxhash64("x"), "label", "x").limit(limit).toPandas()
    if not len(got):
        return None
    x, good = np.stack(got["x"].to_numpy()), got["label"].to_numpy() == 1
    return Model(x, good)


def judge(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and anomaly, the forest's score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                stats, x = statistics(b.column("text").to_pylist())
                failed = base_failed(stats)
                score = model.value.score(x) if model.value else np.zeros(len(x))
                kept = ~failed & (score <= model.value.threshold) if model.value else ~failed
                columns = [b.column("doc_id"), *(pa.array(s) for s in stats.T), pa.array(failed), pa.array(kept), pa.array(score)]
                names = [c.split()[0] for c in _STATS.split(", ")] + ["base_failed", "kept", "anomaly"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(verdicts, _STATS + ", base_failed boolean, kept boolean, anomaly double")


def kept(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """The documents that stay, with all their columns: judged where they lie, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))

    def staying(texts: pa.Array) -> pa.Array:
        stats, rates = statistics(texts.to_pylist())
        ok = ~base_failed(stats)
        return pa.array(ok & model.value.passes(rates) if model.value else ok)

    return passing(docs, staying)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
