"""License scans by diagonal voting.

Texts and templates are sequences of words. All rolling hashes of a text's neighbouring words are joined
to the positions where templates have them: hashes of four words for license texts and notices, of two for
phrases, of which the shortest have no more. Each match is compared by its words and votes for its diagonal,
the word of the text where the template would begin. Votes are counted by text, template and diagonal. Words
put in or left out move the rest of a passage to a neighbouring diagonal, so diagonals are chained while the
next one is no farther than a quarter of the template (REACH words at least). A chain is one span. It is
verified by its matches in order: of all ways to go forward in both text and template the one that covers most
words of the template gives its share; from LEAST on the span is a place of that license. A phrase is found
where its words stand consecutively: all its pairs on one diagonal.

Templates are a parameter: few are broadcast, many are joined by a shuffle. Only matches leave a row's own task.

Defined results: a null or empty text has no words, no places and the score 0. A very long text is scanned
whole. Of overlapping spans that are equally good the one that begins first stays, then the one whose label comes
first; labels are distinct. Rows with a null doc_id are scanned like any
other and repeated rows come out repeated. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..session import small_side
from .common import checkpoint, lower_ascii, table

#: What parts words: everything of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a hash, of license texts and of phrases.
GRAM, PHRASE_GRAM = 4, 2
#: Least reach of a chain of diagonals in words, and the share of a template's words that a span has at least.
REACH, LEAST = 8, 0.8
#: Bits of the map of hashes that templates have, for each hash.
BITS = 64
#: Phrases (fixed values) and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices of well-known licenses, in words as BETWEEN parts them, and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit-license"),
    ("licensed under the mit license", "mit-license"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-license"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("either version 3 of the license or at your option any later version", "gpl-3.0-or-later"),
    ("either version 2 of the license or at your option any later version", "gpl-2.0-or-later"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
)


#: Whole texts of licenses and of the notices that files carry, a file for each label.
TEXTS = Path(__file__).parent / "data" / "licenses"


def license_texts(folder: Path = TEXTS) -> list[tuple[str, str]]:
    """(text in words, label) of each file, those of folders too; files may hold any text."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda text: " ".join(w for w in re.split(BETWEEN, text.translate(lower)) if w)
    return [(words(path.read_text()), path.stem) for path in sorted(folder.rglob("*.txt"))]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(words)), *words)


def _grams(words: Column, k: int) -> Column:
    """(at, h) of each k neighbouring words."""
    last = F.size(words) - F.lit(k)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), _hash([F.get(words, i + j) for j in range(k)]).alias("h")))


def _templates(spark: SparkSession, phrases, notices) -> DataFrame:
    """A row (template, label, exact, size, k, t, gram, h) for each run of k words of each template."""
    rows = []
    for i, (text, label, exact, k) in enumerate([*((*p, True, PHRASE_GRAM) for p in phrases), *((*n, False, GRAM) for n in notices)]):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"a template has {k} words or more: {text}")
        rows += [(i, label, exact, len(words), k, t, words[t : t + k]) for t in range(len(words) - k + 1)]
    made = spark.createDataFrame(rows, "template int, label string, exact boolean, size int, k int, t int, gram array<string>")
    hashes = {k: _hash([F.get("gram", F.lit(j)) for j in range(k)]) for k in (PHRASE_GRAM, GRAM)}
    return made.withColumn("h", F.when(F.col("k") == GRAM, hashes[GRAM]).otherwise(hashes[PHRASE_GRAM]))


def covered(matches: list[tuple[int, int]], k: int) -> int:
    """The most words of a template that matches (t, at) of k words cover, of those that follow each other in
    both the template and the text."""
    by: dict[int, set[int]] = {}
    for t, at in matches:
        by.setdefault(t, set()).add(at)
    # fronts of (at, words covered so far), both rising: for the last k - 1 words of the template one each,
    # and one for all matches before these
    recent: dict[int, list[tuple[int, int]]] = {}
    front: list[tuple[int, int]] = []
    best = 0
    for t in sorted(by):
        for old in [o for o in recent if o <= t - k]:
            front = _rising([*front, *recent.pop(old)])
        here = []
        for at in sorted(by[t]):
            most = _before(front, at) + k
            for old, some in recent.items():
                if (n := _before(some, at)) > 0:
                    most = max(most, n + t - old)
            here.append((at, most))
            best = max(best, most)
        recent[t] = _rising(here)
    return best


def _rising(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The points that have more than all points before them."""
    out: list[tuple[int, int]] = []
    for at, n in sorted(points, key=lambda p: (p[0], -p[1])):
        if not out or n > out[-1][1]:
            out.append((at, n))
    return out


def _before(front: list[tuple[int, int]], at: int) -> int:
    i = bisect_left(front, (at, -1))
    return front[i - 1][1] if i else 0


@F.pandas_udf(IntegerType())
def _covered(matches: pd.Series) -> pd.Series:
    return pd.Series([covered([(m["t"], m["at"]) for m in some], GRAM) for some in matches], dtype="int32")


def best_spans(spans: list[tuple[int, int, int, str]]) -> list[bool]:
    """Which of a text's spans (start, end, score, label) stay: no better one overlaps them by half of the shorter one.

    Spans that stay are looked up by the stretches of words that they touch.
    """
    stays, touched = [False] * len(spans), {}
    for i in sorted(range(len(spans)), key=lambda i: (-spans[i][2], spans[i][0], spans[i][3])):
        a, b, *_ = spans[i]
        places = range(a // _STRETCH, (b - 1) // _STRETCH + 1)
        rivals = {r for p in places for r in touched.get(p, ())}
        if any(2 * (min(b, spans[r][1]) - max(a, spans[r][0])) >= min(b - a, spans[r][1] - spans[r][0]) for r in rivals):
            continue
        stays[i] = True
        for p in places:
            touched.setdefault(p, []).append(i)
    return stays


_STRETCH = 256


@F.pandas_udf(ArrayType(StringType()))
def _labels_of_best(found: pd.Series) -> pd.Series:
    out = []
    for some in found:
        one = [(x["start"], x["end"], x["score"], x["label"]) for x in some]
        out.append(sorted({x[3] for x, stays in zip(one, best_spans(one), strict=True) if stays}))
    return pd.Series(out)


def _may_be(hashes: list[int]) -> Callable[[Column], Column]:
    """Whether a hash may be one of hashes, by a bitmap of about BITS bits each; it never errs to the other side.

    The bitmap is a constant of the query, of 8 bytes for each word of the templates.
    """
    words = [0] * max(1, 1 << (BITS * len(hashes) // 64).bit_length())
    for h in hashes:
        words[h >> 6 & len(words) - 1] |= 1 << (h & 63)
    # one literal, folded to an array when the query is planned
    bitmap = F.split(F.lit(",".join(str(w - (w >> 63 << 64)) for w in words)), ",").cast("array<bigint>")
    word = lambda h: F.get(bitmap, F.shiftright(h, 6).bitwiseAND(F.lit(len(words) - 1)).cast("int"))
    one = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return lambda h: word(h).bitwiseAND(one(h)) != 0


def matches(docs: DataFrame, phrases, notices) -> tuple[DataFrame, DataFrame]:
    """rows: rid, doc_id and n_words of each row; matches: rid and what a template's row has, with at."""
    templates = small_side(_templates(docs.sparkSession, phrases, notices))
    may_be = _may_be([r["h"] for r in templates.select("h").collect()])  # as many as the templates have words
    doc_id, rid = F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid")
    words = docs.select(rid, doc_id, words_of(F.col("text")).alias("words"))
    # hashes that no template has stay where they are; one more entry stands for the row itself, so that texts are read once
    kind = "array<struct<at:int,h:bigint,gram:array<string>>>"
    own = F.array(F.struct(F.lit(-1), F.lit(None), F.lit(None))).cast(kind)
    found = [
        F.transform(
            F.filter(_grams(F.col("words"), k), lambda g: may_be(g["h"])),
            lambda g: F.struct(g["at"].alias("at"), g["h"].alias("h"), F.slice("words", g["at"] + 1, k).alias("gram")),  # noqa: B023
        ).cast(kind)
        for k in (PHRASE_GRAM, GRAM)
    ]
    n_words = F.size("words").cast("long").alias("n_words")
    placed = words.select("rid", "doc_id", n_words, F.concat(own, *found).alias("p")).select("rid", "doc_id", "n_words", F.explode("p").alias("p"))
    placed = placed.select("rid", "doc_id", "n_words", F.col("p.at").alias("at"), F.col("p.h").alias("h"), F.col("p.gram").alias("own"))
    joined = placed.join(templates, "h", "left").where((F.col("at") < 0) | (F.col("own") == F.col("gram")))
    joined = checkpoint(joined.select("rid", "doc_id", "n_words", "at", "template", "label", "exact", "size", "k", "t"))
    return joined.where("at < 0").select("rid", "doc_id", "n_words"), joined.where("at >= 0").drop("doc_id", "n_words")


def spans(docs: DataFrame, phrases=PHRASES, notices=None) -> tuple[DataFrame, DataFrame]:
    """rows: rid, doc_id and n_words of each row; spans: rid, template, label, exact, start and end in words, share of
    the template's words (a phrase's share is of its pairs) and score, the words that it has less those that it lacks."""
    notices = [*NOTICES, *license_texts()] if notices is None else notices
    rows, found = matches(docs, phrases, notices)
    votes = found.withColumn("diagonal", F.col("at") - F.col("t")).groupBy("rid", "template", "diagonal").agg(
        *[F.first(c).alias(c) for c in ("label", "exact", "size", "k")], F.collect_set(F.struct("t", "at")).alias("m")
    )
    phrase = votes.where("exact").select(
        "rid", "template", "label", "exact", F.col("diagonal").cast("long").alias("start"), (F.col("diagonal") + F.col("size")).cast("long").alias("end"),
        (F.size("m") / (F.col("size") - F.col("k") + 1)).alias("share"), F.col("size").alias("score"),
    )
    # a window holds the diagonals of one text and template
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    reach = F.greatest(F.lit(REACH), F.floor(F.col("size") / 4))
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > reach
    chains = votes.where("NOT exact").withColumn("apart", F.when(apart, 1).otherwise(0))
    chains = chains.withColumn("chain", F.sum("apart").over(order)).groupBy("rid", "template", "chain").agg(
        *[F.first(c).alias(c) for c in ("label", "exact", "size", "k")], F.flatten(F.collect_list("m")).alias("m")
    )
    # written down, as what Python has counted is used twice
    chains = checkpoint(chains.withColumn("has", _covered("m")))
    text = chains.select(
        "rid", "template", "label", "exact", F.array_min("m.at").cast("long").alias("start"), (F.array_max("m.at") + F.col("k")).cast("long").alias("end"),
        (F.col("has") / F.col("size")).alias("share"), (2 * F.col("has") - F.col("size")).alias("score"),
    )
    return rows, phrase.unionByName(text)


def scan(docs: DataFrame, phrases=PHRASES, notices=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    rows, found = spans(docs, phrases, notices)
    base, own = F.expr("exact AND share = 1"), F.expr(f"NOT exact AND share >= {LEAST}")
    span = F.struct("start", "end", "score", "label")
    summed = found.groupBy("rid").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.sort_array(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.collect_list(F.when(own, span)).alias("own"),
        F.max(F.when(~F.col("exact") | base, F.col("share"))).alias("score"),
    )
    labels = F.array_sort(F.array_union("base_labels", F.when(F.size("own") > 0, _labels_of_best("own")).otherwise(F.array().cast("array<string>"))))
    summed = summed.withColumns({"labels": F.array_join(labels, ","), "base_labels": F.array_join("base_labels", ",")})
    return rows.join(summed, "rid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
