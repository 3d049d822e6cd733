"""Suffix-array dedup: repeated passages by the common-prefix interval tree of an enhanced suffix array.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too. No task sees all suffixes, so
suffixes are dealt out by anchors: the anchor of a string is the place in it whose ANCHOR bytes have the least
hash, the leftmost of equal ones. Equal strings have equal anchors in equal places, so each string is looked for
among the occurrences of its own anchor only. A run of neighbouring strings with one anchor is an item: the text
that the strings cover, cut at the anchor into a right side (a suffix) and a left side, which is read backwards.

Items are counted by anchor and by text; of equal ones a single copy is read again, for they are repeats as a
whole. The different items of an anchor, sorted by right side, are a piece of a suffix array. Its common-prefix
intervals are scanned with a stack from the leaves up, and each interval keeps its items in the order of their left
sides. When intervals meet in a larger one, their items follow each other with different bytes on the right; where two
neighbours in the order of left sides differ on the left as well, the text between the two differences is a
maximal repeat. With it come all occurrences in the interval, not only neighbours in the suffix array. For
coverage the neighbours in the order of left sides are enough: whoever is farther away has less in common.

An anchor with more than CROWD different items would make too large a task. The strings of such items are hashed and
counted by Spark, which finds the same strings; an anchor's items never have to meet in one task there.

Passages shorter than LENGTH bytes are found by words: a text is written as one code of CODE bytes for each of its
words, and strings of WORDS codes are looked for in the same way. Two words with one code (32 bits of hash) are alike.

Texts and items that are equal are told by SHA-256 and by 128 bits of hash (anchor and item); what is found among
different items is compared byte by byte, or by 128 bits for crowded anchors.

Defined results: a null text counts as empty; texts under LENGTH bytes lose nothing. Repeated rows are copies of each
other: both lose all their bytes, if they have LENGTH. Very long texts are read in blocks, and an item may end at
the end of a block without any change of the result. Of ties any stands for the others. Rows with a null doc_id are
treated like any other. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, checkpoint, slices, table

#: Bytes of a string that counts as repeated, bytes of an anchor, and most items of an anchor for one task.
LENGTH, ANCHOR, CROWD = 400, 128, 512
#: Words of a passage that counts as repeated and of its anchor, bytes of a word's code, and most items of an anchor for
#: one task, which are shorter here.
WORDS, WORD_ANCHOR, CODE, WORD_CROWD = 50, 16, 4, 4096
#: Strings whose anchors are looked for at once.
BLOCK = 1 << 20
#: Bits of a place in a block, in what anchors are compared by.
_PLACE = 28
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
#: A number for each byte.
_OF = np.random.default_rng(400).integers(1 << 62, 1 << 64, 256, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


class _Hashes:
    """Hashes of the substrings of data, by sums of a polynomial's terms."""

    def __init__(self, data: np.ndarray) -> None:
        # a power of two, so that the powers are made for few sizes
        up, self.down = _powers(1 << max(10, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_OF[data] * up[: len(data)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[b] - self.sums[a]) * self.down[a])

    def grams(self, n: int) -> np.ndarray:
        """Of all substrings of n bytes."""
        k = len(self.sums) - n
        return _mixed((self.sums[n:] - self.sums[:k]) * self.down[:k])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _block(data: np.ndarray, whole: np.ndarray, length: int, anchor: int, step: int) -> tuple[np.ndarray, ...]:
    """The items of the strings that start where whole is set: (key, ctx, start, before, size)."""
    hashes = _Hashes(data)
    key = hashes.grams(anchor)
    place = np.arange(len(key), dtype=np.uint64)
    least = _least((key >> np.uint64(_PLACE) << np.uint64(_PLACE)) | place, length - anchor + 1)
    s = np.flatnonzero(whole[: len(least)])
    q = (least[s] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (s[1:] != s[:-1] + step)))[: len(s)])
    last = np.concatenate((first[1:], [len(s)]))[: len(first)] - 1
    q, a, b = q[first], s[first], s[last] + length
    shape = _mixed(((b - a).astype(np.uint64) << np.uint64(32)) + (q - a).astype(np.uint64))
    return key[q], hashes.of(a, b) ^ shape, a, q - a, b - a


def items_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, step: int = 1) -> tuple[np.ndarray, ...]:
    """(key, ctx, start, before, size, stretch) of the items of texts that lie one after the other in data.

    Strings start at each step-th byte of a text; all texts and BLOCK have whole steps.

    Of items that repeat themselves without another one between them, as in a line that comes again and again,
    only the first is there: its stretch is the distance of the last one.
    """
    whole = np.zeros(len(data), bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        whole[a : max(a, b - length + 1) : step] = True
    found = []
    for a in range(0, len(data), BLOCK):
        if whole[a : a + BLOCK].any():
            key, ctx, at, before, size = _block(data[a : a + BLOCK + length - 1], whole[a : a + BLOCK], length, anchor, step)
            found.append((key, ctx, at + a, before, size))
    if not found:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 4
    key, ctx, at, before, size = (np.concatenate(x) for x in zip(*found, strict=True))
    # what repeats itself overlaps, and so covers all from the first to the last
    same = (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1]) & (at[1:] <= at[:-1] + size[:-1])
    same &= np.searchsorted(starts, at[1:], "right") == np.searchsorted(starts, at[:-1], "right")
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return key[first], ctx[first], at[first], before[first], size[first], at[last] - at[first]


# ---- the interval tree of one anchor's items -------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class Interval:
    """A common-prefix interval: its depth, and its items by the order of their left sides."""

    __slots__ = ("depth", "members", "seeds")

    def __init__(self, depth: int, members: list[int]) -> None:
        self.depth, self.members, self.seeds = depth, members, []


def scan(items: list[tuple[bytes, bytes]], length: int = LENGTH, groups: list | None = None) -> list[tuple[int, int]]:
    """(before, after) of each of some different items (right side, left side read backwards): how far from its
    anchor an item is covered by repeats; (0, 0) if it isn't.

    groups gets the maximal repeats (before, after, all items that have it).
    """
    order = sorted(range(len(items)), key=lambda i: items[i][0])
    by_left = sorted(range(len(items)), key=lambda i: items[i][1])
    rank = [0] * len(items)
    for r, i in enumerate(by_left):
        rank[i] = r
    before, after = [0] * len(items), [0] * len(items)

    def meet(node: Interval, child: Interval) -> None:
        """A child joins its interval: the smaller of both goes through the order of the larger."""
        few, many = sorted((child.members, node.members), key=len)
        for r in few:
            k = bisect_left(many, r)
            for other in many[max(0, k - 1) : k + 1]:
                i, j = by_left[r], by_left[other]
                shared = _common(items[i][1], items[j][1])
                if shared + node.depth >= length:
                    for x in (i, j):
                        before[x], after[x] = max(before[x], shared), max(after[x], node.depth)
                    node.seeds.append((r, shared))
        if groups is None and len(few) < 8:
            for r in few:
                insort(many, r)
            node.members = many
        else:
            node.members = sorted(few + many)

    def close(node: Interval) -> None:
        """All repeats of an interval with all that have them."""
        if groups is None or not node.seeds:
            return
        own, told = node.members, set()
        near = [_common(items[by_left[a]][1], items[by_left[b]][1]) for a, b in zip(own, own[1:])]
        for r, shared in node.seeds:
            a = b = bisect_left(own, r)
            while a and near[a - 1] >= shared:
                a -= 1
            while b < len(near) and near[b] >= shared:
                b += 1
            if (a, b) not in told:
                told.add((a, b))
                groups.append((min(near[a:b]), node.depth, [by_left[x] for x in own[a : b + 1]]))

    stack: list[Interval] = []
    for k, i in enumerate(order):
        if stack:
            fall(stack, _common(items[order[k - 1]][0], items[i][0]), meet, close)
        stack.append(Interval(len(items[i][0]), [rank[i]]))
    if stack:
        fall(stack, -1, meet, close)
    return list(zip(before, after, strict=True))


def fall(stack: list[Interval], depth: int, meet, close) -> None:
    """End the intervals that are deeper than depth, each within the next one."""
    top = stack.pop()
    while stack and stack[-1].depth >= depth:
        close(top)
        meet(stack[-1], top)
        top = stack.pop()
    if top.depth > depth:
        close(top)
        top = Interval(depth, top.members)
    stack.append(top)


# ---- on Spark -------------------------------------------------------------------------

_ITEM = "key long, ctx long, start long, before int, size int, stretch long"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
_FIELDS = [c.split()[0] for c in _ITEM.split(", ")]


def _bytes_of(docs: DataFrame) -> DataFrame:
    """doc_id, text in bytes and digest (its SHA-256)."""
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _as_bytes(rows: DataFrame) -> DataFrame:
    return rows


def _as_words(rows: DataFrame) -> DataFrame:
    """_bytes_of() with the codes of a text's words in place of its bytes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            codes, ends = words_of(*_flat(b.column("text")))
            offsets = np.concatenate(([0], ends * CODE)).astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts, b.column("digest")], ["doc_id", "text", "digest"])

    return rows.mapInArrow(code, "doc_id long, text binary, digest binary")


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts, and where each ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None:
        return np.empty(0, np.uint8), offsets[1:] - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the words `[^\\x20\\x09-\\x0D]+` of texts that lie one after the other in data, and where each text's end."""
    solid = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    cut = np.zeros(len(data) + 1, bool)
    cut[0] = cut[ends] = True
    before, after = np.concatenate(([False], solid)), np.concatenate((solid, [False]))
    first, last = np.flatnonzero(after & (cut | ~before)), np.flatnonzero(before & (cut | ~after))
    codes = (_Hashes(data).of(first, last) >> np.uint64(32)).astype(np.uint32)
    return codes, np.searchsorted(first, ends)


def sketch(rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, step: int = 1) -> DataFrame:
    """doc (a number of the row), doc_id, digest and items of each of the rows (doc_id, text, digest), written down."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            texts = b.column("text")
            data, ends = _flat(texts)
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            found = items_of(data, starts, ends, length, anchor, step)
            of = np.searchsorted(starts, found[2], "right") - 1
            # empty texts share a start with the next one, which is the last of them
            found = [x.view(np.int64) if x.dtype == np.uint64 else x for x in found]
            found[2] = found[2] - starts[of]
            struct = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(found, _KINDS, strict=True)], _FIELDS)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), lists], ["doc_id", "digest", "items"])

    schema = f"doc_id long, digest binary, items array<struct<{_ITEM.replace(' ', ': ').replace(',:', ',')}>>"
    return checkpoint(rows.mapInArrow(make, schema).withColumn("doc", F.monotonically_increasing_id()))


def _classes(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items of anchors that come twice at least (doc, and an item's fields), and the different ones of them:
    (key, ctx, n, before, size, doc, start) with one place where each is, d, the number of them by anchor."""
    items = known.select("doc", F.inline("items"))
    times = F.when(F.col("stretch") > 0, 2).otherwise(1)
    again = items.groupBy(F.col("key").alias("k")).agg(F.sum(times).alias("n")).where("n > 1").select("k")
    items = checkpoint(items.join(again, F.col("key") == F.col("k"), "left_semi"))
    # all of fixed width, so that it is counted in place before it is dealt out
    classes = items.groupBy("key", "ctx").agg(
        F.sum(times).alias("n"), F.min("before").alias("before"), F.min("size").alias("size"), F.min("doc").alias("doc"), F.min_by("start", "doc").alias("start")
    )
    classes = checkpoint(classes)
    # written down, so that the join with a crowded anchor is a plain one that can be split
    d = checkpoint(classes.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("d")))
    return items, checkpoint(classes.join(d, F.col("key") == F.col("k")).drop("k"))


def _sides(rows: DataFrame, form, known: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, ctx, d, single, right, left, before) of the different items of anchors that have several, from one text each."""
    some = classes.where("d > 1").groupBy("doc").agg(F.collect_list(F.struct("key", "ctx", "d", "n", "start", "before", "size")).alias("wanted"))
    some = checkpoint(known.select("doc", F.col("doc_id").alias("id"), F.col("digest").alias("sha")).join(some, "doc").drop("doc"))
    same = (F.col("digest") == F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("id"))
    if some.count() <= BROADCAST_KEYS:  # then only these texts are moved
        rows = rows.join(F.broadcast(some.select("sha", "id")), same, "left_semi")
    rows = form(rows).join(some.hint("merge"), same).select("text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            out: list[tuple] = []
            for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    at, end = w["start"] + w["before"], w["start"] + w["size"]
                    out.append((w["key"], w["ctx"], w["d"], w["n"] < 2, text[at:end], text[w["start"] : at][::-1]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "ctx", "d", "single", "right", "left"])

    return checkpoint(rows.mapInArrow(cut, "key long, ctx long, d long, single boolean, right binary, left binary"))


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, tuple[bytes, bytes, bool]]]]:
    """Each anchor with its items; a row that comes twice counts once."""
    key, own = None, {}
    for b in batches:
        for k, c, right, left, single in zip(*(b.column(x).to_pylist() for x in ("key", "ctx", "right", "left", "single")), strict=True):
            if k != key:
                if own:
                    yield key, own
                key, own = k, {}
            own[c] = (right, left, single)
    if own:
        yield key, own


def _by_trees(sides: DataFrame, length: int) -> DataFrame:
    """(key, ctx, before, after) of the single items that repeats cover."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, own in _by_key(batches):
            got = scan([x[:2] for x in own.values()], length)
            out += [(key, c, *x) for (c, (_, _, single)), x in zip(own.items(), got, strict=True) if single and x[1]]
            if len(out) > 10_000:
                yield _found(out)
                out = []
        if out:
            yield _found(out)

    rows = sides.repartition("key").sortWithinPartitions("key", "right")
    return rows.mapInArrow(trees, "key long, ctx long, before int, after int")


def _found(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "ctx", "before", "after"])


def _strings(crowded: DataFrame, length: int, step: int = 1) -> DataFrame:
    """(key, ctx, single, gram, at) of each string of the items; at is its start, counted from the anchor."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "ctx", "single", "gram", "at"], (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32())
        for b in batches:
            for key, ctx, single, right, left in zip(*(b.column(x).to_pylist() for x in ("key", "ctx", "single", "right", "left")), strict=True):
                grams = _Hashes(np.frombuffer(left[::-1] + right, np.uint8)).grams(length)[::step].view(np.int64)
                n = len(grams)
                columns = (np.full(n, key), np.full(n, ctx), np.full(n, single), grams, np.arange(n) * step - len(left))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return crowded.dropDuplicates(["key", "ctx"]).mapInArrow(strings, "key long, ctx long, single boolean, gram long, at int")


def _by_counts(crowded: DataFrame, length: int, step: int) -> DataFrame:
    """_by_trees() for the items of crowded anchors: their strings are counted."""
    strings = checkpoint(_strings(crowded, length, step))
    twice = strings.groupBy(F.col("key").alias("k"), F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = strings.where("single").join(twice, (F.col("key") == F.col("k")) & (F.col("gram") == F.col("g")), "left_semi")
    found = found.groupBy("key", "ctx").agg((-F.min("at")).alias("before"), (F.max("at") + length).alias("after"))
    return found.select("key", "ctx", F.col("before").cast("int"), F.col("after").cast("int"))


def _covered(rows: DataFrame, form, known: DataFrame, length: int, crowd: int, step: int) -> tuple[DataFrame, DataFrame]:
    """The items of anchors that come twice, and how far from the anchor each different one of them is covered."""
    items, classes = _classes(known)
    whole = classes.where("n > 1").select("key", "ctx", "before", (F.col("size") - F.col("before")).alias("after"))
    sides = _sides(rows, form, known, classes)
    found = whole.unionByName(_by_trees(sides.where(F.col("d") <= crowd), length))
    crowded = sides.where(F.col("d") > crowd)
    if not crowded.isEmpty():
        found = found.unionByName(_by_counts(crowded, length, step))
    return items, checkpoint(found)


def _spans(rows: DataFrame, form, length: int, anchor: int, crowd: int, step: int = 1) -> DataFrame:
    """(sha, spans) of each different text that loses something: [start, end) of what repeats cover, in no order."""
    known = sketch(form(rows), length, anchor, step)
    items, found = _covered(rows, form, known, length, crowd, step)
    # copies have the same spans: one of them is enough
    one = known.groupBy("digest").agg(F.min("doc").alias("doc")).select("doc", F.col("digest").alias("sha"))
    at = F.col("start") + F.col("was") - F.col("before")
    places = items.select("doc", "key", "ctx", "start", F.col("before").alias("was"), "stretch").join(found, ["key", "ctx"])
    span = F.struct(at.alias("a"), (F.col("start") + F.col("stretch") + F.col("was") + F.col("after")).alias("b"))
    spans = places.groupBy("doc").agg(F.collect_list(span).alias("spans"))
    return checkpoint(one.join(spans, "doc").drop("doc"))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that are left) of each row."""
    _hold(anchor, length)
    rows = _bytes_of(docs)

    def judge(doc_id: pa.Array, texts: list[bytes], found: list[list]) -> tuple[list, ...]:
        return doc_id, *_lost(texts, found[0])

    return _judged(rows, [_spans(rows, _as_bytes, length, anchor, crowd)], _OUT, judge)


def passages(docs: DataFrame, words: int = WORDS, anchor: int = WORD_ANCHOR, crowd: int = WORD_CROWD) -> DataFrame:
    """doc_id and n_passage_words (words in strings of so many words that stand anywhere else too) of each row."""
    _hold(anchor, words)
    rows = _bytes_of(docs)

    def judge(doc_id: pa.Array, texts: list[bytes], found: list[list]) -> tuple[list, ...]:
        return doc_id, _words_in(found[0])

    spans = _spans(rows, _as_words, words * CODE, anchor * CODE, crowd, CODE)
    return _judged(rows, [spans], "doc_id long, n_passage_words long", judge)


def _hold(anchor: int, length: int) -> None:
    if not 0 < anchor <= length:
        raise ValueError("an anchor has at most as many bytes as a string")


def _lost(texts: list[bytes], found: list) -> tuple[list[int], list[int], list[int], list[bytes]]:
    """(bytes, removed, spans, kept) of texts, as lists."""
    sizes, removed, runs, left = [], [], [], []
    for text, spans in zip(texts, found, strict=True):
        gone = _merged([(s["a"], s["b"]) for s in spans or []])
        ends = [0, *(x for s in gone for x in s), len(text)]
        kept = b"".join(text[a:z] for a, z in zip(ends[::2], ends[1::2], strict=True))
        sizes.append(len(text))
        removed.append(len(text) - len(kept))
        runs.append(len(gone))
        left.append(kept)
    return sizes, removed, runs, left


def _words_in(found: list) -> list[int]:
    """The whole words in spans of codes."""
    return [sum(b // CODE - -(-a // CODE) for a, b in _merged([(s["a"], s["b"]) for s in spans or []])) for spans in found]


def _judged(rows: DataFrame, found: list[DataFrame], schema: str, judge) -> DataFrame:
    """What judge(doc_id, texts, a list of spans for each of found) makes of the rows; texts are moved once."""
    names, of = [c.split()[0] for c in schema.split(", ")], [f"spans{i}" for i in range(len(found))]
    # all spans in one table, so that the join is a plain one that can be split
    spans = found[0].withColumnRenamed("spans", of[0])
    for name, more in zip(of[1:], found[1:], strict=True):
        spans = spans.join(more.withColumnRenamed("spans", name), "sha", "full")
    rows = rows.join(spans.hint("merge"), F.col("digest") == F.col("sha"), "left").select("doc_id", "text", *of)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            out = judge(b.column("doc_id"), b.column("text").to_pylist(), [b.column(c).to_pylist() for c in of])
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names)

    return rows.mapInArrow(make, schema)


def maximal_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """(repeat_id, length, doc_id, start) of all occurrences of each maximal repeat among an anchor's items.

    A repeat that is longer than the items of one anchor comes in parts, one for each anchor, which overlap by
    length - 1 bytes; a repeat's id is made of its bytes. Of crowded anchors the repeats are the strings of length
    bytes that come twice.
    """
    rows = _bytes_of(docs)
    known = sketch(rows, length, anchor)
    items, classes = _classes(known)
    sides = _sides(rows, _as_bytes, known, classes)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "ctx", "id", "before", "long"], (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
        for key, own in _by_key(batches):
            # an item that comes more than once is two leaves
            ids = [c for c, x in own.items() for _ in range(1 if x[2] else 2)]
            found, out = [], set()
            scan([own[c][:2] for c in ids], length, found)
            for before, after, members in found:
                right, left, _ = own[ids[members[0]]]
                name = hashlib.sha256(left[:before][::-1] + right[:after]).hexdigest()
                out |= {(key, ids[i], name, before, before + after) for i in members}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    few = sides.where(F.col("d") <= crowd).repartition("key").sortWithinPartitions("key", "right")
    found = few.mapInArrow(trees, "key long, ctx long, id string, before int, long int")
    # the only item of an anchor is a repeat itself
    whole = classes.where("d = 1").select(
        "key", "ctx", F.concat_ws("-", F.hex("key"), F.hex("ctx")).alias("id"), "before", F.col("size").alias("long")
    )
    strings = checkpoint(_strings(sides.where(F.col("d") > crowd), length))
    twice = strings.groupBy("key", "gram").agg(F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("n")).where("n > 1")
    many = strings.join(twice, ["key", "gram"]).select(
        "key", "ctx", F.concat_ws("-", F.hex("key"), F.hex("gram")).alias("id"), (-F.col("at")).alias("before"), F.lit(length).alias("long")
    )
    found = found.unionByName(whole).unionByName(many).withColumnRenamed("before", "reach")
    places = items.join(found, ["key", "ctx"]).join(known.select("doc", "doc_id"), "doc")
    start = F.col("start") + F.col("before") - F.col("reach")
    return places.select(F.col("id").alias("repeat_id"), F.col("long").alias("length"), "doc_id", start.alias("start"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of without_repeats(), with n_passage_words of passages() and whether a text has such a passage."""
    rows = _bytes_of(table(spark, sf_dir, "documents"))
    found = [_spans(rows, _as_bytes, LENGTH, ANCHOR, CROWD), _spans(rows, _as_words, WORDS * CODE, WORD_ANCHOR * CODE, WORD_CROWD, CODE)]

    def judge(doc_id: pa.Array, texts: list[bytes], found: list[list]) -> tuple[list, ...]:
        sizes, removed, runs, kept = _lost(texts, found[0])
        words = _words_in(found[1])
        return doc_id, sizes, removed, runs, [hashlib.sha256(x).hexdigest() for x in kept], words, [n > 0 for n in words]

    schema = _OUT.replace("kept binary", "kept_sha256 string") + ", n_passage_words long, has_passage boolean"
    return _judged(rows, found, schema, judge)
