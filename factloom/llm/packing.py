"""Best-fit packing with certified bounds.

Documents become pieces of at most CAPACITY tokens. Pieces are dealt evenly over partitions
of bounded size; each is packed by best-fit decreasing, and dual-feasible functions give a
lower bound on the bins that its pieces need in any packing. A partition that meets its
bound is certified: nothing can pack these pieces better, and all but its emptiest bin is
final. A partition with a gap keeps its full bins and opens the others. All opened pieces are
exchanged, dealt anew over as few partitions as hold them, and packed again, until that saves
no more bins. A round that saves nothing is undone, so more rounds never cost a bin.

Defined results: a null text counts as empty and gives a piece of the end id alone. A very long
text is cut into as many pieces as it takes. Pieces of equal length are packed in any order. Rows
with a null or repeated doc_id are packed like any other. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, checkpoint, slices, table

CAPACITY, END_ID = 4096, 1
#: Pieces of a partition, about.
PARTITION_PIECES = 50_000
#: Bytes of what a worker remembers of words, and of parts of texts that are not plain.
WORDS_BYTES, PARTS_BYTES = 48 << 20, 8 << 20
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- tokens ---------------------------------------------------------------------------


class WordTokenizer:
    """The ids of a tokenizer file of the word_bpe kind, with caches of words.

    White space never belongs to a token, so a text's ids are those of its parts between
    white space. Texts and parts of plain characters (ASCII and Latin letters, which normalisation
    lower-cases and nothing more) are split into words here, and words go to the file's BPE
    model; every other part goes to the whole tokenizer as it is.
    """

    PLAIN = re.compile(r"[ \t-\r!-~À-įı-ſ]*")
    WORDS = re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ \t-\ra-z0-9ß-öø-ſ]+"
    )

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.parts, self.words = Memo(PARTS_BYTES), Memo(WORDS_BYTES)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: list[bytes]) -> None:
        plain: list[tuple[bytes, list[str]]] = []
        for part in parts:
            s = part.decode("utf-8", "replace")
            words = self._plain_words(s)
            if words is None:
                self.parts.add(part, self._whole(s))
            else:
                plain.append((part, words))
        self._learn_words({w for _, words in plain for w in words})
        for part, words in plain:
            self.parts.add(part, b"".join([self.words[w] for w in words]))

    def _plain_words(self, s: str) -> list[str] | None:
        """The words of a string of plain characters; None for any other."""
        if not self.PLAIN.fullmatch(s) or ("<|" in s and any(x in s for x in self.special)):
            return None
        return self.WORDS.findall(s.lower())

    def _learn_words(self, words: set[str]) -> None:
        new = [w for w in words if not self.words.knows(w)]
        for a in range(0, len(new), 256):
            some = new[a : a + 256]
            ids = np.array(self.model.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cut = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cut) != len(some) or cut[-1] != len(ids):
                raise ValueError("a word without an end in the vocabulary")
            data, at = ids.tobytes(), 0
            for w, end in zip(some, cut, strict=True):
                self.words.add(w, data[4 * at : 4 * end])
                at = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        self.parts.tidy()
        self.words.tidy()
        texts = [(t or "").encode("utf-8", "replace").decode() for t in texts]
        split = [self._plain_words(t) for t in texts]
        self._learn_words({w for words in split if words for w in words})
        odd = [None if words is not None else t.encode().split() for t, words in zip(texts, split, strict=True)]
        self._learn(list({p for parts in odd if parts for p in parts if not self.parts.knows(p)}))
        word, part = self.words.__getitem__, self.parts.__getitem__
        return [
            b"".join(map(word, words) if words is not None else map(part, parts))
            for words, parts in zip(split, odd, strict=True)
        ]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for whole in batches:
            for batch in slices(whole):
                rows: list[tuple] = []
                data: list[bytes] = []
                for doc, ids in zip(
                    batch.column("doc_id").to_pylist(), tokenizer.encode(batch.column("text").to_pylist()), strict=True
                ):
                    ids += END_ID.to_bytes(4, "little")
                    for k, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                        one = ids[at : at + 4 * CAPACITY]
                        rows.append((doc, k, at // 4, len(one) // 4, zlib.crc32(one)))
                        if with_ids:
                            data.append(one)
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<i4") for x in data], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, _PIECES + (", ids array<int>" if with_ids else ""))


# ---- packing --------------------------------------------------------------------------


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its offset there; each item goes to the fullest bin with room."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by the room they have
    some, n = 0, 0  # the bits of some: the rooms for which there is a bin
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            b, r, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - r
        if r > size:
            room[r - size].append(b)
            some |= 1 << (r - size)
    return bins, offsets


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY, most_k: int = 24) -> int:
    """The best bound on the number of bins among two families of dual-feasible functions.

    Rounding by k: x counts floor((k + 1) x) / k, or x where (k + 1) x is whole.
    Threshold e: x counts 0 below e, 1 above 1 - e, and x between.
    """
    n = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(n @ x) // capacity)
    for k in range(1, most_k + 1):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, k * x, capacity * ((k + 1) * x // capacity))
        best = max(best, -(-int(n @ value) // (k * capacity)))
    count, total = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * x)))
    e = np.arange(1, capacity // 2 + 1)
    above = (count[-1] - count[capacity - e + 1]) * capacity
    between = total[capacity - e + 1] - total[e]
    return max(best, int((-(-(above + between) // capacity)).max()))


_PACKED = _PIECES + ", rid long, sequence_id long, offset long, open boolean"


def _pack_partition(salt: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["length"].to_numpy()
        bins, offsets = best_fit_decreasing(sizes)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        if len(fill) == lower_bound(sizes):  # certified
            opened = np.zeros(len(fill), bool)
            opened[int(fill.argmin())] = True
        else:
            opened = fill < CAPACITY
        base = (salt << 52) + (int(key[0]) << 20)
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "rid"]].assign(
            sequence_id=base + bins, offset=offsets, open=opened[bins]
        )[[c.split()[0] for c in _PACKED.split(", ")]]

    return pack


def assign(items: DataFrame, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """items (the columns of pieces()) with sequence_id and offset, and with rid, which tells rows apart."""
    pool = checkpoint(items if "rid" in items.columns else _numbered(items))
    done: DataFrame | None = None
    bins_before: int | None = None
    for salt in itertools.count():
        n = pool.count()
        parts = max(1, -(-n // partition_pieces))
        part = F.pmod(F.xxhash64(F.lit(salt), "rid"), F.lit(parts))
        packed = checkpoint(
            pool.withColumn("part", part).groupBy("part").applyInPandas(_pack_partition(salt), _PACKED)
        )
        bins = packed.select("sequence_id").distinct().count()
        if bins_before is not None and bins >= bins_before:
            break  # the pool stays as it was packed before
        final = packed.where("NOT open")
        done = final if done is None else done.unionByName(final)
        pool = packed.where("open")
        bins_before = pool.select("sequence_id").distinct().count()
        if parts == 1 or bins_before < 2:
            break
    return done.unionByName(pool).select(*[c.split()[0] for c in _PIECES.split(", ")], "rid", "sequence_id", "offset")


def _numbered(items: DataFrame) -> DataFrame:
    return items.withColumn("rid", F.monotonically_increasing_id())


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return assign(pieces(docs, path or public_tokenizers.path("word_bpe_49k.json"))).drop("rid")


def sequences(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids and offsets in their order."""
    # texts are tokenized once: their ids are written down and meet their places by rid
    made = checkpoint(_numbered(pieces(docs, path or public_tokenizers.path("word_bpe_49k.json"), with_ids=True)))
    placed = assign(made.drop("ids")).select("rid", "doc_id", "sequence_id", "offset")
    # a sequence has at most CAPACITY tokens, so its pieces are bounded
    return (
        placed.join(made.select("rid", "ids"), "rid")
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("rows"))
        .select(
            "sequence_id",
            F.flatten("rows.ids").alias("ids"),
            F.col("rows.doc_id").alias("doc_ids"),
            F.col("rows.offset").alias("offsets"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
