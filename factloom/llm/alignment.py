"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes.

Tokens of A (byte-level BPE, over a blank and the text) and of B (pieces, over the text, in front of which B puts the
blank) are intervals of the same bytes. Merging the cumulative ends of both gives the groups, which end where both
end, and the links: each stretch between neighbouring ends lies in one token of either side, and each pair that
overlaps has one such stretch.

No token of either crosses a blank between two other characters, so a text falls into words there. A task takes
documents in chunks of a bounded size and aligns each different word of a chunk once, unless the chunk before had it;
the ends of all words lie in one array and are merged together. What a document has is then put together from its words.

The pairs of a chunk are numbered and sent on once with the number of documents that have them. Spark sums them over
all chunks, joins the largest sum of each A id, and joins both back to the chunks; each chunk meets its documents, of
which only the numbers of their pairs are kept, and its pairs again by a cogroup. So what is shuffled follows the
different pairs of chunks, not the links of documents.

Defined results: texts that are null or empty, and those that a tokenizer doesn't give back byte by byte, have no
tokens: zeros and an empty string. A very long text is a chunk of its own. Of ties for the highest count all are
best. A repeated row is a document of its own, and counts as one. Rows with a null doc_id are treated like any other.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, slices, table

#: Bytes of text of a chunk, and of words that a tokenizer gets at once.
CHUNK, TOGETHER = 8 << 20, 1 << 16
_BITS = 20  # of a token's id
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_of_char() -> dict[str, int]:
    """The bytes that characters of a byte-level vocabulary stand for: printable ones for themselves, the others
    for those from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: encode gives the ids of some texts, bytes_of the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], bytes_of: list[bytes]) -> None:
        if len(bytes_of) >= 1 << _BITS:
            raise ValueError("a vocabulary has too many entries")
        self.encode, self.bytes_of = encode, bytes_of
        self.length = np.array([len(b) for b in bytes_of], np.int64)

    def words(self, words: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the words, one word after the other, how many each has, and whether their bytes are the word's.

        Words are encoded together as one text, which falls into the same words.
        """
        ids, counts, good = [], np.zeros(len(words), np.int64), np.ones(len(words), bool)
        a = 0
        while a < len(words):
            b, size = a, 0
            # what follows a word that ends in white space isn't told apart from it
            while b < len(words) and size < TOGETHER:
                size += len(raw[b])
                b += 1
                if words[b - 1][-1:].isspace():
                    break
            if b - a > 1 and words[b - 1][-1:].isspace():
                b -= 1
            found = self._together(words[a:b], raw[a:b]) if b - a > 1 else None
            if found is None:
                for k, own in enumerate(self.encode(words[a:b])):
                    ids.append(np.array(own, np.int64))
                    counts[a + k] = len(own)
                    good[a + k] = b"".join(map(self.bytes_of.__getitem__, own)) == raw[a + k]
            else:
                ids.append(found[0])
                counts[a:b] = found[1]
            a = b
        return np.concatenate(ids) if ids else np.empty(0, np.int64), counts, good

    def _together(self, words: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        own = self.encode(["".join(words)])[0]
        if b"".join(map(self.bytes_of.__getitem__, own)) != b"".join(raw):
            return None
        ids = np.array(own, np.int64)
        ends, tokens = np.cumsum([len(r) for r in raw]), np.cumsum(self.length[ids])
        at = np.searchsorted(tokens, ends)
        if not (tokens[at] == ends).all():
            return None
        return ids, np.diff(np.concatenate(([-1], at)))


class _Names(dict):
    """The text of an id and of what follows it, by 3 * id and the place of that in `,|;`."""

    def __missing__(self, k: int) -> str:
        self[k] = f"{k // 3}{',|;'[k % 3]}"
        return self[k]


@lru_cache(maxsize=1)
def _names() -> _Names:
    return _Names()


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    byte_level = Tokenizer.from_file(path_a)
    byte_level.encode_special_tokens = True
    of, names = _byte_of_char(), sorted(byte_level.get_vocab().items(), key=lambda x: x[1])
    entries = [b""] * (names[-1][1] + 1)
    for name, i in names:
        entries[i] = bytes(of[c] for c in name) if all(c in of for c in name) else name.encode()
    a = Side(lambda texts: [e.ids for e in byte_level.encode_batch_fast(texts, add_special_tokens=False)], entries)

    pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    if any("▁" in n.lstrip("▁") for n in names):
        raise ValueError("a piece goes over the end of a word")
    entries = [bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    # a word's first blank is the one that B puts there
    b = Side(lambda texts: pieces.encode([t[1:] for t in texts]), entries)
    return a, b


def words_of(text: str) -> list[str]:
    """The words of a blank and the text, each without its first blank."""
    return _CUT.split(text)


class Aligned:
    """Words, aligned: of each the numbers of tokens, groups and links, its groups as text, and its pairs' codes."""

    def __init__(self, words: list[str], a: Side, b: Side) -> None:
        words = [" " + w for w in words]
        raw = [w.encode() for w in words]
        ids_a, self.n_a, good_a = a.words(words, raw)
        ids_b, self.n_b, good_b = b.words(words, raw)
        self.good = good_a & good_b
        keep_a, keep_b = np.repeat(self.good, self.n_a), np.repeat(self.good, self.n_b)
        ids_a, ids_b = ids_a[keep_a], ids_b[keep_b]
        self.n_a, self.n_b = np.where(self.good, self.n_a, 0), np.where(self.good, self.n_b, 0)
        # both cut the same bytes, words included
        ends_a, ends_b = np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b])
        ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
        twice = np.concatenate((ends[1:] == ends[:-1], [False]))[: len(ends)]
        both, ends = ends[twice], ends[~twice]
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.pairs = (ids_a[at_a] << _BITS) | ids_b[at_b]
        own = np.cumsum([len(r) if g else 0 for r, g in zip(raw, self.good.tolist(), strict=True)])
        self.n_links = np.diff(np.concatenate(([0], np.searchsorted(ends, own, "right"))))
        self.n_groups = np.diff(np.concatenate(([0], np.searchsorted(both, own, "right"))))
        self.texts = self._texts(ids_a, ids_b, np.searchsorted(both, ends_a), np.searchsorted(both, ends_b))

    def _texts(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
        group = np.concatenate((2 * group_a, 2 * group_b + 1))
        order = np.argsort(group, kind="stable")
        group = group[order]
        last = np.concatenate((group[1:] != group[:-1], [True]))[: len(group)]
        ends = np.where(last, np.where(group % 2 == 0, 1, 2), 0)
        parts = list(map(_names().__getitem__, (3 * np.concatenate((ids_a, ids_b))[order] + ends).tolist()))
        at = np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        return ["".join(parts[x:y]) for x, y in zip(at, at[1:])]  # noqa: B905


def _joined(words: list[str], a: Side, b: Side) -> Aligned:
    """Words, aligned; those of the worker's last chunk are taken from there, and the others are kept for the next one."""
    known, old = _LAST.get((id(a), id(b)), ({}, None))
    at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
    fresh = at < 0
    found = Aligned([w for w, new in zip(words, fresh.tolist(), strict=True) if new], a, b)
    if old is not None and not fresh.all():
        at[fresh] = len(old.good) + np.arange(int(fresh.sum()))
        starts = np.concatenate((_starts(old.n_links), len(old.pairs) + _starts(found.n_links)))[at]
        texts, pairs = old.texts + found.texts, np.concatenate((old.pairs, found.pairs))
        for name in ("good", "n_a", "n_b", "n_groups", "n_links"):
            setattr(found, name, np.concatenate((getattr(old, name), getattr(found, name)))[at])
        found.texts = list(map(texts.__getitem__, at.tolist()))
        found.pairs = pairs[_expanded(starts, found.n_links)]
    _LAST.clear()
    _LAST[id(a), id(b)] = ({w: i for i, w in enumerate(words)}, found)
    return found


#: The words of a worker's last chunk.
_LAST: dict[tuple[int, int], tuple[dict[str, int], Aligned]] = {}


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _packed(pair: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers and their times, small."""
    steps = np.diff(pair, prepend=0)
    kinds = [next(k for k in ("<u1", "<u2", "<u4") if not len(x) or x.max() < 1 << 8 * int(k[2])) for x in (steps, times)]
    head = bytes(int(k[2]) for k in kinds)
    return head + steps.astype(kinds[0]).tobytes() + times.astype(kinds[1]).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide, n = data[:2], (len(data) - 2) // (data[0] + data[1])
    steps = np.frombuffer(data, f"<u{wide[0]}", n, 2)
    return np.cumsum(steps, dtype=np.int64), np.frombuffer(data, f"<u{wide[1]}", n, 2 + n * wide[0]).astype(np.int64)


def _expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


_DOC = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary"


class Chunk:
    """Documents that are aligned together."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.number: dict[str, int] = {}
        self.docs: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        known = self.number
        words = words_of(text) if text else []
        for w in words:
            if w not in known:
                known[w] = len(known)
        self.ids.append(doc_id)
        self.docs.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))

    def rows(self, a: Side, b: Side, of: Callable[[str], object]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """A row for each document, and the pairs of the chunk with the numbers of documents."""
        found = _joined(list(self.number), a, b)
        codes, number = np.unique(found.pairs, return_inverse=True)
        links = np.concatenate(([0], np.cumsum(found.n_links)))
        rows, has = [], np.zeros(len(codes), np.int64)
        for doc_id, words in zip(self.ids, self.docs, strict=True):
            if not len(words) or not found.good[words].all():
                rows.append((doc_id, 0, 0, 0, 0, of(""), _packed(words[:0], words[:0])))
                continue
            own, again = np.unique(words, return_counts=True)
            n = found.n_links[own]
            pair, at = np.unique(number[_expanded(links[own], n)], return_inverse=True)
            times = np.bincount(at, np.repeat(again, n)).astype(np.int64)
            has[pair] += 1
            text = "".join(map(found.texts.__getitem__, words.tolist()))[:-1]
            sums = (int(x[words].sum()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links))
            rows.append((doc_id, *sums, of(text), _packed(pair, times)))
        return rows, codes, has


def _aligned(docs: DataFrame, path_a: str | None, path_b: str | None, size: int, of: Callable[[str], object]) -> DataFrame:
    """A row for each document, and one for each chunk that has its pairs instead; written down."""
    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    struct = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int32())])
    kinds = (pa.int64(), *(pa.int64(),) * 5, pa.string(), pa.binary(), pa.list_(struct))
    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "counts"]

    def emit(number: int, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        rows, codes, has = chunk.rows(*sides(path_a, path_b), of)
        for k in range(0, len(rows), 1_000):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1_000], strict=True), kinds[1:8], strict=True)]
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), *columns, pa.nulls(n, kinds[8])], names)
        own = (codes >> _BITS, codes & ((1 << _BITS) - 1), has)
        counts = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in own], ["a", "b", "docs"])
        counts = pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), counts)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.nulls(1, k) for k in kinds[1:8]), counts], names)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the same numbers if the task runs again
        number, chunk = TaskContext.get().partitionId() << 32, Chunk()
        for batch in batches:
            for b in slices(batch):
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    chunk.add(doc_id, text)
                    chunk.size += len(text or "")
                if chunk.size >= size or len(chunk.ids) >= 100_000:
                    yield from emit(number, chunk)
                    number, chunk = number + 1, Chunk()
        if chunk.ids:
            yield from emit(number, chunk)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = _DOC + ", counts array<struct<a: int, b: int, docs: int>>"
    return checkpoint(rows.mapInArrow(align, schema))


def _counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of chunks (chunk, number, a, b, docs), and those of the corpus: (a, b, n, most), most being the
    largest n of the A id."""
    own = rows.where("counts IS NOT NULL").select("chunk", F.posexplode("counts").alias("number", "p"))
    own = own.select("chunk", "number", "p.a", "p.b", "p.docs").where("docs > 0")
    n = checkpoint(own.groupBy("a", "b").agg(F.sum("docs").alias("n")))
    most = n.groupBy(F.col("a").alias("of_a")).agg(F.max("n").alias("most"))
    return own, n.join(most, F.col("a") == F.col("of_a")).drop("of_a")


def pair_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(a, b, n, best) of each pair of ids that is linked: the documents that have it, and whether no B id is linked
    with a by more."""
    n = _counted(_aligned(docs, path_a, path_b, chunk, lambda text: None))[1]
    return n.select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, of: Callable[[str], object] = str, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each row.

    groups is a string: `a1,a2|b1;a3|b2,b3` has two groups, each with its ids of A and of B; of may make another one
    of it, such as a digest.
    """
    rows = _aligned(docs, path_a, path_b, chunk, of)
    own, n = _counted(rows)
    n = n.select(F.col("a").alias("x"), F.col("b").alias("y"), "n", (F.col("n") == F.col("most")).alias("best"))
    told = own.join(n, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")))
    told = told.select(F.col("chunk").alias("of_chunk"), "number", "n", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def judge(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        at = pairs.column("number").to_numpy()
        n, best = (np.zeros(at.max(initial=-1) + 1, np.int64) for _ in range(2))
        n[at], best[at] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for blob in docs.column("pairs").to_pylist():
            pair, times = _unpacked(blob)
            n_best.append(int((best[pair] * times).sum()))
            count_sum.append(int((n[pair] * times).sum()))
        columns = [docs.column(c) for c in names[:5]] + [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs.column("groups")]
        return pa.table(columns, names)

    left = rows.where("counts IS NULL").drop("counts").groupBy("chunk")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return left.cogroup(told.groupBy("of_chunk")).applyInArrow(judge, schema)


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), of=_digest).withColumnRenamed("groups", "groups_sha256")
