"""SentencePiece BPE by vectorised merge rounds.

The pieces and scores of a model file are read once. A text becomes segments that no piece can
cross (a run of blanks stays with the word after it, a character that no longer piece has stands
alone), and each distinct segment is encoded once: all segments of a batch lie as symbols in one flat
array. A round looks up the rank of every neighbouring pair, takes the minimum of each segment, merges
the leftmost pair with that rank in all segments at once and compacts the array, until no segment has
a pair left. Where the merged piece cannot open a better pair, all its places in a segment merge in the
same round, which is what one merge after the other would do. Characters without a piece become bytes.

Decoding looks pieces up and joins them, drops the blank that encoding puts in front, and reads runs of
byte pieces as UTF-8, with U+FFFD for each byte that isn't.

Defined results: a null text counts as empty and has the end id alone. A very long text is encoded
whole. Of pairs with equal ranks the leftmost merges first. Rows with a null doc_id are
encoded like any other and repeated rows come out repeated. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, slices, table

BLANK = "▁"
#: Bytes of what a worker remembers of segments, and symbols that are merged together.
SEGMENT_BYTES, SYMBOLS = 32 << 20, 500_000
_NONE = np.int64(1) << 40


class PieceBpe:
    """The encoding and decoding of a BPE model file with byte fallback, identity normalisation and
    a blank in front of each text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.end, self.unknown = model.eos_id(), model.unk_id()
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = np.full(n, -1, np.int64)
        self.byte_of[list(self.byte.values())] = list(self.byte)
        plain = [
            i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.ids = {self.pieces[i]: i for i in plain}
        # ranks: 0 for the best score; equal scores share a rank
        scores = np.array([model.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        if len(self.byte) != 256 or model.encode("a  bＡ")[-1] == model.unk_id() or model.normalize("Ａ a") != BLANK + "Ａ" + BLANK + "a":
            raise ValueError("only models with byte fallback, no normalisation and a blank in front are meant")
        self._pairs()
        # the symbol of each code point: its piece, or n + code point where there is none
        self.symbol = n + np.arange(0x110000)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        inner = {c for p in self.ids if len(p) > 1 for c in p} - {BLANK}
        kept = "".join(map(re.escape, sorted(inner)))
        self.segment = re.compile(f" *[{kept}]+| +[^{kept} ]|[^ ]| +", re.S)
        self.words = Memo(SEGMENT_BYTES)
        self.text_of = [p.replace(BLANK, " ").encode() for p in self.pieces]
        for i in range(n):
            if model.is_control(i):
                self.text_of[i] = b""
        for x, i in self.byte.items():
            self.text_of[i] = bytes([x])
        self.text_of[self.unknown] = " ⁇ ".encode()

    def _pairs(self) -> None:
        """Sorted codes of the pairs of pieces that merge, the merged piece, and whether all places of a
        piece may merge at once: no pair that holds it has a better rank than the piece itself."""
        n = len(self.pieces)
        pairs: dict[int, int] = {}
        best = np.full(n, _NONE)
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
                    best[a], best[b] = min(best[a], self.rank[i]), min(best[b], self.rank[i])
        self.codes = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[c] for c in self.codes.tolist()], np.int64)
        self.at_once = best > self.rank
        self.size = n

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1."""
        n = self.size
        code = left * n + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((left < n) & (right < n) & (self.codes[at] == code), self.merged[at], -1)

    def _merge(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat symbols; segment is the number of each symbol's segment, ascending."""
        out_symbols, out_segment = [], []
        into = self._lookup(symbols[:-1], symbols[1:])
        while True:
            into[segment[:-1] != segment[1:]] = -1
            rank = np.where(into >= 0, self.rank[into], _NONE)
            starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            low = np.minimum.reduceat(np.concatenate((rank, [_NONE])), starts)
            length = np.diff(np.concatenate((starts, [len(segment)])))
            open_ = np.repeat(low < _NONE, length)
            if not open_.all():  # segments that are done leave the array
                out_symbols.append(symbols[~open_])
                out_segment.append(segment[~open_])
                symbols, segment = symbols[open_], segment[open_]
                if not len(symbols):
                    break
                keep = np.concatenate((rank, [_NONE]))[open_]
                into = np.concatenate((into, [-1]))[open_][:-1]
                rank, low, length = keep[:-1], low[low < _NONE], length[low < _NONE]
                starts = np.concatenate(([0], np.cumsum(length)[:-1]))
            number = np.repeat(np.arange(len(length)), length)[:-1]
            place = np.flatnonzero(rank == low[number])
            # the leftmost place of each segment, and what else may merge with it
            first = np.concatenate(([True], number[place][1:] != number[place][:-1]))
            if (~first).any():
                more = self.at_once[into[place]]
                # neighbouring places overlap: of a run of them every other one merges
                run = np.concatenate(([True], np.diff(place) > 1)) | first
                since = np.arange(len(place)) - np.flatnonzero(run)[np.cumsum(run) - 1]
                place = place[first | (more & (since % 2 == 0))]
            symbols = symbols.copy()
            symbols[place] = into[place]
            stay = np.ones(len(symbols), bool)
            stay[place + 1] = False
            # only pairs beside a merged symbol change
            into = np.concatenate((into, [-1]))[stay]
            symbols, segment = symbols[stay], segment[stay]
            at = place - np.arange(len(place))
            touched = np.zeros(len(symbols) + 1, bool)
            touched[at] = touched[at - 1] = True  # -1 falls on the last, which is cut off
            beside = np.flatnonzero(touched[: len(symbols) - 1])
            into = into[:-1]
            into[beside] = self._lookup(symbols[beside], symbols[beside + 1])
        symbols, segment = np.concatenate(out_symbols), np.concatenate(out_segment)
        order = np.argsort(segment, kind="stable")
        return symbols[order], segment[order]

    def _learn(self, segments: list[str]) -> None:
        """Encode segments that the cache doesn't have."""
        a, size = 0, np.cumsum([len(s) for s in segments])
        while a < len(segments):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SYMBOLS)))
            some = segments[a:b]
            a = b
            points = np.frombuffer("".join(some).replace(" ", BLANK).encode("utf-32-le"), "<u4").astype(np.int64)
            segment = np.repeat(np.arange(len(some)), [len(s) for s in some])
            symbols, segment = self._merge(self.symbol[points], segment)
            if (symbols >= self.size).any():
                symbols, segment = self._bytes(symbols, segment)
            data, ends = symbols.astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(segment, minlength=len(some)))).tolist()
            at = 0
            for s, end in zip(some, ends, strict=True):
                self.words.add(s, data[at:end])
                at = end

    def _bytes(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        as_bytes = [[self.byte[x] for x in chr(c - self.size).encode()] for c in symbols[odd].tolist()]
        times = np.ones(len(symbols), np.int64)
        times[odd] = [len(x) for x in as_bytes]
        out = np.repeat(symbols, times)
        out[np.repeat(symbols >= self.size, times)] = [x for some in as_bytes for x in some]
        return out, np.repeat(segment, times)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, the end id last."""
        self.words.tidy()
        end = np.array([self.end], "<u4").tobytes()
        split = [self.segment.findall(" " + t.replace(BLANK, " ")) if t else [] for t in texts]
        self._learn([s for s in {s for some in split for s in some} if not self.words.knows(s)])
        word = self.words.__getitem__
        return [np.frombuffer(b"".join(map(word, some)) + end, "<u4") for some in split]

    def decode(self, ids: np.ndarray) -> str:
        pieces = list(map(self.text_of.__getitem__, ids.tolist()))
        try:
            # all other pieces are whole characters, so runs of bytes are too if this succeeds
            text = b"".join(pieces).decode()
        except UnicodeDecodeError:
            text = self._decode_runs(pieces, (self.byte_of[ids] >= 0).tolist())
        blank = len(ids) and self.pieces[int(ids[0])].startswith(BLANK)
        return text[1:] if blank else text

    @staticmethod
    def _decode_runs(pieces: list[bytes], is_byte: list[bool]) -> str:
        out, run = [], b""
        for p, byte in zip(pieces, is_byte, strict=True):
            if byte:
                run += p
            else:
                out += [_utf8(run), p.decode()]
                run = b""
        return "".join(out) + _utf8(run)


def _utf8(data: bytes) -> str:
    """data as UTF-8, each byte that doesn't belong to a character as U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 1
                out.append("�")
            i += n
        return "".join(out)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> PieceBpe:
    return PieceBpe(path)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids, the end id last, of each row."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(path)
        for b in _batches(batches):
            ids = [x.astype(np.int32) for x in bpe.encode(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(path)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass, without a shuffle."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(path)
        number = np.array([str(i) for i in range(bpe.size)], object)
        for b in _batches(batches):
            n, by_ids, by_text = [], [], []
            for ids in bpe.encode(b.column("text").to_pylist()):
                n.append(len(ids))
                by_ids.append(hashlib.sha256(" ".join(number[ids].tolist()).encode()).hexdigest())
                by_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            arrays = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
