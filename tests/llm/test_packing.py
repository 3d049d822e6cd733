import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm import packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts):
    """Whatever a packing must keep: every document's pieces, their ids, and gapless sequences."""
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            one = ids[a : a + 4096]
            want.append((i, k, a, len(one), zlib.crc32(one.tobytes())))
    assert sorted(map(repr, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows))) == sorted(map(repr, want))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 4096
    return by


def test_whole_table(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = packing.query(spark, SF).collect()
    by = check(rows, texts)
    bound = packing.lower_bound(np.array([r["length"] for r in rows]))
    assert len(by) <= bound + 1


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (None, "a b"), (3, "Wörd 漢字 <|endoftext|> ŉ don't"), (3, "x"), (3, "x"), (4, "word " * 9000), (5, "\x00\x1c é́ x")]
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, piece int")
    check(packing.pack(df).collect(), texts)
    assert packing.pack(df.limit(0)).count() == 0
    by = [r["ids"] for r in packing.sequences(df).collect()]
    assert sum(map(len, by)) == sum(r["length"] for r in packing.pack(df).collect())


def test_rounds_over_small_partitions(spark):
    rng = random.Random(6)
    sizes = [rng.choice((4096, 2048, 1365, rng.randrange(1, 4097), rng.randrange(1, 300))) for _ in range(4000)]
    items = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.assign(items, partition_pieces=400).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(4000))
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 4096
    assert len(used) <= packing.lower_bound(np.array(sizes)) * 1.01 + 1


def fewest(sizes, capacity):
    """The true number of bins, by trying all ways."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[k] >= sizes[i]:
                place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def test_bounds_never_exceed_the_best_packing():
    rng = random.Random(1)
    for _ in range(150):
        sizes = [rng.randrange(1, 41) for _ in range(rng.randrange(1, 9))]
        bins, offsets = packing.best_fit_decreasing(np.array(sizes), 40)
        n = fewest(sizes, 40)
        assert packing.lower_bound(np.array(sizes), 40) <= n <= len(set(bins.tolist()))
        for b in set(bins.tolist()):
            spans = sorted((o, s) for o, s, k in zip(offsets.tolist(), sizes, bins.tolist(), strict=True) if k == b)
            assert all(a + x <= c for (a, x), (c, _) in itertools.pairwise(spans))


def test_words_equal_the_tokenizer():
    own, whole = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    letters = "aAbBzZ019 '’.,!-éÉßſŉİĳ\n\t\x0b\x1c漢\xa0​<|>st"
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want
