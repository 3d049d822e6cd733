import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    """(id, start, end) of a text's tokens of either side, by the libraries, or two empty lists."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    of = alignment._byte_of_char()
    names = {i: n for n, i in a.get_vocab().items()}

    def both(text):
        if not text:
            return [], []
        own_a = [(i, bytes(of[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        own_b = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            own_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        if any(b"".join(x for _, x in own) != (" " + text).encode() for own in (own_a, own_b)):
            return [], []
        out = []
        for own in (own_a, own_b):
            at, side = 0, []
            for i, x in own:
                side.append((i, at, at + len(x)))
                at += len(x)
            out.append(side)
        return out

    return both


def brute(texts, tokens):
    """The result by comparing all tokens of a text with each other."""
    made, has = [], Counter()
    for t in texts:
        a, b = tokens(t)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [
            (",".join(str(i) for i, s, e in a if low <= s < high), ",".join(str(i) for i, s, e in b if low <= s < high))
            for low, high in zip([0, *ends], ends, strict=False)
        ]
        has.update(set(links))
        made.append((len(a), len(b), len(groups), links, ";".join("|".join(g) for g in groups)))
    most = defaultdict(int)
    for (x, _), n in has.items():
        most[x] = max(most[x], n)
    return [
        (a, b, g, len(links), sum(has[p] == most[p[0]] for p in links), sum(has[p] for p in links), text) for a, b, g, links, text in made
    ], has, most


ODD = [
    None, "", " ", "  two  blanks ", "a", "▁ in a text", "<|endoftext|> and <s> </s> <0x0A>", "line\nline\n\n  end \t\n", "don't I'll 's  x's",
    "naïve café Ａﬁ 漢字 🙂🙂 é́", "a\x00b \x1c c\x85d e\xa0f g", "x" * 300, "word " * 50, "  \n a", "trailing   ", "1 23 456,7.8 $9",
]


def made(seed):
    rng = random.Random(seed)
    chars = "aábcdeé fghi jkl mno  \n'’.,1290漢🙂▁\t"
    return ["".join(rng.choice(chars) for _ in range(rng.randint(0, 120))) for _ in range(80)]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("seed, chunk", [(1, 1 << 23), (2, 300)])
def test_equal_to_brute_force(spark, tokens, seed, chunk):
    texts = ODD + made(seed) + ODD
    if chunk < 1000:  # several chunks in each task
        texts = texts[:60]
    got = alignment.aligned(rows_of(spark, texts).repartition(3), chunk=chunk).orderBy("doc_id").collect()
    want, has, most = brute(texts, tokens)
    assert [tuple(r)[1:] for r in got] == want
    pairs = alignment.pair_counts(rows_of(spark, texts), chunk=chunk).collect()
    assert {(r.a, r.b): (r.n, r.best) for r in pairs} == {p: (n, n == most[p[0]]) for p, n in has.items()}


def test_words_together_and_alone(tokens):
    a, b = alignment.sides(A, B)
    words = [w for t in ODD + made(3) if t for w in alignment.words_of(t)]
    found = alignment.Aligned(words, a, b)
    for k, w in enumerate(words):
        x, y = tokens(w)
        assert (found.n_a[k], found.n_b[k]) == (len(x), len(y)), w
        assert found.good[k] == bool(x or y or not w), w


def test_words_of_the_last_chunk():
    a, b = alignment.sides(A, B)
    words = list(dict.fromkeys(w for t in ODD + made(4) if t for w in alignment.words_of(t)))
    alignment._LAST.clear()
    for some in (words[:60], words[30:110], words[110:], words[:5], words):
        got, want = alignment._joined(some, a, b), alignment.Aligned(some, a, b)
        assert got.texts == want.texts and got.pairs.tolist() == want.pairs.tolist()
        for name in ("good", "n_a", "n_b", "n_groups", "n_links"):
            assert getattr(got, name).tolist() == getattr(want, name).tolist(), name


def test_numbers_are_kept_small():
    import numpy as np

    for pair, times in (([], []), ([0, 5, 300], [1, 2, 255]), ([7, 70_000, 10_000_000], [1, 256, 70_000])):
        back = alignment._unpacked(alignment._packed(np.array(pair, np.int64), np.array(times, np.int64)))
        assert back[0].tolist() == pair and back[1].tolist() == times


def test_odd_rows(spark, tokens):
    rows = spark.createDataFrame(
        [(1, "the same", "x", 5), (1, "the same", "y", 6), (None, "the same", None, 7), (None, None, None, None)],
        "doc_id long, text string, groups string, n int",
    )
    got = alignment.aligned(rows).collect()
    want = brute(["the same"] * 3 + [None], tokens)[0]
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)
    assert sorted((r.doc_id is None, r.n_a) for r in got) == [(False, want[0][0])] * 2 + [(True, 0), (True, want[0][0])]
    empty = alignment.aligned(rows.limit(0))
    assert empty.count() == 0 and alignment.pair_counts(rows.limit(0)).count() == 0


def test_a_very_long_text(spark, tokens):
    text = " ".join(f"word{i % 977} über\n{i}" for i in range(60_000))
    (got,) = alignment.aligned(rows_of(spark, [text])).collect()
    a, b = tokens(text)
    assert (got.n_a, got.n_b) == (len(a), len(b))
    ends = {x[2] for x in a} | {y[2] for y in b}
    assert got.n_links == len(ends) and got.n_best == got.count_sum == got.n_links


def test_query_equals_brute_force(spark, tokens):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    # tokens of long texts are compared by their ends: brute() would take the square
    some = [d for d in docs]
    has, kept = Counter(), {}
    for d in some:
        a, b = tokens(d.text)
        ends = sorted({x[2] for x in a} | {y[2] for y in b})
        links, i, j = [], 0, 0
        for e in ends:
            links.append((a[i][0], b[j][0]))
            i, j = i + (a[i][2] == e), j + (b[j][2] == e)
        kept[d.doc_id] = (len(a), len(b), len({x[2] for x in a} & {y[2] for y in b}), links)
        has.update(set(links))
    most = defaultdict(int)
    for (x, _), n in has.items():
        most[x] = max(most[x], n)
    got = {r.doc_id: r for r in alignment.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for doc_id, (n_a, n_b, n_groups, links) in kept.items():
        r = got[doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (n_a, n_b, n_groups, len(links))
        assert r.count_sum == sum(has[p] for p in links) and r.n_best == sum(has[p] == most[p[0]] for p in links)
    short = next(d for d in some if d.text and len(d.text) < 400)
    assert got[short.doc_id].groups_sha256 == hashlib.sha256(brute([short.text], tokens)[0][0][-1].encode()).hexdigest()
