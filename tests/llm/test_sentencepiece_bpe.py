import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from factloom.llm import sentencepiece_bpe as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  ", "   a", "a ", " a  b   c    d", "\n", "\t\n x", "a\n\nb\r\n", "▁", "a▁b", "▁▁ x", "\x00", "a\x00b",
    "ﬁ Ａ é é ½", "漢字かな交じり文", "😀😀 👩‍👩‍👧", "aaaaaaaaaaaaaaa", "abababababab", "=" * 77, "-" * 501, " " * 333, "x" * 2000,
    "The the THE tHe", "1234567890" * 9, "$$$***%%%###", "<s> </s> <unk> <0x41>", "�", "⁇", "don't", "été où naïve straße ÅÄÖ",
    "ab" * 700 + " " * 40 + "ba" * 300, "//////****//////", "    def f(x):\n        return x\n" * 5,
]


@pytest.fixture(scope="module")
def both():
    return S.PieceBpe(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(both, texts):
    own, library = both
    for t, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(t, add_eos=True)
        assert ids.tolist() == want, (t[:80], ids.tolist()[:40], want[:40])
        assert own.decode(ids) == library.decode(want), t[:80]


def test_odd_texts(both):
    same(both, ODD)


def test_random_texts(both):
    rng = random.Random(7)
    letters = "aabbcdeehinorst   ▁\n=-_*/.,0159éÉßñ漢ы"
    same(both, ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(4000)])
    same(both, ["".join(rng.choices("ab ", k=rng.randrange(1, 200))) for _ in range(300)])
    same(both, ["".join(rng.choices("= -", k=rng.randrange(1, 200))) for _ in range(300)])


def test_random_ids_decode(both):
    own, library = both
    rng = np.random.default_rng(5)
    for _ in range(300):
        ids = rng.choice(np.concatenate([np.arange(3, 259), np.arange(259, 32000, 37)]), rng.integers(1, 30))
        assert own.decode(ids) == library.decode(ids.tolist())


def test_documents(both):
    same(both, pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist())


def test_query(spark, both):
    library = both[1]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = S.query(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids))


def test_nulls_repeats_and_round_trip(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", "y"), (3, "", "z"), (4, "  Ä ß\n", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = S.encoded(docs)
    assert [r["ids"] for r in got.where("doc_id = 1").collect()] == [[2], [2]]
    back = {r["doc_id"]: r["text"] for r in S.decoded(got).collect()}
    assert back == {1: "", None: "a b", 3: "", 4: "  Ä ß\n"}
    assert S.digests(docs.limit(0)).count() == 0
