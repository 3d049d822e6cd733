import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from factloom.llm import sharding

SF = "/root/testdata/sf0.001"


def check(rows, docs, shards=8):
    assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == sorted(
        repr((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t, _ in docs
    )
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(shards))
    assert max(counts.values(), default=0) - min((counts[s] for s in range(shards)), default=0) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = sharding.query(spark, SF).collect()
    check(rows, docs)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_every_shard_matches_the_mixture(spark):
    docs = [(i, f"text {i}", "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    rows = sharding.shard(df).collect()
    check(rows, docs)
    whole = Counter(s for _, _, s in docs)
    for k in range(8):
        own = Counter(r["source"] for r in rows if r["shard"] == k)
        assert all(abs(own[s] - n / 8) <= 2 for s, n in whole.items())
    again = sharding.shard(df.repartition(3)).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in again) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)


def test_against_brute_force(spark):
    """The whole order, ranked in plain Python by the same seeded hash."""
    rng = random.Random(4)
    docs = [(i, "t" * rng.randrange(0, 9), rng.choice(["a", "a", "a", "b", None])) for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(6)
    crc, size = F.crc32(F.encode("text", "UTF-8")), (F.octet_length("text") + 1).cast("long")
    keys = df.select("doc_id", "source", F.xxhash64(F.lit(42), "doc_id", crc.cast("long"), size).alias("key")).collect()
    by = {}
    for r in sorted(keys, key=lambda r: r["key"]):
        by.setdefault(r["source"], []).append(r["doc_id"])
    order = [((k + 0.5) / len(ids), s is None, s or "", k, i) for s, ids in by.items() for k, i in enumerate(ids)]
    want = {}
    for at, (*_, i) in enumerate(sorted(order)):
        s = at * 8 // 700
        want[i] = (s, at - -(-s * 700 // 8))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(df).collect()} == want


def test_odd_rows(spark):
    docs = [(1, None, None), (None, "", None), (2, "é", "a"), (2, "é", "a"), (2, "é", "a"), (3, "x" * 100000, "b")]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, source string, shard int")
    check(sharding.shard(df).collect(), docs)
    assert sharding.shard(df.limit(0)).count() == 0
