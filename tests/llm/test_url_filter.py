import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import url_filter as U

ODD = [
    None, "", "no scheme", "http://", "https://EXAMPLE.net/en/x", "https://a.Example.NET/EN/x", "http://notexample.net/en/", "http://net/", "http://net",
    "http://a.net?x=/en/", "http://a.org/fr/", "ftp://a.org/fr", "x://y://z.org/fr/", "http://m.spam-farm.example.com/", "http://spam-farm.example.com",
    "http://xspam-farm.example.com/", "http://spam-farm.example.net/en/1", "http://example.com/de/#f", "http://example.com/de", "http://.net/", "http://a..net/x",
    "http://é.example.com/de/é", "http://h/" + "p/" * 5000, "http://" + "a." * 300 + "org/fr/", "http://a.org\n/fr/x",
]


def brute(url, rules=U.RULES, listed=U.LISTED):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:].split("#")[0].split("?")[0]
    inside = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if inside(h) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if any(map(inside, listed)) else "allow"


@pytest.mark.parametrize("max_bytes", [U.MAX_BYTES, 0])
def test_odd_urls(spark, max_bytes):
    rows = [(i if i != 3 else None, u, "x") for i, u in enumerate([*ODD, ODD[4]])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted((repr(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df, max_bytes=max_bytes).collect())
    assert got == sorted((repr(i), *brute(u)) for i, u, _ in rows)
    assert U.judge(df.limit(0), max_bytes=max_bytes).count() == 0


def test_long_lists_are_exact(spark):
    rng = random.Random(5)
    hosts = [f"h{i}.site{i % 700}.example" for i in range(5000)]
    listed = rng.sample(hosts, 1500) + ["never.seen"]
    df = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    keys = spark.createDataFrame([(k,) for k in listed], "key string")
    got = {hosts[r["page_id"]] for r in U.judge(df, rules=[], listed=keys).collect() if r["verdict"] == "block"}
    assert got == set(listed) - {"never.seen"}


def test_cascade_has_levels_and_no_errors(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed = keys[::4]
    as_pairs = lambda ks: U._listed(spark, ks)
    cascade = U.build(as_pairs(listed), as_pairs(keys))
    assert len(cascade.levels) > 2
    h, g = U._hashes([k.encode() for k in keys])
    assert cascade.contains(h, g).tolist() == [i % 4 == 0 for i in range(3000)]


def test_a_large_universe_stays_a_cascade(spark):
    # a million keys of the corpus for each listed one
    key = lambda n: spark.range(n).select(F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(1)).alias("g"))
    universe, listed = key(3_000_000), key(3)
    cascade = U.build(listed, universe, max_bytes=256)
    assert cascade is not None and cascade.nbytes() <= 256
    rows = universe.toPandas()
    found = cascade.contains(*(rows[c].to_numpy().view("u8") for c in "hg"))
    assert found.tolist() == [i < 3 for i in range(3_000_000)]
    for n, others in ((1, 10), (1000, 1000), (1000, 10**9), (0, 5)):
        words, hashes = U.shape(n, others)
        assert 64 * words <= 1.45 * n * max(3, math.log2(max(1, others / max(1, n)))) + 64 and hashes >= 1


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.query(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted((r["page_id"], *brute(r["url"])) for r in pages.collect())
    assert {g[4] for g in got} == {"allow", "block"}
