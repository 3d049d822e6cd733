"""URL filters by a cascade of Bloom filters.

A url's keys are its host and every parent domain, each with the beginnings of its path that
have the length of some rule's path (and with none, for listed hosts). The universe is the set
of distinct keys of the whole corpus. For each list (block rules, allow rules, listed hosts)
level 0 encodes the listed keys, level 1 the keys of the universe that level 0 takes for listed,
level 2 the listed keys that level 1 takes for those, and so on until a level errs for no key.
The number of the first level without a key then says whether it is listed: for each key of the
universe the answer is exact, and judging a url needs no join.

A level has as many bits as it takes to be wrong about no more keys than it encodes: level 0 follows the logarithm
of the universe by the list, so that a cascade is some ten bytes a listed key whatever the corpus. Levels are bit
arrays that executors put together in segments; what goes to the executors is held to MAX_BYTES for all lists
together, and beyond that, with lists of several million keys, urls are judged by joining their keys with the lists.

Defined results: a null url, or one without ://, has an empty host and an empty path, fits no rule
and is allowed unless the empty host is listed. A very long url has all its parent domains looked at.
Of rules of equal length, which can't both fit unless they are one, the block list's goes first.
Repeated rows come out repeated. An empty table gives no rows. Other columns are ignored by judge().
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, lower_ascii, table

#: Rules (verdict, host, path) of the query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: A file of hosts that the query blocks with all their subdomains where no rule fits.
HOSTS = Path(__file__).parent / "data" / "blocked_hosts.txt"
#: Share of the other keys that a level may take for its own, at most: fewer wrong keys make fewer levels.
MOST_WRONG = 1 / 8
#: Most bytes of all levels of all lists, which go to every executor, and 64-bit words of a segment.
MAX_BYTES, SEGMENT_WORDS = 64 << 20, 1 << 16
#: Keys that a task takes about.
PARTITION_KEYS = 200_000


def listed_hosts(path: Path = HOSTS) -> tuple[str, ...]:
    lines = (line.strip() for line in path.read_text().splitlines())
    return tuple(line for line in lines if line and not line.startswith("#"))


#: The hosts of that file.
LISTED = listed_hosts()


# ---- one cascade ----------------------------------------------------------------------


def _places(h: np.ndarray, g: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """The bits of each key in a level, from two 64-bit hashes of the key."""
    step = (g | np.uint64(1)) * np.uint64(2 * level + 1)
    at = h[:, None] + step[:, None] * np.arange(1, hashes + 1, dtype=np.uint64)
    at ^= at >> np.uint64(31)
    return at % np.uint64(bits)


@dataclass
class Cascade:
    """Levels of packed bits, and how many bits of each a key has; a level without keys is empty."""

    levels: list[np.ndarray]
    hashes: list[int]

    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.levels)

    def passes(self, level: int, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        words = self.levels[level]
        if not len(words):
            return np.zeros(len(h), bool)
        at = _places(h, g, level, 64 * len(words), self.hashes[level])
        return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1)

    def contains(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Whether each key is listed; exact for the keys of the universe."""
        out, open_ = np.zeros(len(h), bool), np.arange(len(h))
        for level in range(len(self.levels)):
            stays = self.passes(level, h[open_], g[open_])
            out[open_[~stays]] = level % 2 == 1
            open_ = open_[stays]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    digest = xxhash.xxh64_intdigest
    return tuple(np.array([digest(k, s) for k in keys], np.uint64) for s in (1, 2))


def shape(n: int, others: int) -> tuple[int, int]:
    """The 64-bit words and the hash functions of a level of n keys, so that it is wrong about n of the other keys, or
    about MOST_WRONG of them if these are few. So the next level is no larger, however large the universe is."""
    if not n:
        return 0, 1
    bits = math.log2(1 / min(MOST_WRONG, n / max(n, others))) / math.log(2)
    return math.ceil(n * bits / 64), max(1, round(bits * math.log(2)))


def _level(keys: DataFrame, level: int, words: int, hashes: int) -> np.ndarray:
    """The bits of one level; keys are (h, g)."""
    if not words:
        return np.zeros(0, np.uint64)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _places(*(b.column(c).to_numpy().view(np.uint64) for c in "hg"), level, 64 * words, hashes).ravel()
            mask = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(mask)], ["w", "m"])

    def segment(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(SEGMENT_WORDS, np.uint64)
        out[rows["w"].to_numpy() % SEGMENT_WORDS] = rows["m"].to_numpy().view(np.uint64)
        return pd.DataFrame({"s": [key[0]], "bits": [out.tobytes()]})

    rows = keys.select("h", "g").mapInArrow(bits, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m"))
    rows = rows.groupBy(F.shiftright("w", SEGMENT_WORDS.bit_length() - 1).alias("s")).applyInPandas(segment, "s long, bits binary")
    out = np.zeros(words, np.uint64)
    for r in rows.collect():  # build() has seen to it that all segments together are few enough
        at = r["s"] * SEGMENT_WORDS
        out[at : at + SEGMENT_WORDS] = np.frombuffer(r["bits"], np.uint64)[: words - at]
    return out


def _only(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    """The keys that a level lets pass."""
    sent = keys.sparkSession.sparkContext.broadcast(cascade)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, g = (b.column(c).to_numpy().view(np.uint64) for c in "hg")
            yield b.filter(pa.array(sent.value.passes(level, h, g)))

    return keys.mapInArrow(passing, keys.schema)


def _few(keys: DataFrame, n: int) -> DataFrame:
    """keys, n rows, in no more partitions than they are worth."""
    return keys.coalesce(max(1, -(-n // PARTITION_KEYS)))


def build(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES, others: int | None = None) -> Cascade | None:
    """The cascade of the keys listed (h, g) over the universe (h, g), of which there are others; None if it is too large."""
    inside = checkpoint(listed.select("h", "g").distinct())
    cascade, n = Cascade([], []), inside.count()
    others = universe.count() if others is None else others
    inside = _few(inside, n)
    outside = universe.select("h", "g").join(inside, ["h", "g"], "left_anti")
    for level in itertools.count():
        words, hashes = shape(n, others)
        if cascade.nbytes() + 8 * words > max_bytes:
            return None
        cascade.levels.append(_level(inside, level, words, hashes))
        cascade.hashes.append(hashes)
        wrong = checkpoint(_only(outside, cascade, level))
        others, n = n, wrong.count()
        if not n:
            return cascade
        inside, outside = _few(wrong, n), inside


# ---- urls -----------------------------------------------------------------------------


def host_and_path(pages: DataFrame) -> DataFrame:
    """pages with host and path."""
    part = lambda pattern: F.coalesce(F.regexp_extract("url", pattern, 1), F.lit(""))
    return pages.withColumns(
        {"host": lower_ascii(part("(?s)://([^/?#]*)")), "path": part("(?s)://[^/?#]*([^?#]*)")}
    )


def _domains(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def keys_of(host: str, path: str, lengths: tuple[int, ...]) -> list[str]:
    """The keys of a url, those of longer rules first: domain, a space, beginning of the path."""
    keys = [f"{d} {path[:n]}" for d in _domains(host) for n in lengths if len(path) >= n]
    return sorted(set(keys), key=lambda k: (-len(k), -k.index(" ")))


def _universe(urls: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """All distinct keys of the corpus as (h, g)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("host").to_pylist(), b.column("start").to_pylist(), strict=True)
            found = {k.encode("utf-8", "replace") for x in set(pairs) for k in keys_of(*x, lengths)}
            h, g = _hashes(list(found))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (h, g)], ["h", "g"])

    return urls.select("host", "start").distinct().mapInArrow(keys, "h long, g long").distinct()


def _listed(spark: SparkSession, keys: Iterable[str] | DataFrame) -> DataFrame:
    """Listed keys as (h, g): from strings, or from a DataFrame with one column key."""
    if not isinstance(keys, DataFrame):
        keys = spark.createDataFrame([(k,) for k in keys], "key string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, g = _hashes([k.encode("utf-8", "replace") for k in b.column("key").to_pylist() if k is not None])
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (h, g)], ["h", "g"])

    return keys.select("key").mapInArrow(hashed, "h long, g long")


def _verdicts(urls: DataFrame, lengths: tuple[int, ...], cascades: dict[str, Cascade]) -> DataFrame:
    """urls, distinct (host, start), with rule and verdict."""
    sent = urls.sparkSession.sparkContext.broadcast(cascades)

    @F.pandas_udf("rule string, verdict string")
    def decide(host: pd.Series, start: pd.Series) -> pd.DataFrame:
        keys = [keys_of(*x, lengths) for x in zip(host, start, strict=True)]
        flat = [k for some in keys for k in some]
        h, g = _hashes([k.encode("utf-8", "replace") for k in flat])
        block, allow, hosts = (sent.value[c].contains(h, g) for c in ("block", "allow", "listed"))
        out, at = [], 0
        for some in keys:
            span = range(at, at + len(some))
            fits = next((i for i in span if (block[i] or allow[i]) and not flat[i].endswith(" ")), None)
            if fits is None:
                out.append((None, "block" if any(hosts[i] and flat[i].endswith(" ") for i in span) else "allow"))
            else:
                out.append((flat[fits].replace(" ", "", 1), "block" if block[fits] else "allow"))
            at += len(some)
        return pd.DataFrame(out, columns=["rule", "verdict"])

    return urls.withColumn("_v", decide("host", "start"))


def _joined(urls: DataFrame, rules: DataFrame, hosts: DataFrame) -> DataFrame:
    """What _verdicts() gives, from joins with lists of any size."""
    keys = F.explode(
        F.transform(
            F.sequence(F.lit(1), F.size(F.split("host", r"\."))),
            lambda i: F.array_join(F.slice(F.split("host", r"\."), i, F.size(F.split("host", r"\."))), "."),
        )
    )
    at = urls.select("host", "start", keys.alias("domain"))
    best = (
        at.join(rules.withColumnRenamed("host", "domain"), "domain")
        .where(F.startswith("start", "path"))
        .groupBy("host", "start")
        .agg(F.max(F.struct(F.length(F.concat("domain", "path")), F.length("domain"), F.concat("domain", "path").alias("rule"), "verdict")).alias("b"))
    )
    bad = at.join(hosts, F.concat("domain", F.lit(" ")) == F.col("key"), "left_semi").select("host", "start").distinct()
    found = urls.join(best, ["host", "start"], "left").join(bad.withColumn("_bad", F.lit(True)), ["host", "start"], "left")
    other = F.when(F.col("_bad"), "block").otherwise("allow")
    return found.select(
        "host", "start", F.struct(F.col("b.rule").alias("rule"), F.coalesce("b.verdict", other).alias("verdict")).alias("_v")
    )


def judge(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]] = RULES,
    listed: Iterable[str] | DataFrame = LISTED,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages.

    rules: (block or allow, host, path), of which the path begins with a slash. listed: hosts
    that are blocked where no rule fits, as strings or as a DataFrame with one column key.
    """
    spark, rules = pages.sparkSession, list(rules)
    if any(not path.startswith("/") for _, _, path in rules):
        raise ValueError("a rule's path begins with a slash")
    lengths = (0, *sorted({len(path) for _, _, path in rules}))
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(k,) for k in listed], "key string")
    hosts = listed.select(F.concat(lower_ascii(F.col("key")), F.lit(" ")).alias("key"))
    urls = host_and_path(pages.select("page_id", "url")).withColumn("start", F.substring("path", 1, lengths[-1]))
    universe = checkpoint(_universe(urls, lengths))
    size = universe.count()
    universe = _few(universe, size)
    lists = {which: _listed(spark, [f"{h} {p}" for v, h, p in rules if v == which]) for which in ("block", "allow")}
    cascades: dict[str, Cascade] = {}
    for name, keys in (lists | {"listed": _listed(spark, hosts)}).items():
        made = build(keys, universe, max_bytes - sum(c.nbytes() for c in cascades.values()), size)
        if made is None:
            break
        cascades[name] = made
    if len(cascades) < 3:
        distinct = urls.select("host", "start").distinct()
        judged = _joined(distinct, spark.createDataFrame(rules, "verdict string, host string, path string"), hosts)
        out = urls.join(judged, ["host", "start"])
    else:
        out = _verdicts(urls, lengths, cascades)
    return out.select("page_id", "host", "path", "_v.rule", "_v.verdict")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE = f"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rule_host, rule_path) AS (VALUES {', '.join(str(r) for r in RULES)}),
l(listed) AS (VALUES {', '.join(f"('{h}')" for h in LISTED)}),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(r.verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN r ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT p.page_id, host, path, rule,
       coalesce(fits.verdict,
                CASE WHEN EXISTS (SELECT 1 FROM l WHERE ('.' || host) LIKE ('%.' || listed)) THEN 'block' ELSE 'allow' END)
         AS verdict
FROM p LEFT JOIN fits ON p.page_id = fits.page_id
"""
