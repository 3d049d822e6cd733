"""Sharding by proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; a row's fractional
rank is (rank - 1/2) / rows of its source. Sorted by fractional rank, any stretch of rows
has every source in its proportion, so cutting the order into equal stretches gives shards
that all match the mixture, with row counts at most one apart.

Texts are read once and leave only their size and checksum. Both rankings deal these narrow rows
out by range, number them where they lie and add up the counts of the ranges (a row for each source
and range), so neither a source nor the whole table has a task of its own.

Defined results: null text has no bytes (size 1, crc32 of nothing 0); a very long text counts like any
other. A null source is a source of its own. Rows that repeat their id or every column are ranked one
after the other, and rows with equal fractional ranks by source and rank. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import ordinals
from ..session import small_side
from .common import checkpoint, table


def shard(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """doc_id, source, size, text_crc32, shard (from 0) and slot, the place in the shard from 0."""
    rows = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_rid"),
    )
    rows = checkpoint(rows)
    # rows that are equal in all else are told apart by _rid, hashed so that they don't share a range
    key = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")
    rows = rows.withColumns({"_key": key, "_tie": F.xxhash64(F.lit(seed), "_rid")})
    ranked = ordinals(rows, ["source"], ["_key", "_tie", "_rid"], "_rank").select("doc_id", "source", "size", "text_crc32", "_rank")
    per_source = small_side(rows.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("_rows")))
    ranked = ranked.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranked = ranked.withColumn("_frac", (F.col("_rank") + 0.5) / F.col("_rows"))
    placed = ordinals(ranked, [], ["_frac", "source", "_rank"], "_at")
    # shard s holds the places from ceil(s * n / shards) on
    at, n = F.col("_at"), F.lit(rows.count())
    which = F.call_function("div", at * F.lit(shards), n)
    first = F.call_function("div", F.col("shard") * n + F.lit(shards - 1), F.lit(shards))
    return (
        placed.withColumn("shard", which)
        .withColumn("slot", at - first)
        .select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
