"""Exact deduplication by content-defined chunk recipes (DataFrame operations only).

Each text is cut where its own content says so (regular expression CHUNK), each chunk
becomes a 64-bit identifier, and a text becomes the ordered list of its identifiers, its
recipe. A dictionary of all chunks verifies the identifiers: one that stands for two
different contents (seen by their SHA-256) is told apart by that digest. Documents are then
grouped by recipe; only recipes move between executors, never texts.

Defined results: a null text counts as empty; empty texts form one group. Rows with a null
doc_id take part, and stay only if their group has no id at all. Of rows that repeat both
text and the largest doc_id exactly one stays. A very long text is cut into as many chunks as it takes. An empty table gives an empty result. Other
columns are ignored by dedup() and carried by deduplicated().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, lower_ascii, table, without

#: Names of columns that no table has.
ID, SHA = "factloom_kept_id", "factloom_kept_sha256"

#: A chunk has at least 512 characters and ends after a white space that follows one of a
#: few letters; where none comes within 4096 characters it ends there.
CHUNK = r"(?s).{512,4095}?[dnrty][.,;]?\s|.{1,4096}"


def _word(digest: Column, start: int) -> Column:
    """Fifteen hex digits of a digest as a long."""
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and recipe, the ordered array of (id, two digest words); one row each."""
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    chunks = F.transform(
        F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)),
        lambda c: F.struct(F.xxhash64(c).alias("h"), F.sha2(c, 256).alias("d")),
    )
    keyed = F.transform(
        "chunks", lambda c: F.struct(c["h"].alias("h"), _word(c["d"], 1).alias("v"), _word(c["d"], 16).alias("w"))
    )
    return (
        docs.select(F.col("doc_id"), text.alias("norm"))
        .select("doc_id", F.sha2("norm", 256).alias("text_sha256"), chunks.alias("chunks"))
        .select("doc_id", "text_sha256", keyed.alias("recipe"))
    )


def dedup(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    id_bits shortens the chunk identifiers; tests use it to force clashes.
    """
    rows = checkpoint(recipes(docs).withColumn("rid", F.monotonically_increasing_id()))
    short = lambda h: F.shiftright(h, 64 - id_bits)
    refs = rows.select("text_sha256", F.posexplode("recipe").alias("pos", "c")).select(
        "text_sha256", "pos", short(F.col("c.h")).alias("h"), F.col("c.v").alias("v"), F.col("c.w").alias("w")
    )
    clashing = (
        refs.groupBy("h")
        .agg(F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("w").alias("w0"), F.max("w").alias("w1"))
        .where("v0 <> v1 OR w0 <> w1")
        .select("h")
    )
    clashing = checkpoint(clashing)
    rows = rows.withColumn("ids", F.transform("recipe", lambda c: short(c["h"])))
    none = F.array().cast("array<struct<pos:int,v:bigint,w:bigint>>")
    if clashing.isEmpty():
        rows = rows.withColumn("told", none)
    else:
        # texts with such a chunk also compare the digests of these chunks
        told = (
            refs.join(clashing, "h", "left_semi")
            .distinct()
            .groupBy("text_sha256")
            .agg(F.sort_array(F.collect_set(F.struct("pos", "v", "w"))).alias("told"))
        )
        rows = rows.join(told, "text_sha256", "left").withColumn("told", F.coalesce("told", none))
    # a group's digest stands for its recipe from here on: texts with one recipe are equal. The groups
    # are written down, so that the join with a group of very many copies can be split
    groups = checkpoint(
        rows.groupBy("ids", "told")
        .agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size"), F.max("text_sha256").alias("text_sha256"))
        .select("text_sha256", "top", "group_size")
    )
    return rows.join(groups, "text_sha256").select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"),
        "text_sha256",
        F.size("ids").cast("long").alias("n_chunks"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns and in no order; they are not shuffled.

    What leaves is known by id and digest, which are narrow.
    """
    own = docs.withColumn(SHA, F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), 256))
    # written down, so that the join with a very large group can be split before rows are summed up
    made = checkpoint(dedup(docs).select("doc_id", "text_sha256", "kept"))
    keys = made.groupBy(F.col("doc_id").alias(ID), "text_sha256")
    keys = checkpoint(keys.agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("stays")).where("n > 1 OR NOT stays"))

    def same(x: DataFrame, y: DataFrame) -> Column:
        return x["doc_id"].eqNullSafe(y[ID]) & (x[SHA] == y["text_sha256"])

    left = without(own, keys.where("NOT stays").select(ID, "text_sha256"), same)
    again = keys.where("stays").select(ID, "text_sha256")
    if again.isEmpty():
        return left.drop(SHA)
    # rows that repeat id and text: one of them stays
    once = left.join(again, same(left, again), "left_semi").dropDuplicates(["doc_id", SHA])
    return without(left, again, same).unionByName(once).drop(SHA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
