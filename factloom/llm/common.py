"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper and lower case, for normalisation that touches A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the word patterns below: space and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"


#: Documents and bytes of text that an operator takes together.
BATCH_DOCS, BATCH_BYTES = 500, 1 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most BATCH_DOCS rows and about BATCH_BYTES of text (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        start = ends[a - 1] if a else 0
        b = min(int(np.searchsorted(ends, start + BATCH_BYTES)) + 1, a + BATCH_DOCS, batch.num_rows)
        yield batch.slice(a, b - a)
        a = b


class Memo(dict):
    """What a worker has worked out, to be found again: of about limit bytes, what was of use lately."""

    #: Bytes of an entry besides its key and value.
    ENTRY = 100

    def __init__(self, limit: int = 16 << 20) -> None:
        super().__init__()
        self.limit, self.held, self.before = limit, 0, {}

    def add(self, key, value) -> None:
        self[key] = value
        self.held += self.ENTRY + sys.getsizeof(key) + sys.getsizeof(value)

    def knows(self, key) -> bool:
        """Whether the key is there, which may bring it back from before the last tidy()."""
        if key in self:
            return True
        value = self.before.get(key)
        if value is None:
            return False
        self.add(key, value)
        return True

    def tidy(self) -> None:
        """To be called between batches, so that what a batch has used stays for the batch."""
        if self.held > self.limit // 2:
            self.before = dict(self)
            self.clear()
            self.held = 0


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """slices() of an array of texts."""
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"])):
        yield part.column("text")


def passing(docs: DataFrame, passes: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """The rows of docs whose texts pass, with all their columns.

    Only texts go to the Python workers and only booleans come back: documents stay in the JVM, so their
    columns may be of any type.
    """

    @F.arrow_udf("boolean")
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.concat_arrays([passes(part) for part in text_slices(texts)] or [pa.array([], pa.bool_())])

    return docs.where(verdict(F.col("text")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder of spark.checkpoint.dir.

    Only where that setting is missing on a single machine a temporary folder is used; a cluster has to name one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if where is None and re.fullmatch(r"local(\[[^\]]*\])?", sc.master) is None:
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="factloom-"))
    return df.checkpoint()


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else (lower() would also change other capitals)."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is reserved for evaluation; a null id counts as reserved."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(True))


def labelled_sample(labels: DataFrame, column: str, limit: int, train_only: bool, docs: DataFrame) -> DataFrame:
    """At most limit labelled ids of docs, (doc_id, label), those with the smallest hashes.

    Rows with a null id or label are left out; repeated ids count as labelled 1 if any is 1.
    The result has a bounded number of rows, so it may be broadcast.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    if train_only:
        rows = rows.where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    # the limit is for labels that meet a document; an inner join may build on the few labels, a semi-join may not
    rows = rows.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


#: Most rows of a broadcast set of keys (at most some 100 bytes each).
BROADCAST_KEYS = 500_000


def without(docs: DataFrame, gone: DataFrame, same: Callable[[DataFrame, DataFrame], Column], most: int = BROADCAST_KEYS) -> DataFrame:
    """docs without the rows whose keys are in gone, which is checkpointed and narrow.

    Up to most keys are broadcast, so that documents stay where they are; more are joined by a shuffle.
    """
    few = gone.count() <= most
    return docs.join(F.broadcast(gone) if few else gone, same(docs, gone), "left_anti")
