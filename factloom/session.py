"""Session settings and lineage cuts that hold on one machine and on a cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that results rely on.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true"}


def session(name: str = "factloom", **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()


def _shared(spark: SparkSession) -> str:
    """The folder that all executors share.

    Only where spark.checkpoint.dir is missing on a single machine a temporary folder is used; a cluster has to name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if where is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="factloom-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder of spark.checkpoint.dir."""
    _shared(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing lies at."""
    return f"{_shared(spark)}/{uuid.uuid4().hex}"


#: Most rows that are broadcast on the strength of a count.
SMALL = 200_000


def small_side(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df for the small side of a join: written down, counted, and broadcast if it has at most so many rows."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= most else df
