"""Stories in storage that all executors share: one row (id, created, title, story) each, as Parquet."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

_ID = re.compile(r"[a-z0-9]{10}")


def save(spark: SparkSession, path: str, stories: list[dict]) -> None:
    rows = [(s["id"], s["createdAt"], s["title"], json.dumps(s, ensure_ascii=False)) for s in stories]
    if bad := [r[0] for r in rows if not _ID.fullmatch(r[0])]:
        raise ValueError(f"not an id: {bad[0]}")
    spark.createDataFrame(rows, "id string, created string, title string, story string").coalesce(1).write.mode("append").parquet(path)


def all_stories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def find(spark: SparkSession, path: str, story_id: str) -> dict | None:
    """A story by its id; the filter reaches the files, which are pruned by their statistics."""
    if not _ID.fullmatch(story_id):
        return None
    row = all_stories(spark, path).where(f"id = '{story_id}'").orderBy("created", ascending=False).select("story").first()
    return json.loads(row[0]) if row else None


def count(spark: SparkSession, path: str) -> int:
    return all_stories(spark, path).select("id").distinct().count()
