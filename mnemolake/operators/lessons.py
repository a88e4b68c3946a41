"""Lessons: texts that are kept once each, the newest unarchived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def lessons(events: DataFrame, max_lessons: int = 15) -> DataFrame:
    """(id, text, tag, created_at, use_count, archived) of a log of (seq, text, tag, ts).

    A lesson's id, tag and time are those of its first event; repeats raise
    use_count. The `max_lessons` largest ids are not archived; a repeat does
    not move a lesson up, since it keeps its id. Blank texts are ignored.
    """
    said = events.select("seq", strip(F.col("text")).alias("text"), "tag", "ts").filter("text is not null and text != ''")
    unique = said.groupBy("text").agg(F.min("seq").alias("id"), F.min_by("tag", "seq").alias("tag"), F.min_by("ts", "seq").alias("created_at"), (F.count("*") - 1).alias("use_count"))
    newest = unique.orderBy(F.col("id").desc()).limit(max_lessons).select(F.col("id").alias("_id"))
    return unique.join(F.broadcast(newest), F.col("id") == F.col("_id"), "left").withColumn("archived", F.col("_id").isNull()).drop("_id")


def newest_lessons(kept: DataFrame, n: int) -> DataFrame:
    """The n newest unarchived lessons, oldest first."""
    return kept.filter("not archived").orderBy(F.col("id").desc()).limit(n).orderBy("id")
