"""Cursors of incremental pulls: what is fresh, and how far a key has come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floored(cursors: DataFrame, since: str | None) -> DataFrame:
    """Cursors moved up to ``since`` where they are behind it."""
    if since is None:
        return cursors
    floor = F.to_timestamp(F.lit(since))
    return cursors.withColumn("watermark", F.greatest("watermark", floor))


def with_freshness(items: DataFrame, cursors: DataFrame, key: str, edited: str, since: str | None = None) -> DataFrame:
    """items with ``fresh``: edited after the key's cursor (and after ``since``), or without a key, time or cursor."""
    stored = cursors.select(F.col("source_key").alias("_key"), "watermark")
    joined = items.join(stored, F.col(key) == F.col("_key"), "left")
    mark = F.greatest("watermark", F.to_timestamp(F.lit(since))) if since else F.col("watermark")
    return joined.withColumn("fresh", F.coalesce(F.col(edited) > mark, F.lit(True))).drop("_key", "watermark")


def split_counts(marked: DataFrame, edited: str) -> DataFrame:
    """One row: fresh, stale, and the latest time among the fresh, a hint for the next cursor."""
    return marked.agg(F.count_if("fresh").alias("fresh"), F.count_if(~F.col("fresh")).alias("stale"), F.max(F.when(F.col("fresh"), F.col(edited))).alias("new_cursor"))


def advanced(cursors: DataFrame, seen: DataFrame, key: str, edited: str) -> DataFrame:
    """Cursors after ``seen`` items: for each key the later of both, never back."""
    new = seen.where(F.col(key).isNotNull() & F.col(edited).isNotNull()).groupBy(F.col(key).alias("source_key")).agg(F.max(edited).alias("watermark"))
    return cursors.select("source_key", "watermark").unionByName(new).groupBy("source_key").agg(F.max("watermark").alias("watermark"))


def is_fresh(edited: Column, watermark: Column) -> Column:
    return F.coalesce(edited > watermark, F.lit(True))
