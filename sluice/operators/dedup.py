"""Deduplication: by watermark state, by affected partitions, by partition rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_watermark(stream: DataFrame, time_column: str, keys: list[str], delay: str = "120 seconds") -> DataFrame:
    """Drops repeated keys whose state the watermark still holds, and rows later than the watermark. The column must be a TIMESTAMP."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(keys)


def affected_partitions(rows: DataFrame, key: str, time_column: str, team: str) -> DataFrame:
    """The distinct (key, day, hour, team) that a batch touches."""
    stamp = F.col(time_column)
    return rows.select(key, F.date_trunc("day", stamp).alias("day"), F.date_trunc("hour", stamp).alias("hour"), team).distinct()


def first_of_each(rows: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """One whole row for each key: the one with the least `order`, so the pick doesn't depend on the plan."""
    others = [c for c in rows.columns]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_row"))
    return picked.select("_row.*")
