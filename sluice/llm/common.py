"""What the training-data operators share: table access, intermediate tables in shared storage, small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import fresh_path, remove, scratch, shared_dir, table

__all__ = ["discard", "fresh_path", "join_to_groups", "materialize", "quoted", "remove", "scratch", "shared_dir", "table", "text_or_empty"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._sluice_path = path
    return written


def discard(*written: DataFrame) -> None:
    """Deletes the folders of materialized tables that nothing will read any more."""
    for df in written:
        remove(df.sparkSession, df._sluice_path)


def quoted(name: str) -> str:
    """A column's name as a reference, though it may hold dots."""
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def join_to_groups(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with one row of groups for each key, though one key may hold most rows.

    The key is wrapped, so both sides shuffle for this join alone, and adaptive execution may split a hot key.
    """
    left = rows.withColumn("_key", F.struct(key))
    right = groups.withColumn("_key", F.struct(key)).drop(key)
    return left.join(right.hint("merge"), "_key", how).drop("_key")
