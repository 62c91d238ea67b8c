"""MERGE as DataFrame algebra.

The target is pruned before the join, as the ON clause's target-side conditions allow. Joins carry no broadcast hint:
Spark checks sizes itself and shuffles what is too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_only(target: DataFrame, source: DataFrame, keys: list[str], target_filter: Column | None = None, dedup_within: bool = False) -> DataFrame:
    """The source rows that an insert-only MERGE inserts: those that match no target row that meets target_filter.

    Duplicates inside source are all inserted, and so are rows with null keys, unless dedup_within drops
    repeated keys first.
    """
    known = (target if target_filter is None else target.where(target_filter)).select(*keys)
    rows = source.dropDuplicates(keys) if dedup_within else source
    return rows.join(known, keys, "left_anti")


def latest_change(changes: DataFrame, key: str, order: list[Column], since: Column | None = None) -> DataFrame:
    """The first row of each key in the given order, among rows that meet `since`."""
    rows = changes if since is None else changes.where(since)
    top = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(top)).where("_rank = 1").drop("_rank")


def mirror_merge(
    mirror: DataFrame,
    latest: DataFrame,
    key: str = "account_id",
    columns: tuple[str, ...] = ("balance", "last_updated"),
    operation: str = "operation",
) -> DataFrame:
    """The mirror after one change a key: matched deletes go, other matches update, unmatched rows insert unless they delete.

    A null operation updates a match and inserts nothing. Clauses apply in that order.
    """
    a = mirror.select(F.col(key).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    c = latest.select(F.col(key).alias("_c"), F.col(operation).alias("_op"), *[F.col(x).alias(f"_c_{x}") for x in columns])
    matched = F.col("_a").isNotNull() & F.col("_c").isNotNull()
    keep = F.col("_c").isNull() | (matched & ~F.coalesce(F.col("_op") == "D", F.lit(False))) | (F.col("_a").isNull() & (F.col("_op") != "D"))
    value = lambda x: F.when(F.col("_c").isNotNull(), F.col(f"_c_{x}").cast(mirror.schema[x].dataType)).otherwise(F.col(f"_a_{x}")).alias(x)
    return a.join(c, F.col("_a") == F.col("_c"), "full_outer").where(keep).select(F.coalesce("_a", "_c").alias(key), *map(value, columns))


def ordered_merge(mirror: DataFrame, latest: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The mirror after changes that may come late: of a key's row and its change the one greater by `order` stays, so the result doesn't depend on
    the order of arrival. Rows have the same columns; a deletion stays as a row, so an older change can't bring its key back.

    Nulls come first in the order; of rows alike in it, which are alike in all columns if it names them all, the mirror's stays.
    """
    rank = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in order])
    a, c = mirror.select(F.struct(*mirror.columns).alias("a")), latest.select(F.struct(*mirror.columns).alias("c"))
    met = a.join(c, F.col(f"a.{key}") == F.col(f"c.{key}"), "full_outer")
    newer = F.col("a").isNull() | (F.col("c").isNotNull() & (rank("c") > rank("a")))
    return met.select(F.when(newer, F.col("c")).otherwise(F.col("a")).alias("_row")).select("_row.*")
