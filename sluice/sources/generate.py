"""Seeded generators of employee records and account changes, with planted late and repeated rows.

Every value is a hash of (seed, row number, purpose), so the rows are the same however Spark partitions them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATE_EVERY, REPEAT_EVERY = 1000, 500


def _draw(seed: int, purpose: str, below: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), "id"), F.lit(below))


def employees(
    spark: SparkSession,
    rows: int,
    now: datetime,
    *,
    seed: int = 0,
    late: bool = True,
    repeats: bool = True,
    ids: int = 100_000,
) -> DataFrame:
    """Rows of the employee table. One in LATE_EVERY is an hour old, one in REPEAT_EVERY occurs twice."""
    stamp = F.lit(now).cast("timestamp")
    if late:
        stamp = F.when(_draw(seed, "late", LATE_EVERY) == 0, stamp - F.expr("INTERVAL 1 HOUR")).otherwise(stamp)
    made = spark.range(rows)
    if repeats:
        times = F.when(_draw(seed, "repeat", REPEAT_EVERY) == 0, 2).otherwise(1)
        made = made.select("id", F.explode(F.sequence(F.lit(1), times)).alias("_copy"))
    return made.select(
        _draw(seed, "employee", ids).alias("employee_id"),
        _draw(seed, "age", 99).cast("int").alias("age"),
        stamp.alias("start_date"),
        F.lit("Platform").alias("team"),
        F.lit("ARCHITECT").alias("role"),
        F.lit("12 Harbour Road").alias("address"),
        F.concat(F.lit("Person "), _draw(seed, "name", 100).cast("string")).alias("name"),
    )


def account_changes(
    spark: SparkSession,
    rows: int,
    now: datetime,
    *,
    seed: int = 0,
    accounts: int = 10_000,
    operations: tuple[str | None, ...] = ("U",),
) -> DataFrame:
    """Rows of the changelog, one millisecond apart, ending at `now`; operations are dealt evenly."""
    choice = F.array(*[F.lit(o).cast("string") for o in operations])
    return spark.range(rows).select(
        F.get(choice, _draw(seed, "operation", len(operations)).cast("int")).alias("operation"),
        _draw(seed, "account", accounts).alias("account_id"),
        (_draw(seed, "balance", 9000) + 1000).alias("balance"),
        F.timestamp_millis(F.unix_millis(F.lit(now).cast("timestamp")) - F.lit(rows - 1) + F.col("id")).alias("last_updated"),
    )


def json_employees(spark: SparkSession, rows: int = 1000) -> DataFrame:
    """key, value: JSON messages with sequential ids and keys `key-<n>`."""
    value = F.to_json(F.struct(F.col("id").cast("int").alias("employeeId"), F.lit("Person").alias("name")))
    return spark.range(rows).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key"), value.alias("value"))
