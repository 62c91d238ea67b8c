"""Partition transforms as Column expressions: bucket, hours, days, identity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark's hash() is murmur3_x86_32 with seed 42, and hash(a, b) hashes b with the hash of a as its seed. This is the int
#: whose hash is 0, so hash(SEED_0, v) has seed 0, as the bucket transform of table formats needs.
SEED_0 = -1693959553


def murmur3_long(value: Column) -> Column:
    """The 32-bit murmur3 of a bigint's 8 little-endian bytes, seed 0, as a signed int."""
    v = value.cast("bigint")
    return F.when(v.isNotNull(), F.hash(F.lit(SEED_0), v))


def bucket(n: int, value: Column) -> Column:
    return (murmur3_long(value).bitwiseAND(0x7FFFFFFF) % n).cast("int")


def hours(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(3_600_000_000)).cast("int")


def days(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000)).cast("int")


def transform(text: str) -> tuple[str, Column]:
    """The hidden partition column of 'bucket(8, c)', 'hours(c)', 'days(c)', 'identity(c)': its name and expression."""
    kind, inner = re.fullmatch(r"\s*(\w+)\s*\((.*)\)\s*", text).groups()
    args = [a.strip() for a in inner.split(",")]
    column = args[-1]
    value = F.col(column)
    made = {"bucket": lambda: bucket(int(args[0]), value), "hours": lambda: hours(value), "days": lambda: days(value), "identity": lambda: value}
    return f"_{kind}_{column}", made[kind]()


def source_of(text: str) -> str:
    """The column that a transform reads."""
    return text.rstrip(" )").split("(")[-1].split(",")[-1].strip()


def register(spark) -> None:
    """`lake_bucket(n, value)` for SQL text, as a temporary SQL function."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION lake_bucket(n INT, v BIGINT) RETURNS INT RETURN CAST((hash({SEED_0}, v) & 2147483647) % n AS INT)")
