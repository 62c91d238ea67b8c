"""Message logs: Kafka where its connector is present, else a folder of Parquet segments with the same row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LOG_ROW


def append_messages(
    rows: DataFrame,
    path: str,
    *,
    topic: str,
    value: Column,
    key: Column | None = None,
    partitions: int = 8,
    timestamp: Column | None = None,
    first_offset: int = 0,
) -> None:
    """Appends one message a row. Offsets start at first_offset, unique and ascending within one append, though not dense."""
    number = F.monotonically_increasing_id() + F.lit(first_offset)
    stamp = timestamp if timestamp is not None else F.current_timestamp()
    rows.select(
        (key if key is not None else F.lit(None)).cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        (number % partitions).cast("int").alias("partition"),
        number.alias("offset"),
        stamp.cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    ).write.mode("append").parquet(path)


def read_stream(
    spark: SparkSession,
    path: str | None = None,
    *,
    bootstrap: str | None = None,
    topic: str | None = None,
    max_files: int | None = None,
    starting: str = "latest",
    **options: str,
) -> DataFrame:
    """A stream of log rows: from Kafka if bootstrap is given, else from the segments in `path`, which always begins with the earliest.

    options go to the reader as they are: the offsets a batch may take, partitions to read in parallel, what to do about lost data.
    """
    if bootstrap:
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("subscribe", topic).option("startingOffsets", starting)
        return reader.options(**options).load()
    reader = spark.readStream.schema(LOG_ROW).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(path)
    return rows.where(F.col("topic") == topic) if topic else rows


def read_batch(
    spark: SparkSession, path: str | None = None, *, bootstrap: str | None = None, topic: str | None = None, start: int | None = None, stop: int | None = None, **options: str
) -> DataFrame:
    """The log as a bounded relation; `start` (inclusive) and `stop` (exclusive) bound the offsets of every partition.

    Of Kafka, whole ranges are better given as startingOffsets and endingOffsets among the options, which bound what is read.
    """
    if bootstrap:
        rows = spark.read.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("subscribe", topic).options(**options).load()
    else:
        rows = spark.read.schema(LOG_ROW).options(**options).parquet(path)
        rows = rows.where(F.col("topic") == topic) if topic else rows
    rows = rows.where(F.col("offset") >= start) if start is not None else rows
    return rows.where(F.col("offset") < stop) if stop is not None else rows
