"""Typed settings of a session, instead of positional job arguments."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Settings:
    app: str = "sluice"
    master: str | None = None
    shuffle_partitions: int | None = None  # left to Spark and adaptive execution unless set
    rocksdb_state: bool = True
    concurrent_writers: int = 0  # files that a task keeps open to write partitions without sorting them first
    extra: dict[str, str] = field(default_factory=dict)


def session(settings: Settings | None = None) -> SparkSession:
    s = settings or Settings()
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    if s.rocksdb_state:
        conf["spark.sql.streaming.stateStore.providerClass"] = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if s.shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(s.shuffle_partitions)
    if s.concurrent_writers:
        conf["spark.sql.maxConcurrentOutputFileWriters"] = str(s.concurrent_writers)
    builder = SparkSession.builder.appName(s.app).config(map=conf | s.extra)
    return (builder.master(s.master) if s.master else builder).getOrCreate()
