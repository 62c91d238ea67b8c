"""Input tables, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="sluice-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the checkpoint folder of the context.

    Without either, a session on this machine alone (tests) gets a temporary folder; a cluster has to name one. The folder comes with the scheme of
    its file system, so that workers who open files themselves and Spark mean the same one.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local()
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = at.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    return "file:///" + whole.removeprefix("file:/") if whole.startswith("file:/") and not whole.startswith("file://") else whole


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, or below the scratch folder inside `scratch`."""
    return f"{_scratch.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Inside, new paths lie in one folder, which goes at the end: for work whose results are written elsewhere."""
    folder = fresh_path(spark, "scratch")
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        remove(spark, folder)


def namespace(spark: SparkSession, warehouse: str, name: str) -> str:
    """The folder of a namespace's tables, created unless it exists; dots nest."""
    path = "/".join([warehouse.rstrip("/"), *name.split(".")])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
