"""How rows become data files: distribution over tasks, file sizes, formats, and the partition folders that result.

Table properties: `write.distribution-mode` (none, hash), `write.target-file-size-bytes`, `write.shuffle-expansion`, `write.format.default`,
`write.compression-codec`, `write.parquet.bloom-filter-columns`, `write.object-storage.enabled` and those of WRITE_OPTIONS.
"""

from __future__ import annotations

import threading
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.transforms import transform

#: Table properties that go to the file writer.
WRITE_OPTIONS = {
    "write.parquet.compression-level": "parquet.compression.codec.zstd.level",
    "write.parquet.row-group-size-bytes": "parquet.block.size",
    "write.parquet.page-size-bytes": "parquet.page.size",
    "write.max-records-per-file": "maxRecordsPerFile",
}
#: Codecs of the formats that don't know zstd.
CODECS = {"json": "gzip", "csv": "gzip"}
#: Bytes of a data file, and the bytes of shuffled rows that make one byte of file, unless properties say otherwise.
TARGET_BYTES, EXPANSION = 273_741_824, 3.0
#: Bytes of a value in a row of a sort; of the types that are not here, 40.
SIZES = dict.fromkeys((T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType), 8) | {T.StringType: 28}
#: Up to so many files the driver lists itself; more are listed by a Spark job.
LISTED_HERE = 200
ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Partitions that a task writes side by side, without sorting its rows by partition; only if it meets more, it sorts the rest.
OPEN_WRITERS, OPEN_FILES = 32, "spark.sql.maxConcurrentOutputFileWriters"
#: Bytes of rows, as a sort holds them, that one task sorts at most (about): four such tasks fit in the memory of an executor of 10 GB without spilling.
SORT_BYTES = 512 << 20
_advice: dict[str, object] = {"writers": 0, "before": {}}
_lock = threading.Lock()


@contextmanager
def advised(spark: SparkSession, size: int) -> Iterator[None]:
    """Adaptive execution splits and joins shuffle partitions to about `size` bytes inside, and tasks write OPEN_WRITERS partitions (or as many as the session
    says) side by side. Writers in other threads of the session share the size of the last."""
    with _lock:
        if not _advice["writers"]:
            _advice["before"] = {name: spark.conf.get(name, None) for name in (ADVISED, OPEN_FILES)}
            if int(_advice["before"][OPEN_FILES] or 0) <= 0:
                spark.conf.set(OPEN_FILES, str(OPEN_WRITERS))
        _advice["writers"] += 1
        spark.conf.set(ADVISED, str(size))
    try:
        yield
    finally:
        with _lock:
            _advice["writers"] -= 1
            if not _advice["writers"]:
                for name, before in _advice["before"].items():
                    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def sorting_tasks(rows: int, file_bytes: int, schema: T.StructType, properties: dict[str, str]) -> int:
    """Tasks among which `rows` rows, read from `file_bytes` of files, are sorted, so that each sorts about SORT_BYTES at most."""
    width = sum(SIZES.get(type(f.dataType), 40) for f in schema) + 40  # with the length, the null bits and the sort's pointers
    held = max(rows * width, file_bytes * float(properties.get("write.shuffle-expansion", EXPANSION)))
    return max(1, -(-int(held) // SORT_BYTES))


def hidden_columns(spec: list[str], kind: str = "data") -> list[tuple[str, object]]:
    """Names and expressions of the partition columns; deletes have only those of their keys."""
    return [transform(s) for s in spec if kind == "data" or s.startswith("bucket")]


def write_parts(
    rows: DataFrame,
    path: str,
    spec: list[str],
    properties: dict[str, str],
    kind: str = "data",
    sort_by: list[str] | None = None,
    files: int | None = None,
) -> tuple[str, list[dict]]:
    """Writes rows below a fresh folder of the table; returns that folder and its partition folders.

    In hash mode, or with a target size, Spark rebalances the rows by partition: adaptive execution splits a partition that is larger than the target
    among several tasks and gives small ones to one task. files: deals the rows by ranges of partition and sort columns to so many tasks.
    """
    spark, made = rows.sparkSession, hidden_columns(spec, kind)
    name, names = uuid.uuid4().hex, [n for n, _ in made]
    folder = f"{path}/data/{name[:2] + '/' if properties.get('write.object-storage.enabled') == 'true' else ''}{name}"
    hidden = rows.withColumns(dict(made)) if made else rows
    target = int(properties.get("write.target-file-size-bytes", TARGET_BYTES))
    size = max(1, int(target * float(properties.get("write.shuffle-expansion", EXPANSION))))
    if files:
        mixed = [F.xxhash64(*plain)] if (plain := [f.name for f in rows.schema if not _has_map(f.dataType)]) else []
        hidden = hidden.repartitionByRange(files, *names, *(sort_by or []), *mixed)
    elif properties.get("write.distribution-mode") == "hash" or "write.target-file-size-bytes" in properties:
        hidden = hidden.hint("rebalance", *names)
    if sort_by:
        hidden = hidden.sortWithinPartitions(*names, *sort_by)
    form = properties.get("write.format.default", "parquet")
    writer = hidden.write.option("compression", properties.get("write.compression-codec", CODECS.get(form, "zstd")))
    for prop, option in WRITE_OPTIONS.items():
        writer = writer.option(option, properties[prop]) if prop in properties else writer
    for column in properties.get("write.parquet.bloom-filter-columns", "").replace(",", " ").split():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true") if column in rows.columns else writer
    writer = writer.partitionBy(*names) if names else writer
    with advised(spark, size):
        writer.format(form).save(folder)
    return folder, [p | {"kind": kind} for p in parts_below(spark, folder)]


def _has_map(kind: T.DataType) -> bool:
    """Whether a type holds a map, which Spark can't hash."""
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def parts_below(spark: SparkSession, folder: str) -> list[dict]:
    """The partition folders below a folder, with the bytes and the number of their files."""
    jvm, root = spark._jvm, folder.rsplit("/", 1)[1]
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    if fs.getContentSummary(at).getFileCount() <= LISTED_HERE:
        found = fs.listFiles(at, True)
        while found.hasNext():
            status = found.next()
            inside, _, file = status.getPath().toString().rsplit(f"{root}/", 1)[1].rpartition("/")
            if not file.startswith(("_", ".")):
                one = sums[inside]
                one[0] += status.getLen()
                one[1] += 1
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
        inside = F.regexp_replace(F.regexp_replace(F.substring_index("path", root, -1), "/?[^/]*$", ""), "^/", "").alias("inside")
        for r in files.groupBy(inside).agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files")).collect():
            sums[r["inside"]] = [r["bytes"], r["files"]]
    return [{"path": f"{folder}/{inside}".rstrip("/"), "partition": inside, "bytes": size, "files": n} for inside, (size, n) in sorted(sums.items())]
