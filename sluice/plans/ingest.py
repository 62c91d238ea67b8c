"""Ingest jobs from a message log to snapshot tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import codecs
from ..functions.registry import Registry, body_of, from_registry_avro, from_registry_protobuf, from_single_object
from ..operators.dedup import first_of_each
from ..schemas import AVRO_EMPLOYEE, CHANGELOG, CHANGELOG_SPEC, EMPLOYEE, EMPLOYEE_SPEC
from ..sources.log import read_stream
from ..sources.snapshot_table import SnapshotTable
from ..streaming.jobs import append_stream, merge_ingest, watermark_ingest


def decode(
    messages: DataFrame, form: str, *, framed: bool = False, descriptors: bytes | None = None, fields: list[tuple[str, str]] = AVRO_EMPLOYEE, mode: str = "PERMISSIVE",
    registry: Registry | None = None, single_object: list[str] | None = None
) -> DataFrame:
    """The typed columns of log rows whose value is 'protobuf', 'avro', 'json' or 'change' (delimited).

    descriptors, fields: the Protobuf descriptor set and the Avro fields, where they are not those of this library. framed: a registry header is cut off unread;
    registry: it is read, and messages of any version that the registry has become rows of those schemas. single_object: the
    Avro schemas that writers used, found by the fingerprints of their messages.
    """
    value = codecs.strip_registry(F.col("value")) if framed else F.col("value")
    if form == "protobuf":
        own = descriptors or codecs.employee_descriptor_set()
        decoded = from_registry_protobuf(value, registry, own, mode=mode) if registry else codecs.from_protobuf(value, own, mode=mode)
        return codecs.flatten_employee(messages.select(decoded.alias("Employee")))
    if form == "avro":
        reader = codecs.avro_schema(fields)
        if registry:
            decoded = from_registry_avro(value, registry, reader, mode)
        else:
            decoded = from_single_object(value, single_object, reader, mode) if single_object else codecs.from_avro(value, fields, mode=mode)
        e = messages.select(decoded.alias("Employee")).select("Employee.*")
        return e.withColumn("start_date", F.timestamp_millis("start_date")).select("employee_id", "age", "start_date", "team", "role", "address", "name")
    if form == "json":
        return messages.select(codecs.parse_json(body_of(value) if registry else value).alias("Employee")).select("Employee.*")
    if form == "change":
        return messages.select(*codecs.parse_change(value))
    raise ValueError(f"unknown form {form!r}")


@dataclass
class Job:
    """What a job needs; the same names for every job."""

    log: str | None  # the folder of log segments, unless bootstrap is given
    table: str
    checkpoint: str
    name: str
    bootstrap: str | None = None
    topic: str | None = None
    every: str | None = None  # none: take what is there, then end
    max_files: int | None = None
    starting: str = "latest"
    options: dict[str, str] = field(default_factory=dict)  # of the log's reader

    def messages(self, spark: SparkSession) -> DataFrame:
        return read_stream(spark, self.log, bootstrap=self.bootstrap, topic=self.topic, max_files=self.max_files, starting=self.starting, **self.options)


def employee_table(spark: SparkSession, path: str, spec: list[str] = EMPLOYEE_SPEC, properties: dict[str, str] | None = None) -> SnapshotTable:
    return SnapshotTable.create(spark, path, EMPLOYEE, spec, properties)


def ingest_watermark(spark: SparkSession, job: Job, form: str = "protobuf", dedup: bool = True, table: dict | None = None, **decoding) -> StreamingQuery:
    """Decode, remove repeats by watermark state, append. table: spec and properties of a new table."""
    rows = decode(job.messages(spark), form, **decoding)
    run = watermark_ingest if dedup else append_stream
    return run(rows, employee_table(spark, job.table, **(table or {})), name=job.name, checkpoint=job.checkpoint, every=job.every)


def ingest_merge(spark: SparkSession, job: Job, form: str = "protobuf", *, merging: dict | None = None, table: dict | None = None, **decoding) -> StreamingQuery:
    """Decode, then an insert-only MERGE of each batch. merging: options of merge_ingest; table: spec and properties of a new table."""
    rows = decode(job.messages(spark), form, **decoding)
    return merge_ingest(rows, employee_table(spark, job.table, **(table or {})), name=job.name, checkpoint=job.checkpoint, every=job.every, **(merging or {}))


def ingest_changelog(spark: SparkSession, job: Job, table: dict | None = None) -> StreamingQuery:
    """Delimited changes to the changelog table. table: spec and properties of a new table."""
    made = SnapshotTable.create(spark, job.table, CHANGELOG, **({"spec": CHANGELOG_SPEC} | (table or {})))
    return append_stream(decode(job.messages(spark), "change"), made, name=job.name, checkpoint=job.checkpoint, every=job.every)


def dedup_partitions(table: SnapshotTable, keys: list, order, where=lambda values: True) -> int:
    """Rewrites the partitions that `where` takes with one whole row for each key; other partitions stay as they are.

    The old parts are named in the commit, so a partition that loses all its rows to another one is emptied as well.
    """
    old = table.parts(where=where)
    return table.replace(old, first_of_each(table.read_parts(old), keys, order), "overwrite")
