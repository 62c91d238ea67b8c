"""Jobs from the command line: python -m sluice JOB --option value ...

`python -m sluice JOB --help` lists the options of a job. Streams end once they have taken what is there, unless --every gives an interval.
"""

from __future__ import annotations

import argparse
import time
from datetime import datetime, timedelta, timezone
from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions import codecs
from .functions.registry import Registry
from .operators.maintenance import beside, closed_hours, rewrite_data_files
from .operators.predicates import Predicate, col
from .plans.cdc import incremental_mirror, mirror_changes
from .plans.ingest import Job, decode, dedup_partitions, ingest_changelog, ingest_merge, ingest_watermark
from .schemas import EMPLOYEE_SPEC, MIRROR, MIRROR_SPEC, ORDERED_MIRROR
from .session import Settings, session
from .sources.layout import TARGET_BYTES
from .sources.snapshot_table import SnapshotTable
from .streaming.jobs import console
from .workspace import namespace

FORMS = ("protobuf", "avro", "json", "change")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sluice", description=__doc__)
    top.add_argument("--master", help="Spark master; by default that of spark-submit")
    top.add_argument("--namespace", help="WAREHOUSE:NAME, where --table and --changelog are names; created unless it exists")
    top.add_argument("--concurrent-writers", type=int, default=0, help="open files of a task that writes partitions without sorting first")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, text: str, stream: bool = True, table: bool = True) -> argparse.ArgumentParser:
        one = jobs.add_parser(name, help=text, description=text)
        if table:
            one.add_argument("--table", required=True, help="folder of the table, or its name in --namespace")
        if stream:
            source = one.add_mutually_exclusive_group(required=True)
            source.add_argument("--log", help="folder of log segments")
            source.add_argument("--bootstrap", help="Kafka servers")
            one.add_argument("--topic")
            one.add_argument("--starting", default="latest", help="where a new query begins, such as earliest")
            one.add_argument("--max-files", type=int)
            one.add_argument("--option", action="append", default=[], metavar="NAME=VALUE", help="an option of the log's reader")
            one.add_argument("--checkpoint", required=True)
            one.add_argument("--every", help="interval between batches, such as '5 minutes'")
            one.add_argument("--name", default=name)
        return one

    def creating(one: argparse.ArgumentParser) -> None:
        one.add_argument("--spec", nargs="*", default=[], metavar="TRANSFORM", help="partitioning of a new table, such as 'hours(start_date)' 'bucket(8, employee_id)'")
        one.add_argument("--property", action="append", default=[], metavar="NAME=VALUE", help="a property of a new table, such as write.format.default=orc")

    def maintaining(one: argparse.ArgumentParser) -> None:
        one.add_argument("--maintain-every", type=float, metavar="SECONDS", help="rewrite data files and manifests beside the stream, so often")
        one.add_argument("--maintain-first", type=float, metavar="SECONDS", help="when to begin; by default five minutes past the next hour")
        one.add_argument("--maintain-sort-by", nargs="*", default=[])
        one.add_argument("--maintain-hours", metavar="COLUMN", help="only partitions of hours(COLUMN) that closed in the last two hours")

    def decoding(one: argparse.ArgumentParser) -> None:
        one.add_argument("--form", choices=FORMS, default="protobuf")
        one.add_argument("--framed", action="store_true", help="messages have a registry header")
        one.add_argument("--registry", help="folder of schema versions named by their ids; messages are decoded by the version of their header")
        one.add_argument("--writer-schema", action="append", default=[], help="file of an Avro schema that writers of single-object messages used")
        one.add_argument("--descriptors", help="file of a Protobuf descriptor set")
        one.add_argument("--descriptors-hex", help="a Protobuf descriptor set in hexadecimal")
        one.add_argument("--schema", help="file of an Avro schema")

    one = job("ingest-watermark", "Append messages, without repeats that the watermark still knows.")
    decoding(one)
    creating(one)
    maintaining(one)
    one.add_argument("--no-dedup", action="store_true")
    one = job("ingest-merge", "Insert the messages that the table does not hold.")
    decoding(one)
    creating(one)
    maintaining(one)
    one.add_argument("--no-dedup", action="store_true", help="append all")
    one.add_argument("--compaction", action="store_true", help="rewrite closed hours every ten batches")
    one.add_argument("--recent-hours", type=float, help="match only target rows that are not older")
    one.add_argument("--team", help="match only target rows of this team")
    one = job("ingest-changelog", "Append delimited account changes to the changelog.")
    creating(one)
    maintaining(one)
    one = job("mirror", "Merge what the changelog has got since the last run into the mirror.", stream=False)
    creating(one)
    one.add_argument("--changelog", required=True)
    one.add_argument("--since-days", type=float, help="merge all of the changelog's last days instead")
    one.add_argument("--ordered", action="store_true", help="keep the time of each key's last change and its deletion, so that late changes do no harm")
    one.add_argument("--mode", choices=("copy-on-write", "merge-on-read"), default="copy-on-write")
    one = job("dedup", "Rewrite partitions with one row for each key.", stream=False)
    one.add_argument("--keys", nargs="+", required=True)
    one.add_argument("--order-by", nargs="*", default=[], help="the first row in this order stays; by default that of all columns")
    one.add_argument("--partition", action="append", default=[], metavar="NAME=VALUE", help="only partitions of this hidden value, such as _days_ts=2024-01-02")
    one = job("maintain", "Rewrite data files and manifests, expire snapshots.", stream=False)
    one.add_argument("--sort-by", nargs="*", default=[])
    one.add_argument("--closed-hours", metavar="COLUMN", help="rewrite only the partitions of hours(COLUMN) that closed in the last two hours")
    one.add_argument("--small", type=float, metavar="SHARE", help="rewrite only files smaller than this share of the target size")
    one.add_argument("--target-bytes", type=int, default=TARGET_BYTES)
    one.add_argument("--expire-days", type=float, help="drop snapshots older than this")
    one = job("console", "Print decoded messages.", table=False)
    decoding(one)
    return top


def _job(a: argparse.Namespace) -> Job:
    options = dict(o.split("=", 1) for o in a.option)
    return Job(a.log, getattr(a, "table", ""), a.checkpoint, a.name, a.bootstrap, a.topic, a.every, a.max_files, a.starting, options)


def _decoding(spark: SparkSession, a: argparse.Namespace) -> dict:
    found: dict = {"form": a.form, "framed": a.framed}
    if a.registry:
        found["registry"] = Registry.load(spark, a.registry)
    if a.writer_schema:
        found["single_object"] = [codecs.read_bytes(p).decode() for p in a.writer_schema]
    if a.descriptors or a.descriptors_hex:
        found["descriptors"] = codecs.descriptor_bytes(a.descriptors, a.descriptors_hex)
    if a.schema:
        found["fields"] = codecs.avro_fields(codecs.read_bytes(a.schema).decode())
    return found


def _condition(a: argparse.Namespace) -> Predicate | None:
    """The target rows that a merge matches with."""
    found = []
    if a.recent_hours is not None:
        found.append(col("start_date") > datetime.now(timezone.utc) - timedelta(hours=a.recent_hours))
    if a.team is not None:
        found.append(col("team") == a.team)
    return reduce(and_, found) if found else None


def _hot(a: argparse.Namespace):
    """Partitions that hold rows which `_condition` lets through."""
    condition = _condition(a)
    return condition.partitions(a.spec or EMPLOYEE_SPEC) if condition else lambda values: True


def _properties(a: argparse.Namespace) -> dict[str, str]:
    return dict(p.split("=", 1) for p in a.property)


def _table(a: argparse.Namespace) -> dict:
    """What a job's table is created with, unless it exists."""
    return ({"spec": a.spec} if a.spec else {}) | {"properties": _properties(a)}


def _maintained(a: argparse.Namespace, query: StreamingQuery, table: SnapshotTable) -> None:
    """Waits for a query; beside it, its table is kept in order if that was asked for."""
    if a.maintain_every is None:
        query.awaitTermination()
        return

    def task() -> None:
        where = closed_hours(a.maintain_hours, datetime.now(timezone.utc)) if a.maintain_hours else lambda values: True
        rewrite_data_files(table, a.maintain_sort_by, where)
        table.rewrite_manifests()

    schedule = beside(query, task, a.maintain_first, a.maintain_every)
    try:
        query.awaitTermination()
    finally:
        schedule.stop()
    print("maintenance runs", schedule.runs, "failures", schedule.failures)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.namespace:
        folder = namespace(spark, *a.namespace.rsplit(":", 1))
        for option in ("table", "changelog"):
            if getattr(a, option, None):
                setattr(a, option, f"{folder}/{getattr(a, option)}")
    if a.job == "ingest-watermark":
        query = ingest_watermark(spark, _job(a), dedup=not a.no_dedup, table=_table(a), **_decoding(spark, a))
        _maintained(a, query, SnapshotTable(spark, a.table))
    elif a.job == "ingest-merge":
        merging = {"dedup": not a.no_dedup, "compaction": a.compaction, "target_filter": lambda: _condition(a)}
        query = ingest_merge(spark, _job(a), merging=merging, table=_table(a), **_decoding(spark, a))
        _maintained(a, query, SnapshotTable(spark, a.table))
    elif a.job == "ingest-changelog":
        query = ingest_changelog(spark, _job(a), table=_table(a))
        _maintained(a, query, SnapshotTable(spark, a.table))
    elif a.job == "console":
        rows = decode(_job(a).messages(spark), **_decoding(spark, a))
        rows.printSchema()
        console(rows, name=a.name, checkpoint=a.checkpoint, every=a.every).awaitTermination()
    elif a.job == "mirror":
        changelog, properties = SnapshotTable(spark, a.changelog), {"merge.key": "account_id"} | _properties(a)
        schema = ORDERED_MIRROR if a.ordered else MIRROR
        mirror = SnapshotTable.create(spark, a.table, schema, a.spec or MIRROR_SPEC, properties)
        if a.since_days is not None:
            since = col("last_updated") > datetime.now(timezone.utc) - timedelta(days=a.since_days)
            rows = changelog.scan(where=since.partitions(changelog.load()[1].spec))
            print("snapshot", mirror_changes(rows, mirror, since.column(), mode=a.mode, ordered=a.ordered))
        else:
            print("snapshot", incremental_mirror(changelog, mirror, mode=a.mode, ordered=a.ordered))
    elif a.job == "dedup":
        table = SnapshotTable(spark, a.table)
        order = F.struct(*[F.col(c) for c in a.order_by or table.schema.names])
        day = lambda c: int(datetime.fromisoformat(c).replace(tzinfo=timezone.utc).timestamp() // 86_400)
        parts = dict(p.split("=", 1) for p in a.partition)
        wanted = {n: str(day(v)) if n.startswith("_days_") and "-" in v[1:] else v for n, v in parts.items()}
        print("snapshot", dedup_partitions(table, [F.col(k) for k in a.keys], order, lambda values: all(unquote(values.get(n, "")) == v for n, v in wanted.items())))
    else:
        table = SnapshotTable(spark, a.table)
        where = closed_hours(a.closed_hours, datetime.now(timezone.utc)) if a.closed_hours else lambda values: True
        rewrite_data_files(table, a.sort_by, where, target_bytes=a.target_bytes, small=a.small).show()
        table.rewrite_manifests().show()
        if a.expire_days is not None:
            table.expire_snapshots(time.time() - a.expire_days * 86_400).show()


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    run(session(Settings(master=a.master, concurrent_writers=a.concurrent_writers)), a)


if __name__ == "__main__":
    main()
