"""The registered queries of the library and their DuckDB SQL.

`events` stands for the employee stream (user_id, ts, event_type as employee, start date and team) and for account changes
(signup inserts, error deletes, others update); `customer` seeds the mirror. Each query runs over its whole tables; time
windows are the feature of the queries that have one, and take a fixed `AS_OF` instead of the clock.
"""

from __future__ import annotations

import json
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.registry import Registry, frame, from_registry_avro
from ..functions.transforms import bucket, days, hours
from ..operators.dedup import affected_partitions
from ..operators.maintenance import rewrite_data_files
from ..operators.merge import insert_only, latest_change, mirror_merge
from ..operators.predicates import col
from ..schemas import CHANGELOG, CHANGELOG_SPEC, MIRROR, MIRROR_SPEC, ORDERED_MIRROR
from ..sources.log import append_messages, read_batch, read_stream
from ..sources.snapshot_table import SnapshotTable
from ..streaming.jobs import append_stream, merge_ingest, watermark_ingest
from ..workspace import fresh_path, table
from .cdc import incremental_mirror, live, merge_into_mirror, mirror_changes, newest_first
from .ingest import Job, decode, dedup_partitions, employee_table, ingest_changelog

AS_OF = "2024-01-30 12:00:00"
#: Where the tables built from events are cut into three commits.
CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")
HOT_SINCE, HOT_TEAM = "2024-01-20 00:00:00", "click"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz").cast("timestamp")


def plain(column: str) -> Column:
    """A timestamp without zone, as DuckDB's TIMESTAMP."""
    return F.col(column).cast("timestamp_ntz").alias(column)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    operation = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    balance = F.floor(F.col("value") * 100).cast("bigint")
    return events(spark, sf_dir).select(operation.alias("operation"), F.col("user_id").alias("account_id"), balance.alias("balance"), F.col("ts").alias("last_updated"))


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_acctbal").cast("float").alias("balance"), at("2024-01-01 00:00:00").alias("last_updated"))


def since() -> Column:
    return F.col("last_updated") > at(AS_OF) - F.expr("INTERVAL 1 DAY")


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_change(changes(spark, sf_dir), "account_id", newest_first(), since())


def mirror_rows(rows: DataFrame) -> DataFrame:
    return rows.select("account_id", "balance", plain("last_updated"))


def event_rows(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", plain("ts"), "user_id", "event_type", "value", "props")


def slices(rows: DataFrame, column: str) -> list[DataFrame]:
    c, (a, b) = F.col(column), map(at, CUTS)
    return [rows.where(c < a), rows.where((c >= a) & (c < b)), rows.where(c >= b)]


def event_table(spark: SparkSession, sf_dir: str, spec: list[str] = ("days(ts)",), properties: dict[str, str] | None = None) -> SnapshotTable:
    """events in three commits, numbered 1 to 3."""
    rows = events(spark, sf_dir)
    made = SnapshotTable.create(spark, fresh_path(spark, "events"), rows.schema, list(spec), properties)
    for part in slices(rows, "ts"):
        made.append(part)
    return made


def employees_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as employee rows; every tenth age is missing."""
    return events(spark, sf_dir).select(
        F.col("user_id").alias("employee_id"),
        F.when(F.col("event_id") % 10 != 0, (F.col("event_id") % 99).cast("int")).alias("age"),
        F.col("ts").alias("start_date"),
        F.col("event_type").alias("team"),
        F.lit("ARCHITECT").alias("role"),
        F.lit("12 Harbour Road").alias("address"),
        F.concat(F.lit("Person "), (F.col("user_id") % 100).cast("string")).alias("name"),
    )


def employee_rows(rows: DataFrame) -> DataFrame:
    return rows.select("employee_id", "age", plain("start_date"), "team", "role", "address", "name")


def proto_value() -> Column:
    return codecs.to_protobuf(*[F.col(c) for c in ("employee_id", "name", "address", "age", "start_date", "team", "role")])


def cdc_latest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).select("account_id", "balance", "operation", plain("last_updated"))


def cdc_mirror_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror_rows(mirror_merge(seed(spark, sf_dir), latest(spark, sf_dir)))


def _mirror(spark: SparkSession, sf_dir: str) -> SnapshotTable:
    made = SnapshotTable.create(spark, fresh_path(spark, "mirror"), MIRROR, MIRROR_SPEC, {"merge.key": "account_id"})
    made.append(seed(spark, sf_dir))
    return made


def cow_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    mirror = _mirror(spark, sf_dir)
    merge_into_mirror(mirror, latest(spark, sf_dir))
    return mirror_rows(mirror.scan())


def mor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    mirror = _mirror(spark, sf_dir)
    merge_into_mirror(mirror, latest(spark, sf_dir), mode="merge-on-read")
    return mirror_rows(mirror.scan())


def incremental_mirror_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mirror = _mirror(spark, sf_dir)
    log = SnapshotTable.create(spark, fresh_path(spark, "changelog"), CHANGELOG, CHANGELOG_SPEC)
    for part in slices(changes(spark, sf_dir), "last_updated"):
        log.append(part)
        incremental_mirror(log, mirror)
    return mirror_rows(mirror.scan())


def cdc_parse_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = codecs.format_change(F.col("operation"), F.col("account_id"), F.col("balance"), F.unix_millis("last_updated"))
    parsed = changes(spark, sf_dir).select(line.alias("value")).select(*codecs.parse_change(F.col("value")))
    return parsed.select("operation", "account_id", "balance", plain("last_updated"))


def merge_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target holds all events; a replay of all of them inserts those that the moving window doesn't know."""
    target = events(spark, sf_dir)
    recent = (F.col("ts") > at(HOT_SINCE)) & (F.col("event_type") == HOT_TEAM)
    return event_rows(target.unionByName(insert_only(target, target, ["user_id", "ts"], recent)))


def affected_partitions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = affected_partitions(events(spark, sf_dir), "user_id", "ts", "event_type")
    return found.select("user_id", plain("day"), plain("hour"), "event_type")


def partition_overwrite_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event a user and hour, the first, in the partition of one day; the other days stay."""
    made = event_table(spark, sf_dir)
    day = str((datetime(2024, 1, 2) - datetime(1970, 1, 1)).days)
    keys = [F.col("user_id").alias("_user"), F.date_trunc("hour", "ts").alias("_hour")]
    dedup_partitions(made, keys, F.col("event_id"), lambda values: values["_days_ts"] == day)
    return event_rows(made.scan())


def dynamic_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day's rows overwrite that day's partition; the rows are the purchases."""
    made = event_table(spark, sf_dir)
    ts = F.col("ts")
    made.overwrite_partitions(events(spark, sf_dir).where((ts >= at("2024-01-02 00:00:00")) & (ts < at("2024-01-03 00:00:00")) & (F.col("event_type") == "purchase")))
    return event_rows(made.scan())


def compaction_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = at("2024-01-30 00:00:00")
    return events(spark, sf_dir).where(F.col("ts").between(end - F.expr("INTERVAL 2 HOURS"), end - F.expr("INTERVAL 1 HOUR"))).select("event_id", plain("ts"))


def hot_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("ts") >= at(AS_OF) - F.expr("INTERVAL 1 HOUR")).select("event_id", plain("ts"))


def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second commit, read as the snapshots after 1 up to the one of a later compaction, which adds no rows."""
    made = event_table(spark, sf_dir)
    stop = 2
    made.rollback(stop)
    rewrite_data_files(made, ["ts"], min_parts=1)
    return event_rows(made.incremental(1, made.current_snapshot_id()))


def rewrite_data_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = event_table(spark, sf_dir, ["bucket(8, user_id)"])
    rewrite_data_files(made, ["ts"])
    return event_rows(made.scan())


def rewrite_manifests_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = event_table(spark, sf_dir)
    made.rewrite_manifests()
    return event_rows(made.scan())


def expire_snapshots_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = event_table(spark, sf_dir, ["bucket(8, user_id)"])
    rewrite_data_files(made, ["ts"])
    made.expire_snapshots(older_than=float("inf"))
    return event_rows(made.scan())


def rollback_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = event_table(spark, sf_dir)
    made.rollback(2)
    return event_rows(made.scan())


def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = event_table(spark, sf_dir, ["bucket(8, user_id)"])
    rewrite_data_files(made, ["ts"], max_commits=1)
    return made.snapshots().select("snapshot_id", "parent_id", "operation")


def bulk_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem in one commit, hash-distributed to its buckets, below hashed paths."""
    rows = table(spark, sf_dir, "lineitem")
    props = {"write.distribution-mode": "hash", "write.object-storage.enabled": "true", "write.parquet.compression-level": "7"}
    made = SnapshotTable.create(spark, fresh_path(spark, "lineitem"), rows.schema, ["bucket(8, l_orderkey)"], props)
    made.append(rows, positional=True)
    return made.scan().withColumn("l_shipdate", plain("l_shipdate"))


def _log(spark: SparkSession, rows: DataFrame, value: Column, topic: str, times: int = 1) -> str:
    path = fresh_path(spark, "log")
    for i in range(times):
        append_messages(rows, path, topic=topic, value=value, first_offset=i << 50)
    return path


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice, as a Protobuf message."""
    path = _log(spark, employees_of(spark, sf_dir), proto_value(), "employees", times=2)
    made = employee_table(spark, fresh_path(spark, "employee"), spec=["bucket(8, employee_id)"])
    watermark_ingest(decode(read_stream(spark, path), "protobuf"), made, name="watermark-ingest", checkpoint=fresh_path(spark, "checkpoint")).awaitTermination()
    return employee_rows(made.scan())


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events arrive, then all again; the merge suppresses the recent ones of one team. Batch 0 compacts."""
    path, checkpoint = fresh_path(spark, "log"), fresh_path(spark, "checkpoint")
    made = employee_table(spark, fresh_path(spark, "employee"), spec=["bucket(8, employee_id)"])
    recent = (F.col("start_date") > at(HOT_SINCE)) & (F.col("team") == HOT_TEAM)
    for i in range(2):
        append_messages(employees_of(spark, sf_dir), path, topic="employees", value=proto_value(), first_offset=i << 50)
        rows = decode(read_stream(spark, path), "protobuf")
        merge_ingest(rows, made, name="merge-ingest", checkpoint=checkpoint, target_filter=lambda: recent, compaction=True).awaitTermination()
    return employee_rows(made.scan())


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited changes to the changelog table, with a restart between two halves of the log."""
    path, checkpoint, made = (fresh_path(spark, n) for n in ("log", "checkpoint", "changelog"))
    line = codecs.format_change(F.col("operation"), F.col("account_id"), F.col("balance"), F.unix_millis("last_updated"))
    for i, part in enumerate(slices(changes(spark, sf_dir), "last_updated")):
        append_messages(part, path, topic="changes", value=line, first_offset=i << 50)
        ingest_changelog(spark, Job(path, made, checkpoint, "changelog")).awaitTermination()
    return SnapshotTable(spark, made).scan().select("operation", "account_id", "balance", plain("last_updated"))


def log_batch_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    path = _log(spark, rows, F.to_json(F.struct("event_id", "event_type")), "events")
    value = F.from_json(F.col("value").cast("string"), "event_id bigint, event_type string").alias("v")
    return read_batch(spark, path, topic="events", start=0).select(value).select("v.*")


def proto_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employee_rows(decode(employees_of(spark, sf_dir).select(proto_value().alias("value")), "protobuf"))


def proto_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    descriptors = codecs.descriptor_bytes(hexadecimal=codecs.employee_descriptor_set().hex())
    framed = codecs.add_registry(proto_value(), bytes(range(16)))
    return employee_rows(decode(employees_of(spark, sf_dir).select(framed.alias("value")), "protobuf", framed=True, descriptors=descriptors, mode="FAILFAST"))


def proto_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    codecs.register_name_udf(spark, codecs.employee_descriptor_set())
    employees_of(spark, sf_dir).select("employee_id", proto_value().alias("value")).createOrReplaceTempView("sluice_messages")
    return spark.sql("SELECT employee_id, proto(value) AS name FROM sluice_messages")


def proto_udf_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same function in SQL over a view of a stream, whose rows are appended to a table."""
    codecs.register_name_udf(spark, codecs.employee_descriptor_set())
    path = _log(spark, employees_of(spark, sf_dir), proto_value(), "employees")
    read_stream(spark, path, topic="employees").createOrReplaceTempView("sluice_message_stream")
    names = spark.sql("SELECT partition, proto(value) AS name FROM sluice_message_stream")
    made = SnapshotTable.create(spark, fresh_path(spark, "names"), names.schema)
    append_stream(names, made, name="proto-udf", checkpoint=fresh_path(spark, "checkpoint")).awaitTermination()
    return made.scan().select("name")


def avro_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = employees_of(spark, sf_dir).withColumn("age", F.coalesce("age", F.lit(0)))
    fields = [F.col("employee_id"), F.col("age"), F.unix_millis("start_date"), F.col("team"), F.col("role"), F.col("address"), F.col("name")]
    raw = rows.select(codecs.to_avro(fields).alias("value"))
    single = rows.select(codecs.to_avro(fields, fingerprint=codecs.fingerprint_of('"employee"')).alias("value"))
    return employee_rows(decode(raw.unionByName(single), "avro"))


def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", codecs.parse_json(F.col("props"), "k int")["k"].alias("k"))


def json_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("user_id").cast("int").alias("employeeId"), F.lit("Person").alias("name"))).cast("binary")
    return decode(events(spark, sf_dir).select(codecs.add_registry(body, bytes(range(16))).alias("value")), "json", framed=True)


#: Two versions of the employee's Avro schema: the first knew no role and had short ids; the second is what is read.
EMPLOYEE_VERSIONS = {
    bytes(range(16)): [("employee_id", "int"), ("age", "int"), ("start_date", "long"), ("team", "string"), ("address", "string"), ("name", "string")],
    bytes(range(1, 17)): [("employee_id", "long"), ("age", "int"), ("start_date", "long"), ("team", "string"), ("role", "string"), ("address", "string"), ("name", "string")],
}


def _employee_schema(fields: list[tuple[str, str]]) -> str:
    kinds = [{"name": n, "type": k} | ({"default": "ARCHITECT"} if n == "role" else {}) for n, k in fields]
    return json.dumps({"type": "record", "name": "Employee", "fields": kinds})


def avro_registry_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic, two writers: clicks come in the first version of the schema, packed, all else in the second; one reader schema has both."""
    rows = employees_of(spark, sf_dir).withColumn("age", F.coalesce("age", F.lit(0))).withColumn("start_date", F.unix_millis("start_date"))
    path, registry = fresh_path(spark, "log"), Registry({i: _employee_schema(fields) for i, fields in EMPLOYEE_VERSIONS.items()})
    for n, (version, fields) in enumerate(EMPLOYEE_VERSIONS.items()):
        part = rows.where((F.col("team") == HOT_TEAM) == F.lit(n == 0))
        value = frame(codecs.to_avro([F.col(c) for c, _ in fields], fields), version, compress=n == 0)
        append_messages(part, path, topic="employees", value=value, first_offset=n << 50)
    reader = registry.versions[bytes(range(1, 17))]
    e = read_batch(spark, path).select(from_registry_avro(F.col("value"), registry, reader, "FAILFAST").alias("e")).select("e.*")
    return employee_rows(e.withColumn("start_date", F.timestamp_millis("start_date")))


def cdc_ordered_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes arrive in three slices by hash, so most come late; the ordered mirror is as if they had come in order."""
    mirror = SnapshotTable.create(spark, fresh_path(spark, "mirror"), ORDERED_MIRROR, MIRROR_SPEC, {"merge.key": "account_id"})
    rows = changes(spark, sf_dir)
    for i in (2, 0, 1):
        part = rows.where(F.pmod(F.xxhash64("account_id", "last_updated"), F.lit(3)) == i)
        mirror_changes(part, mirror, mode="merge-on-read" if i else "copy-on-write", ordered=True)
    return mirror_rows(live(mirror.scan()))


def predicate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One predicate chooses both the partitions of hours, type and bucket that are read and the rows in them."""
    made = event_table(spark, sf_dir, ["hours(ts)", "identity(event_type)", "bucket(8, user_id)"])
    ts = col("ts")
    wanted = (ts.between(datetime(2024, 1, 5, 6, 30), datetime(2024, 1, 9, 18)) & (col("event_type").isin("click", "error"))) | (col("user_id") == 7)
    return event_rows(made.scan(where=wanted.partitions(made.load()[1].spec)).where(wanted.column()))


def stream_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs go to one table by jobs of one name with a checkpoint each; neither takes the other's batches for its own."""
    made = employee_table(spark, fresh_path(spark, "employee"), spec=["bucket(8, employee_id)"])
    for half in (0, 1):
        path = _log(spark, employees_of(spark, sf_dir).where(F.col("employee_id") % 2 == half), proto_value(), "employees")
        append_stream(decode(read_stream(spark, path), "protobuf"), made, name="ingest", checkpoint=fresh_path(spark, "checkpoint")).awaitTermination()
    return employee_rows(made.scan())


def orders_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_change(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey", "o_orderstatus", plain("o_orderdate"))


def partition_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", bucket(8, F.col("user_id")).alias("user_bucket"), hours(F.col("ts")).alias("ts_hours"), days(F.col("ts")).alias("ts_days"))


QUERIES = {
    "cdc_latest_change": cdc_latest_change,
    "cdc_mirror_merge": cdc_mirror_merge,
    "cow_merge": cow_merge,
    "mor_merge": mor_merge,
    "incremental_mirror": incremental_mirror_query,
    "cdc_parse_csv": cdc_parse_csv,
    "merge_insert_only": merge_insert_only,
    "affected_partitions": affected_partitions_query,
    "partition_overwrite_dedup": partition_overwrite_dedup,
    "dynamic_overwrite": dynamic_overwrite,
    "compaction_window": compaction_window,
    "hot_window": hot_window,
    "incremental_append": incremental_append,
    "rewrite_data_files": rewrite_data_files_query,
    "rewrite_manifests": rewrite_manifests_query,
    "expire_snapshots": expire_snapshots_query,
    "rollback": rollback_query,
    "snapshot_history": snapshot_history,
    "bulk_append": bulk_append,
    "stream_dedup": stream_dedup,
    "stream_merge": stream_merge,
    "stream_append": stream_append,
    "log_batch_scan": log_batch_scan,
    "proto_flatten": proto_flatten,
    "proto_hex": proto_hex,
    "proto_udf": proto_udf,
    "avro_flatten": avro_flatten,
    "json_decode": json_decode,
    "json_registry": json_registry,
    "orders_latest_status": orders_latest_status,
    "partition_transforms": partition_transforms,
    "proto_udf_stream": proto_udf_stream,
    "avro_registry_versions": avro_registry_versions,
    "cdc_ordered_mirror": cdc_ordered_mirror,
    "predicate_scan": predicate_scan,
    "stream_two_sources": stream_two_sources,
}


def bucket_sql(n: int, value: str) -> str:
    """The bucket transform in DuckDB's integer SQL, for a select list: one nested select for each step."""
    word = 4294967295
    times = lambda a, b: f"((({a} & 65535) * {b} + (((({a} >> 16) * {b}) & 65535) << 16)) & {word})"
    turn = lambda a, r: f"((({a} << {r}) & {word}) | ({a} >> {32 - r}))"
    steps, h = [], "0"
    for name, part in (("a", f"CAST({value} AS BIGINT) & {word}"), ("b", f"(CAST({value} AS BIGINT) >> 32) & {word}")):
        steps += [(f"{name}0", part), (f"{name}1", times(f"{name}0", 3432918353)), (f"{name}2", turn(f"{name}1", 15)), (f"{name}3", f"xor({times(f'{name}2', 461845907)}, {h})")]
        steps += [(f"{name}4", f"({turn(f'{name}3', 13)} * 5 + 3864292196) & {word}")]
        h = f"{name}4"
    steps += [("c0", f"xor({h}, 8)"), ("c1", "xor(c0, c0 >> 16)"), ("c2", times("c1", 2246822507)), ("c3", "xor(c2, c2 >> 13)"), ("c4", times("c3", 3266489909)), ("c5", "xor(c4, c4 >> 16)")]
    inner = "SELECT * FROM events"
    inner = reduce(lambda q, step: f"SELECT *, {step[1]} AS {step[0]} FROM ({q})", steps, inner)
    return f"SELECT event_id, CAST((c5 & 2147483647) % {n} AS INTEGER) AS user_bucket, ts FROM ({inner})"


_CHANGES = """changes AS (SELECT CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS operation,
    user_id AS account_id, CAST(floor(value * 100) AS BIGINT) AS balance, ts AS last_updated FROM events)"""
_RANKED = "row_number() OVER (PARTITION BY account_id ORDER BY last_updated DESC NULLS LAST, balance DESC NULLS LAST, operation DESC NULLS LAST) AS row_num"


def _latest_sql(where: str) -> str:
    return f"latest AS (SELECT * FROM (SELECT *, {_RANKED} FROM changes WHERE {where}) WHERE row_num = 1)"


def _mirror_sql(where: str) -> str:
    return f"""WITH {_CHANGES}, {_latest_sql(where)},
        mirror AS (SELECT c_custkey AS account_id, CAST(c_acctbal AS FLOAT) AS balance, TIMESTAMP '2024-01-01 00:00:00' AS last_updated FROM customer)
        SELECT coalesce(a.account_id, c.account_id) AS account_id,
               CASE WHEN c.account_id IS NOT NULL THEN CAST(c.balance AS FLOAT) ELSE a.balance END AS balance,
               CASE WHEN c.account_id IS NOT NULL THEN c.last_updated ELSE a.last_updated END AS last_updated
        FROM mirror a FULL OUTER JOIN latest c ON a.account_id = c.account_id
        WHERE c.account_id IS NULL OR (a.account_id IS NOT NULL AND coalesce(c.operation, '') <> 'D')
           OR (a.account_id IS NULL AND c.operation <> 'D')"""


_SINCE = f"last_updated > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY"
_EVENTS = "SELECT event_id, ts, user_id, event_type, value, props FROM events"
_EMPLOYEES = """SELECT user_id AS employee_id, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 99 AS INTEGER) END AS age, ts AS start_date,
    event_type AS team, 'ARCHITECT' AS role, '12 Harbour Road' AS address, 'Person ' || CAST(user_id % 100 AS VARCHAR) AS name FROM events"""
_NOT_KNOWN = f"""NOT EXISTS (SELECT 1 FROM events t WHERE s.user_id = t.user_id AND s.ts = t.ts
    AND t.ts > TIMESTAMP '{HOT_SINCE}' AND t.event_type = '{HOT_TEAM}')"""
_AVRO = """SELECT user_id AS employee_id, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 99 AS INTEGER) ELSE 0 END AS age, date_trunc('milliseconds', ts) AS start_date,
    event_type AS team, 'ARCHITECT' AS role, '12 Harbour Road' AS address, 'Person ' || CAST(user_id % 100 AS VARCHAR) AS name FROM events"""

ORACLE_SQL = {
    "cdc_latest_change": f"WITH {_CHANGES}, {_latest_sql(_SINCE)} SELECT account_id, balance, operation, last_updated FROM latest",
    "cdc_mirror_merge": _mirror_sql(_SINCE),
    "cow_merge": _mirror_sql(_SINCE),
    "mor_merge": _mirror_sql(_SINCE),
    "incremental_mirror": _mirror_sql("true"),
    "cdc_parse_csv": f"""WITH {_CHANGES} SELECT operation, CAST(account_id AS INTEGER) AS account_id, CAST(balance AS INTEGER) AS balance,
        date_trunc('milliseconds', last_updated) AS last_updated FROM changes""",
    "merge_insert_only": f"{_EVENTS} UNION ALL SELECT event_id, ts, user_id, event_type, value, props FROM events s WHERE {_NOT_KNOWN}",
    "affected_partitions": "SELECT DISTINCT user_id, date_trunc('day', ts)::TIMESTAMP AS day, date_trunc('hour', ts) AS hour, event_type FROM events",
    "partition_overwrite_dedup": f"""{_EVENTS} WHERE CAST(ts AS DATE) <> DATE '2024-01-02'
        OR event_id IN (SELECT min(event_id) FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-02' GROUP BY user_id, date_trunc('hour', ts))""",
    "dynamic_overwrite": f"{_EVENTS} WHERE CAST(ts AS DATE) <> DATE '2024-01-02' OR event_type = 'purchase'",
    "compaction_window": """SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 2 HOUR
        AND TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 HOUR""",
    "hot_window": f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR",
    "incremental_append": f"{_EVENTS} WHERE ts >= TIMESTAMP '{CUTS[0]}' AND ts < TIMESTAMP '{CUTS[1]}'",
    "rewrite_data_files": _EVENTS,
    "rewrite_manifests": _EVENTS,
    "expire_snapshots": _EVENTS,
    "rollback": f"{_EVENTS} WHERE ts < TIMESTAMP '{CUTS[1]}'",
    "snapshot_history": """SELECT CAST(a AS BIGINT) AS snapshot_id, CAST(b AS BIGINT) AS parent_id, c AS operation
        FROM (VALUES (1, NULL, 'append'), (2, 1, 'append'), (3, 2, 'append'), (4, 3, 'replace')) v(a, b, c)""",
    "bulk_append": "SELECT * FROM lineitem",
    "stream_dedup": _EMPLOYEES,
    "stream_merge": f"{_EMPLOYEES} UNION ALL {_EMPLOYEES} s WHERE {_NOT_KNOWN}",
    "stream_append": f"WITH {_CHANGES} SELECT operation, account_id, balance, date_trunc('milliseconds', last_updated) AS last_updated FROM changes",
    "log_batch_scan": "SELECT event_id, event_type FROM events",
    "proto_flatten": _EMPLOYEES,
    "proto_hex": _EMPLOYEES,
    "proto_udf": "SELECT user_id AS employee_id, 'Person ' || CAST(user_id % 100 AS VARCHAR) AS name FROM events",
    "proto_udf_stream": "SELECT 'Person ' || CAST(user_id % 100 AS VARCHAR) AS name FROM events",
    "avro_flatten": f"{_AVRO} UNION ALL {_AVRO}",
    "json_decode": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "json_registry": "SELECT CAST(user_id AS INTEGER) AS \"employeeId\", 'Person' AS name FROM events",
    "orders_latest_status": """SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
    "avro_registry_versions": _AVRO,
    "cdc_ordered_mirror": f"""WITH {_CHANGES}, {_latest_sql("true")}
        SELECT account_id, balance, last_updated FROM latest WHERE coalesce(operation, '') <> 'D'""",
    "predicate_scan": f"""{_EVENTS} WHERE user_id = 7
        OR (ts BETWEEN TIMESTAMP '2024-01-05 06:30:00' AND TIMESTAMP '2024-01-09 18:00:00' AND event_type IN ('click', 'error'))""",
    "stream_two_sources": _EMPLOYEES,
    "partition_transforms": f"""SELECT event_id, user_bucket, CAST(epoch_us(ts) // 3600000000 AS INTEGER) AS ts_hours,
        CAST(epoch_us(ts) // 86400000000 AS INTEGER) AS ts_days FROM ({bucket_sql(8, "user_id")})""",
}
