"""Codecs by file, the choice of connectors, and jobs from the command line."""

import json
import types
from datetime import datetime, timedelta, timezone

import pytest
from google.protobuf import descriptor_pb2
from pyspark.sql import functions as F

from sluice import __main__ as cli
from sluice.functions import codecs
from sluice.plans.queries import proto_value
from sluice.schemas import EMPLOYEE
from sluice.session import Settings, session
from sluice.sources import log
from sluice.sources.log import append_messages
from sluice.sources.snapshot_table import SnapshotTable
from sluice.streaming.jobs import start

T0 = datetime(2024, 1, 1)


def employee(k, at=T0, team="a"):
    return (k, 30, at, team, "DEVELOPER", "1 Quay", f"n{k}")


def order_descriptors():
    """A message with what the employee has not: repeated and map fields, bytes, optional scalars, unsigned numbers, a nested message."""
    kind = descriptor_pb2.FieldDescriptorProto
    files = descriptor_pb2.FileDescriptorSet()
    f = files.file.add(name="order.proto", package="shop", syntax="proto3")
    line = f.message_type.add(name="Line")
    line.field.add(name="sku", number=1, type=kind.TYPE_STRING, label=kind.LABEL_OPTIONAL)
    line.field.add(name="n", number=2, type=kind.TYPE_UINT32, label=kind.LABEL_OPTIONAL)
    order = f.message_type.add(name="Order")
    entry = order.nested_type.add(name="TagsEntry")
    entry.options.map_entry = True
    entry.field.add(name="key", number=1, type=kind.TYPE_STRING, label=kind.LABEL_OPTIONAL)
    entry.field.add(name="value", number=2, type=kind.TYPE_INT64, label=kind.LABEL_OPTIONAL)
    order.field.add(name="lines", number=1, type=kind.TYPE_MESSAGE, type_name=".shop.Line", label=kind.LABEL_REPEATED)
    order.field.add(name="tags", number=2, type=kind.TYPE_MESSAGE, type_name=".shop.Order.TagsEntry", label=kind.LABEL_REPEATED)
    order.field.add(name="raw", number=3, type=kind.TYPE_BYTES, label=kind.LABEL_OPTIONAL)
    order.field.add(name="paid", number=4, type=kind.TYPE_DOUBLE, label=kind.LABEL_OPTIONAL, proto3_optional=True, oneof_index=0)
    order.oneof_decl.add(name="_paid")
    return files.SerializeToString()


def test_any_protobuf_message(spark, tmp_path):
    (tmp_path / "order.desc").write_bytes(order_descriptors())
    descriptors = codecs.descriptor_bytes(path=str(tmp_path / "order.desc"))
    assert descriptors == order_descriptors() == codecs.descriptor_bytes(hexadecimal=descriptors.hex())
    made = codecs.message_class(descriptors, "shop.Order")
    full = made(raw=b"\x00\xff", paid=2.5, tags={"x": 2**40})
    full.lines.add(sku="s", n=2**32 - 1)
    values = spark.createDataFrame([(full.SerializeToString(),), (made().SerializeToString(),), (None,), (b"\x0a\xff",)], "value binary")
    got = [r.o for r in values.select(codecs.from_protobuf(F.col("value"), descriptors, "Order", "PERMISSIVE").alias("o")).collect()]
    assert [tuple(x) for x in got[0].lines] == [("s", 2**32 - 1)] and got[0].tags == {"x": 2**40} and bytes(got[0].raw) == b"\x00\xff" and got[0].paid == 2.5
    assert (got[1].lines, got[1].tags, bytes(got[1].raw), got[1].paid) == ([], {}, b"", None)
    assert all(x is None or all(v is None for v in x) for x in got[2:])


def test_employee_messages_keep_late_dates_and_unknown_roles(spark):
    rows = spark.createDataFrame([(1, None, datetime(9999, 1, 1), "a", "7", "", "x")], EMPLOYEE)
    back = rows.select(proto_value().alias("value")).select(codecs.from_protobuf(F.col("value"), codecs.employee_descriptor_set()).alias("e"))
    assert back.select("e.role", F.year("e.start_date")).first() == ("7", 9999)
    with pytest.raises(Exception, match="CHEF"):
        rows.withColumn("role", F.lit("CHEF")).select(proto_value()).collect()


def test_avro_schema_by_file(spark, tmp_path):
    schema = {"type": "record", "name": "R", "fields": [{"name": "a", "type": ["null", "string"]}, {"name": "b", "type": "double"}, {"name": "c", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "d", "type": "boolean"}, {"name": "e", "type": "bytes"}]}
    (tmp_path / "r.avsc").write_text(json.dumps(schema))
    fields = codecs.avro_fields(codecs.read_bytes(str(tmp_path / "r.avsc")).decode())
    assert fields == [("a", "string?"), ("b", "double"), ("c", "long"), ("d", "boolean"), ("e", "bytes")]
    records = [("x", 1.5, 2**50, True, b"\x01"), (None, -0.5, -1, False, b"")]
    frame = spark.createDataFrame([(codecs.avro_encode_record(r, fields),) for r in records], "value binary")
    got = frame.select(codecs.from_avro(F.col("value"), fields, "FAILFAST").alias("r")).select("r.*").collect()
    assert [(*r[:4], bytes(r.e)) for r in got] == records
    assert codecs.avro_fields(codecs.avro_schema(fields)) == fields
    with pytest.raises(ValueError, match="not supported"):
        codecs.avro_fields(json.dumps({"fields": [{"name": "m", "type": "map"}]}))


def test_connectors_are_used_where_present(spark, monkeypatch):
    assert codecs.connector("avro") is None and codecs.connector("protobuf") is None  # no jars here
    seen = []
    stand_in = types.SimpleNamespace(
        from_avro=lambda value, schema, options: seen.append((json.loads(schema)["type"], options)) or value,
        from_protobuf=lambda value, message, options, binaryDescriptorSet: seen.append((message, options, binaryDescriptorSet)) or value,
    )
    monkeypatch.setattr(codecs, "connector", lambda name: stand_in)
    bodies = spark.createDataFrame([(b"\xc3\x01" + bytes(8) + b"body",), (b"plain",)], "value binary")
    assert [bytes(r[0]) for r in bodies.select(codecs.from_avro(F.col("value"))).collect()] == [b"body", b"plain"]
    codecs.from_protobuf(F.col("value"), b"set", "M")
    assert seen == [("record", {"mode": "PERMISSIVE"}), ("M", {"mode": "FAILFAST", "emit.default.values": "true"}, b"set")]


def test_kafka_readers_get_their_options():
    class Reader:
        def __init__(self):
            self.seen = {}

        def format(self, name):
            self.seen["format"] = name
            return self

        def option(self, name, value):
            self.seen[name] = value
            return self

        def options(self, **more):
            self.seen |= more
            return self

        def load(self):
            return self.seen

    fake = types.SimpleNamespace(readStream=Reader(), read=Reader())
    job = cli._job(cli.parser().parse_args(["console", "--bootstrap", "h:1", "--topic", "t", "--starting", "earliest", "--checkpoint", "c", "--option", "maxOffsetsPerTrigger=5"]))
    seen = job.messages(fake)
    assert seen == {"format": "kafka", "kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "5"}
    assert log.read_batch(fake, bootstrap="h:1", topic="t", endingOffsets="{}")["endingOffsets"] == "{}"


def test_jobs_from_the_command_line(spark, tmp_path, capsys):
    run = lambda *words: cli.run(spark, cli.parser().parse_args([str(w) for w in words]))
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    rows = spark.createDataFrame([employee(k, at, team) for k in (1, 2) for at in (now, now - timedelta(hours=9)) for team in ("a", "b")], EMPLOYEE)
    for i in range(2):
        append_messages(rows, str(tmp_path / "log"), topic="e", value=proto_value(), first_offset=i << 50)
        stream = ["--log", tmp_path / "log", "--table", tmp_path / "t", "--checkpoint", tmp_path / "c"]
        run("ingest-merge", *stream, "--recent-hours", 1, "--team", "a", "--compaction")
    table = SnapshotTable(spark, str(tmp_path / "t"))
    # all eight, then again but for what the window and the team know: keys are id and date, so team b's recent rows are known as well
    assert table.scan().count() == 8 + 4
    run("maintain", "--table", tmp_path / "t", "--sort-by", "start_date", "--expire-days", 0)
    assert table.scan().count() == 12 and table.snapshots().count() == 1
    lines = spark.createDataFrame([("I,1,10,1704067200123",), ("U,1,11,1704067200124",)], "v string")
    append_messages(lines, str(tmp_path / "changes"), topic="c", value=F.col("v"))
    bank = ["--namespace", f"{tmp_path}/lake:bank.accounts"]
    run(*bank, "ingest-changelog", "--log", tmp_path / "changes", "--table", "changelog", "--checkpoint", tmp_path / "c2")
    run(*bank, "mirror", "--changelog", "changelog", "--table", "mirror", "--mode", "merge-on-read")
    assert SnapshotTable(spark, str(tmp_path / "lake/bank/accounts/mirror")).scan().select("account_id", "balance").collect() == [(1, 11.0)]
    run("ingest-watermark", "--log", tmp_path / "log", "--table", tmp_path / "w", "--checkpoint", tmp_path / "c3", "--no-dedup")
    assert SnapshotTable(spark, str(tmp_path / "w")).scan().count() == 16
    run("console", "--log", tmp_path / "log", "--checkpoint", tmp_path / "c4")
    assert "|-- employee_id: long" in capsys.readouterr().out


def test_a_merge_job_reads_the_hot_partitions_of_its_team():
    a = cli.parser().parse_args(["ingest-merge", "--log", "l", "--table", "t", "--checkpoint", "c", "--recent-hours", "2", "--team", "a:b"])
    hour = int(datetime.now(timezone.utc).timestamp() // 3600)
    values = [{"_hours_start_date": str(h), "_identity_team": team} for h in (hour, hour - 2, hour - 3) for team in ("a%3Ab", "c")]
    assert [cli._hot(a)(v) for v in values] == [True, False, True, False, False, False]
    assert cli._hot(a)({"_hours_start_date": "__HIVE_DEFAULT_PARTITION__"})


def test_formats_of_data_files(spark, tmp_path):
    for form in ("orc", "json"):
        t = SnapshotTable.create(spark, str(tmp_path / form), "k long, v string", ["bucket(2, k)"], {"write.format.default": form, "write.compression-codec": "none" if form == "json" else "zlib"})
        t.append(spark.createDataFrame([(1, "a"), (2, None)], "k long, v string"))
        assert sorted(tuple(r) for r in t.scan().collect()) == [(1, "a"), (2, None)]
        assert list((tmp_path / form).rglob(f"*.{form}"))
    t = SnapshotTable.create(spark, str(tmp_path / "sized"), "k long", [], {"write.max-records-per-file": "10"})
    t.append(spark.range(45).coalesce(1).toDF("k"))
    assert len(list((tmp_path / "sized" / "data").rglob("*.parquet"))) == 5


def test_sql_over_the_view_of_a_micro_batch(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    seen = []

    def handle(rows, batch_id):
        rows.createOrReplaceTempView("micro_batch")
        seen.append(rows.sparkSession.sql("SELECT sum(id) AS s FROM micro_batch").first().s)

    start(stream, handle, name="view", checkpoint=str(tmp_path / "c")).awaitTermination()
    assert seen == [10]


def test_a_processing_time_trigger_takes_what_comes(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream, seen = spark.readStream.schema("id long").parquet(str(tmp_path / "in")), []
    query = start(stream, lambda rows, batch_id: seen.append((batch_id, rows.count())), name="timed", checkpoint=str(tmp_path / "c"), every="1 second")
    try:
        query.processAllAvailable()
        spark.range(4).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert [n for _, n in seen] == [3, 4]


def test_partitions_are_written_without_a_sort_by_concurrent_writers(spark, tmp_path):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    assert session(Settings(rocksdb_state=False, concurrent_writers=8)).conf.get(name) == "8"
    try:
        t = SnapshotTable.create(spark, str(tmp_path / "t"), "k long", ["bucket(4, k)"])
        t.append(spark.range(100).toDF("k"))
        assert t.scan().count() == 100 and len(t.parts()) == 4
    finally:
        spark.conf.unset(name)
