"""Operators on planted edge rows."""

import json
import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions import codecs
from sluice.functions.transforms import bucket, murmur3_long, register
from sluice.operators.maintenance import HourlyMaintenance, closed_hours, millis_to_next_run, rewrite_data_files
from sluice.operators.merge import insert_only, latest_change, mirror_merge
from sluice.plans.cdc import incremental_mirror, merge_into_mirror, newest_first, watermark_of
from sluice.plans.ingest import dedup_partitions
from sluice.schemas import MIRROR, MIRROR_SPEC
from sluice.sources.generate import account_changes, employees, json_employees
from sluice.sources.snapshot_table import CommitConflict, SnapshotTable
from sluice.streaming.jobs import append_stream, console, merge_ingest, merge_new, watermark_ingest

T0 = datetime(2024, 1, 1)
CHANGE = "account_id long, operation string, balance long, last_updated timestamp"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def numbers(spark, path, spec=("bucket(4, k)",), **properties):
    return SnapshotTable.create(spark, str(path), "k long, v string", list(spec), properties)


def kv(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def test_bucket_vectors(spark):
    made = spark.range(1).select(murmur3_long(F.lit(34)).alias("h"), bucket(8, F.lit(34)).alias("b")).first()
    assert (made.h, made.b) == (2017239379, 3)
    register(spark)
    ids = spark.createDataFrame([(0,), (34,), (-1,), (2**40,), (-(2**63),)], "v long")
    assert all(a == b for a, b in ids.select(bucket(8, F.col("v")), F.expr("lake_bucket(8, v)")).collect())
    assert spark.range(1).select(bucket(8, F.lit(None))).first()[0] is None
    assert len(ids.select(bucket(8, F.col("v")))._jdf.queryExecution().analyzed().toString()) < 1000


def test_parse_change(spark):
    lines = [(x.encode(),) for x in ("U,42,5310,1704067200123", "U,1", "D,x,3,0", "I,3000000000,1,0", "U,1,2,0,more", "")]
    got = spark.createDataFrame(lines, "value binary").select(*codecs.parse_change(F.col("value"))).collect()
    stamp = datetime(2024, 1, 1, 0, 0, 0, 123000)
    assert [tuple(r)[:3] for r in got] == [("U", 42, 5310), ("U", 1, None), ("D", None, 3), ("I", None, 1), ("U", 1, 2), ("", None, None)]
    assert got[0].last_updated.replace(tzinfo=None) == stamp and got[1].last_updated is None


def test_protobuf_defaults(spark):
    made = codecs.message_class(codecs.employee_descriptor_set(), "Employee")
    zero = made()
    zero.employee_age.value = 0
    bodies = [(made().SerializeToString(),), (zero.SerializeToString(),), (None,), (b"\x0a\xff",)]
    df = spark.createDataFrame(bodies, "value binary")
    e = df.select(codecs.from_protobuf(F.col("value"), codecs.employee_descriptor_set(), mode="PERMISSIVE").alias("e"))
    got = e.select("e.id", "e.name", "e.employee_age.value", "e.role").collect()
    assert [tuple(r) for r in got] == [(0, "", None, "MANAGER"), (0, "", 0, "MANAGER"), (None,) * 4, (None,) * 4]
    with pytest.raises(Exception, match="(?i)decode|parse|message"):
        df.select(codecs.from_protobuf(F.col("value"), codecs.employee_descriptor_set()).alias("e")).collect()


@settings(max_examples=50, deadline=None)
@given(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**31), 2**31 - 1), st.integers(0, 2**50), st.text(), st.text(), st.text(), st.text()))
def test_avro_round_trip(values):
    fingerprint = codecs.fingerprint_of('"x"')
    assert codecs.avro_decode_record(codecs.avro_encode_record(values)) == values
    assert codecs.avro_decode_record(codecs.avro_encode_record(values, fingerprint=fingerprint)) == values


def test_avro_malformed(spark):
    good = codecs.avro_encode_record((1, 2, 3, "t", "r", "a", "n"))
    df = spark.createDataFrame([(good,), (good[:-1],), (good + b"x",), (None,)], "value binary").select(codecs.from_avro(F.col("value")).alias("e")).select("e.*")
    assert [r.name for r in df.collect()] == ["n", None, None, None]


def test_insert_only_merge(spark):
    cut = T0 - timedelta(hours=1)
    kind = "k long, ts timestamp, team string"
    old = T0 - timedelta(hours=2)
    target = spark.createDataFrame([(1, T0, "a"), (2, old, "a"), (3, T0, "b"), (None, T0, "a")], kind)
    source = spark.createDataFrame([(1, T0, "a"), (2, old, "a"), (3, T0, "b"), (None, T0, "a"), (9, T0, "a"), (9, T0, "a")], kind)
    new = insert_only(target, source, ["k", "ts"], (F.col("ts") > F.lit(cut)) & (F.col("team") == "a"))
    assert rows(new, "k") == sorted([(2,), (3,), (None,), (9,), (9,)], key=repr)
    assert insert_only(target, source, ["k", "ts"], dedup_within=True).where("k = 9").count() == 1


def planted(spark):
    mirror = spark.createDataFrame([(k, float(b), T0) for k, b in ((1, 10), (2, 20), (3, 30), (7, 70))], MIRROR)
    ops = [(1, None, 11), (2, "D", 0), (4, "I", 40), (5, "D", 0), (6, None, 60), (7, "I", 71)]
    return mirror, spark.createDataFrame([(k, o, b, T0) for k, o, b in ops], CHANGE)


EXPECTED = [(1, 11.0), (3, 30.0), (4, 40.0), (7, 71.0)]


def test_mirror_merge(spark):
    assert rows(mirror_merge(*planted(spark)), "account_id", "balance") == EXPECTED


@pytest.mark.parametrize("mode", ["copy-on-write", "merge-on-read"])
def test_mirror_tables(spark, tmp_path, mode):
    start, changes = planted(spark)
    mirror = SnapshotTable.create(spark, str(tmp_path / "m"), MIRROR, MIRROR_SPEC, {"merge.key": "account_id"})
    mirror.append(start)
    merge_into_mirror(mirror, changes, mode=mode)
    assert rows(mirror.scan(), "account_id", "balance") == EXPECTED
    merge_into_mirror(mirror, changes.where("account_id = 2").withColumn("operation", F.lit("I")).withColumn("balance", F.lit(5)), mode=mode)
    assert rows(mirror.scan(), "account_id", "balance") == sorted([*EXPECTED, (2, 5.0)])
    rewrite_data_files(mirror, ["last_updated"])
    assert rows(mirror.scan(), "account_id", "balance") == sorted([*EXPECTED, (2, 5.0)]) and not mirror.parts(kind="delete")


def test_latest_change_ties_and_window(spark):
    df = spark.createDataFrame([(1, "U", 1, T0), (1, "U", 2, T0), (1, "U", 9, T0 - timedelta(days=3)), (2, "U", 5, T0 - timedelta(days=3))], CHANGE)
    got = latest_change(df, "account_id", newest_first(), F.col("last_updated") > F.lit(T0 - timedelta(days=1)))
    assert rows(got, "account_id", "balance") == [(1, 2)]


def test_incremental(spark, tmp_path):
    log = SnapshotTable.create(spark, str(tmp_path / "log"), CHANGE, ["bucket(2, account_id)"])
    mirror = SnapshotTable.create(spark, str(tmp_path / "m"), MIRROR, MIRROR_SPEC)
    assert incremental_mirror(log, mirror) is None and log.incremental(None, None).count() == 0
    change = lambda k, b: spark.createDataFrame([(k, "I", b, T0)], CHANGE)
    first = log.append(change(1, 1))
    incremental_mirror(log, mirror)
    assert watermark_of(mirror, "accounts_changelog") == first and incremental_mirror(log, mirror) is None
    second = log.append(change(2, 2))
    rewrite_data_files(log, ["last_updated"], min_parts=1)
    assert log.incremental(first, first).count() == 0
    assert rows(log.incremental(first, log.current_snapshot_id()), "account_id") == [(2,)] == rows(log.incremental(first, second), "account_id")
    incremental_mirror(log, mirror)
    assert rows(mirror.scan(), "account_id") == [(1,), (2,)]
    log.expire_snapshots(float("inf"))
    with pytest.raises(ValueError, match="lineage"):
        log.incremental(first, log.current_snapshot_id())


def test_commit_race(spark, tmp_path):
    one, two = numbers(spark, tmp_path / "t"), SnapshotTable(spark, str(tmp_path / "t"))
    base = one.append(kv(spark, (1, "a")))
    parts = one.parts()
    two.append(kv(spark, (2, "b")))  # an append rebases
    with pytest.raises(CommitConflict):
        one.append(kv(spark, (3, "c")), base=base, check_base=True)
    one.replace(parts, kv(spark, (1, "x")), "replace")
    with pytest.raises(CommitConflict):
        two.replace(parts, kv(spark, (1, "y")), "replace")
    assert rows(one.scan()) == [(1, "x"), (2, "b")]


def test_versions_are_exclusive(spark, tmp_path):
    t = numbers(spark, tmp_path / "t")
    version, meta = t.load()
    t._put(version + 1, meta)
    with pytest.raises(CommitConflict):
        t._put(version + 1, meta)


def test_rollback_and_expiry(spark, tmp_path):
    t = numbers(spark, tmp_path / "t")
    first = t.append(kv(spark, (1, "a")))
    t.append(kv(spark, (2, "b")))
    t.rollback(first)
    assert rows(t.scan()) == [(1, "a")]
    t.append(kv(spark, (3, "c")))
    assert t.expire_snapshots(float("inf")).first().expired_snapshots == 2
    assert rows(t.scan()) == [(1, "a"), (3, "c")]
    with pytest.raises(ValueError, match="no snapshot"):
        t.rollback(first)


def test_overwrite_dedup_leaves_other_partitions(spark, tmp_path):
    t = numbers(spark, tmp_path / "t", spec=["identity(v)"])
    t.append(kv(spark, (1, "a b"), (1, "a b"), (2, "a b"), (5, "z"), (5, "z")))
    kept = [p for p in t.parts() if p["partition"].endswith("=z")]
    dedup_partitions(t, [F.col("k").alias("_k")], F.col("k"), lambda v: v["_identity_v"] != "z")
    assert rows(t.scan()) == [(1, "a b"), (2, "a b"), (5, "z"), (5, "z")]
    assert [p for p in t.parts() if p["partition"].endswith("=z")] == kept
    t.overwrite_partitions(kv(spark, (8, "z")))
    assert rows(t.scan()) == [(1, "a b"), (2, "a b"), (8, "z")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 20), max_size=6), min_size=1, max_size=3))
def test_compaction_keeps_rows(spark, tmp_path_factory, commits):
    t = numbers(spark, tmp_path_factory.mktemp("t"))
    for c in commits:
        t.append(kv(spark, *[(k, str(k)) for k in c]))
    before = rows(t.scan())
    rewrite_data_files(t, ["k"], target_bytes=500)
    assert rows(t.scan()) == before
    assert len({p["partition"] for p in t.parts()}) == len(t.parts())


def test_merge_new_replay(spark, tmp_path):
    t = numbers(spark, tmp_path / "t")
    for _ in range(2):
        merge_new(t, kv(spark, (1, "a"), (2, "b")), ["k"], summary={"query-id": "q", "batch-id": "0"})
    assert rows(t.scan()) == [(1, "a"), (2, "b")]


def test_batch_twice_is_one_snapshot(spark, tmp_path):
    t = numbers(spark, tmp_path / "t")
    for _ in range(2):
        t.append(kv(spark, (1, "a")), {"query-id": "q", "batch-id": "7"})
    assert t.snapshots().count() == 1 and t.has_batch("q", 7)


def test_replay_after_expiry_commits_nothing(spark, tmp_path):
    """Commit, compact, expire, and only then the same batch again, as after a failure before the stream's own commit."""
    t = numbers(spark, tmp_path / "t")
    batch = {"query-id": "q", "batch-id": "0"}
    t.append(kv(spark, (1, "a")), batch)
    t.append(kv(spark, (1, "b")), {"query-id": "other", "batch-id": "5"})
    rewrite_data_files(t, ["k"])
    t.expire_snapshots(float("inf"))
    again = SnapshotTable(spark, t.path)
    assert again.has_batch("q", 0) and again.has_batch("other", 4) and not again.has_batch("q", 1)
    again.append(kv(spark, (1, "a")), batch)
    assert rows(again.scan()) == [(1, "a"), (1, "b")]
    mirror = SnapshotTable.create(spark, str(tmp_path / "m"), MIRROR, MIRROR_SPEC)
    mirror.append(spark.createDataFrame([], MIRROR), {"watermark:log": "4"})
    rewrite_data_files(mirror, min_parts=1)
    mirror.append(spark.createDataFrame([], MIRROR))
    mirror.expire_snapshots(float("inf"))
    assert watermark_of(mirror, "log") == 4


def test_a_merge_reads_only_partitions_that_may_match(spark, tmp_path):
    kind = "k long, ts timestamp, team string"
    t = SnapshotTable.create(spark, str(tmp_path / "t"), kind, ["hours(ts)", "identity(team)", "bucket(4, k)"])
    t.append(spark.createDataFrame([(k, T0 + timedelta(hours=h), team) for k in (34, 35) for h in (0, 5) for team in ("a b", "c:d")], kind))
    batch = spark.createDataFrame([(34, T0, "a b"), (34, T0 + timedelta(minutes=1), "a b")], kind)
    hit = t.affected(batch, ["k", "ts", "team"])
    for p in t.parts(where=lambda values: not hit(values)):
        shutil.rmtree(p["path"])  # a merge that opened them would fail
    assert len(t.parts(where=hit)) == 1 and len(t.parts()) == 8
    merge_new(t, batch, ["k", "ts", "team"])
    assert rows(t.read_parts(t.parts(where=hit)), "k", "ts") == [(34, T0), (34, T0 + timedelta(minutes=1))]
    other = t.affected(spark.createDataFrame([(34, T0, "c:d")], kind), ["team"])
    assert {p["partition"].split("/")[1] for p in t.parts(where=other)} == {"_identity_team=c%3Ad"}
    assert t.affected(batch, ["nothing"])({})


def test_a_stream_compacts_closed_hours_only(spark, tmp_path):
    now = datetime.now().replace(minute=30)
    kind = "employee_id long, start_date timestamp"
    t = SnapshotTable.create(spark, str(tmp_path / "t"), kind, ["hours(start_date)"])
    for i in range(2):
        t.append(spark.createDataFrame([(i, now - timedelta(hours=h)) for h in (0, 1, 2, 4)], kind))
    spark.createDataFrame([(9, now)], kind).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    merge_ingest(stream, t, name="m", checkpoint=str(tmp_path / "c"), compaction=True).awaitTermination()
    parts = {}
    for p in t.parts():
        parts.setdefault(p["partition"], []).append(p)
    assert sorted(map(len, parts.values())) == [1, 1, 2, 3]
    inside = closed_hours("start_date", datetime(2024, 1, 1, 10, 17))
    hour = int(datetime(2024, 1, 1, 10).timestamp() // 3600) if datetime.now().astimezone().utcoffset() == timedelta(0) else 473_364 + 10
    assert [h - hour for h in range(hour - 5, hour + 2) if inside({"_hours_start_date": str(h)})] == [-2, -1]


def test_metadata_grows_by_changes(spark, tmp_path):
    t = numbers(spark, tmp_path / "t", spec=["identity(k)"])
    for i in range(4):
        t.append(kv(spark, *[(k, str(i)) for k in range(i * 10, i * 10 + 10)]))
    newest = sorted(Path(t.path, "metadata").glob("v*.json"))[-1]
    assert "_identity_k" not in newest.read_text()
    sizes = [len(json.loads(m.read_text())["added"]) for m in Path(t.path, "metadata").glob("m-*.json")]
    assert sizes == [10] * 4 and len(t.parts()) == 40 and t.snapshots().select("live_parts").collect()[-1][0] == 40
    before = rows(t.scan())
    assert t.rewrite_manifests(keep_versions=2).first().rewritten_manifests == 4
    assert len(list(Path(t.path, "metadata").glob("v*.json"))) == 2
    t.append(kv(spark, (99, "x")))
    assert rows(SnapshotTable(spark, t.path).scan()) == sorted([*before, (99, "x")], key=repr)


def test_maintenance_meets_a_concurrent_commit(spark, tmp_path):
    for task in (lambda t: t.rewrite_manifests(), lambda t: t.expire_snapshots(float("inf")), lambda t: t.rollback(1)):
        t = numbers(spark, tmp_path / f"t{id(task)}")
        t.append(kv(spark, (1, "a")))
        put, other = t._put, SnapshotTable(spark, t.path)

        def late(version, meta, put=put, other=other, t=t):
            t._put = put
            other.append(kv(spark, (2, "b")))
            put(version, meta)

        t._put = late
        task(t)
        assert (1, "a") in rows(t.scan())


def test_merge_on_read_is_one_scan_whatever_the_commits(spark, tmp_path):
    t = SnapshotTable.create(spark, str(tmp_path / "m"), MIRROR, MIRROR_SPEC, {"merge.key": "account_id"})
    change = lambda b: spark.createDataFrame([(1, "I", b, T0), (b, "I", b, T0)], CHANGE)
    for b in range(10, 14):
        merge_into_mirror(t, change(b), mode="merge-on-read")
    plan = t.scan()._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation [") == 2
    assert rows(t.scan(), "account_id", "balance") == [(1, 13.0), *[(b, float(b)) for b in range(10, 14)]]


def test_watermark_dedup_and_restart(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [[(1, at(0)), (1, at(0))], [(1, at(0)), (2, at(300))], [(3, at(10)), (1, at(0))], [(4, at(200)), (2, at(300))]]
    kind = "employee_id long, start_date timestamp"
    t = SnapshotTable.create(spark, str(tmp_path / "t"), kind, [])
    for b in batches:  # the query starts again for each
        spark.createDataFrame(b, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        watermark_ingest(stream, t, name="w", checkpoint=str(tmp_path / "c")).awaitTermination()
    assert rows(t.scan(), "employee_id") == [(1,), (2,), (4,)]


def test_append_stream_and_console(spark, tmp_path):
    kv(spark, (1, "a")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v string").parquet(str(tmp_path / "in"))
    t = numbers(spark, tmp_path / "t")
    append_stream(stream, t, name="a", checkpoint=str(tmp_path / "c"), every="1 second").stop()
    append_stream(stream, t, name="a", checkpoint=str(tmp_path / "c")).awaitTermination()
    assert rows(t.scan()) == [(1, "a")]
    console(stream, name="seen", sink="memory").awaitTermination()
    assert spark.table("seen").count() == 1


def test_schedules():
    assert millis_to_next_run(datetime(2024, 1, 1, 10, 17, 30)) == 2_850_000
    ran = []

    def task():
        ran.append(1)
        raise ValueError("planted")

    m = HourlyMaintenance(task, 0.01, 0.01).start()
    while len(ran) < 3:
        m.stopped.wait(0.01)
    m.stop()
    assert m.failures >= 3


def test_generators(spark):
    made = employees(spark, 50_000, T0)
    late = made.where(F.col("start_date") < F.lit(T0)).count()
    assert 20 < late < 100 and 50_040 < made.count() < 50_200
    assert rows(made.limit(5)) == rows(employees(spark, 50_000, T0).repartition(3).limit(0).unionByName(made.limit(5)))
    assert made.repartition(7).exceptAll(employees(spark, 50_000, T0)).count() == 0
    changes = account_changes(spark, 1000, T0, operations=("U", "D", None))
    assert {r[0] for r in changes.select("operation").distinct().collect()} == {"U", "D", None}
    assert changes.agg(F.max("last_updated")).first()[0] == T0
    assert json_employees(spark, 3).select("value").first()[0] == '{"employeeId":0,"name":"Person"}'
