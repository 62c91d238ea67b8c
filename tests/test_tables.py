"""Exactly once by checkpoint, sizes of files, compaction in groups, deletes by partition, pruning, the ordered mirror, maintenance beside a stream."""

import threading
import time
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.operators import maintenance
from sluice.operators.maintenance import beside, pack_groups, rewrite_data_files
from sluice.operators.merge import ordered_merge
from sluice.operators.predicates import col
from sluice.plans.cdc import live, merge_into_mirror, mirror_changes
from sluice.plans.ingest import dedup_partitions
from sluice.schemas import CHANGELOG, EMPLOYEE, ORDERED_MIRROR
from sluice.sources import layout
from sluice.sources.layout import advised
from sluice.sources.snapshot_table import CommitConflict, SnapshotTable, values_of
from sluice.streaming.jobs import append_stream, key_condition, merge_ingest, merge_new, start, watermark_ingest

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def numbers(spark, path, n, start=0):
    spark.range(start, start + n).toDF("k").write.mode("append").parquet(str(path))
    return spark.readStream.schema("k long").parquet(str(path))


@pytest.mark.parametrize("merge", [False, True])
def test_two_checkpoints_of_one_name_lose_nothing(spark, tmp_path, merge):
    t = SnapshotTable.create(spark, str(tmp_path / "t"), "k long", ["bucket(2, k)"])
    run = lambda stream, checkpoint: (
        merge_ingest(stream, t, name="ingest", checkpoint=checkpoint, keys=("k",), sort_by=("k",)) if merge else append_stream(stream, t, name="ingest", checkpoint=checkpoint)
    ).awaitTermination()
    run(numbers(spark, tmp_path / "a", 10), str(tmp_path / "c1"))
    run(numbers(spark, tmp_path / "b", 10, 100), str(tmp_path / "c2"))
    assert sorted(r.k for r in t.scan().collect()) == [*range(10), *range(100, 110)]
    assert len([k for k in t.progress() if k.startswith("batch:")]) == 2
    run(numbers(spark, tmp_path / "a", 5, 50), str(tmp_path / "c1"))  # the first checkpoint goes on
    assert t.scan().count() == 25


def test_a_batch_that_comes_again_commits_nothing(spark, tmp_path):
    t = SnapshotTable.create(spark, str(tmp_path / "t"), "k long")
    stream, checkpoint = numbers(spark, tmp_path / "a", 10), tmp_path / "c"
    append_stream(stream, t, name="once", checkpoint=str(checkpoint)).awaitTermination()
    for f in (checkpoint / "commits").iterdir():  # as if Spark had failed after the table's commit
        f.unlink()
    append_stream(stream, t, name="renamed", checkpoint=str(checkpoint)).awaitTermination()
    assert t.scan().count() == 10 and t.snapshots().count() == 1
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_commits_say_what_they_did(spark, tmp_path):
    kind = "employee_id long, start_date timestamp"
    t = SnapshotTable.create(spark, str(tmp_path / "m"), kind)
    t.append(spark.createDataFrame([(1, T0)], kind))
    merge_new(t, spark.createDataFrame([(1, T0), (2, T0), (2, T0), (None, T0)], kind), ["employee_id", "start_date"], summary={"query-id": "q", "batch-id": "0"})
    last = t.snapshots().orderBy(F.desc("snapshot_id")).first().summary
    assert (last["rows-read"], last["rows-inserted"], last["rows-suppressed"]) == ("4", "3", "1")
    merge_new(t, spark.createDataFrame([], kind), ["employee_id", "start_date"])
    # a stream whose second batch has a repeat and two rows behind the watermark
    late, src = SnapshotTable.create(spark, str(tmp_path / "w"), kind), str(tmp_path / "in")
    batches = [[(1, 0), (1, 0), (2, 600)], [(3, 10), (4, 20), (2, 600), (5, 700)]]
    for rows in batches:
        spark.createDataFrame([(k, T0 + timedelta(seconds=s)) for k, s in rows], kind).coalesce(1).write.mode("append").parquet(src)
        watermark_ingest(spark.readStream.schema(kind).parquet(src), late, name="late", checkpoint=str(tmp_path / "c")).awaitTermination()
    found: list = []
    for _ in range(100):
        found = [s for s in (r.summary for r in late.snapshots().orderBy("snapshot_id").collect()) if int(s.get("rows-read", 0))]
        if len(found) == 2:
            break
        time.sleep(0.1)
    assert [(s["rows-read"], s["rows-inserted"], s["rows-late"]) for s in found] == [("3", "2", "0"), ("4", "1", "2")]


def test_a_hot_partition_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(400_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(1).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    target = 1_000_000
    props = {"write.distribution-mode": "hash", "write.target-file-size-bytes": str(target), "write.shuffle-expansion": "1.2"}
    t = SnapshotTable.create(spark, str(tmp_path / "t"), "k long, v string", ["identity(k)"], props)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    t.append(rows)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
    hot = next(p for p in t.parts() if p["partition"] == "_identity_k=1")
    cold = [p for p in t.parts() if p["partition"] != "_identity_k=1"]
    assert hot["files"] >= 5 and 0.4 * target < hot["bytes"] / hot["files"] < 2 * target
    assert len(cold) == 6 and sorted(p["files"] for p in cold)[2] == 1 and t.scan().count() == 400_000  # some share a shuffle partition with the hot one


def test_advice_goes_when_the_last_writer_ends(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    with advised(spark, 1), advised(spark, 2):
        assert spark.conf.get(name) == "2"
    assert spark.conf.get(name) == before


def test_partitions_are_written_side_by_side(spark, tmp_path):
    """A write of bucketed rows doesn't sort them first; the session's own number of writers stays, and a task that meets more partitions loses no row."""
    for writers, expected in ((None, layout.OPEN_WRITERS), (2, 2)):
        spark.conf.unset(layout.OPEN_FILES) if writers is None else spark.conf.set(layout.OPEN_FILES, str(writers))
        before = spark.conf.get(layout.OPEN_FILES)
        with advised(spark, 1):
            assert int(spark.conf.get(layout.OPEN_FILES)) == expected
        t = SnapshotTable.create(spark, str(tmp_path / f"t{expected}"), "id long", ["bucket(64, id)"], {"write.distribution-mode": "hash"})
        t.append(spark.range(5000))
        assert spark.conf.get(layout.OPEN_FILES) == before
        assert len(t.parts()) == 64 and sorted(r.id for r in t.scan().collect()) == list(range(5000))
    spark.conf.unset(layout.OPEN_FILES)


def test_a_rewrite_sorts_among_as_many_tasks_as_its_rows_need(spark, tmp_path, monkeypatch):
    t = SnapshotTable.create(spark, str(tmp_path / "t"), "k long, v long", [])
    for i in range(2):
        t.append(spark.range(4000).selectExpr("id * 7919 % 4001 AS k", f"id + {i} AS v"))
    before = sorted(map(tuple, t.scan().collect()))
    monkeypatch.setattr(layout, "SORT_BYTES", 100_000)
    rewrite_data_files(t, ["k"])
    (part,) = t.parts()
    assert part["files"] in (4, 5) and sorted(map(tuple, t.scan().collect())) == before  # 8,000 rows of 56 bytes in a file of a few kilobytes
    spans = t.scan().groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("k").alias("low"), F.max("k").alias("high")).orderBy("low").collect()
    assert all(a.high <= b.low for a, b in zip(spans, spans[1:], strict=False))


def test_groups_are_bounded():
    part = lambda name, size: {"path": name, "bytes": size}
    sets = [[part("a", 40), part("b", 40), part("c", 40)], [part("d", 10)], [part("e", 15)]]
    got = pack_groups(sets, limit=80, aim=30)
    assert sorted(sorted(p["path"] for p in g) for g in got) == [["a", "b"], ["c"], ["d", "e"]]
    assert pack_groups([], 10, 10) == []


def test_groups_run_at_once_and_fail_alone(spark, tmp_path, monkeypatch):
    t = SnapshotTable.create(spark, str(tmp_path / "t"), "k long", ["identity(k)"])
    for _ in range(2):
        t.append(spark.range(4).toDF("k"))
    met, seen, replace = threading.Barrier(2, timeout=60), [], SnapshotTable.replace

    def slow(self, old, *args, **more):
        key = old[0]["partition"]
        seen.append(key)
        met.wait()  # both groups are there at the same time, or this times out
        if key == "_identity_k=0":
            raise CommitConflict("planted")
        return replace(self, old, *args, **more)

    monkeypatch.setattr(SnapshotTable, "replace", slow)
    (r,) = rewrite_data_files(t, where=lambda values: values["_identity_k"] in "01", workers=2).collect()
    assert (r.rewritten_parts, r.added_parts, r.failed_groups) == (2, 1, 1) and sorted(seen) == ["_identity_k=0", "_identity_k=1"]
    monkeypatch.undo()
    assert sorted(x.k for x in t.scan().collect()) == [0, 0, 1, 1, 2, 2, 3, 3]
    (r,) = rewrite_data_files(t, small=0.75, target_bytes=1).collect()  # no file is that small
    assert (r.rewritten_parts, r.failed_groups) == (0, 0)


def test_compaction_of_deletes_by_partition(spark, tmp_path):
    kind = "k long, v long"
    t = SnapshotTable.create(spark, str(tmp_path / "t"), kind, ["bucket(4, k)"], {"merge.key": "k"})
    rows = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], kind)
    t.append(rows(range(40), 0))
    t.delete_and_append(rows(range(20), 0).select("k"), rows(range(10), 1), base=t.current_snapshot_id())
    want = sorted([(k, 1) for k in range(10)] + [(k, 0) for k in range(20, 40)])
    assert sorted(map(tuple, t.scan().collect())) == want
    one = t.parts()[0]["partition"]
    rewrite_data_files(t, where=lambda values: "_bucket_k=" + values["_bucket_k"] == one)
    assert sorted(map(tuple, t.scan().collect())) == want
    assert [p["partition"] for p in t.parts()].count(one) == 1 and len(t.parts()) == 7 and len(t.parts(kind="delete")) == 3
    rewrite_data_files(t)
    assert sorted(map(tuple, t.scan().collect())) == want and not t.parts(kind="delete") and len(t.parts()) == 4


def test_deletes_that_come_while_parts_are_rewritten_hold(spark, tmp_path, monkeypatch):
    kind = "k long, v long"
    t = SnapshotTable.create(spark, str(tmp_path / "t"), kind, ["bucket(2, k)"], {"merge.key": "k"})
    for v in range(2):
        t.append(spark.createDataFrame([(k, v) for k in range(10 * v, 10 * v + 10)], kind))
    read = SnapshotTable.read_live

    def meanwhile(self, data, snapshot_id=None):
        found = read(self, data, snapshot_id).persist()
        found.count()
        other = SnapshotTable(spark, t.path)
        other.delete_and_append(spark.createDataFrame([(k,) for k in range(5)], "k long"), spark.createDataFrame([(100, 9)], kind), base=other.current_snapshot_id())
        return found

    monkeypatch.setattr(SnapshotTable, "read_live", meanwhile)
    (r,) = rewrite_data_files(t, max_commits=1).collect()
    monkeypatch.undo()
    assert r.failed_groups == 0 and sorted(x.k for x in t.scan().collect()) == [*range(5, 20), 100]
    assert t.parts(kind="delete")
    rewrite_data_files(t)
    assert sorted(x.k for x in t.scan().collect()) == [*range(5, 20), 100] and not t.parts(kind="delete")


def test_maps_json_and_lost_commits(spark, tmp_path):
    t = SnapshotTable.create(spark, str(tmp_path / "maps"), "k long, m map<string,int>, s struct<x: map<string,int>>", ["bucket(2, k)"])
    for k in (1, 2):
        t.append(spark.sql(f"SELECT {k}L AS k, map('a', {k}) AS m, named_struct('x', map('b', 1)) AS s"))
    rewrite_data_files(t, ["k"])
    assert sorted((r.k, r.m["a"], r.s.x["b"]) for r in t.scan().collect()) == [(1, 1, 1), (2, 2, 1)]
    j = SnapshotTable.create(spark, str(tmp_path / "json"), "k long, v string", ["bucket(2, k)"], {"write.format.default": "json"})
    j.append(spark.createDataFrame([(1, "a"), (2, None)], "k long, v string"))
    assert sorted(tuple(r) for r in j.scan().collect()) == [(1, "a"), (2, None)]
    with pytest.raises(CommitConflict):
        j.append(spark.createDataFrame([(3, "c")], "k long, v string"), base=None, check_base=True)
    assert len(list((tmp_path / "json" / "data").iterdir())) == 1  # the rows of the lost commit are gone


def test_maintenance_beside_a_stream(spark, tmp_path, monkeypatch):
    t = SnapshotTable.create(spark, str(tmp_path / "t"), "k long", ["bucket(2, k)"])
    stream, pools = numbers(spark, tmp_path / "in", 4), []
    query = append_stream(stream, t, name="beside", checkpoint=str(tmp_path / "c"), every="200 milliseconds")

    def task():
        pools.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        rewrite_data_files(t)

    schedule = beside(query, task, first_seconds=0.5, period_seconds=0.5)
    try:
        query.processAllAvailable()
        numbers(spark, tmp_path / "in", 4, 10)
        query.processAllAvailable()
        end = time.time() + 60
        while time.time() < end and "replace" not in [s.operation for s in t.load()[1].snapshots]:
            time.sleep(0.2)
        numbers(spark, tmp_path / "in", 4, 20)
        query.processAllAvailable()
    finally:
        query.stop()
    end = time.time() + 30
    while time.time() < end and not schedule.stopped.is_set():
        time.sleep(0.1)
    schedule.stop()
    runs = schedule.runs
    assert "replace" in [s.operation for s in t.load()[1].snapshots] and schedule.failures == 0 and set(pools) == {maintenance.POOL}
    assert sorted(r.k for r in t.scan().collect()) == [*range(4), *range(10, 14), *range(20, 24)]
    time.sleep(1.2)
    assert schedule.runs == runs and not schedule.thread.is_alive()


def test_beside_a_query_that_has_ended(spark, tmp_path):
    query = start(numbers(spark, tmp_path / "in", 1), lambda rows, n: None, name="ended", checkpoint=str(tmp_path / "c"))
    query.awaitTermination()
    schedule = beside(query, lambda: 1 / 0, 0.0, 0.1)
    schedule.stop()
    assert schedule.runs == 0


CHANGES = [("I", 1, 10, 0), ("U", 1, 11, 5), ("D", 1, 11, 9), ("U", 2, 20, 3), (None, 2, 21, 4), ("D", 3, 30, 1), ("I", 3, 31, 2), ("U", 4, None, 7), ("U", 4, 41, 7), ("U", None, 1, 1)]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(CHANGES), st.integers(1, len(CHANGES) - 1), st.booleans())
def test_an_ordered_mirror_does_not_depend_on_arrival(spark, tmp_path_factory, changes, cut, on_read):
    mirror = SnapshotTable.create(spark, str(tmp_path_factory.mktemp("m") / "t"), ORDERED_MIRROR, ["bucket(2, account_id)"], {"merge.key": "account_id"})
    for part in (changes[:cut], changes[cut:]):
        rows = spark.createDataFrame([(o, k, b, T0 + timedelta(seconds=s)) for o, k, b, s in part if k is not None], CHANGELOG)
        mirror_changes(rows, mirror, mode="merge-on-read" if on_read else "copy-on-write", ordered=True)
    got = sorted((r.account_id, r.balance) for r in live(mirror.scan()).collect())
    assert got == [(2, 21), (3, 31), (4, 41)]
    assert mirror.scan().where("account_id = 1").first().operation == "D"


def test_ordered_merge_keeps_null_keys_apart(spark):
    kind = "k long, v long"
    got = ordered_merge(spark.createDataFrame([(None, 1), (1, 5)], kind), spark.createDataFrame([(None, 2), (1, 4), (2, None)], kind), "k", ["v"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 1), (None, 2), (1, 5), (2, None)], key=str)


TIMES = [None, *[T0 + timedelta(minutes=m) for m in (0, 59, 60, 61, 600, 1439, 1440, 3000)]]
NAMES = [None, "a", "b", "b c", "d/e=f"]
simple = st.one_of(
    st.builds(lambda op, v: getattr(col("at"), f"__{op}__")(v), st.sampled_from(["gt", "ge", "lt", "le", "eq"]), st.sampled_from(TIMES)),
    st.builds(lambda op, v: getattr(col("name"), f"__{op}__")(v), st.sampled_from(["gt", "le", "eq"]), st.sampled_from(NAMES)),
    st.builds(lambda v: col("id").isin(*v), st.lists(st.integers(0, 12), max_size=3)),
    st.builds(lambda op, v: getattr(col("id"), f"__{op}__")(v), st.sampled_from(["gt", "lt", "eq"]), st.integers(0, 12)),
    st.builds(lambda n: col(n).is_null(), st.sampled_from(["at", "name", "id"])),
)
predicate = st.recursive(simple, lambda p: st.builds(lambda a, b, both: (a & b) if both else (a | b), p, p, st.booleans()), max_leaves=4)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    kind = "id long, at timestamp, name string"
    t = SnapshotTable.create(spark, str(tmp_path_factory.mktemp("p") / "t"), kind, ["hours(at)", "identity(name)", "bucket(4, id)", "days(at)"])
    rows = [(None if i % 13 == 12 else i % 13, TIMES[i % len(TIMES)], NAMES[i % len(NAMES)]) for i in range(120)]
    t.append(spark.createDataFrame(rows, kind).coalesce(1))
    return t, t.scan().persist()


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(predicate)
def test_pruning_never_loses_a_row(spark, table, p):
    t, rows = table
    spec = t.load()[1].spec
    may = p.partitions(spec)
    taken = [x for x in t.parts() if may(values_of(x))]
    assert sorted(map(str, t.read_parts(taken).where(p.column()).collect())) == sorted(map(str, rows.where(p.column()).collect()))


def test_pruning_leaves_partitions_out(spark, table):
    t, _ = table
    spec, n = t.load()[1].spec, len(t.parts())
    left = lambda p: len([x for x in t.parts() if p.partitions(spec)(values_of(x))])
    assert left(col("at") >= T0 + timedelta(days=2)) < n / 3
    assert left((col("name") == "b c") & (col("id") == 3)) < n / 4
    assert left(col("at").between(T0, T0 + timedelta(minutes=30)) | (col("name") == "a")) < 2 * n / 3


def test_a_merge_skips_row_groups_without_its_keys(spark, tmp_path):
    kind = "k long, v string"
    props = {"write.parquet.bloom-filter-columns": "k", "write.parquet.row-group-size-bytes": str(64 << 10)}
    t = SnapshotTable.create(spark, str(tmp_path / "t"), kind, [], props)
    even = spark.range(200_000).select((F.col("id") * 2).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    t.append(even.repartitionByRange(4, F.xxhash64("k")))  # every file has keys of the whole range
    batch = spark.createDataFrame([(4, "x"), (100_001, "y"), (399_998, "z")], kind)
    read = lambda c: _rows_read(spark, t.scan().where(c))
    inside = key_condition(batch, ["k"])
    assert read(inside) < 100_000 < 200_000 == read(F.col("k") >= 0)
    assert read(key_condition(spark.range(100_001, 100_600, 2).toDF("k"), ["k"])) <= 200_000  # many keys: a range
    merge_new(t, batch, ["k"])
    assert t.scan().count() == 200_001
    assert t.scan().where("k = 100001").first().v == "y"
    assert _rows_read(spark, t.scan().where(key_condition(spark.createDataFrame([(None, "n")], kind), ["k"]))) == 0
    merge_new(t, spark.createDataFrame([(None, "n")], kind), ["k"])
    assert t.scan().where("k is null").count() == 1


def _rows_read(spark, df):
    """Rows that the Parquet scan gave."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    stack, total = [plan], 0
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_jobs_set_spec_properties_and_maintenance(spark, tmp_path, capsys):
    from sluice import __main__ as cli
    from sluice.plans.queries import proto_value
    from sluice.sources.log import append_messages

    run = lambda *words: cli.run(spark, cli.parser().parse_args([str(w) for w in words]))
    rows = spark.createDataFrame([(k, 30, T0, "a", "DEVELOPER", "1 Quay", f"n{k}") for k in range(5)], EMPLOYEE)
    append_messages(rows, str(tmp_path / "log"), topic="e", value=proto_value())
    stream = ["--log", tmp_path / "log", "--table", tmp_path / "t", "--checkpoint", tmp_path / "c"]
    options = ["--spec", "days(start_date)", "--property", "write.format.default=orc", "--property", "write.compression-codec=zlib", "--property", "write.distribution-mode=hash"]
    run("ingest-watermark", *stream, *options, "--maintain-every", 5, "--maintain-first", 0)
    t = SnapshotTable(spark, str(tmp_path / "t"))
    assert t.load()[1].spec == ["days(start_date)"] and t.load()[1].properties["write.distribution-mode"] == "hash"
    assert t.scan().count() == 5 and list((tmp_path / "t").rglob("*.orc")) and "maintenance runs" in capsys.readouterr().out
    now = datetime.now(timezone.utc)
    lines = [f"{o},{k},{b},{int(a.timestamp() * 1000)}" for o, k, b, a in [("D", 1, 5, now), ("I", 1, 4, now - timedelta(hours=1)), ("I", 2, 9, now), ("I", 3, 7, now - timedelta(days=3))]]
    append_messages(spark.createDataFrame([(x,) for x in lines], "v string"), str(tmp_path / "changes"), topic="c", value=F.col("v"))
    run("ingest-changelog", "--log", tmp_path / "changes", "--table", tmp_path / "changelog", "--checkpoint", tmp_path / "c2", "--spec", "days(last_updated)")
    run("mirror", "--changelog", tmp_path / "changelog", "--table", tmp_path / "mirror", "--since-days", 1, "--ordered")
    mirror = SnapshotTable(spark, str(tmp_path / "mirror")).scan()
    assert sorted((r.account_id, r.operation) for r in mirror.collect()) == [(1, "D"), (2, "I")]
    table = SnapshotTable.create(spark, str(tmp_path / "d"), "k long, at timestamp, v long", ["days(at)"])
    table.append(spark.createDataFrame([(1, T0, 2), (1, T0, 1), (1, T0 + timedelta(days=1), 3), (1, T0 + timedelta(days=1), 4)], "k long, at timestamp, v long"))
    run("dedup", "--table", tmp_path / "d", "--keys", "k", "--order-by", "v", "--partition", "_days_at=2024-01-01")
    assert sorted(r.v for r in table.scan().collect()) == [1, 3, 4]


def test_a_predicate_drives_a_merge(spark, tmp_path):
    kind = "k long, at timestamp"
    t = SnapshotTable.create(spark, str(tmp_path / "t"), kind, ["hours(at)"])
    t.append(spark.createDataFrame([(1, T0), (2, T0 + timedelta(hours=5))], kind))
    spark.createDataFrame([(1, T0), (2, T0 + timedelta(hours=5))], kind).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    since = col("at") >= T0 + timedelta(hours=2)
    merge_ingest(stream, t, name="p", checkpoint=str(tmp_path / "c"), keys=("k", "at"), sort_by=("at",), target_filter=lambda: since).awaitTermination()
    assert sorted(r.k for r in t.scan().collect()) == [1, 1, 2]  # the window does not know the first row


def test_merges_and_dedup_still_agree(spark, tmp_path):
    mirror = SnapshotTable.create(spark, str(tmp_path / "m"), ORDERED_MIRROR, ["bucket(2, account_id)"], {"merge.key": "account_id"})
    latest = spark.createDataFrame([(1, 5, T0, "U")], ORDERED_MIRROR)
    for _ in range(2):
        merge_into_mirror(mirror, latest, ordered=True)
    assert [tuple(r)[:2] for r in mirror.scan().collect()] == [(1, 5)]
    assert dedup_partitions(mirror, [F.col("account_id")], F.col("balance")) and mirror.scan().count() == 1
