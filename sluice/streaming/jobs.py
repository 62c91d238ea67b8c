"""Structured Streaming jobs: watermark ingest, append, insert-only merge, with in-line maintenance.

Every micro-batch commits one snapshot that carries the id of the streaming query, which lives in its checkpoint, and the batch number. So a batch that is
delivered again after a failure commits nothing, while another checkpoint or a second source loses nothing, whatever its name. The same
commit says how many rows were read, inserted and suppressed; how many came too late follows when Spark reports it.
Offsets and state live in the checkpoint folder, which is always an argument.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.dedup import within_watermark
from ..operators.maintenance import closed_hours, due, rewrite_data_files
from ..operators.merge import insert_only
from ..operators.predicates import Predicate
from ..sources.snapshot_table import CommitConflict, SnapshotTable

COMPACT_EVERY, MANIFESTS_EVERY = 10, 30
#: Values of a key that a merge hands to the scan of the target; Spark hands on lists of up to spark.sql.parquet.pushdown.inFilterThreshold as they are.
KEY_VALUES = 10
PRUNABLE = (T.IntegralType, T.StringType, T.TimestampType, T.DateType)


@dataclass(frozen=True)
class Batch:
    """A micro-batch: the id that its checkpoint gives the query, its number, and the query's name."""

    query_id: str
    number: int
    name: str

    @property
    def summary(self) -> dict[str, str]:
        return {"query": self.name, "query-id": self.query_id, "batch-id": str(self.number)}


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], *, name: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hands each micro-batch to `handle`. every: a processing-time interval; none: take what is there, then end."""
    writer = stream.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start_batches(stream: DataFrame, handle: Callable[[DataFrame, Batch], None], *, name: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """As start, but the handler learns which checkpoint a batch belongs to. Names of running queries are unique, so the name finds the id."""
    running = stream.sparkSession.streams

    def one(rows: DataFrame, number: int) -> None:
        (query_id,) = [q.id for q in running.active if q.name == name]
        handle(rows, Batch(str(query_id), number, name))

    return start(stream, one, name=name, checkpoint=checkpoint, every=every)


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Callable[[], int]]:
    """rows, and a function that gives their number once a write has read them."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), lambda: int(seen.get.get("rows") or 0)


class _Lateness(StreamingQueryListener):
    """Adds to the snapshots of one query's batches how many rows the watermark dropped. Spark reports it when a batch has ended."""

    def __init__(self, table: SnapshotTable, name: str):
        self.table, self.name = table, name
        self.id = None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name and self.id is None:
            self.id = event.id

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if p.id == self.id and p.stateOperators and p.numInputRows:
            self.table.annotate(str(p.id), p.batchId, {"rows-read": str(p.numInputRows), "rows-late": str(late)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.id == self.id:
            self.table.spark.streams.removeListener(self)


def append_stream(stream: DataFrame, table: SnapshotTable, *, name: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    def handle(rows: DataFrame, batch: Batch) -> None:
        if not table.has_batch(batch.query_id, batch.number):
            rows, inserted = counted(rows, "inserted")
            table.append(rows, lambda: batch.summary | {"rows-inserted": str(inserted())})

    return start_batches(stream, handle, name=name, checkpoint=checkpoint, every=every)


def watermark_ingest(
    stream: DataFrame, table: SnapshotTable, *, name: str, checkpoint: str, time_column: str = "start_date", keys: tuple[str, ...] = ("start_date", "employee_id"), delay: str = "120 seconds", every: str | None = None
) -> StreamingQuery:
    """Appends rows whose keys the watermark's state does not hold; rows later than the watermark go, and are counted."""
    table.spark.streams.addListener(_Lateness(table, name))
    return append_stream(within_watermark(stream, time_column, list(keys), delay), table, name=name, checkpoint=checkpoint, every=every)


def key_condition(rows: DataFrame, keys: list[str], most: int = KEY_VALUES) -> Column | None:
    """What the target's rows must meet to match one of `rows`, in a form that Parquet can skip row groups by: for each key its values,
    where they are at most `most`, else its least and greatest. None if no key has a type with such statistics.

    Values go to the row groups' Bloom filters and dictionaries, ranges to their statistics. The driver gets `most` values a key at most.
    """
    plain = [k for k in keys if isinstance(rows.schema[k].dataType, PRUNABLE)]
    if not plain:
        return None
    ends = rows.agg(*[f(k).alias(f"{n}{i}") for i, k in enumerate(plain) for n, f in (("lo", F.min), ("hi", F.max), ("n", F.approx_count_distinct))]).first()
    found: list[Column] = []
    for i, k in enumerate(plain):
        if ends[f"lo{i}"] is None:
            return F.lit(False)  # a null key matches nothing
        few = ends[f"n{i}"] <= 2 * most
        values = [r[0] for r in rows.where(F.col(k).isNotNull()).select(k).distinct().limit(most + 1).collect()] if few else range(most + 1)
        found.append(F.col(k).isin(values) if len(values) <= most else F.col(k).between(ends[f"lo{i}"], ends[f"hi{i}"]))
    return reduce(and_, found)


def merge_new(
    table: SnapshotTable,
    rows: DataFrame,
    keys: list[str],
    *,
    target_filter: Column | None = None,
    parts: Callable[[dict], bool] = lambda values: True,
    dedup_within: bool = False,
    summary: dict[str, str] | None = None,
    tries: int = 10,
    prune: bool = True,
) -> int:
    """Insert-only MERGE in one commit; after a conflicting commit the match is computed again on the new snapshot.

    Of the target only partitions are read that can hold a match: those that the batch itself falls in, by the transforms of
    key columns, and that `parts` takes by their hidden values; `parts` must take all that target_filter could let through. Inside them,
    the batch's keys prune row groups (see key_condition), unless prune is false.
    """
    rows = rows.persist()  # read for its partitions, its keys and for the merge
    try:
        hit = table.affected(rows, keys)
        inside = key_condition(rows, keys) if prune else None
        for _ in range(tries):
            base = table.current_snapshot_id()
            target = table.scan(base, where=lambda values: hit(values) and parts(values))
            target = target if inside is None else target.where(inside)
            source, read = counted(rows, "read")
            new, inserted = counted(insert_only(target, source, keys, target_filter, dedup_within), "inserted")
            facts = lambda: {"rows-read": str(read()), "rows-inserted": str(inserted()), "rows-suppressed": str(read() - inserted())}  # noqa: B023, E731
            try:
                return table.append(new, lambda: (summary or {}) | facts(), base=base, check_base=True)  # noqa: B023
            except CommitConflict:
                continue
        raise CommitConflict(f"merge: no commit in {tries} tries")
    finally:
        rows.unpersist()


def merge_ingest(
    stream: DataFrame,
    table: SnapshotTable,
    *,
    name: str,
    checkpoint: str,
    keys: tuple[str, ...] = ("employee_id", "start_date"),
    target_filter: Callable[[], Column | Predicate | None] = lambda: None,
    parts: Callable[[], Callable[[dict], bool]] = lambda: lambda values: True,
    dedup: bool = True,
    dedup_within: bool = False,
    compaction: bool = False,
    compact: Callable[[], Callable[[dict], bool]] | None = None,
    sort_by: tuple[str, ...] = ("start_date",),
    every: str | None = None,
) -> StreamingQuery:
    """Insert-only MERGE of each batch, or a plain append without `dedup`; with `compaction`, data files are rewritten every
    COMPACT_EVERY batches and manifests every MANIFESTS_EVERY.

    target_filter, parts and compact are called for each batch, so they can move with time. A target_filter that is a Predicate also gives the
    partitions that can meet it; for a Column, parts may name them. compact: the partitions to rewrite; unless
    given, closed hours of a table that has hours of the first sort column, else all.
    """
    hourly = f"hours({sort_by[0]})" in [s.replace(" ", "") for s in table.load()[1].spec]

    def closed() -> Callable[[dict], bool]:
        return closed_hours(sort_by[0], datetime.now(timezone.utc)) if hourly else lambda values: True

    def handle(rows: DataFrame, batch: Batch) -> None:
        if not table.has_batch(batch.query_id, batch.number):
            if dedup:
                condition, where = target_filter(), parts()
                if isinstance(condition, Predicate):
                    may, given = condition.partitions(table.load()[1].spec), where
                    condition, where = condition.column(), lambda values: may(values) and given(values)
                merge_new(table, rows, list(keys), target_filter=condition, parts=where, dedup_within=dedup_within, summary=batch.summary)
            else:
                rows, inserted = counted(rows, "inserted")
                table.append(rows, lambda: batch.summary | {"rows-inserted": str(inserted())}, positional=True)
        if compaction:
            if due(batch.number, COMPACT_EVERY):
                rewrite_data_files(table, list(sort_by), (compact or closed)())
            if due(batch.number, MANIFESTS_EVERY):
                table.rewrite_manifests()

    return start_batches(stream, handle, name=name, checkpoint=checkpoint, every=every)


def console(stream: DataFrame, *, name: str, checkpoint: str | None = None, every: str | None = None, sink: str = "console") -> StreamingQuery:
    """Prints the rows, or keeps them in a memory table of that name (sink='memory')."""
    writer = stream.writeStream.format(sink).queryName(name).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
