"""Table maintenance: compaction, manifests, expiry, and when to run them."""

from __future__ import annotations

import logging
import threading
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.layout import TARGET_BYTES, sorting_tasks
from ..sources.snapshot_table import CommitConflict, SnapshotTable, values_of

log = logging.getLogger(__name__)
RESULT = "rewritten_parts int, added_parts int, failed_groups int"
#: Bytes that one job rewrites at most, and jobs at once.
GROUP_BYTES, WORKERS = 100 << 30, 4
POOL = "maintenance"


def _worth(table: SnapshotTable, base: int | None, where: Callable[[dict], bool], min_parts: int, small: float) -> list[list[dict]]:
    """For each partition the parts to rewrite: those of small files if there are min_parts of them, and those that a delete may touch."""
    names = [f"_{s.split('(')[0].strip()}_{s.rstrip(' )').split(',')[-1].split('(')[-1].strip()}" for s in table.load()[1].spec if s.strip().startswith("bucket")]
    bucket_of = lambda p: tuple(values_of(p).get(n) for n in names)
    newest: dict[tuple, int] = {}
    for d in table.parts(base, "delete"):
        newest[bucket_of(d)] = max(d["seq"], newest.get(bucket_of(d), 0))
    by_partition: dict[str, list[dict]] = defaultdict(list)
    for p in table.parts(base, where=where):
        by_partition[p["partition"]].append(p)
    found = []
    for parts in by_partition.values():
        dirty = [p for p in parts if p["seq"] < newest.get(bucket_of(p), 0)]
        few = [p for p in parts if p not in dirty and p["bytes"] / max(1, p.get("files", 1)) < small]
        chosen = dirty + few if len(dirty) + len(few) >= min_parts else dirty
        if chosen:
            found.append(chosen)
    return found


def pack_groups(sets: list[list[dict]], limit: int, aim: int) -> list[list[dict]]:
    """The sets put together in groups of about `aim` bytes, small ones first; a set beyond `limit` bytes is cut between its parts."""
    size = lambda parts: sum(p["bytes"] for p in parts)
    pieces: list[list[dict]] = []
    for parts in sets:
        piece: list[dict] = []
        for p in sorted(parts, key=lambda p: p["bytes"]):
            if piece and size(piece) + p["bytes"] > limit:
                pieces.append(piece)
                piece = []
            piece.append(p)
        pieces.append(piece)
    groups: list[list[dict]] = []
    for piece in sorted(pieces, key=size):
        if groups and size(groups[-1]) + size(piece) <= min(aim, limit):
            groups[-1] += piece
        else:
            groups.append(list(piece))
    return groups


def rewrite_data_files(
    table: SnapshotTable,
    sort_by: list[str] | None = None,
    where: Callable[[dict], bool] = lambda values: True,
    max_commits: int = 10,
    min_parts: int = 2,
    target_bytes: int = TARGET_BYTES,
    max_group_bytes: int = GROUP_BYTES,
    workers: int = WORKERS,
    small: float | None = None,
) -> DataFrame:
    """Rewrites the parts of partitions that have several as sorted parts with files of about target_bytes, and parts that deletes touch without the
    deleted rows; the table's rows stay the same. No task sorts more than about SORT_BYTES of rows, so files of rows that compress well, when sorted, stay smaller.

    where: the partitions to look at, by their hidden values. small: only parts count whose files are on average smaller than this share of
    target_bytes. Groups of partitions, about max_commits of them but none beyond max_group_bytes, are
    rewritten by `workers` jobs at once in a scheduler pool of their own, each with its own commit. A group that fails, as another commit has
    changed its parts, is left for the next run; it takes nothing else with it. Deletes that come while a group is rewritten still hold for its rows.
    """
    base, spark = table.current_snapshot_id(), table.spark
    sets = _worth(table, base, where, min_parts, float("inf") if small is None else small * target_bytes)
    total = sum(p["bytes"] for parts in sets for p in parts)
    groups = pack_groups(sets, max_group_bytes, -(-total // max_commits))

    def rewrite(group: list[dict]) -> int:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", POOL)
        size = sum(p["bytes"] for p in group)
        files = max(1, -(-size // target_bytes))
        if sort_by:  # a task holds what it sorts
            files = max(files, sorting_tasks(table.read_parts(group).count(), size, table.schema, table.load()[1].properties))
        return table.added_parts(table.replace(group, table.read_live(group, base), "replace", sort_by, files=files, as_of=base))

    before = after = 0
    errors: list[Exception] = []
    with ThreadPoolExecutor(max(1, workers)) as pool:
        running = [(g, pool.submit(inheritable_thread_target(spark)(rewrite), g)) for g in groups]
        for group, job in running:
            try:
                after += job.result()
                before += len(group)
            except CommitConflict as e:
                errors.append(e)
                log.warning("a group of partitions has changed; left for the next run")
            except Exception as e:
                errors.append(e)
                log.exception("a group of partitions could not be rewritten")
    others = [e for e in errors if not isinstance(e, CommitConflict)]
    if others and len(errors) == len(groups):
        raise others[0]
    before += table.drop_spent_deletes()
    return spark.createDataFrame([(before, after, len(errors))], RESULT)


def closed_hours(column: str, now: datetime, first: int = 2, last: int = 1) -> Callable[[dict], bool]:
    """Partitions of hours(column) that began `first` to `last` hours before the current hour of `now` (UTC): closed ones, which no
    writer on time touches any more, so compaction doesn't race with the hot hour."""
    hour = int(now.replace(tzinfo=now.tzinfo or timezone.utc).timestamp() // 3600)
    return lambda values: values[f"_hours_{column}"].isdigit() and hour - first <= int(values[f"_hours_{column}"]) <= hour - last


def due(batch_id: int, every: int) -> bool:
    """In-line schedule by batch number; batch 0 is due."""
    return batch_id % every == 0


def millis_to_next_run(now: datetime, minute: int = 5) -> int:
    """Milliseconds from now to `minute` minutes past the next full hour."""
    start = now.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1, minutes=minute)
    return int((start - now).total_seconds() * 1000)


class HourlyMaintenance:
    """Runs a task on a thread of the driver, first at five past the next hour, then every period. An exception doesn't end the schedule."""

    def __init__(self, task: Callable[[], object], first_seconds: float | None = None, period_seconds: float = 3600.0):
        self.task, self.period = task, period_seconds
        self.first = millis_to_next_run(datetime.now()) / 1000 if first_seconds is None else first_seconds
        self.stopped = threading.Event()
        self.runs = self.failures = 0
        self.thread = threading.Thread(target=self._loop, daemon=True)

    def start(self) -> HourlyMaintenance:
        self.thread.start()
        return self

    def _loop(self) -> None:
        wait = self.first
        while not self.stopped.wait(wait):
            try:
                self.task()
            except Exception:
                self.failures += 1
                log.exception("maintenance failed; the next run goes on")
            self.runs += 1
            wait = self.period

    def stop(self) -> None:
        self.stopped.set()
        if self.thread.is_alive():
            self.thread.join()


class _Ending(StreamingQueryListener):
    """Calls `stop` when a query ends, however it does."""

    def __init__(self, query_id, stop: Callable[[], object]):
        self.query_id, self.stop = query_id, stop

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == str(self.query_id):
            self.stop()


def beside(query: StreamingQuery, task: Callable[[], object], first_seconds: float | None = None, period_seconds: float = 3600.0) -> HourlyMaintenance:
    """Runs a task again and again while a streaming query runs, in the scheduler pool of maintenance. It ends with the query: a run that has begun
    goes on, no other begins."""
    spark = SparkSession.active()

    def pooled() -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", POOL)
        task()

    schedule = HourlyMaintenance(pooled, first_seconds, period_seconds)
    ending = _Ending(query.id, schedule.stopped.set)
    spark.streams.addListener(ending)
    if query.isActive:
        schedule.start()
    else:
        schedule.stopped.set()
    return schedule
