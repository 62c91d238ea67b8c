"""Change data capture: from a changelog table to a mirror of the latest state, whole or snapshot by snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.merge import latest_change, mirror_merge, ordered_merge
from ..sources.snapshot_table import CommitConflict, SnapshotTable

#: What decides which of two changes of a key is the later one.
ORDER = ["last_updated", "balance", "operation"]


def newest_first(time_column: str = "last_updated", ties: tuple[str, ...] = ("balance", "operation")) -> list[Column]:
    """Newest first; equal times are decided by the other columns, so the pick doesn't depend on the plan."""
    return [F.desc_nulls_last(c) for c in (time_column, *ties)]


def merge_into_mirror(
    mirror: SnapshotTable, latest: DataFrame, key: str = "account_id", mode: str = "copy-on-write", summary: dict[str, str] | None = None, tries: int = 10, ordered: bool = False
) -> int:
    """Applies one change a key to the mirror in one commit, which fails and is computed again if another commit came first.

    copy-on-write rewrites the partitions that hold a changed key. merge-on-read writes the changed keys as a delete part and
    the new rows as a data part; scans put them together.

    ordered: changes may come late. The mirror (schema ORDERED_MIRROR) keeps the whole last change of each key, deletions too, and only a later one
    takes its place; `live` gives its accounts.
    """
    merged = (lambda rows: ordered_merge(rows, latest, key, ORDER)) if ordered else (lambda rows: mirror_merge(rows, latest, key))
    latest = latest.persist()  # read for the keys and for the rows
    try:
        inside = mirror.affected(latest, [key])
        for _ in range(tries):
            base = mirror.current_snapshot_id()
            try:
                if mode == "merge-on-read":
                    keys = latest.select(key)
                    touched = mirror.scan(base, where=inside).join(keys, key, "left_semi")
                    return mirror.delete_and_append(keys, merged(touched), summary, base=base)
                old = mirror.parts(base, where=inside)
                return mirror.replace(old, merged(mirror.read_parts(old)), "merge", summary=summary, base=base, check_base=True)
            except CommitConflict:
                continue
        raise CommitConflict(f"mirror: no commit in {tries} tries")
    finally:
        latest.unpersist()


def mirror_changes(
    changelog: DataFrame,
    mirror: SnapshotTable,
    since: Column | None = None,
    key: str = "account_id",
    mode: str = "copy-on-write",
    ordered: bool = False,
) -> int:
    """Brings the mirror to the latest change of each key among the changelog rows that meet `since`."""
    return merge_into_mirror(mirror, latest_change(changelog, key, newest_first(), since), key, mode, ordered=ordered)


def live(mirror: DataFrame) -> DataFrame:
    """The accounts of an ordered mirror: those whose last change is no deletion. There a change without an operation updates or inserts."""
    return mirror.where(F.coalesce(F.col("operation") != "D", F.lit(True)))


def watermark_of(mirror: SnapshotTable, source: str) -> int | None:
    """The newest snapshot of `source` that the mirror holds."""
    return mirror.progress().get(f"watermark:{source}")


def incremental_mirror(
    changelog: SnapshotTable,
    mirror: SnapshotTable,
    source: str = "accounts_changelog",
    key: str = "account_id",
    mode: str = "copy-on-write",
    ordered: bool = False,
) -> int | None:
    """Merges what the changelog has got since the last run; data and watermark are one commit.

    The first run reads all of it; without new snapshots nothing is committed.
    """
    stop, seen = changelog.current_snapshot_id(), watermark_of(mirror, source)
    if stop is None or stop == seen:
        return None
    latest = latest_change(changelog.incremental(seen, stop), key, newest_first())
    return merge_into_mirror(mirror, latest, key, mode, {f"watermark:{source}": str(stop)}, ordered=ordered)
